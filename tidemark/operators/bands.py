"""Pairs of two tables within a band of an ordered column, counted by how far their values lie apart; no row per pair."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distances that a task gathers before it sums up those that are alike.
GATHERED = 2_000_000
#: Bands in one stretch of time, the work of one group.
STRETCH = 6


def _merged(distance: list[np.ndarray], count: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not distance:
        return np.zeros(0), np.zeros(0, np.int64)
    d, at = np.unique(np.concatenate(distance), return_inverse=True)
    n = np.zeros(len(d), np.int64)
    np.add.at(n, at, np.concatenate(count))
    return d, n


def count_distances(t: np.ndarray, v: np.ndarray, s: np.ndarray, w: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, how often each occurs) of values v at times t and w at times s, over pairs at most `band` apart in time.

    Of each distinct v, either its pairs are counted, or, if they are more than the rows of s, how many of its intervals cover
    each row of s.
    """
    by_time = np.argsort(s, kind="stable")
    s = s[by_time]
    values, code = np.unique(w[by_time], return_inverse=True)
    by_value = np.argsort(v, kind="stable")
    t, v = t[by_value], v[by_value]
    low, high = np.searchsorted(s, t - band, "left"), np.searchsorted(s, t + band, "right")
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
    distance, count, gathered = [], [], 0
    for i, j in zip(starts, [*starts[1:], len(v)], strict=False):
        lo, hi = low[i:j], high[i:j]
        lens = hi - lo
        if (size := int(lens.sum())) <= len(s):
            at, n = np.unique(code[np.repeat(lo - (np.cumsum(lens) - lens), lens) + np.arange(size)], return_counts=True)
        else:
            cover = np.cumsum(np.bincount(lo, minlength=len(s) + 1) - np.bincount(hi, minlength=len(s) + 1))[:-1]
            n = np.bincount(code, cover, len(values)).astype(np.int64)  # exact below 2 ** 53
            at = np.flatnonzero(n)
            n = n[at]
        distance.append(np.abs(v[i] - values[at]))
        count.append(n)
        gathered += len(at)
        if gathered > GATHERED:
            d, n = _merged(distance, count)
            distance, count, gathered = [d], [n], 0
    return _merged(distance, count)


def band_distances(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, band: int) -> DataFrame:
    """(by, distance, pairs): how many pairs of a left and a right row of a key, at most `band` apart in `on` (integers), have
    values so far apart. Both sides are dealt by key and stretches of `STRETCH` bands, right rows within a band of an end twice.

    A stretch's work is its rows times the distinct values of the left side there, and never more than its pairs; it
    doesn't grow with pairs where values lie on a grid of prices. Values must not be null.
    """
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*by, on)])
    stretch = lambda t: t - F.pmod(t, F.lit(STRETCH * band))
    keys = [*by, "__b"]
    lt = left.where(known).select(*by, stretch(F.col(on)).alias("__b"), F.col(on).alias("t"), F.col(value).alias("v"))
    rt = right.where(known).select(*by, F.explode(F.array_distinct(F.array(*[stretch(F.col(on) + d) for d in (-band, 0, band)]))).alias("__b"), F.col(on).alias("t"), F.col(value).alias("v"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lt.schema.fields[: len(by)]) + ", distance double, pairs long"

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d, n = count_distances(*(x[c].to_numpy() for x in (a, b) for c in ("t", "v")), band) if len(a) and len(b) else _merged([], [])
        return pd.DataFrame({**{c: pd.Series([k] * len(d), dtype=object) for c, k in zip(by, key, strict=False)}, "distance": d, "pairs": n})

    return lt.groupBy(*keys).cogroup(rt.groupBy(*keys)).applyInPandas(run, shape).groupBy(*by, "distance").agg(F.sum("pairs").alias("pairs"))
