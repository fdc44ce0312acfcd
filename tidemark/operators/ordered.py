"""Operators on ordered rows of a key: gaps, samples, last rows, picks by rank, excursions and throttles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import running_totals


def seq_gaps(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Rows whose sequence number isn't the previous one plus one, with the numbers missing before them."""
    prev = F.lag(seq).over(Window.partitionBy(*by).orderBy(seq))
    return df.withColumn("prev_seq", prev).where(F.col(seq) != F.col("prev_seq") + 1).withColumn("missing", F.col(seq) - F.col("prev_seq") - 1)


def keep_last(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def systematic_sample(df: DataFrame, by: list[str], order: list[str], every: int, most: int) -> DataFrame:
    """Every `every`-th row of each file (or other key), at most `most` of them: the same rows each time."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__i", i).where((F.col("__i") % every == 0) & (F.col("__i") <= every * most)).drop("__i")


def nearest_rank(df: DataFrame, by: list[str], value: str, tie: str, q: float, inclusive: bool = False, name: str = "q") -> DataFrame:
    """The value at index floor(q n), or floor(q (n - 1)) if inclusive, of each key's sorted values."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    at = F.floor(F.lit(q) * (n - 1 if inclusive else n))
    x = df.withColumn("__n", n).withColumn("__at", at).withColumn("__i", F.row_number().over(w.orderBy(value, tie)))
    return x.where(F.col("__i") == F.least(F.col("__at") + 1, F.col("__n"))).select(*by, F.col(value).alias(name))


def excursions(path: DataFrame, by: list[str], order: list[str], bid: str, snapshot: list[str]) -> DataFrame:
    """Peak (first maximum, at least 0), trough and lowest bid after the peak of each path, with columns at the peak."""
    whole = Window.partitionBy(*by)
    run = whole.orderBy(*order)
    x = path.withColumn("__i", F.row_number().over(run)).withColumn("__top", F.max(bid).over(whole))
    x = x.withColumn("__at", F.min(F.when((F.col(bid) == F.col("__top")) & (F.col(bid) > 0), F.col("__i"))).over(whole))
    at = F.col("__i") == F.col("__at")
    return x.groupBy(*by).agg(
        F.coalesce(F.max(F.when(at, F.col(bid))), F.lit(0.0)).alias("peak"),
        F.min(bid).alias("trough"),
        F.min(F.when(F.col("__i") >= F.col("__at"), F.col(bid))).alias("post_peak_low"),
        *[F.max(F.when(at, F.col(c))).alias(f"peak_{c}") for c in snapshot],
        F.count("*").alias("n"),
    )


def running_sum(df: DataFrame, order: list[str], value: str, bucket: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with the running sum of `value` in `order`, over the whole table or each key, without one task that reads it all.

    `bucket` is an SQL expression of the first column of `order` that never falls (the day of a time, say). Sums of buckets are
    summed up first, one row a bucket; each bucket then runs on its own from the sum before it. Rows without a bucket, as
    their first order column is null, come first; every row stays.
    """
    return running_totals(df, by or [], order, {name: F.col(value)}, bucket)


def throttle(df: DataFrame, by: list[str], time: str, seq: str, least_gap: float) -> DataFrame:
    """(by, seq) of the rows that a greedy throttle lets pass: at least `least_gap` after the last one that passed, per key.

    Sequential by nature: each key's rows stream in time order through Arrow batches; only the time of the last row
    that passed is held, and a batch is left from row to row that passes, not row by row. Rows without a time don't pass.
    """
    shape = df.select(*by, seq).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, -np.inf
        for pdf in batches:
            t = pdf["__t"].to_numpy()
            kept = []
            changed = (pdf[by] != pdf[by].shift()).any(axis=1).to_numpy()
            cuts = np.unique([0, *np.flatnonzero(changed), len(t)])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                k = tuple(pdf[by].iloc[lo])
                if k != key:
                    key, last = k, -np.inf
                i = lo
                while i < hi:
                    i = lo + int(np.searchsorted(t[lo:hi], last + least_gap))
                    if i < hi:
                        kept.append(i)
                        last = t[i]
            yield pdf.iloc[kept][[*by, seq]]

    return df.select(*by, seq, F.col(time).cast("double").alias("__t")).where("__t is not null").repartition(*by).sortWithinPartitions(*by, "__t", seq).mapInPandas(run, shape)
