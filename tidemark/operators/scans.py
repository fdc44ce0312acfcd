"""Ordered work within a key on many tasks: positions, windows over stretches with a halo, scans of associative steps.

A key's rows are numbered without one task that reads them all: counts of buckets of time are summed up first, one row a
bucket. Positions then cut the key into parts of equal size. A window that reaches back a bounded number of rows runs over
each part together with so many rows before it (its halo); a step that depends on everything before is an element of a
monoid: each part is reduced to one, the parts' elements are combined in order, and each part is run again from what came
before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of a key in one part.
SIZE = 100_000


def same(left: list[str], right: list[str]) -> Column:
    """Equality of columns, nulls included."""
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)], F.lit(True))


def with_before(df: DataFrame, by: list[str], bucket: str, totals: dict[str, Column], whole: dict[str, Column] | None = None) -> DataFrame:
    """df with its bucket as `__key` (the key's columns and the bucket in one struct, so that nulls meet nulls) and, for each
    of `totals` (aggregates over rows), what all earlier buckets of the key sum up to, null buckets first; for each of
    `whole`, what all buckets sum up to. Rows are dealt by `__key` once, for the join and for windows over buckets."""
    whole = whole or {}
    x = df.withColumn("__key", F.struct(*by, F.expr(bucket).alias("__b")))
    sums = x.groupBy("__key").agg(*[c.alias(n) for n, c in {**totals, **whole}.items()])
    key = Window.partitionBy(*[f"__key.{k}" for k in by])
    earlier = key.orderBy("__key.__b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__key", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals], *[F.sum(n).over(key).alias(n) for n in whole])
    return x.join(before, "__key")


def positions(df: DataFrame, by: list[str], order: list[str], bucket: str, name: str = "i", whole: dict[str, Column] | None = None) -> DataFrame:
    """df with each row's place within its key, from 1, in `order`; and `whole`, sums or counts over all of its key.

    `bucket` is an SQL expression of the first column of `order` that never falls (the day of a time, say); each bucket is
    numbered on its own. Rows that are alike in `order` are numbered in any order.
    """
    inside = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return with_before(df, by, bucket, {"__before": F.count("*")}, whole).withColumn(name, F.col("__before") + inside).drop("__key", "__before")


def halo(df: DataFrame, by: list[str], order: list[str], bucket: str | None, before: int, after: int = 0, size: int = SIZE, at: str | None = None) -> DataFrame:
    """df in parts of `size` rows a key: `__i` is a row's place, `__part` its part, and `__own` whether it belongs there or
    is one of the `before` rows ahead of the part or of the `after` rows behind it. Rows that `positions` has
    numbered need no bucket: `at` names the column of their places."""
    if before > size or after > size:
        raise ValueError("a halo reaches into one neighbouring part at most: take larger parts")
    x = df.withColumn("__i", F.col(at)) if at else positions(df, by, order, bucket, "__i")
    home, place = F.floor((F.col("__i") - 1) / size), F.pmod(F.col("__i") - 1, F.lit(size))
    parts = F.filter(F.array(home, F.when(place >= size - before, home + 1), F.when(place < after, home - 1)), lambda p: p.isNotNull() & (p >= 0))
    return x.withColumn("__home", home).withColumn("__part", F.explode(parts)).withColumn("__own", F.col("__part") == F.col("__home")).drop("__home")


def windowed(df: DataFrame, by: list[str], order: list[str], columns: Callable[[WindowSpec], dict[str, Column]] | list, before: int, after: int = 0, bucket: str | None = None, size: int = SIZE, at: str | None = None) -> DataFrame:
    """df with columns made of a key's ordered window, which may use `before` rows ahead of a row and `after` behind it. Of
    several functions, later ones may use what earlier ones made; `before` and `after` are then what they reach together.

    Without `bucket` or `at` the window is the whole key, one task; with one of them (see `halo`) the key is cut into parts.
    """
    steps = columns if isinstance(columns, list) else [columns]
    if bucket is None and at is None:
        w = Window.partitionBy(*by).orderBy(*order)
        return reduce(lambda x, f: x.withColumns(f(w)), steps, df)
    w = Window.partitionBy(*by, "__part").orderBy("__i")
    x = reduce(lambda x, f: x.withColumns(f(w)), steps, halo(df, by, order, bucket, before, after, size, at))
    return x.where("__own").drop("__i", "__part", "__own")


def running_totals(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], bucket: str) -> DataFrame:
    """df with running sums over each key, this row's value included: `values` maps new columns to what is summed; a null
    adds nothing. Sums of earlier buckets are added to those within a row's own."""
    x = df.withColumns({f"__v_{n}": c for n, c in values.items()})
    x = with_before(x, by, bucket, {f"__before_{n}": F.sum(f"__v_{n}") for n in values})
    inside = Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({n: F.col(f"__before_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in values})
    return x.drop("__key", *[f"__{k}_{n}" for n in values for k in ("v", "before")])


@dataclass(frozen=True)
class Monoid:
    """Steps that can be combined in any grouping: `lift` makes one of each row (a row of the result), `combine` merges
    steps with those that follow them, `finish` makes columns from what holds before and after each row."""

    unit: tuple[float, ...]
    lift: Callable[[pd.DataFrame], np.ndarray]
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[pd.DataFrame, np.ndarray, np.ndarray], dict[str, np.ndarray]]
    schema: str

    def prefixes(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each step combined with all before it from the last start on, in as many passes as the longest run has bits."""
        x = x.copy()
        run = np.arange(len(x)) - np.maximum.accumulate(np.where(starts, np.arange(len(x)), 0))
        shift = 1
        while (which := np.flatnonzero(run >= shift)).size:
            x[which] = self.combine(x[which - shift], x[which])
            shift *= 2
        return x


def _runs(batches: Iterator[pd.DataFrame], keys: list[str], monoid: Monoid, lift: Callable[[pd.DataFrame], np.ndarray], first: list[str] | None = None) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, where a key starts, elements before, elements after each row) of batches sorted by keys; each key starts from the
    unit, or from the elements that its first row has in the columns `first`. Only one row is held from batch to batch."""
    last, held = None, None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys]
        was = k.shift()
        starts = ~((k == was) | (k.isna() & was.isna())).all(axis=1).to_numpy(bool)
        row = k.iloc[0]
        starts[0] = last is None or not all(a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip(row, last, strict=True))
        begin = pdf[first].to_numpy(float)[starts] if first else np.repeat([monoid.unit], int(starts.sum()), axis=0)
        steps = lift(pdf)
        steps[starts] = monoid.combine(begin, steps[starts])
        if not starts[0]:
            steps[:1] = monoid.combine(held, steps[:1])
        after = monoid.prefixes(steps, starts)
        before = np.concatenate([held if held is not None else np.array([monoid.unit]), after[:-1]])
        before[starts] = begin
        last, held = tuple(k.iloc[-1]), after[-1:]
        yield pdf, starts, before, after


def scan(df: DataFrame, by: list[str], order: list[str], monoid: Monoid, bucket: str | None, size: int = SIZE, at: str | None = None) -> DataFrame:
    """df with the monoid's columns, run over each key in `order` on as many tasks as the key has parts of `size` rows.

    Between parts go one row a part with the monoid's element. Rows are streamed through sorted partitions, so neither a
    part nor many small keys cost memory. `bucket` is that of `positions`, `at` that of `halo`; an empty table gives none.
    """
    x = (df.withColumn("__i", F.col(at)) if at else positions(df, by, order, bucket, "__i")).withColumn("__part", F.floor((F.col("__i") - 1) / size))
    names = [f"__m{k}" for k in range(len(monoid.unit))]
    keys = [*by, "__part"]

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_row = None
        for pdf, starts, _, after in _runs(batches, keys, monoid, monoid.lift):
            rows = pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(after, columns=names)], axis=1)
            ends = np.append(starts[1:], False)
            done = rows[ends]
            if open_row is not None and starts[0]:
                done = pd.concat([open_row, done])
            open_row = rows.iloc[-1:]
            yield done
        if open_row is not None:
            yield open_row

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, _, before, _ in _runs(batches, by or ["__one"], monoid, lambda rows: rows[names].to_numpy(float)):
            pdf[names] = before
            yield pdf

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, _, before, after in _runs(batches, keys, monoid, monoid.lift, names):
            yield pdf.assign(**monoid.finish(pdf, before, after))[out.names]

    elements = StructType.fromDDL(", ".join(f"{n} double" for n in names)).fields
    parts = StructType([*[x.schema[k] for k in keys], *elements])
    out = StructType([*df.schema.fields, *StructType.fromDDL(monoid.schema).fields])
    sums = x.repartition(*keys).sortWithinPartitions(*keys, "__i").mapInPandas(summaries, parts)
    if by:
        carried = sums.repartition(*by).sortWithinPartitions(*keys).mapInPandas(carry, parts)
    else:
        one = sums.withColumn("__one", F.lit(1))
        carried = one.repartition("__one").sortWithinPartitions("__part").mapInPandas(carry, one.schema)
    carried = carried.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *names)
    both = x.join(carried, same(keys, [f"__k_{k}" for k in keys]))
    return both.repartition(*keys).sortWithinPartitions(*keys, "__i").mapInPandas(replay, out)


def decayed(value: list[str], decay: Callable[[pd.DataFrame], np.ndarray], names: list[str]) -> Monoid:
    """Running sums that decay: y = a y + v, where a comes from `decay(rows)`. As maps y -> a y + b they combine."""
    k = len(value)

    def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.column_stack([x[:, 0] * y[:, 0], *(y[:, 0] * x[:, j] + y[:, j] for j in range(1, k + 1))])

    return Monoid((1.0, *[0.0] * k), lambda pdf: np.column_stack([decay(pdf), *(pdf[c].to_numpy(float, na_value=0.0) for c in value)]), combine, lambda pdf, before, after: {n: after[:, j + 1] for j, n in enumerate(names)}, ", ".join(f"{n} double" for n in names))


def drawdown(value: str) -> Monoid:
    """Running sum, its highest value so far (0 before the first row), how far below that it is, and the deepest such fall.

    An element is (sum, highest, lowest, deepest fall) of the prefixes of some rows, the empty one included.
    """

    def lift(pdf: pd.DataFrame) -> np.ndarray:
        v = pdf[value].to_numpy(float, na_value=0.0)
        return np.column_stack([v, np.maximum(v, 0), np.minimum(v, 0), np.maximum(-v, 0)])

    def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s, high, low, deep = x.T
        return np.column_stack([s + y[:, 0], np.maximum(high, s + y[:, 1]), np.minimum(low, s + y[:, 2]), np.maximum(np.maximum(deep, y[:, 3]), high - (s + y[:, 2]))])

    return Monoid((0.0, 0.0, 0.0, 0.0), lift, combine, lambda pdf, before, after: {"cum": after[:, 0], "peak": after[:, 1], "drawdown": after[:, 1] - after[:, 0], "worst": after[:, 3]}, "cum double, peak double, drawdown double, worst double")


def breach(value: str, limit: float) -> Monoid:
    """Running sum, whether it has been at or below -limit (a latch), and whether this row is the first where it is."""

    def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.column_stack([x[:, 0] + y[:, 0], np.minimum(x[:, 1], x[:, 0] + y[:, 1])])

    def lift(pdf: pd.DataFrame) -> np.ndarray:
        v = pdf[value].to_numpy(float, na_value=0.0)
        return np.column_stack([v, v])

    return Monoid((0.0, np.inf), lift, combine, lambda pdf, before, after: {"run": after[:, 0], "tripped": after[:, 1] <= -limit, "first": (after[:, 1] <= -limit) & (before[:, 1] > -limit)}, "run double, tripped boolean, first boolean")
