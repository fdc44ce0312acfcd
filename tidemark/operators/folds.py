"""Ordered folds: one step function, run per key in arrival order, by rows or by blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block that a fold takes at once.
BLOCK = 20_000


def fold_per_key(df: DataFrame, by: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], dict | None], schema: str) -> DataFrame:
    """Run step(state, row) over each key's rows in order; the rows it returns are the result.

    Keys run in parallel. Within a key, rows are streamed from sorted partitions in Arrow batches, so a key may be
    larger than memory; only its state is held.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            keys = list(zip(*(pdf[b] for b in by), strict=True))
            for k, row in zip(keys, pdf.itertuples(index=False), strict=True):
                if key != k:
                    key, state = k, start()
                got = step(state, row)
                if got is not None:
                    out.append(got)
            names = [f.split()[0] for f in schema.split(",")]
            yield pd.DataFrame(out, columns=names)

    return df.select(*columns).repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def fold_blocks(df: DataFrame, by: str, keys: list, order: list[str], start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run step(state, block) over blocks of each key's rows in order; what it returns is the result, with the key put before it.

    keys: all that `by` holds, but null, which is a key as well; another is an error. Each gets a partition of its own, so
    that none waits for another. As in `fold_per_key`, rows are streamed, and only a block and a key's state are held.
    """
    names, place = [f.split()[0] for f in schema.split(",")], "_place"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, held, n = None, None, [], 0

        def block() -> pd.DataFrame:
            out = step(state, pd.concat(held, ignore_index=True))
            out.insert(0, by, key)
            return out[names]

        for pdf in batches:
            if not len(pdf):
                continue
            if state is None:
                key, state = [None, *keys][pdf[place].iloc[0]], start()
            held.append(pdf.drop(columns=place))
            n += len(pdf)
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if held:
            yield block()

    at = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col(by)).cast("int") if keys else F.lit(0)
    at = F.when(F.col(by).isNull(), 0).when(at > 0, at).otherwise(F.raise_error(F.lit(f"a key of {by} that wasn't named")).cast("int"))
    placed = df.withColumn(place, at).drop(by)
    return placed.repartitionById(len(keys) + 1, place).sortWithinPartitions(*order).mapInPandas(run, schema)
