"""Exact ranks within keys without sorting them: counts in ranges of values, refined around the ranks that are wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import same

#: Ranges that one pass cuts a key's values into.
RANGES = 1024


def _range(value: Column, low: Column, high: Column, n: int) -> Column:
    """Number of the range of [low, high] that a value is in; it never falls as values rise."""
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high > low, F.least(F.floor(share * n), F.lit(n - 1))).otherwise(0)


def ranks(df: DataFrame, by: list[str], value: str, wanted: dict[str, Column], passes: int = 2, n: int = RANGES, few: bool = False) -> DataFrame:
    """(by, n, one column per wanted rank) of each key: the value at an index, from 0, of its sorted values.

    `wanted` maps names to expressions of `n`, the number of values of the key (floor(0.95 * (n - 1)), say); an index
    outside of the values gives null. Each pass counts all keys' values within ranges, map-side, finds the range that an
    index falls in, and takes its smallest and largest value as the next range; equal values need no order. What is left
    after `passes`, about one of n ** passes values, is ranked. Null values and NaN don't count; a key without values
    has no row. Infinite values are an error, as ranges of them have no width. If keys are `few`, the ranges go to all
    tasks, and rows aren't dealt by key, which would leave most tasks without any.
    """
    x = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    x = x.withColumn("__v", F.when(F.abs("__v") == float("inf"), F.raise_error(F.lit("ranks of infinite values"))).otherwise(F.col("__v")))
    whole = x.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), index.cast("long").alias("index")) for name, index in wanted.items()])).alias("__q")
    at = whole.select(*by, "n", "__low", "__high", each).select(*by, "n", "__low", "__high", F.col("__q.name").alias("__name"), F.col("__q.index").alias("__index"))
    left, mine = [f"__k_{k}" for k in by], [*by, "__name"]

    def inside(at: DataFrame) -> DataFrame:
        """Values within the ranges that are still wanted."""
        q = at.select(*[F.col(k).alias(f"__k_{k}") for k in by], "__name", "__index", "__low", "__high")
        return x.join(F.broadcast(q) if few else q, same(by, left)).where((F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high"))).drop(*left)

    for _ in range(passes):
        cut = inside(at).withColumn("__r", _range(F.col("__v"), F.col("__low"), F.col("__high"), n))
        counts = cut.groupBy(*mine, "__index", "__r").agg(F.count("*").alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        # at most n rows a key and rank
        upto = F.sum("__c").over(Window.partitionBy(*mine).orderBy("__r"))
        hit = counts.withColumn("__before", upto - F.col("__c")).where((F.col("__index") >= F.col("__before")) & (F.col("__index") < F.col("__before") + F.col("__c")))
        at = hit.select(*mine, (F.col("__index") - F.col("__before")).alias("__index"), "__low", "__high")
    done = at.where(F.col("__low") == F.col("__high")).select(*mine, F.col("__low").alias("__v"))
    order = F.row_number().over(Window.partitionBy(*mine).orderBy("__v")) - 1
    last = inside(at.where(F.col("__low") < F.col("__high"))).withColumn("__i", order).where(F.col("__i") == F.col("__index")).select(*mine, "__v")
    found = done.unionByName(last).groupBy(*by).agg(*[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in wanted])
    found = found.select(*[F.col(k).alias(f"__k_{k}") for k in by], *wanted)
    return whole.select(*by, "n").join(found, same(by, left), "left").drop(*left)
