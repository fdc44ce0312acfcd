"""As-of, nearest and range joins on an ordered column, without pairing rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], tolerance: int | None = None, direction: str = "backward", strict: bool = False, prefix: str = "r_", tie: str | None = None, bucket: int | None = None) -> DataFrame:
    """Each left row with the last right row at or before it (forward: first at or after), per key.

    Union of both sides and one window over (by, on): one shuffle, one sort, no row pairs. `strict` leaves out equal
    times. Left rows without a match within `tolerance` keep nulls. `tie` orders right rows of one time (the last wins
    backward, the first forward). Result: left columns, prefix + on and prefix + each of values.

    With `bucket`, a key's rows are cut into stretches of so many units of `on`, each a window of its own, so a few keys
    with very many rows spread over the cluster. Each stretch's last right row is carried to the later ones by a window
    over one row a stretch.
    """
    forward = direction == "forward"
    r = right.select(*by, F.col(on).alias("__on"), F.lit(0 if not strict else 2).alias("__side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("__tie"), F.struct(F.col(on), *values).alias("__r"), F.lit(None).cast(left_struct(left)).alias("__l"))
    lt = left.select(*by, F.col(on).alias("__on"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    both = r.unionByName(lt)
    order = [F.col("__on"), F.col("__side"), F.col("__tie")]
    if forward:
        order = [F.col("__on").desc(), F.col("__side"), F.col("__tie").desc()]
    keys = list(by)
    if bucket:
        both = both.withColumn("__b", F.floor(F.col("__on") / F.lit(bucket)))
        keys.append("__b")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last("__r", ignorenulls=True).over(w)
    out = both.withColumn("__m", seen).where(F.col("__l").isNotNull())
    if bucket:
        at = F.when(F.col("__r").isNotNull(), F.struct("__on", "__tie"))
        ends = both.groupBy(*keys).agg((F.min_by if forward else F.max_by)("__r", at).alias("__end"))
        earlier = Window.partitionBy(*by).orderBy(F.col("__b").desc() if forward else F.col("__b")).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.last("__end", ignorenulls=True).over(earlier).alias("__c"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
        out = out.join(carried, same, "left").withColumn("__m", F.coalesce("__m", "__c"))
    gap = F.abs(F.col("__on") - F.col(f"__m.{on}"))
    ok = F.col("__m").isNotNull() if tolerance is None else gap <= tolerance
    return out.select("__l.*", *[F.when(ok, F.col(f"__m.{c}")).alias(prefix + c) for c in (on, *values)])


def left_struct(df: DataFrame):
    """Type of a row of df as one struct."""
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], tolerance: int, tie: str | None = None, bucket: int | None = None) -> DataFrame:
    """Each left row with the nearest right row in either direction within `tolerance`; of equal distances the earlier."""
    back = asof_join(left, right, by, on, values, tolerance, "backward", prefix="b_", tie=tie, bucket=bucket)
    both = asof_join(back, right, by, on, values, tolerance, "forward", prefix="f_", tie=tie, bucket=bucket)
    before, after = F.col(on) - F.col(f"b_{on}"), F.col(f"f_{on}") - F.col(on)
    take = before.isNotNull() & (after.isNull() | (before <= after))
    pick = lambda c: F.when(take, F.col(f"b_{c}")).otherwise(F.col(f"f_{c}")).alias(f"r_{c}")
    return both.select(*left.columns, *[pick(c) for c in (on, *values)])


def range_join(left: DataFrame, right: DataFrame, by: list[str], on: str, lookback: int, right_on: str | None = None, extra: Column | None = None) -> DataFrame:
    """Pairs of a left row and the right rows with 0 < left.on - right.on <= lookback, per key.

    Times are cut to buckets of the lookback's length; a left row meets two buckets by equi-join, then the residual.
    """
    right_on = right_on or on
    bucket = lambda c: F.floor(F.col(c) / F.lit(lookback)).cast("long")
    lt = left.withColumn("__b", F.explode(F.array(bucket(on), bucket(on) - 1)))
    r = right.select(*by, bucket(right_on).alias("__b"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    gap = F.col(on) - F.col(f"r_{right_on}")
    out = lt.join(r, [*by, "__b"]).where((gap > 0) & (gap <= lookback)).drop("__b")
    return out if extra is None else out.where(extra)


def interval_parts(left: DataFrame, right: DataFrame, by: list[str], on: str, before: int, after: int, make: list[Callable[[WindowSpec], dict[str, Column]]], tie: str | None = None) -> DataFrame:
    """What the right rows within [left.on - before, left.on + after] amount to, per key, without pairing rows.

    Times are integers, cut to stretches as long as the interval, so an interval is the end of one stretch and the start of
    the next. Each is a running window over its stretch's right rows, the end read backwards, with a left row placed where its
    share is complete. Result: one row for each left row and share of its interval that isn't empty, with the left columns,
    `head` (whether it is the earlier share) and the columns of `make`: functions of the window up to a row, of which later ones
    may use what earlier ones made. In them `r` is the right row, a struct that is null on left rows; aggregates should skip
    nulls. Right rows of one time are in the order of `tie`. Shares of one left row are merged by the caller's grouping.
    """
    width = before + after + 1
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*by, on)])
    first = lambda t: t - F.pmod(t, F.lit(width))
    low, high = F.col(on) - before, F.col(on) + after
    share = lambda head, t: F.struct(F.lit(head).alias("head"), t.alias("t"))
    # an interval that is a whole stretch has one share
    shares = F.array(share(True, low), F.when(first(low) != first(high), share(False, high)))
    lt = left.where(known).select(*by, F.explode(F.filter(shares, lambda s: s.isNotNull())).alias("__s"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(left_struct(right)).alias("r"))
    r = right.where(known).select(*by, F.explode(F.array(share(True, F.col(on)), share(False, F.col(on)))).alias("__s"), F.lit(0).alias("__side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("__tie"), F.lit(None).cast(left_struct(left)).alias("__l"), F.struct(*right.columns).alias("r"))
    turned = lambda c: F.when(F.col("head"), -F.col(c)).otherwise(F.col(c))
    both = r.unionByName(lt).select(*by, "__s.head", F.col("__s.t").alias("__t"), "__side", "__tie", "__l", "r").withColumn("__b", first(F.col("__t")))
    both = both.withColumns({"__at": turned("__t"), "__tie": turned("__tie")})
    w = Window.partitionBy(*by, "head", "__b").orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = reduce(lambda x, f: x.withColumns(f(w)), [lambda w: {"__n": F.count("r").over(w)}, *make], both).where("__side = 1 and __n > 0")
    return out.select("__l.*", "head", *out.columns[len(both.columns) + 1 :])


def interval_totals(left: DataFrame, right: DataFrame, by: list[str], on: str, before: int, after: int, keys: list[str], sums: dict[str, Column] | None = None, highest: dict[str, Column] | None = None) -> DataFrame:
    """(keys, n, sums, highest) over the right rows within [left.on - before, left.on + after] of all left rows with those keys:
    how many, sums and largest values of columns of the right row `r`. Keys without such rows are left out."""
    sums, highest = sums or {}, highest or {}
    run = lambda w: {"n": F.count("r").over(w), **{n: F.sum(c).over(w) for n, c in sums.items()}, **{n: F.max(c).over(w) for n, c in highest.items()}}
    parts = interval_parts(left, right, by, on, before, after, [run])
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in highest])
