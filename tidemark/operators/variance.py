"""Returns, realised variance and jumps of ordered prices as functions of a DataFrame, per key.

Functions that take `bucket` (an SQL expression of the first order column that never falls) cut a key into parts with halos,
so that one key runs on many tasks; without it a key is one window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import SIZE, positions, same, windowed


def _of_two(price: str, value, w) -> Column:
    """A function of a price and the one before it; null where either is no positive number."""
    now, before = F.col(price), F.lag(price).over(w)
    return F.when((now > 0) & (before > 0), value(now / before))


def log_return(price: str, by: list[str], order: list[str]) -> Column:
    """Log return on the row before, over a key's whole window."""
    return _of_two(price, F.log, Window.partitionBy(*by).orderBy(*order))


def log_returns(df: DataFrame, by: list[str], order: list[str], price: str, name: str = "r", bucket: str | None = None, size: int = SIZE) -> DataFrame:
    """df with the log return on the row before."""
    return windowed(df, by, order, lambda w: {name: _of_two(price, F.log, w)}, 1, bucket=bucket, size=size)


def simple_returns(df: DataFrame, by: list[str], order: list[str], price: str, name: str = "r", bucket: str | None = None, size: int = SIZE) -> DataFrame:
    """df with the simple return on the row before."""
    return windowed(df, by, order, lambda w: {name: _of_two(price, lambda x: x - 1, w)}, 1, bucket=bucket, size=size)


def changed(df: DataFrame, by: list[str], order: list[str], value: str, bucket: str | None = None, size: int = SIZE) -> DataFrame:
    """Rows whose value is not that of the row before; a key's first row and rows after a null stay."""
    x = windowed(df, by, order, lambda w: {"__was": F.lag(value).over(w)}, 1, bucket=bucket, size=size)
    return x.where(F.col("__was").isNull() | (F.col(value) != F.col("__was"))).drop("__was")


def rolling_moments(df: DataFrame, by: list[str], order: list[str], r: str, rows: int, bucket: str | None = None, size: int = SIZE) -> DataFrame:
    """df with n, rv (sum of squares) and mean of the last `rows` values of r, this row's included."""

    def columns(w):
        w = w.rowsBetween(1 - rows, 0)
        return {"n": F.count(r).over(w), "rv": F.sum(F.col(r) * F.col(r)).over(w), "mean": F.avg(r).over(w)}

    return windowed(df, by, order, columns, rows - 1, bucket=bucket, size=size)


def fixed_bars(df: DataFrame, by: list[str], order: list[str], r: str, size: int, bucket: str | None = None) -> DataFrame:
    """(by, bar, rv, ret) of stretches of `size` rows after each key's first; those with a missing value are left out."""
    x = positions(df, by, order, bucket, "__i") if bucket else df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    x = x.withColumn("bar", F.floor((F.col("__i") - 2) / size).cast("long")).where(F.col(r).isNotNull())
    g = x.groupBy(*by, "bar").agg(F.sum(F.col(r) * F.col(r)).alias("rv"), F.sum(r).alias("ret"), F.count("*").alias("__n"))
    return g.where(F.col("__n") == size).drop("__n")


def har_features(bars: DataFrame, by: list[str], bar: str = "bar", rv: str = "rv", ret: str = "ret", week: int = 5, month: int = 22) -> DataFrame:
    """bars with rv5, rv22 (trailing means), lev (squared fall) and target (next bar's variance), from the bar after the
    first month on; the last bar has no target and is left out."""
    w = Window.partitionBy(*by).orderBy(bar)
    x = bars.withColumns({
        "rv5": F.avg(rv).over(w.rowsBetween(1 - week, 0)), "rv22": F.avg(rv).over(w.rowsBetween(1 - month, 0)),
        "lev": F.when(F.col(ret) < 0, F.col(ret) * F.col(ret)).otherwise(0.0), "target": F.lead(rv).over(w), "__t": F.row_number().over(w),
    })
    return x.where((F.col("__t") > month) & F.col("target").isNotNull()).drop("__t")


def _numbered(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], bucket: str | None) -> tuple[DataFrame, dict]:
    """df with sums or counts over each key, and what `windowed` needs to cut it: places that come from the same pass."""
    if bucket:
        return positions(df, by, order, bucket, "__at", sums), {"at": "__at"}
    g = df.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()]).select(*[F.col(k).alias(f"__k_{k}") for k in by], *sums)
    return df.join(g, same(by, [f"__k_{k}" for k in by])).drop(*[f"__k_{k}" for k in by]), {}


def realized_variance(df: DataFrame, by: list[str], order: list[str], r: str, bucket: str | None = None, size: int = SIZE) -> DataFrame:
    """(by, n, naive, ac1, kernel): sum of squares, with the first autocovariance, and with three Bartlett-weighted ones of
    centred returns; both corrected ones stay above a quarter of the first."""
    x, cut = _numbered(df.where(F.col(r).isNotNull()), by, order, {"__sum": F.sum(r), "__n": F.count("*")}, bucket)
    x = x.withColumn("__e", F.col(r) - F.col("__sum") / F.col("__n"))
    x = windowed(x, by, order, lambda w: {f"__e{k}": F.lag("__e", k).over(w) for k in (1, 2, 3)}, 3, size=size, **cut)
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(r) * F.col(r)).alias("naive"), *[F.sum(F.col("__e") * F.col(f"__e{k}" if k else "__e")).alias(f"__g{k}") for k in range(4)])
    kernel = F.col("__g0") + 2 * (0.75 * F.col("__g1") + 0.5 * F.col("__g2") + 0.25 * F.col("__g3"))
    floor = 0.25 * F.col("naive")
    return g.select(*by, "n", "naive", F.greatest(F.col("naive") + 2 * F.col("__g1"), floor, F.lit(1e-18)).alias("ac1"), F.greatest(kernel, floor, F.lit(1e-18)).alias("kernel"))


def _products(df: DataFrame, by: list[str], order: list[str], r: str, bucket: str | None, size: int) -> DataFrame:
    """Rows with a return, and `__b`, the product of its size and that of the one before."""
    return windowed(df.where(F.col(r).isNotNull()), by, order, lambda w: {"__b": F.abs(r) * F.abs(F.lag(r).over(w))}, 1, bucket=bucket, size=size)


def bipower(df: DataFrame, by: list[str], order: list[str], r: str, bucket: str | None = None, size: int = SIZE) -> DataFrame:
    """(by, n, bipower, rv): variance from products of neighbouring absolute returns, which jumps hardly move."""
    x = _products(df, by, order, r, bucket, size)
    return x.groupBy(*by).agg(F.count("*").alias("n"), (math.pi / 2 * F.sum("__b")).alias("bipower"), F.sum(F.col(r) * F.col(r)).alias("rv"))


def _tested(df: DataFrame, by: list[str], order: list[str], r: str, window: int, level: float, bucket: str | None, size: int) -> DataFrame:
    """Rows with a return, `__b`, and `stat` and `jump`, both null where the local window isn't full."""
    x, cut = _numbered(df.where(F.col(r).isNotNull()), by, order, {"__n": F.count("*")}, bucket)

    def products(w):
        return {"__b": F.abs(r) * F.abs(F.lag(r).over(w))}

    def local(w):
        w = w.rowsBetween(1 - window, -1)
        return {"__s": F.sum("__b").over(w), "__c": F.count("__b").over(w)}

    # products reach back one row, their sums `window` - 1 more
    x = windowed(x, by, order, [products, local], window, size=size, **cut)
    full = (F.col("__c") == window - 1) & (F.col("__s") > 0)
    ll, q = F.log(F.greatest(F.col("__n") - window, F.lit(2))), math.sqrt(2 / math.pi)
    stat = F.abs(r) / F.sqrt(F.col("__s") / (window - 2))
    centre = F.sqrt(2 * ll) / q - (math.log(math.pi) + F.log(ll)) / (2 * q * F.sqrt(2 * ll))
    jump = F.when((stat - centre) * (q * F.sqrt(2 * ll)) > -math.log(-math.log(1 - level)), 1).otherwise(0)
    return x.withColumns({"stat": F.when(full, stat), "jump": F.when(full, jump)}).drop("__n", "__s", "__c", "__at")


def jumps(df: DataFrame, by: list[str], order: list[str], r: str, window: int = 50, level: float = 0.01, bucket: str | None = None, size: int = SIZE) -> DataFrame:
    """Rows of df with a full window before them, with `stat` (absolute return in local bipower deviations) and `jump`.

    The local scale comes from the `window` - 1 products before a row; a jump exceeds the Gumbel quantile 1 - level of
    the largest of the key's tested returns (two at least).
    """
    return _tested(df, by, order, r, window, level, bucket, size).where("jump is not null").drop("__b")


def decompose(df: DataFrame, by: list[str], order: list[str], row: str, r: str, window: int = 50, bucket: str | None = None, size: int = SIZE) -> DataFrame:
    """Variance of each key in parts: rv, bv (bipower), jv and jumps, up and down semivariance, their shares, and the part
    that jumps don't make. `row` names a row within its key, among rows of one place in `order`."""
    x = _tested(df, by, list(dict.fromkeys([*order, row])), r, window, 0.01, bucket, size)
    square = F.col(r) * F.col(r)
    g = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(square).alias("rv"), (math.pi / 2 * F.sum("__b")).alias("bv"), F.coalesce(F.sum(F.when(F.col("jump") == 1, square)), F.lit(0.0)).alias("jv"), F.coalesce(F.sum("jump"), F.lit(0)).cast("long").alias("jumps"),
        F.sum(F.when(F.col(r) > 0, square).otherwise(0.0)).alias("up_semivar"), F.sum(F.when(F.col(r) < 0, square).otherwise(0.0)).alias("down_semivar"),
    )
    rest = F.greatest(F.col("rv") - F.col("jv"), F.lit(0.0))
    share = lambda c: F.when(F.col("rv") > 0, c / F.col("rv"))
    return g.withColumns({"jump_share": share(F.col("jv")), "jump_robust": F.when(F.col("bv") > 0, F.least(F.col("bv"), rest)).otherwise(rest), "skew": share(F.col("up_semivar") - F.col("down_semivar"))})
