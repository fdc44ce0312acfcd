"""The decision path on users' frames: quotes, candidates, the trade gate, and picks by closing time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import positions


def mid(bid: Column, ask: Column) -> Column:
    """Middle of both sides, or the one that is there."""
    return F.coalesce((bid + ask) / 2, bid, ask)


def oriented(side: Column, bid: Column, ask: Column) -> tuple[Column, Column]:
    """(bid, ask) of UP from those of the side quoted: DOWN at x is UP at 1 - x, and its bid is UP's ask."""
    down = side == "down"
    return F.when(down, 1 - ask).otherwise(bid), F.when(down, 1 - bid).otherwise(ask)


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    """Bid size less ask size as a share of both; 0 without any."""
    total = F.coalesce(bid_size, F.lit(0.0)) + F.coalesce(ask_size, F.lit(0.0))
    return F.when(total > 0, (F.coalesce(bid_size, F.lit(0.0)) - F.coalesce(ask_size, F.lit(0.0))) / total).otherwise(0.0)


def liquid(quotes: DataFrame, bid: str, ask: str, widest: float = 0.12) -> DataFrame:
    """Quotes with a price and a spread of at most `widest`; one side alone has no spread."""
    gap = F.coalesce(F.col(ask) - F.col(bid), F.lit(0.0))
    return quotes.where(mid(F.col(bid), F.col(ask)).isNotNull() & (gap <= widest))


def without(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is in no row of `done`; rows with a null in the key stay."""
    return df.join(done.select(*key), key, "left_anti")


def in_reach(df: DataFrame, minutes_left: str, window: str, spot: str, strike: str, kind: str, tf: str) -> DataFrame:
    """Markets that are neither too young nor about to close, with thresholds near the money: 8 percent of an hour's
    market, 4 of others."""
    left, w = F.col(minutes_left), F.col(window)
    soon, late = F.greatest(F.lit(0.5), 0.05 * w), F.least(0.95 * w, F.lit(180.0))
    near = F.abs(F.log(F.col(spot) / F.col(strike))) <= F.when(F.col(tf) == "1h", 0.08).otherwise(0.04)
    return df.where((F.col(spot) > 0) & (F.col(strike) > 0)).where((left >= soon) & (left <= late) & ((F.col(kind) != "threshold") | near))


@dataclass(frozen=True)
class Gate:
    """Fixed values of the trade gate."""

    seen: int = 40
    most_edge: float = 0.2
    low_mid: float = 0.3
    high_mid: float = 0.65
    net: float = 0.01
    confidence: float = 0.05
    move: float = 0.35
    low_price: float = 0.02
    high_price: float = 0.98
    cost: float = 0.005
    doubt: float = 0.01


def gated(decisions: DataFrame, by: list[str], order: list[str], bucket: str, gate: Gate | None = None) -> DataFrame:
    """Decisions whose side has a price, with lean, price, ev (edge less cost and doubt) and gate: TRADE where an asset has
    more rows than `seen`, the price is in the middle, the distance points the same way, and edge, confidence and the chance
    of a move are large enough. Rows are numbered as `positions` does.

    decisions: p_cal, book_mid_up, z_dist, confidence and move_prob besides `by` and `order`.
    """
    g = gate or Gate()
    p, m, up = F.col("p_cal"), F.col("book_mid_up"), F.col("p_cal") > F.col("book_mid_up")
    x = positions(decisions, by, order, bucket, "__seen").withColumns({"lean": F.when(up, "up").otherwise("down"), "price": F.when(up, m).otherwise(1 - m)})
    x = x.where((F.col("price") > g.low_price) & (F.col("price") < g.high_price)).withColumn("ev", F.abs(p - m) - g.cost - g.doubt * (1 - F.col("confidence")))
    agrees = F.when(F.col("lean") == "up", F.col("z_dist") >= 0).otherwise(F.col("z_dist") <= 0)
    ok = (F.col("__seen") > g.seen) & (F.abs(p - m) <= g.most_edge) & m.between(g.low_mid, g.high_mid) & agrees & (F.col("ev") > g.net) & (F.col("confidence") > g.confidence) & (F.col("move_prob") > g.move)
    return x.withColumn("gate", F.when(ok, "TRADE").otherwise("SKIP")).drop("__seen")


def first_of_each(df: DataFrame, by: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each key. Of one row a key, partial results are combined before the shuffle."""
    if n == 1:
        rest = [c for c in df.columns if c not in by]
        return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*by, *[F.col("__r")[c].alias(c) for c in rest])
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")
