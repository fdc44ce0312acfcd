"""Ledgers of users' frames: totals, groups, days, drift and staleness. Nulls are left out of means and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def day(ts_us: str) -> Column:
    """Number of the day of a time in microseconds."""
    return F.floor(F.col(ts_us) / DAY_US).cast("long")


def trades(df: DataFrame, by: list[str], won: str = "won", pnl: str | None = None, **means: Column) -> DataFrame:
    """(by, n, wins, winrate, pnl if wanted, and the mean of each of `means`) of trades that were filled."""
    more = [] if pnl is None else [F.sum(pnl).alias("pnl")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(won).cast("long").alias("wins"), F.avg(won).alias("winrate"), *more, *[F.avg(c).alias(n) for n, c in means.items()])


def net(won: str, price: str, fee: Column) -> Column:
    """What a contract brings after its price and fee."""
    return F.col(won) - F.col(price) - fee


def attribution(df: DataFrame, won: str, price: str, fee: Column, stake: float = 20.0) -> DataFrame:
    """(n, gross, fees, net, winrate) of filled trades of one stake each."""
    contracts = F.lit(stake) / F.col(price)
    gross = F.sum((F.col(won) - F.col(price)) * contracts)
    fees = F.sum(fee * contracts)
    return df.agg(F.count("*").alias("n"), gross.alias("gross"), fees.alias("fees"), F.sum(net(won, price, fee) * contracts).alias("net"), F.avg(won).alias("winrate"))


def totals(df: DataFrame, filled: str = "filled", won: str = "won", pnl: str = "pnl") -> DataFrame:
    """One row (pnl, filled, won, settled, winrate) over all settlements; zeros where there are none."""
    here = F.col(filled) == 1
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    return df.agg(
        zero(F.sum(F.when(here, F.col(pnl))), 0.0).alias("pnl"), zero(F.sum(filled), 0).cast("long").alias("filled"), zero(F.sum(won), 0).cast("long").alias("won"),
        F.count("*").alias("settled"), zero(F.avg(F.when(here, F.col(won))), 0.0).alias("winrate"),
    )


def last_day(df: DataFrame, ts_us: str, pnl: str, filled: str = "filled") -> DataFrame:
    """One row (midnight, pnl, trades) of the day of the newest row: sums by day first, then the last of them. Fills on
    that day count, its midnight is that of any row."""
    start = F.col(ts_us) - F.pmod(ts_us, F.lit(DAY_US))
    here = F.col(filled) == 1
    days = df.groupBy(start.alias("midnight")).agg(F.coalesce(F.sum(F.when(here, F.col(pnl))), F.lit(0.0)).alias("pnl"), F.count(F.when(here, F.col(pnl))).alias("trades"))
    newest = days.agg(F.max_by(F.struct("midnight", "pnl", "trades"), "midnight").alias("d"))
    return newest.select("d.*")


def throughput(decisions: DataFrame, settlements: DataFrame, by: list[str]) -> DataFrame:
    """(by, evaluated, trades, filled, winrate, pnl): decisions beside filled settlements, groups of either side."""
    d = decisions.groupBy(*by).agg(F.count("*").alias("evaluated"), F.count_if(F.col("decision") == "TRADE").alias("trades"))
    s = trades(settlements, by, pnl="pnl").select(*by, F.col("n").alias("filled"), "winrate", "pnl")
    zero = {"evaluated": 0, "trades": 0, "filled": 0, "pnl": 0.0}
    return d.join(s, by, "full_outer").select(*by, *[F.coalesce(c, F.lit(zero[c])).alias(c) if c in zero else F.col(c) for c in ("evaluated", "trades", "filled", "winrate", "pnl")])


def daily_rate(df: DataFrame, ts_us: str, outcome: str, least: int = 1) -> DataFrame:
    """(day, n, up_rate) of days with `least` rows or more."""
    return df.groupBy(day(ts_us).alias("day")).agg(F.count("*").alias("n"), F.avg(outcome).alias("up_rate")).where(F.col("n") >= least)


def equal_days(rates: DataFrame) -> DataFrame:
    """(days, mean_rate, last_day, last_rate) of daily rates, each day counting once."""
    return rates.agg(F.count("*").alias("days"), F.avg("up_rate").alias("mean_rate"), F.max("day").alias("last_day"), F.max_by("up_rate", "day").alias("last_rate"))


def drift(df: DataFrame, by: list[str], ts: str, price: str) -> DataFrame:
    """(by, n, first_price, last_price, drift): relative change over a group's time; null where it starts at no positive price."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.min_by(price, ts).alias("first_price"), F.max_by(price, ts).alias("last_price"))
    return g.withColumn("drift", F.when(F.col("first_price") > 0, F.col("last_price") / F.col("first_price") - 1))


def falling(drifts: DataFrame, share: float = 0.6) -> DataFrame:
    """(assets, falling, down): the share of groups that fell, and whether it is `share` or more."""
    fell = F.avg(F.when(F.col("drift") < 0, 1.0).otherwise(0.0))
    return drifts.agg(F.count("*").alias("assets"), fell.alias("falling"), (fell >= share).alias("down"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share) of each value's rows; the total is one row."""
    g = df.groupBy(by).agg(F.count("*").alias("n"))
    return g.join(g.agg(F.sum("n").alias("__all")), how="cross").select(by, "n", (F.col("n") / F.col("__all")).alias("share"))


def staleness(df: DataFrame, by: str, ts_us: str, now: DataFrame | None = None) -> DataFrame:
    """(by, events, last_us, age_s): how far each group's newest row is behind the newest of all, or of the frame `now`."""
    newest = (df if now is None else now).agg(F.max(ts_us).alias("__now"))  # one row
    g = df.groupBy(by).agg(F.count("*").alias("events"), F.max(ts_us).alias("last_us"))
    return g.join(newest, how="cross").select(by, "events", "last_us", ((F.col("__now") - F.col("last_us")) / 1e6).alias("age_s"))
