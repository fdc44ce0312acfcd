"""File formats of forward runs as DataFrames with declared schemas; bad lines are dropped, missing keys are null."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import storage

SETTLED = "record_type string, venue string, side string, signal_time string, market_start_time string, market_end_time string, settlement_winning_side string, model_prob_side double, raw_model_probability double, entry_price double, avg_entry_price double, entry_fee_per_contract double, fee_paid double, contracts double, quantity double, realized_pnl double"
DECISION = "record_type string, venue string, signal_time string, market_start_time string, market_end_time string, selected_side string, decision_reason string, should_enter boolean, time_to_settlement_minutes double, probability_up double, model_probability double, confidence double, entry_price double, observed_best_ask double, observed_best_bid double"
QUOTE = "record_type string, venue string, selected_side string, market_start_time string, market_end_time string, quote_timestamp string, observed_best_bid double, observed_best_ask double, observed_bid_size double, observed_ask_size double"


def first_of(*names: str) -> Column:
    """First key that is there."""
    return F.coalesce(*[F.col(n) for n in names])


def _jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under run/asset folders; run and asset come from the path."""
    x = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return x.withColumn("run", F.element_at(parts, -3)).withColumn("asset", F.element_at(parts, -2))


def settled_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Settled trades."""
    x = _jsonl(spark, path, SETTLED).where("record_type = 'paper_trade_settled'")
    return x.select("run", "asset", "venue", "side", "signal_time", "market_start_time", "market_end_time", "settlement_winning_side", first_of("model_prob_side", "raw_model_probability").alias("prob"), first_of("entry_price", "avg_entry_price").alias("entry_price"), first_of("entry_fee_per_contract", "fee_paid").alias("fee"), first_of("contracts", "quantity").alias("contracts"), "realized_pnl")


def decisions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Decision records; sample them with `operators.systematic_sample` by file."""
    return _jsonl(spark, path, DECISION).withColumn("probability", first_of("probability_up", "model_probability"))


def quotes_jsonl(spark: SparkSession, path: str, seconds: int = 900) -> DataFrame:
    """Quote snapshots of windows of the given length (within a second)."""
    x = _jsonl(spark, path, QUOTE).where("record_type = 'quote_snapshot'")
    epoch = lambda c: F.unix_timestamp(F.to_timestamp(c))
    return x.where(F.abs(epoch("market_end_time") - epoch("market_start_time") - seconds) <= 1)


def find_runs(folder: str, prefix: str, last: int | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run folders by name, the last few of them; with a session the folder may be on any store that Spark reaches."""
    names = [n for n in (sorted(os.listdir(folder)) if spark is None else storage.names(spark, folder)) if n.startswith(prefix)]
    return [os.path.join(folder, n) for n in (names[-last:] if last else names)]


def candle_path(folder: str, asset: str, symbols: dict[str, str] | None = None, name: str = "BTCUSDT_1m.csv") -> str | None:
    """Where an asset's candles are: in a folder of its own, or with `symbols` in one file a symbol (none: no candles)."""
    if symbols is None:
        return f"{folder}/{asset}/{name}"
    return f"{folder}/{symbols[asset]}_1m.csv" if asset in symbols else None


def candles(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """(epoch, open, close) of CSV candles from `since`; both time formats are read."""
    x = spark.read.schema("timestamp string, open double, high double, low double, close double, volume double").option("header", "true").csv(path)
    t = F.coalesce(F.expr("try_to_timestamp(timestamp, 'yyyy-MM-dd HH:mm:ss')"), F.expr("try_to_timestamp(timestamp, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))
    return x.select(F.unix_timestamp(t).alias("epoch"), "open", "close").where(F.col("epoch") >= since)


def lane_config(spark: SparkSession, path: str) -> DataFrame:
    """Lanes of a pipe-separated file with # comments."""
    x = spark.read.schema("name string, data_dir string, flags string").option("sep", "|").option("comment", "#").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    return x.where("name is not null")


def lanes(spark: SparkSession, pattern: str) -> DataFrame:
    """Open positions of all lane snapshots: (lane, updated, equity, pnl_today, asset, cost)."""
    schema = "updated string, config struct<name: string>, performance struct<pnl_today: double, equity: double>, open_positions array<struct<asset: string, cost: double>>"
    x = spark.read.schema(schema).option("multiLine", "true").json(pattern)
    return x.select(F.col("config.name").alias("lane"), "updated", "performance.equity", "performance.pnl_today", F.explode_outer("open_positions").alias("p")).select("lane", "updated", "equity", "pnl_today", "p.asset", "p.cost")


def append_rows(df: DataFrame, path: str, schema: str, partition: str | None = None) -> None:
    """Append rows to a table; columns that are missing are null, others are left out."""
    empty = df.sparkSession.createDataFrame([], schema)
    rows = empty.unionByName(df.select(*[c for c in df.columns if c in empty.columns]), allowMissingColumns=True)
    w = rows.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latest_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows."""
    return df.orderBy(F.col(order).desc()).limit(n)


def write_snapshot(doc: dict, path: str, spark: SparkSession | None = None) -> None:
    """Replace a small JSON document at once; with a session, on any store that Spark reaches."""
    if spark is not None:
        storage.write_text(spark, path, json.dumps(doc))
        return
    with open(f"{path}.new", "w") as f:
        json.dump(doc, f)
    os.replace(f"{path}.new", path)


def write_flag(path: str, due: bool, text: str = "", spark: SparkSession | None = None) -> bool:
    """A marker file that is there while something is due, and gone once it isn't; whether it is there now. With a session,
    on any store that Spark reaches."""
    if spark is not None:
        storage.write_text(spark, path, text) if due else storage.remove(spark, path)
        return storage.exists(spark, path)
    if due:
        with open(path, "w") as f:
            f.write(text)
    elif os.path.exists(path):
        os.remove(path)
    return due


def simulated_autoregression(spark: SparkSession, n: int, phi: float, seed: int = 7, sigma: float = 0.01) -> DataFrame:
    """(i, r): returns that keep the share `phi` of the one before; a weighted sum of the shocks that still count."""
    reach = 0 if phi == 0 else math.ceil(math.log(1e-12) / math.log(abs(phi)))
    stretch = max(10_000, 10 * reach)
    shocks = spark.range(-reach, n).select(F.col("id").alias("i"), (F.randn(seed) * sigma).alias("e"))
    # stretches with the shocks before them, each a window of its own
    x = shocks.withColumn("s", F.explode(F.sequence(F.floor(F.col("i") / stretch), F.floor((F.col("i") + reach) / stretch))))
    weights = F.array(*[F.lit(phi**k) for k in range(reach, -1, -1)])
    past = F.collect_list("e").over(Window.partitionBy("s").orderBy("i").rowsBetween(-reach, 0))
    total = F.aggregate(F.zip_with(past, weights, lambda e, w: e * w), F.lit(0.0), lambda a, v: a + v)
    return x.withColumn("r", total).where((F.col("i") >= 0) & (F.col("s") == F.floor(F.col("i") / stretch))).select("i", "r")


def simulated_jumps(spark: SparkSession, n: int, seed: int = 7, sigma: float = 0.01, share: float = 0.002, size: float = 0.1) -> DataFrame:
    """(i, r, jump): normal returns, of which a share carries a jump of either sign."""
    u = F.rand(seed + 1)
    x = spark.range(n).select(F.col("id").alias("i"), (F.randn(seed) * sigma).alias("e"), u.alias("u"))
    jump = F.when(F.col("u") < share / 2, size).when(F.col("u") < share, -size).otherwise(0.0)
    return x.select("i", (F.col("e") + jump).alias("r"), (F.col("u") < share).alias("jump"))


def simulated_regimes(spark: SparkSession, n: int, length: int = 500, calm: float = 0.005, wild: float = 0.02, seed: int = 7) -> DataFrame:
    """(i, regime, r): normal returns whose deviation changes between two regimes every `length` rows."""
    regime = F.floor(F.col("id") / length) % 2
    return spark.range(n).select(F.col("id").alias("i"), regime.cast("int").alias("regime"), (F.randn(seed) * F.when(regime == 1, wild).otherwise(calm)).alias("r"))


def simulated_returns(spark: SparkSession, n: int, seed: int = 7, sigma: float = 0.01, bounce: float = 0.0) -> DataFrame:
    """(i, r): seeded normal returns, with alternating noise of size `bounce` if wanted."""
    return spark.range(n).select(F.col("id").alias("i"), (F.randn(seed) * sigma + F.when(F.col("id") % 2 == 0, bounce).otherwise(-bounce)).alias("r"))


def simulated_panel(spark: SparkSession, periods: int, rows: int, on_mid: float = 0.5, on_signal: float = 1.2, seed: int = 7) -> DataFrame:
    """(period, mid, signal, noise, y): outcomes whose log-odds are known sums of those of a noisy price and of a signal; the
    column `noise` has no part in them."""
    u = F.rand(seed) * 0.6 + 0.2 + F.randn(seed + 1) * 0.15
    x = spark.range(periods * rows).select(F.floor(F.col("id") / rows).alias("period"), F.least(F.greatest(u, F.lit(0.05)), F.lit(0.95)).alias("mid"), (F.rand(seed + 2) * 2 - 1).alias("signal"), (F.randn(seed + 3) * 0.1).alias("noise"), F.rand(seed + 4).alias("u"))
    odds = on_mid * F.log(F.col("mid") / (1 - F.col("mid"))) + on_signal * F.col("signal")
    return x.withColumn("y", (F.col("u") < 1 / (1 + F.exp(-odds))).cast("int")).drop("u")
