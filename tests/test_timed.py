"""Streams with timers: as-of joins against the batch operator, failover while input is silent, positions in any order."""

import datetime
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import models
from tidemark.operators import asof_join
from tidemark.streaming import freeze_strikes, run_once, settle_positions
from tidemark.streaming.timed import failover, stream_asof, use_rocksdb

T0 = 1_700_000_100


def at(seconds):
    return datetime.datetime.fromtimestamp(T0 + seconds, datetime.UTC)


def feed(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(stream, tmp_path, name):
    run_once(stream.writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append"), str(tmp_path / f"{name}_c"))
    return pd.read_parquet(tmp_path / name)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


SCHEMA = "side string, k string, ts timestamp, n long, v double"


@pytest.mark.parametrize(("seed", "tolerance"), [(1, None), (2, 6_000)])
def test_stream_as_of_is_the_batch_join(spark, tmp_path, rocks, seed, tolerance):
    """Rows in an order within the delay, split into files at random; ties, keys without right rows."""
    rng = random.Random(seed)
    rows = []
    for n in range(220):
        t = rng.randrange(0, 120_000, 500) / 1000
        rows.append((rng.choice("LR"), "z" if rng.random() < 0.05 else rng.choice("ab"), at(t), n, None if rng.random() < 0.1 else float(n)))
    rows = [r if r[1] != "z" else ("L", *r[1:]) for r in rows]
    arrive = sorted(rows, key=lambda r: r[2].timestamp() + rng.uniform(0, 8))
    cuts = sorted(rng.sample(range(len(arrive)), 6))
    files = [arrive[i:j] for i, j in zip([0, *cuts], [*cuts, len(arrive)], strict=True) if i < j] + [[("R", "a", at(500), -1, 0.0)], [("R", "a", at(501), -2, 0.0)]]
    stream = feed(spark, tmp_path / "in", files, SCHEMA)
    parts = [stream.where(f"side = '{s}'").drop("side") for s in "LR"]
    joined = stream_asof(*parts, "k", "ts", ["n", "v"], late="10 seconds", tolerance_ms=tolerance, tie="n")
    got = drain(joined, tmp_path, "out")
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("ms", F.unix_millis("ts"))
    want = asof_join(batch.where("side = 'L'").drop("side"), batch.where("side = 'R'").drop("side"), ["k"], "ms", ["n", "v"], tolerance=tolerance, tie="n").toPandas()
    key = lambda df: sorted((int(r.n), None if pd.isna(r.r_n) else int(r.r_n), None if pd.isna(r.r_v) else r.r_v) for r in df.itertuples())
    assert key(got) == key(want) and got.r_n.isna().any() and got.r_n.notna().any()


def test_failover_is_counted_once_while_input_is_silent(spark, tmp_path, rocks):
    schema = "feed string, transport string, n long"
    source = tmp_path / "in"
    spark.createDataFrame([("f", "md", 1), ("g", "rest", 1)], schema).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = failover(stream, silent_ms=1500).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()

    def seen(n):
        for _ in range(240):
            rows = [(r.feed, r.was, r.became, r.changes) for r in spark.table("changes").collect()]
            if len(rows) >= n:
                return sorted(rows)
            time.sleep(0.25)
        raise AssertionError(f"{rows}")

    try:
        assert seen(2) == [("f", "md", "rest", 1), ("g", "md", "rest", 1)]
        time.sleep(3)  # still silent: no further change
        assert len(seen(2)) == 2
        spark.createDataFrame([("f", "md", 2), ("g", "rest", 2)], schema).coalesce(1).write.mode("append").parquet(str(source))
        assert seen(4) == [("f", "md", "rest", 1), ("f", "md", "rest", 3), ("f", "rest", "md", 2), ("g", "md", "rest", 1)]
    finally:
        q.stop()


QUOTES = "market string, ts timestamp, window_end timestamp, up_bid double, up_ask double, underlying double"


def plain_position(quotes, end):
    """The quotes of a market in time order, by hand: none at or before its end, none."""
    position = strike = last = None
    n = 0
    for t, bid, ask, under in sorted(quotes):
        if t > end + 5:
            break
        if position is None:
            if t > end:
                return None
            position, strike = models.Position("up", 0.5, passive=4.0), under
        last = under
        if t <= end:
            position.on_quote(bid, ask)
            n += 1
    return None if position is None else (position.settle(last, strike)["outcome_up"], n, position.peak, position.trough)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_positions_in_any_order_and_long_after_the_end(spark, tmp_path, seed):
    """Quotes that go on after the settlement, markets first seen after their end or within the grace, arrival out of order."""
    rng = random.Random(seed)
    markets = {"long": (100, range(20, 400, 7)), "late": (60, range(90, 300, 11)), "grace": (80, range(82, 200, 9)), "usual": (150, range(90, 152, 4)), "edge": (50, range(50, 58, 2))}
    quotes = {m: [(t, round(rng.uniform(0.05, 0.9), 2), round(rng.uniform(0.1, 0.95), 2), rng.uniform(90, 110)) for t in times] for m, (_, times) in markets.items()}
    rows = [(m, at(t), at(markets[m][0]), b, a, u) for m, qs in quotes.items() for t, b, a, u in qs]
    arrive = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, 8))
    files = [arrive[i : i + 9] for i in range(0, len(arrive), 9)] + [[("end", at(5000 + k), at(9000), 0.5, 0.5, 1.0)] for k in range(2)]
    got = drain(settle_positions(feed(spark, tmp_path / "in", files, QUOTES), lambda r: models.Position("up", 0.5, passive=4.0), late="10 seconds"), tmp_path, "out")
    want = {m: p for m in markets if (p := plain_position(quotes[m], markets[m][0])) is not None}
    assert set(want) == {"long", "usual", "edge"}, want
    assert len(got) == len(want)
    for r in got.itertuples():
        outcome, n, peak, trough = want[r.market]
        assert (int(r.outcome_up), int(r.quotes), r.peak) == (outcome, n, pytest.approx(peak))
        assert pd.isna(r.trough) if trough is None else r.trough == pytest.approx(trough)


def test_older_rounds_within_the_delay_and_idle_assets(spark, tmp_path):
    """The first trigger's round is not the earliest; an asset that falls silent has strikes for its idle time only."""
    schema = "asset string, ts timestamp, price double, round_id long"
    files = [
        [("A", at(620), 3.0, 3), ("I", at(10), 9.0, 1)],
        [("A", at(290), 1.0, 1), ("A", at(310), 2.0, 2)],
        [("A", at(1300), 4.0, 4)],
        [("A", at(2000), 5.0, 5)],
        [("A", at(2001), 6.0, 6), ("I", at(1960), 8.0, 2)],
        [("A", at(2600), 7.0, 7)],
        [("A", at(2601), 7.0, 8)],
    ]
    got = drain(freeze_strikes(feed(spark, tmp_path / "in", files, schema), grids=(300,), late="600 seconds", idle_ms=700_000), tmp_path, "out")
    rows = {(r.asset, int(r.window_start.timestamp()) - T0): r.price for r in got.itertuples()}
    assert {k: v for k, v in rows.items() if k[0] == "A"} == {("A", 300): 1.0, ("A", 600): 2.0, ("A", 900): 3.0, ("A", 1200): 3.0, ("A", 1500): 4.0, ("A", 1800): 4.0}
    assert {k: v for k, v in rows.items() if k[0] == "I"} == {("I", 300): 9.0, ("I", 600): 9.0}
