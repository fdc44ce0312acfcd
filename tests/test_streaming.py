"""Streams with state and timers against the same rows in batch."""

import datetime
import random

import pandas as pd
import pytest

from tidemark.functions import models
from tidemark.streaming import fold_stream, freeze_strikes, run_once, settle_positions

T0 = 1_700_000_100  # a multiple of 300 and of 900


def at(seconds):
    return datetime.datetime.fromtimestamp(T0 + seconds, datetime.UTC)


def feed(spark, path, batches, schema):
    """A folder with one file a batch, read one at a time in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        del i
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(stream, tmp_path, name):
    run_once(stream.writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append"), str(tmp_path / f"{name}_c"))
    return pd.read_parquet(tmp_path / name)


def test_strikes_freeze_after_the_delay(spark, tmp_path):
    schema = "asset string, ts timestamp, price double, round_id long"
    batches = [
        [("BTC", at(-50), 99.0, None), ("BTC", at(-5), 100.0, None), ("BTC", at(3), 101.0, 3)],
        [("BTC", at(-5), 100.0, 7), ("BTC", at(9), 102.0, 4)],  # a log row gives the poll row its id; too early to freeze
        [("BTC", at(12), 103.0, 5), ("ETH", at(12), 5.0, 1)],
        [("BTC", at(15), 104.0, 6), ("BTC", at(-2), 777.0, 8)],  # the boundary is frozen by now: a late round changes nothing
        [("BTC", at(320), 105.0, 9)],
        [("BTC", at(321), 106.0, 10)],
    ]
    got = drain(freeze_strikes(feed(spark, tmp_path / "in", batches, schema), grids=(300,)), tmp_path, "out")
    rows = sorted((r.asset, int(r.window_start.timestamp()) - T0, r.price, int(r.round_at.timestamp()) - T0, r.round_id) for r in got.itertuples())
    assert rows == [("BTC", 0, 100.0, -5, 7), ("BTC", 300, 104.0, 15, 6), ("ETH", 300, 5.0, 12, 1)]


def test_strikes_equal_the_batch_as_of(spark, tmp_path):
    rng = random.Random(3)
    times = {a: sorted(rng.sample(range(1, 9000), 150)) for a in ("A", "B")}
    rows = sorted((at(t), a, float(i)) for a, ts in times.items() for i, t in enumerate(ts))
    batches = [[(a, t, p, None) for t, a, p in rows[i : i + 30]] for i in range(0, len(rows), 30)] + [[("A", at(20_000), 0.0, None)], [("A", at(20_001), 0.0, None)]]
    got = drain(freeze_strikes(feed(spark, tmp_path / "in", batches, "asset string, ts timestamp, price double, round_id long"), grids=(300, 900), keep=40), tmp_path, "out")
    frozen = {(r.asset, r.grid_s, int(r.window_start.timestamp()) - T0): r.price for r in got.itertuples() if int(r.window_start.timestamp()) - T0 <= 9000}
    want = {(a, g, w): float(sum(t <= w for t in ts) - 1) for a, ts in times.items() for g in (300, 900) for w in range(0, 9001, g) if w >= ts[0]}
    assert frozen == want


def test_positions_settle_after_the_grace(spark, tmp_path):
    schema = "market string, ts timestamp, window_end timestamp, up_bid double, up_ask double, underlying double"
    rng, batches, plain = random.Random(5), [], {}
    for m in range(6):
        end = 100 * (m + 1)
        path, p, first = [], None, None
        for t in sorted(rng.sample(range(end - 90, end + 12), 25)):
            bid, under = round(rng.uniform(0.05, 0.93), 2), rng.uniform(90, 110)
            row = (f"m{m}", at(t), at(end), None if rng.random() < 0.1 else bid, None if rng.random() < 0.1 else bid + 0.02, under)
            path.append((t, row))
            if p is None:
                p, first = models.Position("up", 0.5, passive=4.0), under
            if t <= end + 5:
                last = under
            if t <= end:
                p.on_quote(row[3], row[4])
        plain[f"m{m}"] = p.settle(last, first) | {"peak": p.peak, "trough": p.trough}
        batches.append(path)
    rows = sorted(r for part in batches for r in part)
    files = [[r for _, r in rows[i : i + 10]] for i in range(0, len(rows), 10)] + [[("end", at(5000), at(9000), 0.5, 0.5, 1.0)], [("end", at(5001), at(9000), 0.5, 0.5, 1.0)]]
    stream = settle_positions(feed(spark, tmp_path / "in", files, schema), lambda r: models.Position("up", 0.5, passive=4.0))
    got = drain(stream, tmp_path, "out")
    assert sorted(got.market) == sorted(plain)
    for r in got.itertuples():
        w = plain[r.market]
        assert (r.outcome_up, r.filled, r.peak, r.trough) == (w["outcome_up"], w["filled"], pytest.approx(w["peak"]), pytest.approx(w["trough"], nan_ok=True) if w["trough"] is not None else pytest.approx(float("nan"), nan_ok=True))
        assert (pd.isna(r.pnl) and w["pnl"] is None) or (r.pnl == pytest.approx(w["pnl"]) and r.tp_pnl == pytest.approx(w["tp_pnl"]))


def test_books_and_mirrors_in_a_stream(spark, tmp_path):
    schema = "feed string, ts timestamp, seq long, topic string, side string, price double, size double, snapshot boolean"
    rows = [("f", at(i), s, "book.a", "BUY" if i % 2 else "SELL", 0.4 + 0.01 * (i % 9), float(i % 3), snap) for i, (s, snap) in enumerate([(1, False), (2, False), (4, False), (5, False), (6, True), (7, False), (7, False), (8, False)])]

    def step(state, r):
        mirror, book = state
        became = mirror.apply(r.seq, r.topic, r.price, bool(r.snapshot))
        if became == "snapshot":
            book.clear()
        if became in ("applied", "snapshot"):
            models.l2_apply(book, "price_change", [], [], [(r.side, r.price, r.size)])
        return {"seq": r.seq, "became": became, "bid": max(book.get("bid") or {0.0: 0}), "gaps": mirror.gaps}

    stream = feed(spark, tmp_path / "in", [rows[:3], rows[3:5], rows[5:]], schema)
    got = drain(fold_stream(stream, "feed", "ts", lambda: (models.Mirror(), {}), step, "seq long, became string, bid double, gaps long"), tmp_path, "out").sort_values(["seq", "became"])
    assert [(r.seq, r.became) for r in got.itertuples()] == [(1, "applied"), (2, "applied"), (4, "gap"), (5, "stale"), (6, "snapshot"), (7, "applied"), (7, "repeated"), (8, "applied")]
    assert got.gaps.max() == 1


def test_idle_state_goes(spark, tmp_path):
    schema = "k string, ts timestamp, v long"
    batches = [[("a", at(0), 1), ("b", at(0), 1)], [("b", at(400), 1)], [("b", at(800), 1)], [("b", at(801), 1)], [("a", at(900), 1), ("b", at(900), 1)]]

    def step(state, r):
        state["n"] = state.get("n", 0) + int(r.v)
        return {"k": r.k, "at": r.ts, "n": state["n"]}

    stream = feed(spark, tmp_path / "in", batches, schema).withWatermark("ts", "1 second")
    got = drain(fold_stream(stream, "k", "ts", dict, step, "k string, at timestamp, n long", idle_ms=450_000), tmp_path, "out")
    last = {r.k: r.n for r in got.sort_values("at").itertuples()}
    assert last == {"a": 1, "b": 5}  # a was idle and starts anew, b was not
