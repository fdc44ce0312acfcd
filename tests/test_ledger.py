"""Ledger functions on a user's frame against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as book

DAY = book.DAY_US


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(rng.choice(["x", "y", None]), rng.randrange(4) * DAY + rng.randrange(DAY), int(rng.random() < 0.8), None if rng.random() < 0.1 else rng.randrange(2), None if rng.random() < 0.1 else rng.uniform(-5, 5), rng.uniform(0.2, 0.8)) for _ in range(300)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "who string, t long, filled int, won int, pnl double, price double").repartition(3)


def mean(v):
    return sum(v) / len(v) if v else None


def test_totals_and_the_last_day(spark, rows, frame):
    got = book.totals(frame).first()
    fill = [r for r in rows if r[2]]
    assert tuple(got) == pytest.approx((sum(r[4] for r in fill if r[4] is not None), len(fill), sum(r[3] or 0 for r in rows), len(rows), mean([r[3] for r in fill if r[3] is not None])))
    assert tuple(book.totals(frame.limit(0)).first()) == (0.0, 0, 0, 0, 0.0)
    last = max(r[1] // DAY for r in rows)
    today = [r[4] for r in rows if r[1] // DAY == last and r[2] and r[4] is not None]
    assert tuple(book.last_day(frame, "t", "pnl").first()) == pytest.approx((last * DAY, sum(today), len(today)))


def test_groups_days_and_drift(rows, frame):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    got = {r.who: r for r in book.trades(frame, ["who"], pnl="pnl", entry=F.col("price"), net=book.net("won", "price", F.lit(0.01))).collect()}
    for who, part in groups.items():
        won = [r[3] for r in part if r[3] is not None]
        g = got[who]
        assert (g.n, g.wins) == (len(part), sum(won))
        assert (g.winrate, g.entry, g.net) == pytest.approx((mean(won), mean([r[5] for r in part]), mean([r[3] - r[5] - 0.01 for r in part if r[3] is not None])))
    days = {r.day: r for r in book.daily_rate(frame, "t", "won", 60).collect()}
    assert set(days) == {d for d in range(4) if sum(r[1] // DAY == d for r in rows) >= 60}
    drifts = {r.who: r for r in book.drift(frame, ["who"], "t", "price").collect()}
    for who, part in groups.items():
        part = sorted(part, key=lambda r: r[1])
        assert drifts[who].drift == pytest.approx(part[-1][5] / part[0][5] - 1)
    fall = [d.drift < 0 for d in drifts.values()]
    assert tuple(book.falling(book.drift(frame, ["who"], "t", "price"), 0.5).first()) == pytest.approx((3, mean(fall), mean(fall) >= 0.5))
    part = {r.who: r.share for r in book.shares(frame, "who").collect()}
    assert part == pytest.approx({w: len(p) / len(rows) for w, p in groups.items()})
    ages = {r.who: r.age_s for r in book.staleness(frame, "who", "t").collect()}
    assert ages == pytest.approx({w: (max(r[1] for r in rows) - max(r[1] for r in p)) / 1e6 for w, p in groups.items()})


def test_attribution_and_throughput(spark, rows, frame):
    fill = frame.where("filled = 1 and won is not null")
    got = book.attribution(fill, "won", "price", F.lit(0.02)).first()
    part = [r for r in rows if r[2] and r[3] is not None]
    gross, fees = sum((r[3] - r[5]) * 20 / r[5] for r in part), sum(0.02 * 20 / r[5] for r in part)
    assert tuple(got) == pytest.approx((len(part), gross, fees, gross - fees, mean([r[3] for r in part])))
    decisions = spark.createDataFrame([("x", "TRADE"), ("x", "SKIP"), ("z", "SKIP")], "who string, decision string")
    both = {r.who: r for r in book.throughput(decisions, frame.where("who is not null"), ["who"]).collect()}
    assert set(both) == {"x", "y", "z"} and (both["x"].evaluated, both["x"].trades, both["y"].evaluated, both["z"].filled, both["z"].winrate) == (2, 1, 0, 0, None)
