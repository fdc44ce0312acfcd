"""The decision path on a user's frame against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions as path


@pytest.fixture(scope="module")
def quotes():
    rng = random.Random(1)
    some = lambda v: None if rng.random() < 0.2 else v
    return [(n, some(round(rng.uniform(0.1, 0.6), 2)), some(round(rng.uniform(0.5, 0.9), 2)), some(float(rng.randrange(3))), some(float(rng.randrange(3)))) for n in range(120)]


def test_quotes(spark, quotes):
    df = spark.createDataFrame(quotes, "n int, bid double, ask double, bs double, as_ double")
    bid, ask = path.oriented(F.when(F.col("n") % 2 == 0, "down").otherwise("up"), F.col("bid"), F.col("ask"))
    got = {r.n: r for r in df.select("n", path.mid(F.col("bid"), F.col("ask")).alias("mid"), bid.alias("up_bid"), ask.alias("up_ask"), path.imbalance(F.col("bs"), F.col("as_")).alias("imb")).collect()}
    kept = {r.n for r in path.liquid(df, "bid", "ask").collect()}
    for n, b, a, bs, as_ in quotes:
        mid = (b + a) / 2 if b is not None and a is not None else b if b is not None else a
        assert got[n].mid == (None if mid is None else pytest.approx(mid))
        want = (None if a is None else 1 - a, None if b is None else 1 - b) if n % 2 == 0 else (b, a)
        assert (got[n].up_bid, got[n].up_ask) == want
        total = (bs or 0) + (as_ or 0)
        assert got[n].imb == pytest.approx(((bs or 0) - (as_ or 0)) / total if total else 0)
        assert (n in kept) == (mid is not None and (b is None or a is None or a - b <= 0.12))


def test_candidates(spark):
    rows = [(n, m, float(left), 60.0, spot, strike, kind, "1h") for n, (m, left, spot, strike, kind) in enumerate([("a", 10, 100.0, 107.0, "threshold"), ("b", 10, 100.0, 110.0, "threshold"), ("c", 10, 100.0, 110.0, "directional"), ("d", 1, 100.0, 100.0, "directional"), ("e", 58, 100.0, 100.0, "directional"), (None, 10, 100.0, 100.0, "directional"), ("f", 10, None, 100.0, "directional"), ("g", 10, 100.0, 0.0, "directional")])]
    df = spark.createDataFrame(rows, "n int, market string, left_ double, w double, spot double, strike double, kind string, tf string")
    reach = path.in_reach(df, "left_", "w", "spot", "strike", "kind", "tf")
    assert {r.n for r in reach.collect()} == {0, 2, 5}
    assert {r.n for r in path.without(reach, spark.createDataFrame([("c",), (None,)], "market string"), ["market"]).collect()} == {0, 5}


@pytest.mark.parametrize("gate", [path.Gate(), path.Gate(seen=3, most_edge=0.1, net=-1.0, move=0.0)])
def test_gate(spark, gate):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(1000), n, rng.uniform(0, 1), rng.uniform(0.01, 0.99), rng.uniform(-1, 1), rng.random(), rng.random()) for n in range(400)]
    df = spark.createDataFrame(rows, "asset string, t int, id int, p_cal double, book_mid_up double, z_dist double, confidence double, move_prob double")
    got = {r.id: r for r in path.gated(df, ["asset"], ["t", "id"], "floor(t / 100e0)", gate).collect()}
    seen, traded = {}, 0
    for asset, _, n, p, m, z, c, move in sorted(rows, key=lambda r: r[1:3]):
        seen[asset] = seen.get(asset, 0) + 1
        price = m if p > m else 1 - m
        if not gate.low_price < price < gate.high_price:
            assert n not in got
            continue
        ev = abs(p - m) - gate.cost - gate.doubt * (1 - c)
        trade = seen[asset] > gate.seen and abs(p - m) <= gate.most_edge and gate.low_mid <= m <= gate.high_mid and (z >= 0 if p > m else z <= 0) and ev > gate.net and c > gate.confidence and move > gate.move
        assert got[n].gate == ("TRADE" if trade else "SKIP") and got[n].lean == ("up" if p > m else "down")
        assert math.isclose(got[n].ev, ev, abs_tol=1e-12) and math.isclose(got[n].price, price)
        traded += trade
    assert traded > 0


def test_first_rows_of_each_key(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 2, "w")], "k string, t int, v string")
    assert {tuple(r) for r in path.first_of_each(df, ["k"], ["t", "v"]).collect()} == {("a", 1, "y"), (None, 2, "w")}
    assert {tuple(r) for r in path.first_of_each(df, ["k"], ["t", "v"], 2).collect()} == {("a", 1, "y"), ("a", 1, "z"), (None, 2, "w")}
