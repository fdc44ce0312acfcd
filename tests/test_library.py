"""Scalar functions, joins, folds, statistics, sources and streams on small cases."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from tidemark.functions import expressions as x
from tidemark.functions import models, statistics
from tidemark.operators import asof_join, excursions, fold_per_key, keep_last, nearest_join, nearest_rank, range_join, running_sum, seq_gaps, systematic_sample, throttle
from tidemark.operators import scores, variance
from tidemark.sources import (
    append_rows, candle_path, candles, lane_config, lanes, settled_jsonl, simulated_autoregression, simulated_jumps, simulated_regimes, simulated_returns, write_flag, write_snapshot,
)
from tidemark.streaming import bars, event_stream, fold_stream, insert_first, run_once, upsert_latest


def value(spark, sql):
    return spark.sql(f"select {sql} as v").first()["v"]


def test_functions(spark):
    for z in (-8.5, -3.0, -0.2, 0.0, 1.5, 7.5):
        assert value(spark, x.normal_cdf(f"{z}e0")) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-12)
    assert value(spark, x.taker_fee("0.5e0")) == pytest.approx(0.018)
    assert value(spark, x.taker_fee("1.7e0")) == 0 and value(spark, x.venue_fee("'polymarket'", "0.5e0")) == 0
    assert value(spark, x.kelly("0.9e0", "0.5e0")) == pytest.approx(0.02) and value(spark, x.kelly("0.51e0", "0.5e0")) == pytest.approx(0.01) and value(spark, x.kelly("0.3e0", "0.5e0")) == 0
    assert [value(spark, x.band(p)) for p in ("0.44e0", "0.45e0", "0.55e0")] == ["lo", "mid", "hi"]
    assert value(spark, x.digital_prob("100e0", "100e0", "0e0", "60e0")) == 0.5 and value(spark, x.bridge_prob("100e0", "100e0", "0.1e0", "0e0")) is None
    assert value(spark, x.mid("null", "0.4e0")) == pytest.approx(0.4)
    names = x.register_all(spark)
    assert spark.sql("select tm_normal_cdf(0e0) + tm_sigmoid(0e0) as v").first()["v"] == 1.0 and len(names) == len(x.FUNCTIONS)


def test_asof_and_nearest(spark):
    rng = random.Random(1)
    left = [(rng.choice("ab"), rng.randrange(60), i) for i in range(80)]
    right = [(rng.choice("abc"), t, t * 10 + k) for k in range(2) for t in rng.sample(range(60), 20)]
    lt, r = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, v long")
    for direction, strict, tol in (("backward", False, None), ("backward", True, 5), ("forward", False, 4), ("forward", True, None)):
        got = {row.i: row.r_v for row in asof_join(lt, r, ["k"], "t", ["v"], tol, direction, strict, tie="v").collect()}
        assert got == {row.i: row.r_v for row in asof_join(lt, r, ["k"], "t", ["v"], tol, direction, strict, tie="v", bucket=7).collect()}
        for k, t, i in left:
            sign = 1 if direction == "backward" else -1
            ok = [(sign * b, sign * v, v) for a, b, v in right if a == k and (sign * b < sign * t if strict else sign * b <= sign * t) and (tol is None or abs(t - b) <= tol)]
            assert got[i] == (max(ok)[2] if ok else None)
    got = {row.i: row.r_t for row in nearest_join(lt, r, ["k"], "t", ["v"], 3).collect()}
    for k, t, i in left:
        ok = [(abs(t - b), b) for a, b, _ in right if a == k and abs(t - b) <= 3]
        assert got[i] == (min(ok)[1] if ok else None)
    pairs = {(row.i, row.r_v) for row in range_join(lt, r, ["k"], "t", 7).collect()}
    assert pairs == {(i, v) for k, t, i in left for a, b, v in right if a == k and 0 < t - b <= 7}


def test_asof_is_causal(spark):
    """Later right rows never change earlier matches."""
    lt = spark.createDataFrame([("a", 5, 1), ("a", 9, 2)], "k string, t long, i long")
    few, more = [("a", 3, 1.0)], [("a", 3, 1.0), ("a", 8, 2.0), ("a", 99, 3.0)]
    get = lambda rows: {r.i: r.r_v for r in asof_join(lt, spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", ["v"]).collect()}
    assert get(few)[1] == get(more)[1] == 1.0 and get(more)[2] == 2.0


def test_ordered(spark):
    df = spark.createDataFrame([("a", s, float(s % 5)) for s in (1, 2, 4, 7, 8)], "k string, s long, v double")
    assert [(r.s, r.missing) for r in seq_gaps(df, ["k"], "s").orderBy("s").collect()] == [(4, 1), (7, 2)]
    assert [r.s for r in keep_last(df, ["k"], [F.col("s").desc()], 2).orderBy("s").collect()] == [7, 8]
    assert [r.s for r in systematic_sample(df, ["k"], ["s"], 2, 1).collect()] == [2]
    assert nearest_rank(df, ["k"], "v", "s", 0.5).first()["q"] == 2.0
    assert [r.s for r in throttle(df.withColumn("t", F.col("s") / 10), ["k"], "t", "s", 0.25).orderBy("s").collect()] == [1, 4, 7]
    p = excursions(spark.createDataFrame([("m", i, b) for i, b in enumerate([0.2, 0.7, 0.3, 0.7, 0.5])], "m string, i long, b double"), ["m"], ["i"], "b", ["i"]).first()
    assert (p.peak, p.trough, p.post_peak_low, p.peak_i) == (0.7, 0.2, 0.3, 1)


def test_fold_matches_a_loop(spark):
    rows = [(k, i, random.Random(i * 7 + ord(k)).gauss(0, 1), i % 2) for k in "ab" for i in range(200)]
    step = lambda h, r: {"k": r.k, "i": r.i, "p": h.learn((r.z,), None, int(r.y))[0]}
    start = lambda: models.Ensemble(uses=((0,),), weight=[[1.8]])
    got = {(r.k, r.i): r.p for r in fold_per_key(spark.createDataFrame(rows, "k string, i long, z double, y int"), ["k"], ["i"], start, step, "k string, i long, p double").collect()}
    for k in "ab":
        w, b, seen = 1.8, 0.0, []
        for _, i, z, y in (r for r in rows if r[0] == k):
            seen.append(z)
            x = (z - np.mean(seen)) / np.std(seen) if len(seen) > 5 else z
            p = 1 / (1 + math.exp(-(b + w * x)))
            assert got[k, i] == pytest.approx(p, rel=1e-9)
            w, b = w - 0.04 * (p - y) * x, b - 0.04 * (p - y)


@given(st.floats(0.02, 0.98), st.lists(st.tuples(st.floats(-3, 3), st.integers(0, 1)), max_size=40))
@settings(max_examples=40, deadline=None)
def test_tilt_is_capped(mid, history):
    m = models.Predictor()
    for z, y in history:
        made = m.predict((z, 2.0, z, 0.3, -z, 0.1), mid)
        assert abs(models.logit(made["p_up"]) - models.logit(mid)) <= 0.4 + 1e-6 and 0 <= made["p_cal"] <= 1
        m.learn(made, y)


def test_predictor_matches_its_equations():
    rng = random.Random(8)
    rows = [(dict(zip(models.FEATURES, (rng.gauss(0, 2), rng.uniform(0, 6), rng.gauss(0, 1), rng.random(), rng.uniform(-1, 1), abs(rng.gauss(0.1, 0.1))), strict=True)), rng.uniform(0.05, 0.95), rng.randrange(2)) for _ in range(250)]
    m, got = models.Predictor(), []
    for x, mid, y in rows:
        made = m.predict(tuple(x[f] for f in models.FEATURES), mid)
        got.append((made["p_up"], made["p_cal"], made["temperature"], made["regime"]))
        m.learn(made, y, "b")
    events = [e for i, (x, mid, y) in enumerate(rows) for e in (("predict", i, x, mid), ("learn", i, y))]
    for a, b in zip(got, plain.predictor(events), strict=True):
        assert a[:3] == pytest.approx(b[1:4], rel=1e-7) and a[3] == b[4]
    assert m.buckets["b"][0] == 250 and {g[3] for g in got} > {"panic", "high_vol/trend"}


def test_models():
    c = models.Calibration()
    for _ in range(5000):
        c.learn(0.55, 1)
    c.n[5] *= 3
    c.w[5] *= 3
    rate = c.w[5] / c.n[5]
    c.clamp()
    assert c.n[5] == pytest.approx(200) and c.w[5] / c.n[5] == pytest.approx(rate)
    s = models.Skill()
    assert s.assess()[0] == "WARMUP"
    for i in range(200):
        s.learn(0.6 if i % 2 else 0.4, 0.5, i % 2)
    assert s.assess()[0] == "SKILL"
    book = {}
    assert models.l2_apply(book, "book", [("0.40", "10")], [("0.45", "5")], []) == (0.4, 0.45)
    assert models.l2_apply(book, "price_change", [], [], [("BUY", "0.42", "3"), ("SELL", "0.45", "0")]) == (0.42, None)


def test_statistics(spark):
    rng = np.random.default_rng(2)
    truth = (rng.random(600) < 0.03).cumsum() % 2
    m = statistics.hmm_fit(np.where(truth, 1.0, -1.0) + rng.normal(size=600) * 0.5, 2)
    path = statistics.viterbi(np.where(truth, 1.0, -1.0) + rng.normal(size=600) * 0.5, m)
    assert (path == truth).mean() > 0.9 and m["mu"][0] < m["mu"][1]
    xs = np.column_stack([np.ones(4000), rng.normal(size=4000)])
    b = statistics.irls(xs, (rng.random(4000) < 1 / (1 + np.exp(-(0.3 + 0.8 * xs[:, 1])))).astype(float))
    assert b == pytest.approx([0.3, 0.8], abs=0.15) and statistics.irls(xs[:9], np.ones(9)) is None
    assert float(statistics.lower_gamma(1.0, 2.0)) == pytest.approx(1 - math.exp(-2)) and float(statistics.lower_gamma(0.5, 9.0)) == pytest.approx(math.erf(3.0))
    # shape 2 is the normal, shape 1 the Laplace distribution; another shape by integrating its density
    z = np.array([-3.0, -0.4, 0.0, 0.7, 2.5])
    assert statistics.gennorm_up(z, 2.0, 1.0) == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    assert statistics.gennorm_up(z, 1.0, 0.5) == pytest.approx([1 - 0.5 * math.exp(-2 * v) if v >= 0 else 0.5 * math.exp(2 * v) for v in z])
    t = np.linspace(-60, 60, 2_000_001)
    density = np.exp(-np.abs(t) ** 1.5 / 1.5)
    assert statistics.gennorm_up(z, 1.5, 1.0) == pytest.approx([density[t >= -v].sum() / density.sum() for v in z], abs=5e-5)
    assert statistics.gennorm_up(1.0, 0.0, 1.0) == statistics.gennorm_up(1.0, 1.5, 0.0) == 0.5
    for r, p in ((0.02, 0.2), (0.3, 0.05)):
        assert statistics.gennorm_up(-r, 1.5, statistics.implied_scale(r, p, 1.5)) == pytest.approx(p)
    assert np.isnan(statistics.implied_scale([0.0, 0.1], [0.3, 1.0], 1.5)).all()
    assert abs(simulated_returns(spark, 2000).agg(F.stddev("r").alias("s")).first()["s"] - 0.01) < 0.001


def test_hidden_markov_scan():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(3, 0.5, 83), rng.normal(0, 1, 70)])
    m = statistics.hmm_fit(x, 2, rounds=7, restarts=3)
    e = statistics._emission(x, m["mu"], m["sigma"])
    rows, scale = statistics._scan(m["pi"], m["trans"], e)
    assert np.log(scale).sum() == pytest.approx(plain.forward(x, m), rel=1e-9) and rows.sum(1) == pytest.approx(np.ones(len(x)))
    path = statistics.viterbi(x, m)
    assert (path[:140] == 0).all() and (path[160:225] == 1).all()
    # a round of learning never lowers the likelihood
    ll = [statistics._hmm_once(x, 2, r, 0.0, None)["loglik"] for r in range(1, 12)]
    assert all(b >= a - 1e-9 for a, b in zip(ll, ll[1:], strict=False))
    assert statistics.hmm_fit(x, 2, restarts=3)["loglik"] >= statistics.hmm_fit(x, 2)["loglik"]


def test_har_walk_matches_a_loop():
    rng = np.random.default_rng(3)
    rv, ret = rng.gamma(2, 1, 140), rng.normal(0, 1, 140)
    for window in (60, 400):
        beta, want = None, []
        for t in range(len(rv)):
            held = list(range(max(0, t - window), t))
            if beta is not None and len(held) >= 22 and t >= 23:
                f = beta @ [1, rv[t - 1], np.mean(rv[t - 5 : t]), np.mean(rv[t - 22 : t]), min(ret[t - 1], 0) ** 2]
                want.append(min(max(f, 0), 5 * rv[: t + 1].max()))
            held = list(range(max(0, t + 1 - window), t + 1))
            rows = [i for i in held if i - held[0] >= 22 and i < t]
            if t % 5 == 0 and len(held) >= 27 and len(rows) >= 7:
                x = np.array([[1, rv[i], np.mean(rv[i - 4 : i + 1]), np.mean(rv[i - 21 : i + 1]), min(ret[i], 0) ** 2] for i in rows])
                beta = np.linalg.lstsq(x, rv[np.array(rows) + 1], rcond=None)[0]
        got, r2 = statistics.har_walk(rv, ret, window=window)
        assert got == pytest.approx(want, rel=1e-6) and r2 < 1
    assert statistics.har_walk(rv[:25], ret[:25])[0] == []


def test_regressions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2)) * [1, 30] + [0, 5]
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 + x[:, 0] - 0.03 * x[:, 1])))).astype(float)
    rows = [(i // 80, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "fold int, a double, b double, y double")
    fits = statistics.expanding_logit(df, "fold", ["a", "b"], "y", 5)
    assert set(fits) == {1, 2, 3, 4}
    for f, b in fits.items():
        assert b == pytest.approx(statistics.irls(np.column_stack([np.ones(80 * f), x[: 80 * f]]), y[: 80 * f]), rel=1e-3)
    assert statistics.expanding_logit(df.withColumn("y", F.lit(1.0)), "fold", ["a"], "y", 5) == {} and statistics.expanding_logit(df.limit(0), "fold", ["a"], "y", 5) == {}
    got = statistics.ols(df.withColumn("one", F.lit(1.0)), ["one", "a", "b"], "y")
    assert list(got.values()) == pytest.approx(np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0], rel=1e-8)
    betas = spark.createDataFrame([(p, "u", v) for p, v in enumerate([1.0, 2.0, 4.0, None, math.nan])], "period int, term string, beta double")
    (r,) = statistics.fama_macbeth(betas).collect()
    assert (r.periods, r.mean, r.t) == (3, pytest.approx(7 / 3), pytest.approx((7 / 3) / (np.std([1, 2, 4], ddof=1) / math.sqrt(3))))


def test_generators(spark):
    r = np.array([x.r for x in simulated_autoregression(spark, 30_000, 0.4).orderBy("i").collect()])
    assert len(r) == 30_000 and np.corrcoef(r[1:], r[:-1])[0, 1] == pytest.approx(0.4, abs=0.03)
    assert r.std() == pytest.approx(0.01 / math.sqrt(1 - 0.16), rel=0.05)
    # shocks recovered from the series don't depend on each other, also where stretches meet
    e = r[1:] - 0.4 * r[:-1]
    assert abs(np.corrcoef(e[1:], e[:-1])[0, 1]) < 0.03 and np.abs(e).max() < 0.06
    j = simulated_jumps(spark, 20_000).toPandas()
    assert 10 < j.jump.sum() < 80 and (j.r.abs() > 0.06).equals(j.jump)
    g = simulated_regimes(spark, 10_000).toPandas()
    assert g[g.regime == 1].r.std() > 3 * g[g.regime == 0].r.std() and (g.regime.diff().abs() == 1).sum() == 19


def test_flags_and_layouts(tmp_path):
    flag = tmp_path / "due"
    assert write_flag(str(flag), True, "now") and flag.read_text() == "now"
    assert not write_flag(str(flag), False) and not flag.exists() and not write_flag(str(flag), False)
    assert candle_path("d", "BTC") == "d/BTC/BTCUSDT_1m.csv" and candle_path("d", "ETH", {"ETH": "ETHUSDT"}) == "d/ETHUSDT_1m.csv" and candle_path("d", "X", {}) is None


def test_scores_on_a_users_frame(spark):
    """Any columns and groups: scores against plain formulas, with ties, one-sided groups and missing values."""
    rng = random.Random(9)
    rows = [(rng.choice("ab"), round(rng.random(), 1), rng.randrange(2)) for _ in range(300)] + [("c", 0.3, 1), ("c", 0.9, 1), (None, 0.2, 1), (None, 0.1, 0), ("a", None, 1)]
    df = spark.createDataFrame(rows, "model string, prob double, hit int")
    s = {r.model: r for r in scores.forecast_scores(df, ["model"], "prob", "hit").collect()}
    u = {r.model: r.auc for r in scores.auc(df, ["model"], "prob", "hit", buckets=7).collect()}
    for m in ("a", "b", "c", None):
        part = [(p, y) for k, p, y in rows if k == m and p is not None]
        assert s[m].n == len(part) and s[m].brier == pytest.approx(np.mean([(p - y) ** 2 for p, y in part]))
        q = [min(max(p, 1e-6), 1 - 1e-6) for p, _ in part]
        assert s[m].logloss == pytest.approx(-np.mean([math.log(v if y else 1 - v) for v, (_, y) in zip(q, part, strict=True)]))
        pos, neg = [p for p, y in part if y], [p for p, y in part if not y]
        assert u[m] == (pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])) if pos and neg else None)
    table = scores.reliability(df, "prob", "hit", bins=4).orderBy("bin").collect()
    assert [r.n for r in table] == [sum(p is not None and min(int(p * 4), 3) == b for _, p, _ in rows) for b in range(4)]
    card = {r.who: r for r in scores.scorecard(df.where("model <> 'c'").withColumnRenamed("model", "who"), p="prob", y="hit", benchmark="a").collect()}
    assert card["a"].verdict == "benchmark" and card["b"].verdict == ("beats market" if card["b"].brier < card["a"].brier else "behind market")
    assert scores.auc(df.limit(0), ["model"], "prob", "hit").count() == scores.forecast_scores(df.limit(0), ["model"], "prob", "hit").count() == 0


def test_variance_on_a_users_frame(spark):
    rng = np.random.default_rng(8)
    r = rng.normal(0, 0.01, 900)
    r[[300, 600]] += 0.2
    prices = np.exp(np.cumsum(r)) * 50
    rows = [("x", i, float(p)) for i, p in enumerate(prices)] + [("y", 0, 5.0), ("y", 1, 0.0), ("y", 2, -1.0), ("y", 3, 7.0), ("z", 0, 1.0)]
    df = spark.createDataFrame(rows, "coin string, step long, px double").withColumn("ret", variance.log_return("px", ["coin"], ["step"]))
    assert df.where("coin <> 'x' and ret is not null").count() == 0
    got = np.array([x.ret for x in df.where("coin = 'x' and ret is not null").orderBy("step").collect()])
    assert got == pytest.approx(r[1:])
    flags = {x.step for x in variance.jumps(df, ["coin"], ["step"], "ret").where("jump = 1").collect()}
    assert flags == {300, 600}
    d = variance.decompose(df, ["coin"], ["step"], "step", "ret").where("coin = 'x'").first()
    assert (d.jumps, d.rv) == (2, pytest.approx((r[1:] ** 2).sum())) and d.jv == pytest.approx(r[300] ** 2 + r[600] ** 2)
    assert d.bv == pytest.approx(math.pi / 2 * (np.abs(r[1:-1]) * np.abs(r[2:])).sum()) and d.jump_share > 0.4
    v = variance.realized_variance(df, ["coin"], ["step"], "ret").where("coin = 'x'").first()
    e = got - got.mean()
    assert v.ac1 == pytest.approx(max((got**2).sum() + 2 * (e[1:] * e[:-1]).sum(), 0.25 * (got**2).sum()))
    bars = variance.fixed_bars(df, ["coin"], ["step"], "ret", 20)
    assert bars.count() == 44 and variance.har_features(bars, ["coin"]).count() == 44 - 22 - 1


def test_running_sum_and_throttle(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(400), i, rng.choice([None, 1.5, -2.0, 3.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "t long, i long, v double")
    got = {r.i: r.s for r in running_sum(df, ["t", "i"], "v", "floor(t / 50)", "s").collect()}
    total = 0.0
    for _, i, v in sorted(rows, key=lambda r: r[:2]):
        total += v or 0.0
        assert got[i] == pytest.approx(total)
    assert running_sum(df.limit(0), ["t", "i"], "v", "floor(t / 50)", "s").count() == 0
    events = [(rng.choice("abc"), rng.randrange(2000), i) for i in range(700)] + [("a", None, 9999)]
    got = sorted((r.k, r.i) for r in throttle(spark.createDataFrame(events, "k string, t long, i long"), ["k"], "t", "i", 40).collect())
    want, last = [], {}
    for k, t, i in sorted((e for e in events if e[1] is not None), key=lambda e: (e[0], e[1], e[2])):
        if t - last.get(k, -1e9) >= 40:
            last[k] = t
            want.append((k, i))
    assert got == sorted(want)


def test_sources(spark, tmp_path):
    d = tmp_path / "runs" / "run1" / "BTC"
    d.mkdir(parents=True)
    (d / "t.jsonl").write_text('{"record_type":"paper_trade_settled","venue":"kalshi","avg_entry_price":0.4,"raw_model_probability":0.6,"quantity":3}\nnot json\n{"record_type":"other"}\n')
    (r,) = settled_jsonl(spark, str(tmp_path / "runs")).collect()
    assert (r.run, r.asset, r.entry_price, r.prob, r.contracts, r.fee) == ("run1", "BTC", 0.4, 0.6, 3.0, None)
    (tmp_path / "c.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01 00:00:00,1,2,0,1.5,9\n2024-01-01T00:01:00Z,2,2,2,2.5,9\n2020-01-01 00:00:00,1,1,1,1,1\n")
    assert [(r.epoch, r.open, r.close) for r in candles(spark, str(tmp_path / "c.csv"), 1_600_000_000).orderBy("epoch").collect()] == [(1704067200, 1.0, 1.5), (1704067260, 2.0, 2.5)]
    (tmp_path / "lanes.conf").write_text("# lanes\na | dir_a | --x\nb | dir_b | --y\n")
    assert [(r.name, r.data_dir) for r in lane_config(spark, str(tmp_path / "lanes.conf")).orderBy("name").collect()] == [("a", "dir_a"), ("b", "dir_b")]
    (tmp_path / "lane_a").mkdir()
    write_snapshot({"updated": "x", "config": {"name": "a"}, "performance": {"equity": 5.0}, "open_positions": [{"asset": "BTC", "cost": 2.0}]}, str(tmp_path / "lane_a" / "status.json"))
    (r,) = lanes(spark, str(tmp_path / "lane_*" / "status.json")).collect()
    assert (r.lane, r.equity, r.pnl_today, r.asset, r.cost) == ("a", 5.0, None, "BTC", 2.0)
    append_rows(spark.createDataFrame([(1, "x")], "id long, other string"), str(tmp_path / "t"), "id long, pnl double")
    assert spark.read.parquet(str(tmp_path / "t")).collect() == [(1, None)]
    assert json.loads((tmp_path / "lane_a" / "status.json").read_text())["updated"] == "x"


@pytest.fixture
def split(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i, p in enumerate(sorted(r.d for r in e.select(F.to_date("ts").alias("d")).distinct().collect())[:6]):
        e.where(F.to_date("ts") == F.lit(p)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    return str(tmp_path / "in")


def test_stream_equals_batch(spark, split, tmp_path):
    t = event_stream(spark, split)
    run_once(bars(t, "1 hour").writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "bars")), str(tmp_path / "c1"))
    batch = spark.read.parquet(split).selectExpr("event_id as seq", "event_type as asset", "cast(ts as timestamp) as ts", "value as price")
    want = {(r.asset, r.start): (r.n, r.open, r.close) for r in batch.groupBy(F.window("ts", "1 hour").start.alias("start"), "asset").agg(F.count("*").alias("n"), F.min_by("price", "seq").alias("open"), F.max_by("price", "seq").alias("close")).collect()}
    got = {(r.asset, r.start): (r.n, r.open, r.close) for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    last = max(k[1] for k in want)
    assert got == {k: v for k, v in want.items() if k in got} and {k for k in want if k[1] < last} <= set(got)

    run_once(upsert_latest(t, str(tmp_path / "latest"), ["asset"], "seq"), str(tmp_path / "c2"))
    versions = sorted((p for p in (tmp_path / "latest").iterdir()), key=lambda p: int(p.name[2:]))
    assert {(r.asset, r.seq) for r in spark.read.parquet(str(versions[-1])).collect()} == {(r.asset, r.s) for r in batch.groupBy("asset").agg(F.max("seq").alias("s")).collect()}

    run_once(insert_first(t, str(tmp_path / "first"), ["asset"], "seq"), str(tmp_path / "c3"))
    assert {(r.asset, r.seq) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "first")).collect()} == {(r.asset, r.s) for r in batch.groupBy("asset").agg(F.min("seq").alias("s")).collect()}

    step = lambda m, r: m.add(r.price) or {"asset": r.asset, "seq": r.seq, "mean": m.mean}
    run_once(fold_stream(t, "asset", "seq", models.Moments, step, "asset string, seq long, mean double").writeStream.format("parquet").option("path", str(tmp_path / "fold")), str(tmp_path / "c4"))
    want = {(r.asset, r.seq): r.mean for r in fold_per_key(batch.select("asset", "seq", "price"), ["asset"], ["seq"], models.Moments, step, "asset string, seq long, mean double").collect()}
    assert {(r.asset, r.seq): r.mean for r in spark.read.parquet(str(tmp_path / "fold")).collect()} == want


def test_position():
    p = models.Position("up", 0.4, passive=10, aggressive=5, aggressive_price=0.5, fee=0.018)
    assert p.on_quote(0.45, 0.47) == "open" and not p.filled
    assert p.on_quote(0.38, 0.40) == "open" and p.filled
    assert p.on_quote(0.91, 0.93, {"t": 3}) == "took_profit" and p.on_quote(0.7, 0.72) == "took_profit"
    assert (p.peak, p.trough, p.after_peak, p.peak_row) == (0.91, 0.38, 0.7, {"t": 3})
    r = p.settle(101.0, 100.0)
    assert r["pnl"] == pytest.approx((1 - 0.5 - 0.018) * 5 + 0.6 * 10) and r["tp_pnl"] == pytest.approx((0.9 - 0.5 - 0.018) * 5 + 0.5 * 10)
    assert models.Position("down", 0.3, passive=2).settle(100.0, 100.0) == {"outcome_up": 0, "filled": 0, "won": None, "pnl": None, "tp_pnl": None}
