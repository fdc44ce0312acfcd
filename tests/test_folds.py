"""Queries without SQL, on whole small tables, against plain loops over the same rows."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark import TaskContext

import plain
from tidemark import registry
from tidemark.functions import blocks, models, statistics
from tidemark.operators import fold_blocks
from tidemark.plans import folds
from tidemark.plans.dialect import view

SF = "/root/testdata/sf0.001"
CHECKED = set()


def rows(spark, name):
    CHECKED.add(name)
    return registry.queries()[name](spark, SF).collect()


def by(items, key):
    out = defaultdict(list)
    for r in items:
        out[key(r)].append(r)
    return out


@pytest.fixture(scope="module")
def calib(spark):
    return folds._calib(spark, SF).collect()


def sig(v):
    return 1 / (1 + math.exp(-v))


def moments(seen, value):
    """Standardised from six values on."""
    if len(seen) <= 5:
        return value
    sd = np.std(seen)
    return (value - np.mean(seen)) / (sd if sd > 1e-9 else 1.0)


def test_online_and_fair_value_heads(spark, calib):
    online = {(r.asset, r.id): (r.p, r.reliability) for r in rows(spark, "online_head")}
    fair = {(r.asset, r.id): (r.p, r.k, r.reliability) for r in rows(spark, "fair_value_head")}
    assert len(online) == len(fair) == len(calib)
    for asset, part in by(calib, lambda r: r.asset).items():
        w, b, s, k, t, zs, cs = [1.8, 0.0], 0.0, -0.6931, 0.5, -0.6931, [], []
        for r in sorted(part, key=lambda r: (r.ts_us, r.id))[:400]:
            zs.append(r.z_dist)
            cs.append(r.confidence)
            x = [moments(zs, r.z_dist), moments(cs, r.confidence)]
            p = sig(b + w[0] * x[0] + w[1] * x[1])
            w, b = [v - 0.04 * (p - r.outcome_up) * u for v, u in zip(w, x, strict=True)], b - 0.04 * (p - r.outcome_up)
            s = 0.97 * s + 0.03 * math.log(max(p if r.outcome_up else 1 - p, 1e-6))
            assert online[asset, r.id] == pytest.approx((p, math.exp(s)), rel=1e-6)
            mid = min(max(r.market_mid, 1e-4), 1 - 1e-4)
            q = sig(math.log(mid / (1 - mid)) + k * x[0])
            k = min(4.0, max(0.0, k - 0.03 * (q - r.outcome_up) * x[0]))
            t = 0.97 * t + 0.03 * math.log(max(q if r.outcome_up else 1 - q, 1e-6))
            assert fair[asset, r.id] == pytest.approx((q, k, math.exp(t)), rel=1e-6)


def test_prequential_model(spark, calib):
    got = {(r.asset, r.id): (r.p_up, r.p_cal, r.temperature, r.regime) for r in rows(spark, "prequential_model")}
    assert len(got) == len(calib)
    minutes = {"5m": 5, "15m": 15, "1h": 60, "4h": 240, "1D": 1440}
    for asset, part in by(calib, lambda r: r.asset).items():
        events = []
        for r in part:
            x = {"z_dist": r.z_dist, "log_tau": math.log(minutes[r.tf]), "momentum": 10 * (r.p_cal - r.market_mid), "efficiency": r.move_prob, "ob_imbalance": 4 * r.confidence - 1, "realized_vol": 0.05 + abs(r.p_cal - r.market_mid)}
            events += [(r.ts_us, 1, r.id, "predict", x, r.market_mid), (r.ts_us + 3_605_000_000, 0, r.id, "learn", int(r.outcome_up))]
        events.sort(key=lambda e: e[:3])
        for key, *want in plain.predictor([(e[3], e[2], *e[4:]) for e in events[:500]]):
            a = got[asset, key]
            assert a[:3] == pytest.approx(want[:3], rel=1e-6) and a[3] == want[3]


@pytest.mark.parametrize(("rows", "step"), [(1, 200), (37, 40), (37, 900), (700, 1), (700, 4000), (150, 0)])
def test_delayed_model_over_blocks(rows, step):
    """Blocks of any size, times that are mostly equal or all different, waits of many rows or of none: as event by event."""
    rng = random.Random(rows + step)
    at, t = [], 0
    for i in range(700):
        t += step * (rng.random() < 0.02) * 50 if step == 4000 else rng.randrange(step) if step else 10**4 * (i == 600)
        at.append(t)
    x = [(rng.gauss(0, 2), rng.uniform(0, 6), rng.gauss(0, 1), rng.choice([0.2, 0.45, rng.random()]), rng.uniform(-1, 1), 0.1 + abs(rng.gauss(0, 0.1)) * (rng.random() < 0.8)) for _ in at]
    mid, y = [rng.uniform(0.01, 0.99) for _ in at], [rng.randrange(2) for _ in at]
    model, want = models.Predictor(), []
    open_ = {}
    for _, kind, i in sorted([(t, 1, i) for i, t in enumerate(at)] + [(t + 3605, 0, i) for i, t in enumerate(at)]):
        if kind:
            open_[i] = model.predict(x[i], mid[i])
            want.append(open_[i])
        else:
            model.learn(open_.pop(i), y[i])
    state, got = blocks.Delayed(3605), []
    for k in range(0, len(at), rows):
        some = slice(k, k + rows)
        made = state.run(np.array(at[some]), np.array(x[some]), np.array(mid[some]), np.array(y[some], float))
        got += [dict(zip(made, v, strict=True)) for v in zip(*made.values(), strict=True)]
    for a, b in zip(got, want, strict=True):
        assert all(a[c] == pytest.approx(b[c], rel=1e-9) for c in ("p_up", "p_cal", "move_prob", "temperature", "confidence")) and a["regime"] == b["regime"]
    assert len({r["regime"] for r in want}) > 5 or step == 1


def test_heads_over_blocks():
    """Heads of one, two and three features, with and without a market's odds: as row by row, with the state left behind."""
    rng = np.random.default_rng(2)
    x, mid, y = rng.normal(size=(600, 3)) * [1, 5, 0.1], rng.uniform(0.01, 0.99, 600), rng.integers(0, 2, 600).astype(float)
    for m in (mid, None):
        one, other = (models.Ensemble(uses=((0,), (2, 1), (0, 1, 2)), weight=[[1.8], [0.4, 0.0], [0.1, 0.2, 0.3]]) for _ in range(2))
        want = [one.learn(tuple(v), None if m is None else m[i], int(y[i])) for i, v in enumerate(x)]
        got = [blocks.learn(other, x[s], None if m is None else m[s], y[s]) for s in (slice(0, 3), slice(3, 300), slice(300, 300), slice(300, 600))]
        assert np.concatenate([g.p for g in got]) == pytest.approx(np.array(want), rel=1e-9)
        for f in ("n", "k", "mean", "m2", "bias", "score"):
            assert getattr(other, f) == pytest.approx(getattr(one, f), rel=1e-9)
        assert all(a == pytest.approx(b, rel=1e-9) for a, b in zip(other.weight, one.weight, strict=True))


def test_folds_take_blocks_and_each_key_a_task(spark, monkeypatch):
    """No row is handed to Python code by itself; keys don't share partitions, null is a key, an unknown one an error."""
    monkeypatch.setattr("tidemark.operators.folds.BLOCK", 8)
    df = spark.range(200).selectExpr("id", "case when id % 3 > 0 then concat('k', id % 3) end as k", "200 - id as t")
    step = lambda state, rows: (state.append(len(rows)), rows.assign(n=len(state), task=TaskContext.get().partitionId())[["id", "n", "task"]])[1]
    got = fold_blocks(df, "k", ["k1", "k2"], ["t"], list, step, "k string, id long, n long, task long").collect()
    assert len(got) == 200 and len({(r.k, r.task) for r in got}) == len({r.task for r in got}) == 3
    for part in by(got, lambda r: r.k).values():
        assert [r.id for r in part] == sorted((r.id for r in part), reverse=True) and [r.n for r in part] == sorted(r.n for r in part)
    with pytest.raises(Exception, match="wasn't named"):
        fold_blocks(df, "k", ["k1"], ["t"], list, step, "k string, id long, n long, task long").collect()
    for name in ("prequential_model", "online_head", "fair_value_head"):
        monkeypatch.setattr(folds, "fold_per_key", None)
        registry.queries()[name](spark, SF)


def test_har(spark):
    larger = "/root/testdata/sf0.01"
    bars = by(registry.queries()["bar_rv"](spark, larger).collect(), lambda r: r.asset)
    CHECKED.add("har_walkforward")
    for r in registry.queries()["har_walkforward"](spark, larger).collect():
        part = sorted(bars[r.asset], key=lambda b: b.bar)
        f, r2 = statistics.har_walk(np.array([b.rv for b in part]), np.array([b.ret for b in part]))
        assert r.n == len(f) > 20 and r.r2 == pytest.approx(r2) and r.last_forecast == pytest.approx(f[-1])
    design = registry.queries()["har_design"](spark, larger).toPandas()
    x = np.column_stack([np.ones(len(design)), design[["rv", "rv5", "rv22", "lev"]]])
    got = {r.term: r.beta for r in registry.queries()["har_ols"](spark, larger).collect()}
    CHECKED.add("har_ols")
    assert [got[t] for t in ("one", "rv", "rv5", "rv22", "lev")] == pytest.approx(np.linalg.lstsq(x, design["target"], rcond=None)[0], rel=1e-5)


def newton(x, y):
    """Logistic regression, one matrix solve a round."""
    b = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-9)) @ x, x.T @ (y - p))
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b


def test_daily_regressions(spark, calib):
    day = lambda r: r.ts_us - r.ts_us % 86_400_000_000
    want = {}
    for period, part in by(calib, day).items():
        x = np.array([[math.log(r.market_mid / (1 - r.market_mid)), r.z_dist, r.p_cal - r.market_mid] for r in part])
        y = np.array([r.outcome_up for r in part], float)
        if len(y) >= 5 and 0 < y.mean() < 1:
            try:
                want[period] = newton(np.column_stack([np.ones(len(y)), (x - x.mean(0)) / x.std(0, ddof=1)]), y)
            except np.linalg.LinAlgError:
                continue
    got = defaultdict(dict)
    for r in rows(spark, "irls_logit"):
        got[r.period][r.term] = r.beta
    terms = ["one", "market_logit", "z_dist", "edge"]
    # days without a finite maximum run off to large values, in which rounding shows
    calm = {p for p, b in want.items() if np.isfinite(b).all() and np.abs(b).max() < 20}
    assert len(calm) > 20
    for p in calm:
        assert [got[p][t] for t in terms] == pytest.approx(want[p], rel=1e-3, abs=1e-4)
    one_sided = {p for p, part in by(calib, day).items() if len({r.outcome_up for r in part}) < 2 or len(part) < 5}
    assert one_sided and all(v is None for p in one_sided for v in got[p].values())
    fit = {t: np.array([b[t] for b in got.values() if b[t] is not None]) for t in terms}
    for r in rows(spark, "fama_macbeth"):
        b = fit[r.term]
        assert (r.periods, r.mean, r.se) == (len(b), pytest.approx(b.mean(), rel=1e-9), pytest.approx(b.std(ddof=1) / math.sqrt(len(b)), rel=1e-9))


def test_out_of_sample(spark, calib):
    part = sorted(calib, key=lambda r: (r.ts_us, r.id))
    x = np.array([[math.log(r.market_mid / (1 - r.market_mid)), r.z_dist, r.p_cal - r.market_mid] for r in part])
    y, size = np.array([r.outcome_up for r in part], float), len(part) // 5
    got = {r.fold: r for r in rows(spark, "oos_validation")}
    assert set(got) == {1, 2, 3, 4}
    for f, r in got.items():
        test = slice(f * size, (f + 1) * size if f < 4 else len(part))
        mu, sd = x[: f * size].mean(0), x[: f * size].std(0, ddof=1)
        b = newton(np.column_stack([np.ones(f * size), (x[: f * size] - mu) / sd]), y[: f * size])
        p = 1 / (1 + np.exp(-np.column_stack([np.ones(len(y[test])), (x[test] - mu) / sd]) @ b))
        assert (r.n, r.brier) == (len(p), pytest.approx(((p - y[test]) ** 2).mean(), rel=1e-5))
        assert r.logloss == pytest.approx(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean(), rel=1e-5)


def test_hidden_markov_queries(spark):
    series = {a: np.array([r.r for r in sorted(p, key=lambda r: r.seq)]) for a, p in by(registry.queries()["log_returns"](spark, SF).collect(), lambda r: r.asset).items()}
    fit, bic, path = (by(rows(spark, n), lambda r: r.asset) for n in ("hmm_fit", "hmm_bic", "hmm_viterbi"))
    assert set(fit) == set(bic) == set(path) == set(series)
    for a, x in series.items():
        lo, hi = sorted(fit[a], key=lambda r: r.state)
        assert lo.mu <= hi.mu and lo.loglik == hi.loglik and 0 < lo.stay < 1
        k = {r.k: r for r in bic[a]}
        # one state has a closed form; more states never fit worse
        assert k[1].loglik == pytest.approx(-0.5 * len(x) * (math.log(2 * math.pi * x.var()) + 1), rel=1e-6)
        assert k[1].loglik <= k[2].loglik + 1e-6 and k[2].loglik == pytest.approx(lo.loglik)
        assert all(r.bic == pytest.approx(-2 * r.loglik + (r.k**2 + r.k - 1) * math.log(len(x))) for r in k.values())
        model = {"mu": [lo.mu, hi.mu], "sigma": [lo.sigma, hi.sigma], "trans": [[lo.stay, 1 - lo.stay], [1 - hi.stay, hi.stay]], "pi": [0.5, 0.5]}
        assert plain.forward(x, model) == pytest.approx(lo.loglik, abs=1.5)  # but for the first row's probabilities
        states = [r.state for r in sorted(path[a], key=lambda r: r.seq)]
        assert len(states) == len(x)

        def weight(s, x=x, m=model):
            e = sum(-0.5 * ((v - m["mu"][k]) / m["sigma"][k]) ** 2 - math.log(m["sigma"][k]) for v, k in zip(x, s, strict=True))
            return e + sum(math.log(m["trans"][i][j]) for i, j in zip(s, s[1:], strict=False))

        assert all(weight(states) >= weight([*states[:i], 1 - states[i], *states[i + 1 :]]) - 1e-6 for i in range(1, len(x)))


def test_generalised_normal_queries(spark):
    d = {i: part[0] for i, part in by(view(spark, SF, "decisions").collect(), lambda r: r.id).items() if len(part) == 1}
    t = np.linspace(-80, 80, 400_001)
    for r in [r for r in rows(spark, "gennorm_prob") if r.id in d][:40]:
        shape = 1.2 + d[r.id].confidence
        density = np.exp(-np.abs(t) ** shape / shape)
        assert r.p == pytest.approx(density[t >= -d[r.id].z_dist].sum() / density.sum(), abs=2e-4)
    density = np.exp(-np.abs(t) ** 1.5 / 1.5)
    tail = np.cumsum(density[::-1])[::-1] / density.sum()
    n = 0
    for r in rows(spark, "implied_scale"):
        if r.id not in d:
            continue
        z, p = d[r.id].z_dist / 100, d[r.id].p_cal
        if 2e-6 < r.scale < 0.99:
            n += 1
            assert np.interp(z / r.scale, t, tail) == pytest.approx(p, abs=1e-3)
        else:  # no scale in range gives p: the strike lies on the other side, or the market is too sure
            assert (p - 0.5) * z >= 0 or np.interp(z, t, tail) <= p + 1e-3 or np.interp(z * 1e5, t, tail) >= p
    assert n > 50


def test_positions(spark):
    quotes = by(view(spark, SF, "quotes").collect(), lambda r: r.market)
    got = {(r.market, r.seq): r for r in rows(spark, "position_machine")}
    for market, part in quotes.items():
        part = sorted(part, key=lambda r: (r.ts_us, r.seq))
        first = part[0]
        mid = 0.5 if first.up_bid is None or first.up_ask is None else (first.up_bid + first.up_ask) / 2
        up, filled, bids = bool(first.seq % 2), False, []
        for r in part:
            bid = r.up_bid if up else None if r.up_ask is None else 1 - r.up_ask
            ask = r.up_ask if up else None if r.up_bid is None else 1 - r.up_bid
            filled = filled or (ask is not None and ask <= mid - 0.02 + 1e-9)
            if filled and bid is not None:
                bids.append(bid)
            state = "resting" if not filled else "took_profit" if bids and max(bids) >= 0.9 - 1e-9 else "open"
            a = got[market, r.seq]
            peak = max([0.0, *bids])
            after = min(bids[bids.index(peak) :]) if peak in bids else None
            assert (a.state, a.peak) == (state, pytest.approx(peak))
            assert (a.trough, a.after_peak) == (None, None) if not bids else (a.trough, a.after_peak) == (pytest.approx(min(bids)), pytest.approx(after))


def test_every_query_without_sql_is_checked():
    assert CHECKED == set(registry.queries()) - set(registry.oracle_sql())
