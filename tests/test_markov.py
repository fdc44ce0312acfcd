"""Hidden Markov models in parts against the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions.statistics import hmm_fit, viterbi
from tidemark.operators import markov
from tidemark.operators.selection import ranks
from tidemark.plans import folds


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(6)
    out = {}
    for name, n in (("a", 400), ("b", 90), ("c", 1)):
        state = np.cumsum(rng.random(n) < 0.05) % 2
        out[name] = np.where(state == 0, rng.normal(-1, 0.5, n), rng.normal(1.5, 1.0, n))
    return out


@pytest.fixture(scope="module")
def rows(spark, series):
    return spark.createDataFrame([(k, i + 1, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, i long, v double").repartition(3)


def test_products_and_counts_of_parts_are_those_of_the_series(series):
    x = series["a"]
    m = markov.Model(np.array([0.3, 0.5, 0.2]), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.3, 0.4]]), np.array([-1.0, 0.0, 2.0]), np.array([0.5, 1.0, 0.7]))
    cuts = [0, 1, 50, 333, 400]
    parts = [x[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    whole = markov.ends([markov.product(m.trans, markov._emission(x, m.mu, m.sigma), True)], m.pi)
    before, behind, loglik = markov.ends([markov.product(m.trans, markov._emission(p, m.mu, m.sigma), i == 0) for i, p in enumerate(parts)], m.pi)
    assert loglik == pytest.approx(whole[2], abs=1e-9)
    summed = sum(markov.counts(p, m, before[i], behind[i], i == 0) for i, p in enumerate(parts))
    assert summed == pytest.approx(markov.counts(x, m, whole[0][0], whole[1][0], True), abs=1e-9)


@pytest.mark.parametrize("size", [37, 1000])
def test_fits_in_parts_are_fits_of_the_series(rows, series, size):
    models = markov.fit(rows, "k", "v", "i", [1, 2], rounds=5, size=size)
    assert set(models) == {(k, n) for k in series for n in (1, 2)}
    for k in ("a", "b"):
        for n in (1, 2):
            want, got = hmm_fit(series[k], n, rounds=5), models[k, n]
            assert got.loglik == pytest.approx(want["loglik"], abs=1e-9) and got.mu == pytest.approx(want["mu"], abs=1e-9) and got.sigma == pytest.approx(want["sigma"], abs=1e-9)
            assert got.trans == pytest.approx(want["trans"], abs=1e-9)


def test_paths_in_parts_are_paths_of_the_series(rows, series):
    fits = {k: hmm_fit(x, 2, rounds=6) for k, x in series.items()}
    models = {k: markov.Model(m["pi"], m["trans"], m["mu"], m["sigma"]) for k, m in fits.items()}
    for size in (29, 1000):
        got = {}
        for r in sorted(markov.paths(rows, "k", "v", "i", models, size).collect(), key=lambda r: r.i):
            got.setdefault(r.k, []).append(r.state)
        assert got == {k: viterbi(x, fits[k]).tolist() for k, x in series.items()}


def test_restarts_are_those_of_the_series(rows, series):
    got = markov.fit(rows.where("k <> 'c'"), "k", "v", "i", [2], rounds=3, restarts=3, size=50)
    for k in ("a", "b"):
        want = hmm_fit(series[k], 2, rounds=3, restarts=3)
        assert got[k, 2].loglik == pytest.approx(want["loglik"], abs=1e-9) and got[k, 2].mu == pytest.approx(want["mu"], abs=1e-9)


def test_rounds_read_one_row_a_part(spark, rows, series):
    x = markov._cut(rows.unionByName(rows.where("k = 'b'").withColumn("k", F.lit(None).cast("string"))), "k", "v", "i", 37)
    try:
        got = {(r.key, r.part): r.v for r in x.collect()}
        assert x.count() == len(got) == 11 + 3 + 1 + 3
        for k, v in [*series.items(), (None, series["b"])]:
            assert np.concatenate([got[k, p] for p in range(-(-len(v) // 37))]).tolist() == v.tolist()
        # ranks of first models don't deal rows by key: only the join of one row a key sorts
        found = ranks(x.select("key", F.explode("v").alias("x")), ["key"], "x", {"mid": F.floor(F.col("n") / 2)}, few=True)
        assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 1
        assert {r.key: r.mid for r in found.collect()} == {k: np.sort(v)[len(v) // 2] for k, v in [*series.items(), (None, series["b"])]}
    finally:
        x.unpersist()


@pytest.mark.parametrize("n", [1, 2, 11, 399, 1003])
def test_blocks_and_rows_left_over_count_as_a_plain_loop(n):
    m = markov.Model(np.array([0.2, 0.5, 0.3]), np.array([[0.9, 0.1, 0.0], [0.05, 0.9, 0.05], [0.3, 0.3, 0.4]]), np.array([-1.0, 0.0, 2.0]), np.array([0.1, 1.0, 2.0]))
    x, enter, behind = np.random.default_rng(n).normal(size=n) * 3, np.array([0.6, 0.3, 0.1]), np.array([0.2, 0.3, 0.5])
    x[n // 2] = 90.0  # unlikely in each state
    e = markov._emission(x, m.mu, m.sigma)
    for first in (True, False):
        alpha, beta = [enter * e[0] if first else enter @ m.trans * e[0]], [behind]
        for t in range(1, n):
            alpha.append(alpha[-1] / alpha[-1].sum() @ m.trans * e[t])
            back = m.trans @ (e[n - t] * beta[0])
            beta.insert(0, back / back.sum())
        g = np.array(alpha) * np.array(beta)
        g /= g.sum(1, keepdims=True)
        before = ([] if first else [enter]) + [a / a.sum() for a in alpha[:-1]]
        steps = [m.trans * np.outer(a, e[t] * beta[t]) for t, a in enumerate(before, int(first))]
        xi = sum((s / s.sum() for s in steps), np.zeros((3, 3)))
        d = x[:, None] - m.mu
        want = np.concatenate([g[0] if first else np.zeros(3), g.sum(0), (g * d).sum(0), (g * d * d).sum(0), xi.ravel()])
        assert markov.counts(x, m, enter, behind, first) == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert np.array(markov._densities(x, m)).tolist() == e.tolist()


def test_models_know_their_rows(rows, series):
    models = markov.fit(rows, "k", "v", "i", [1, 3], rounds=1, size=50)
    assert {n: m.rows for n, m in models.items()} == {(k, n): len(x) for k, x in series.items() for n in (1, 3)}


def test_series_are_the_log_returns_without_a_join_of_ticks(spark):
    sf = "/root/testdata/sf0.001"
    x = folds._series(spark, sf)
    joins = [line for line in x._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("(seq#" in line for line in joins)
    got, want = x.collect(), registry.queries()["log_returns"](spark, sf).collect()
    assert sorted((r.seq, r.asset, r.r) for r in got) == sorted((r.seq, r.asset, r.r) for r in want)
    for a in {r.asset for r in got}:
        part = sorted((r for r in got if r.asset == a), key=lambda r: (r.ts_us, r.seq))
        assert [r.i for r in part] == list(range(1, len(part) + 1))
