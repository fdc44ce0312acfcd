"""The vector graph against all pairs, the network's gradients against differences, and toxicity on held-out rows."""

import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import toxicity, vectors


def brute(rows, t=0.98):
    ok = [i for i, (v, e, lab) in enumerate(rows) if v is not None and e and lab is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    near = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= t:
                    near[i].add(j)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            todo, comp = [i], set()
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp.add(x)
                    todo += near[x]
            seen |= dict.fromkeys(comp, min((rows[c][0] for c in comp if rows[c][0] is not None), default=None))
        out.append((rows[i][0], len(near[i]), seen[i]))
    return sorted(map(str, out))


@pytest.mark.parametrize("shard", [2048, 60])
def test_vectors(spark, monkeypatch, shard):
    monkeypatch.setattr(vectors, "SHARD", shard)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 16))
    rows = []
    for i in range(400):
        c = centre[rng.integers(30)] if i % 3 else centre[0]
        rows.append((i * 2, [float(np.float32(x)) for x in c + rng.normal(size=16) * rng.choice([0.01, 0.1, 1])], int(rng.integers(2))))
    rows += [(1, None, 0), (3, [0.0] * 16, 0), (5, [1.0, None] * 8, 0), (7, [float("nan")] * 16, 0), (9, rows[0][1], None), (11, [], 1), (13, rows[0][1], rows[0][2]), (13, rows[0][1], rows[0][2]), (15, [1.0, 0.0], 0), (17, [2.0, 0.0], 0), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted(str((r.vec_id, r.n_links, r.component_id)) for r in vectors.near_duplicates(df).collect())
    assert got == brute(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_search_follows_lists_into_other_shards():
    """A query that only one shard is asked about finds the edge that leads out of it; the other shard's visit counts it."""
    x = np.stack([[1.0, 0.01 * i] for i in range(4)] + [[0.0, 1.0]])
    here = pd.DataFrame({"shard": 1, "node": [0, 1, 4], "copies": [1, 5, 1], "vec": list(x[[0, 1, 4]]), "near": [[1], [0, 2], []], "homes": [[1], [1, 2], []], "cosines": [[0.9999], [0.9999, 0.9999], []]})
    there = pd.DataFrame({"shard": 2, "node": [2, 3], "copies": [1, 2], "vec": list(x[[2, 3]]), "near": [[3, 1], [2]], "homes": [[2, 1], [2]], "cosines": [[0.9999, 0.9999], [0.9999]]})
    run = vectors._visit(0.98)
    got = run(here, pd.DataFrame({"node": [0], "vec": [x[0]], "entries": [[]]}))
    q = got[got["at"] == 1].iloc[0]
    assert (q.links, q.peer, list(q.to), list(q.via)) == (5, 1, [2], [2])
    got = run(there, pd.DataFrame({"node": [0], "vec": [x[0]], "entries": [list(q.via)]}))
    assert got[got["at"] == 2].iloc[0].links == 3 and {(r.node, r.peer) for r in got.itertuples() if r.at is pd.NA} == {(3, 2)}


def test_visits_of_near_copies_are_bounded():
    """Where all members are near all queries, a visit names each shard to go on to once, not the members there, and follows
    edges without holding vectors of all pairs; all links are found."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=64) + rng.normal(size=(1536, 64)) * 0.08
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seats = pd.DataFrame({"node": np.arange(1536), "at": np.arange(1536) // 1024, "home": np.arange(1536) < 1024, "vec": list(x)})
    members = seats.assign(shard=0, copies=1).merge(vectors._build(0.98)(seats), on="node").query("home")
    queries = pd.DataFrame({"node": np.arange(600), "vec": list(x[:600]), "entries": [[]] * 600})
    tracemalloc.start()
    got = vectors._visit(0.98)(members, queries)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    asked = got[got["at"] == 0]
    want = (x[:600] @ x[:1024].T >= 0.98).sum(1) - 1
    assert want.sum() > 400_000 and list(asked.links) == list(want)
    assert peak < 120 and all(list(t) == [1] for t in asked.to) and all(len(v) == 1 for v in asked.via)
    got = vectors._visit(0.98)(members, queries.assign(been=[[0, 1], [0]] * 300))
    assert [list(t) for t in got[got["at"] == 0].to] == [[], [1]] * 300  # a query that has been sent to a shard isn't again


def test_a_visit_begins_at_all_members_with_edges_to_its_sources():
    """Two members that no list within their shard connects, both with edges to shard 1: the entry is only one of them."""
    x = np.array([[0.0, 1.0], [1.0, 0.01], [1.0, -0.01]])
    members = pd.DataFrame({"shard": 2, "node": [5, 6, 7], "copies": 1, "vec": list(x), "near": [[], [0], [0]], "homes": [[], [1], [1]], "cosines": [[], [0.9999], [0.9999]]})
    queries = pd.DataFrame({"node": [0], "vec": [np.array([1.0, 0.0])], "entries": [[6]], "sources": [[1]]})
    assert vectors._visit(0.98)(members, queries).iloc[0].links == 2


def test_many_shards_at_default_settings(spark):
    """A label of many shards, with a group of near copies that clusters cut apart, against all pairs."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6500, 24))
    x[:700] = x[0] + rng.normal(size=(700, 24)) * 0.1
    x[700:3000] = x[1000:3300:1] + rng.normal(size=(2300, 24)) * 0.03
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [list(map(float, v)) for v in x.astype(np.float32)], "label": 0}), "vec_id long, embedding array<float>, label int")
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.98).sum(1) - 1
    got = vectors.near_duplicates(df).toPandas().sort_values("vec_id")
    assert want.sum() > 100_000 and (got.n_links.to_numpy() == want).mean() > 0.999 and got.n_links.sum() >= 0.9999 * want.sum()
    assert (got.audited_recall >= 0.99).all()


def test_very_long_and_very_short_vectors(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1.01e200], 0), (3, [1e-200, 1e-200], 0), (4, [1e-300, -1e-300], 0), (5, [5e-324, 5e-324], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_recall_below_target_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_audit", lambda *a: (0.5, 9))
    df = spark.createDataFrame([(i, [1.0, 0.01 * i], 0) for i in range(4)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(RuntimeError, match="recall 0.5"):
        vectors.near_duplicates(df)


def test_gradients():
    rng = np.random.default_rng(0)
    H, A = toxicity.HIDDEN, toxicity.ATTEND
    w = {k: rng.normal(size=s) * 0.5 for k, s in {"uf": (H, 3 * H), "ub": (H, 3 * H), "wa": (2 * H, A), "ba": (A,), "va": (A,), "wo": (2 * H,), "bo": (1,)}.items()}
    table = rng.normal(size=(6, 6 * H))
    win = rng.integers(1, 6, (3, toxicity.WINDOW))
    win[1, 20:] = 0
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.mean(np.logaddexp(0, z := toxicity.forward(w, table, win, win > 0)[0]) - y * z))
    g, dt = toxicity.gradients(w, table, win, win > 0, y)
    for p, d in [(w[k], g[k]) for k in w] + [(table, dt)]:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in p.shape)
            if p is table and i[0] == 0:
                continue
            old = p[i]
            p[i] = old + 1e-3
            up = loss()
            p[i] = old - 1e-3
            down = loss()
            p[i] = old
            assert d[i] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=2e-4)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.report(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert 2 * hit.sum() >= 0.7 * (got.toxic.sum() + got.predicted.sum())  # F1; few labels here, the larger tables give over 0.99
    assert got.score.between(0, 1).all()


def plain_window(w, table, ids):
    """Logit of one window, word by word and state by state, with plain Python numbers."""
    H = toxicity.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))

    def gru(u, px, order):
        h, out = [0.0] * H, {}
        for t in order:
            x, hu = px[ids[t]], [sum(h[i] * u[i][j] for i in range(H)) for j in range(3 * H)]
            z, r = [sig(x[j] + hu[j]) for j in range(H)], [sig(x[H + j] + hu[H + j]) for j in range(H)]
            c = [math.tanh(x[2 * H + j] + r[j] * hu[2 * H + j]) for j in range(H)]
            h = [(1 - z[j]) * c[j] + z[j] * h[j] for j in range(H)]
            out[t] = h
        return out

    f, b = gru(w["uf"], table[:, : 3 * H], range(len(ids))), gru(w["ub"], table[:, 3 * H :], range(len(ids) - 1, -1, -1))
    states = [f[t] + b[t] for t in range(len(ids))]
    worth = []
    for h in states:
        u = [math.tanh(sum(h[i] * w["wa"][i][k] for i in range(2 * H)) + w["ba"][k]) for k in range(toxicity.ATTEND)]
        worth.append(math.exp(sum(a * b for a, b in zip(u, w["va"], strict=True))))
    pooled = [sum(a * h[i] for a, h in zip(worth, states, strict=True)) / sum(worth) for i in range(2 * H)]
    return sum(p * o for p, o in zip(pooled, w["wo"], strict=True)) + w["bo"][0]


def test_text_scores_match_plain_loops():
    """Scores of whole texts: the worst of all overlapping windows, each computed with plain loops."""
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("na", "te", "so", "x" * 90)]
    texts = [" ".join(rng.choice(words, n)) + (" vile filth" if i % 2 else "") for i, n in enumerate([5, 30, 40, 70, 12, 55, 20, 33, 48, 61, 9, 25, 90, 15] * 2)]
    net = toxicity.train(texts, [i % 2 for i in range(len(texts))], epochs=1)
    for text in (texts[3], texts[4], " ".join(words * 4)):
        f = toxicity.words_of(text)
        table = net.features(f)[0] @ net.weights["wx"] + net.weights["bx"]
        starts = range(0, max(len(f) - toxicity.WINDOW + toxicity.STRIDE, 1), toxicity.STRIDE)
        want = max(plain_window(net.weights, table, list(range(s, min(s + toxicity.WINDOW, len(f))))) for s in starts)
        assert net.logits([text])[0] == pytest.approx(want, rel=1e-3, abs=1e-3)
    assert net.logits([None, "", "12 .."]).tolist() == [toxicity.EMPTY_LOGIT] * 3


def test_end_of_a_long_word_counts():
    a, b = toxicity.char_ids(["x" * 300 + "vile"])[0], toxicity.char_ids(["x" * 300 + "mild"])[0]
    assert len(a) == len(b) and set(a) != set(b)


def test_network_learns_without_log_odds(spark, monkeypatch):
    """Ablation: with the log-odds inputs at zero the recurrent network alone tells the classes apart."""
    rng = np.random.default_rng(2)
    calm, vile = [f"calm{i}a" for i in range(60)], ["scum", "filth", "vermin"]
    texts = [" ".join([*rng.choice(calm, 20), *(rng.choice(vile, 2) if i % 2 else [])]) for i in range(400)]
    monkeypatch.setattr(toxicity, "_log_odds", lambda docs, y, buckets: np.zeros(buckets, np.float32))
    net = toxicity.train(texts[:300], [i % 2 for i in range(300)])
    assert not net.word_odds.any() and not net.char_odds.any()
    got = net.scores(texts[300:]) >= 0.7
    assert (got == np.arange(300, 400) % 2).mean() > 0.95


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "fine words", 1.0), (3, "fine words", 1.0), (None, "..", 1.0), (4, "word " * 60_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.report(docs, labels)
    # no labels to learn from: everything is scored alike and nothing is toxic
    assert got.count() == 6 and got.where("score between 0 and 0.1 and predicted = 0").count() == 6
    assert got.where("held_out is null").count() == 0
    assert toxicity.report(docs.limit(0), labels.limit(0)).count() == 0


def test_audit_can_fail(spark):
    """Rare links, of which some are lost: the sample meets them; without a link the share is null."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    x[1::100] = x[::100] + 1e-6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(7, k, 1, v.tolist()) for k, v in enumerate(x)], "shard long, node long, copies long, vec array<double>")
    found = [(k, 1) for c in range(0, 600, 100) for k in (c, c + 1)]
    frame = lambda some: spark.createDataFrame(some, "node long, links long")
    assert vectors._audit(rows, frame(found), 0.98, 40)[0] == 1.0
    share, met = vectors._audit(rows, frame([(k, 1) for k, _ in found[1:]]), 0.98, 2000)
    assert met == 12 and share == 11 / 12
    assert vectors._audit(rows.where("node % 100 > 1"), frame([]), 0.98, 40) == (None, 0)


def test_vectors_without_links_say_that_nothing_was_met(spark):
    docs = spark.createDataFrame([(k, [float(k == j) for j in range(4)], 0) for k in range(4)], "vec_id long, embedding array<double>, label int")
    assert {(r.audited_recall, r.audited_links, r.n_links) for r in vectors.near_duplicates(docs).collect()} == {(None, 0, 0)}
