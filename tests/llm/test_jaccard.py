"""The n-gram Jaccard join against all pairs compared one by one."""

import random
import re
from collections import Counter

import pytest

from tidemark.llm import jaccard
from tidemark.llm.common import components


def brute(rows, n=5, t=0.8):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, near = Counter(), {i: {i} for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                near[i].add(j)
                near[j].add(i)
    seen = {}
    for i in range(len(rows)):
        if i not in seen:
            todo, comp = [i], set()
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp.add(x)
                    todo += near[x]
            low = min(rows[c][0] for c in comp)
            seen |= dict.fromkeys(comp, low)
    return sorted((rows[i][0], seen[i], links[i]) for i in range(len(rows)))


def corpus(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["of", "the", "tin", "oak", "sea", "ant"]) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 90))) for _ in range(25)]
    rows = []
    for i in range(160):
        w = rng.choice(base[: 3 + i % 23]).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(1000))
        rows.append((i * 3, " ".join(w)))
    return [*rows, (1, None), (4, ""), (7, " .. "), (10, "Two words"), (13, "two, WORDS!"), (16, "a " * 900)]


@pytest.mark.parametrize("block", [256, 4])
def test_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(block)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.report(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999).collect())
    assert got == brute(rows)


def test_keep_one(spark):
    rows = [(3, "a b c d e f g", None), (2, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (9, None, "x"), (None, "a b c d e f g", "x"), (5, "other words here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    out = jaccard.keep_one(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "5", "9", "None"]
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_bands():
    assert jaccard.bands_for(0.8, 0.999) == 18
    assert jaccard.bands_for(1, 0.999) == 1
    for bad in ((0.8, 1.0), (0.8, 0.0), (0.0, 0.9), (1.1, 0.9)):
        with pytest.raises(ValueError, match="threshold"):
            jaccard.bands_for(*bad)


def test_measured_recall_at_the_threshold(spark):
    """Pairs at a similarity of just 0.8 and a little over, found with the default number of bands."""
    rng = random.Random(2)
    rows, pairs = [], 0
    while pairs < 400:
        w = [f"p{pairs}w{i}" for i in range(rng.randrange(60, 120))]
        at = rng.randrange(len(w) - 20, len(w))
        v = [*w[:at], *(f"q{pairs}w{i}" for i in range(len(w) - at))]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
        if 0.8 <= len(a & b) / len(a | b) < 0.84:
            rows += [(2 * pairs, " ".join(w)), (2 * pairs + 1, " ".join(v))]
            pairs += 1
    got = jaccard.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_links = 1").count() >= 0.995 * len(rows)


def test_long_texts_and_empty_table(spark):
    rng = random.Random(1)
    w = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near = [*w[:70_000], "other", *w[70_001:]]
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(w[:100_000])), (4, "a " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.report(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]
    assert jaccard.report(df.limit(0)).count() == 0


def test_components_of_stars_and_chains(spark):
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 500)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000 + rng.randrange(90), 2000 + rng.randrange(90)) for _ in range(70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(a != b and n in (a, b) for a, b in edges)}
