"""The pipeline against a plain version of each stage, on planted cases; and odd input to every stage."""

import random
import re

import corpus_pipeline
from tidemark.llm import langid

EN = ["the", "of", "and", "to", "in", "that", "was", "with", "river", "stone", "house", "morning", "letter", "garden", "window", "street"]


def text(rng, n):
    return " ".join(rng.choice(EN) + (str(rng.randrange(99)) if rng.random() < 0.5 else "") for _ in range(n))


def shingles(t):
    w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_pipeline_matches_plain_stages(spark, tmp_path):
    rng = random.Random(11)
    item = text(rng, 40)
    passage = text(rng, 60)
    docs = [(i, text(rng, rng.randrange(20, 120)), "en", "s", 0) for i in range(0, 80, 2)]
    docs += [(101, docs[0][1], "en", "s", 0), (103, docs[1][1] + " extra", "en", "s", 0)]  # exact and near copy
    docs += [(105, text(rng, 30) + " " + passage, "en", "s", 0), (107, text(rng, 30) + " " + passage + " " + text(rng, 9), "en", "s", 0)]
    docs += [(109, text(rng, 30) + " " + item + " " + text(rng, 5), "en", "s", 0), (111, "12 !! ..", "en", "s", 0), (113, None, None, None, None), (115, text(rng, 6000), None, "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # plain stages
    left = [(i, t) for i, t, *_ in docs if t and re.search(r"[^\W\d_]", t)]
    keep, sets = [], {}
    for i, t in sorted(left):
        s = shingles(t)
        if not any(len(s & o) >= 0.8 * len(s | o) for o in sets.values()):
            keep.append((i, t))
        sets[i] = s
    first, cut = {}, []
    for i, t in keep:
        w, gone = t.split(), set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone |= set(range(k, k + 13))
        rest = [x for k, x in enumerate(w) if k not in gone]
        if rest:
            cut.append((i, " ".join(rest) if gone else t))
    clean = {i: t for i, t in cut if i != 109}

    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) == set(clean)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(corpus_pipeline.WORD_BPE)
    sizes = got.groupby("doc_id").length.sum().to_dict()
    assert sizes == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert got.groupby("sequence_id").length.sum().max() <= 4096


def test_stages_keep_columns_and_stand_odd_input(spark, tmp_path):
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", "s", 1), (3, "same words again", "en", "s", 1), (3, "same words again", "en", "s", 1)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "benchmark text of several words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (df, df.limit(0)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, frame, str(tmp_path))
            assert out.columns == df.columns, name
            assert out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == frame.count()
    assert langid.keep_identified(df).count() == 3


def test_a_new_held_thing_gives_freed_memory_back(monkeypatch):
    """Also where nothing was held before: stages that hold nothing leave freed memory in their workers too."""
    from tidemark.llm import common

    trimmed = []
    monkeypatch.setattr(common, "trim", lambda: trimmed.append(1))
    monkeypatch.setattr(common, "_HELD", {})
    assert [common.held(k, lambda: k) for k in (("a",), ("a",), ("b",))] == [("a",), ("a",), ("b",)] and len(trimmed) == 2
    monkeypatch.undo()
    common.trim()
