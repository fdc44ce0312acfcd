"""Decontamination, language, substring and preference operators on small cases with odd input."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate, langid, licenses, preference, substring, words

ITEM = "A train travels 120 km in 3 hours while Alice waits. How far would the same train travel in 5 hours at that speed?"


def test_canonical():
    t, _ = decontaminate.canonical("Pay 3.50 $ to Alice. Bob saw 20 km of ROAD")
    assert t == ["pay", "<num>", "<unit>", "to", "<name>", "bob", "saw", "<num>", "<unit>", "of", "road"]


def test_leaks(spark):
    rows = [
        (1, "Intro words here. " + ITEM + " And more.", 0), (2, "x " + ITEM.upper() + " y", 0),
        (3, "A train travels 90 miles in 4 hours while Carol waits. How far would the same train travel in 7 hours at that speed?", 0),
        (4, "A train travels 90 miles in 4 hours while Carol waits. How far would the same train travel in 4 hours at that speed?", 0),
        (5, "A train passed. How far would it go, said Alice, in 3 hours?", 0), (6, None, 0), (None, ITEM, 0), (7, "", 0), (8, "w " * 50_000 + ITEM, 0), (1, "Intro words here. " + ITEM + " And more.", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, ITEM, "a"), (11, None, "a"), (12, "", "a"), (13, "short one", "b"), (None, "x y z", "c")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontaminate.leaks(docs, bench).collect()}
    # 3 refills all slots; 4 gives one value to slots that differ in the item: hours 3 and 5 become 4 and 4, distances still differ
    assert {k for k in got} >= {(1, 10), (2, 10), (3, 10), (8, 10)} and all(k[0] in (1, 2, 3, 4, 8) for k in got)
    assert got[1, 10] == 0 and got[3, 10] > 0
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.select("doc_id").collect() if r.doc_id not in (4,)) == ["5", "6", "7", "None"]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_slots():
    assert decontaminate._slots_agree([("<num>", "3", "7"), ("<num>", "3", "7"), ("<num>", "5", "9")])
    assert not decontaminate._slots_agree([("<num>", "3", "7"), ("<num>", "3", "8")])
    assert not decontaminate._slots_agree([("<num>", "3", "7"), ("<num>", "5", "7")])


def plain_phrases(text, form):
    i, n = 0, 0
    while i < len(form):
        j = i
        while j < len(form) and form[i : j + 1] in text:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


@pytest.mark.parametrize("entries", [16_000_000, 0])
def test_parser_counts_greedy_phrases(monkeypatch, entries):
    """Stretches parsed side by side, and sparse transitions, give the plain parse's counts, also where parses never agree."""
    monkeypatch.setattr(langid, "MOST_ENTRIES", entries)
    monkeypatch.setattr(langid, "STRETCH", 16)
    rng = random.Random(3)
    train = " " + " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(60)) + " "
    forms = ["", "x", "abab" * 40, train * 2, "é" * 70, "aab" * 50] + ["".join(rng.choice("abcde xyz") for _ in range(rng.randrange(200))) for _ in range(40)]
    off = np.concatenate([[0], np.cumsum([len(f) for f in forms])]).astype(np.int64)
    p = langid.Parser(train)
    got = p.counts(np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32), off)
    assert got.tolist() == [plain_phrases(train, f) for f in forms] == [langid.SuffixAutomaton(train).phrases(f) for f in forms]
    assert [p._one(p.code[[ord(c) for c in f]]) for f in forms[1:5]] == got[1:5].tolist()


def test_language_against_a_plain_parse(spark):
    """The query's predictions from its training text by naive longest matches over whole texts, spaces included."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = langid.training_text(docs, letters=3000)
    rows = docs.where("length(text) between 1 and 400").limit(25).collect()
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.join(spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long"), "doc_id"), texts).collect()}
    for r in rows:
        w = regex.findall(r"\p{L}+", r.text.lower())
        form = f" {' '.join(w)} "
        cost = {x: plain_phrases(t, form) * math.log2(len(t)) for x, t in texts.items()}
        assert got[r.doc_id] == (min(sorted(cost), key=cost.get) if w else "und")


def test_languages_with_unequal_training_text(spark):
    en = "the house by the river was quiet in the morning and nobody came to open the window or to read the letter on the table "
    texts = {"en": " " + en * 50, "de": " wir haben heute einen langen spaziergang am fluss gemacht und "}
    df = spark.createDataFrame([(1, "wir haben heute einen langen spaziergang gemacht"), (2, "nobody came to the house in the morning")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(df, texts).collect()} == {1: "de", 2: "en"}


def test_language(spark):
    en, de = "the cat sat on the mat and the dog ran to the house with them ", "der hund lief in das haus und die katze sass auf dem dach mit ihm "
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de", 1.0) for i in range(40)] + [(50, None, "en", 0.0), (51, "12 .. !", "de", 0.0), (52, "", None, 0.0), (53, "the dog " * 20_000, None, 0.0), (None, "das haus", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert [got[i].lang_pred for i in (50, 51, 52, 53, None)] == ["und", "und", "und", "en", "de"] and got[50].score == 0 and 0 <= got[53].score <= 1
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(40), 53, None}
    assert langid.report(docs.limit(0)).count() == 0


def test_substring_edges(spark):
    rep = "a b c d e f g h i j k l m"
    rows = [(1, rep), (2, f"x {rep} y"), (2, f"z {rep}"), (3, None), (4, "  "), (None, rep), (5, "la " * 40), (6, "la " * 14 + "end"), (7, "\t" + rep + "\n" + rep), (7, "\t" + rep + "\n" + rep)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, words int")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring.report(docs).collect())
    assert got == sorted([("1", 13, 0), ("2", 15, 13), ("2", 14, 13), ("3", 0, 0), ("4", 0, 0), ("None", 13, 0), ("5", 40, 0), ("6", 15, 14), ("7", 26, 26), ("7", 26, 26)])
    assert substring.report(docs.limit(0)).count() == 0


def test_substring_long_text(spark):
    """A text of many chunks, also without white space, against one of its parts."""
    rng = random.Random(9)
    w = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    part = w[123_456:123_556]
    rows = [(1, " ".join(part)), (2, "\n".join(w)), (3, "z" * 3_000_000), (4, "z" * 3_000_000 + " " + " ".join(part[:20]))]
    got = {r.doc_id: r for r in substring.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = " ".join([*w[:123_456], *w[123_556:]])
    assert {k: (r.n_words, r.n_removed) for k, r in got.items()} == {1: (100, 0), 2: (400_000, 100), 3: (1, 0), 4: (21, 20)}
    assert got[2].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@given(st.lists(st.text(alphabet="ab é日\t\n\x0b\x1c\x85\u2003", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_of_bytes(texts):
    """Word bounds in UTF-8 bytes are those of the pattern, and equal words alone have equal hashes."""
    data, at = words.texts_of(pa.array(texts, pa.string()))
    s, e, off = words.words(data, at)
    plain = [[w for w in re.split(r"[\x20\x09-\x0D]+", t) if w] for t in texts]
    assert [[bytes(data[a:b]).decode() for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(off[:-1], off[1:], strict=True)] == plain
    flat = [w for t in plain for w in t]
    for h in words.hashed(data, s, e):
        assert len({*zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))


def test_substring_against_brute_force(spark):
    rng = random.Random(4)
    parts = [" ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(5, 200))) for _ in range(12)]
    rows = [(i * 2, " ".join(rng.choice(parts) for _ in range(rng.randrange(4)))) for i in range(60)] + [(i * 2 + 1, "a " * rng.randrange(40)) for i in range(10)]
    first, want = {}, {}
    for i, text in sorted(rows):
        w, gone = text.split(), set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone |= set(range(k, k + 13))
        want[i] = (len(w), len(gone))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_preference(spark):
    rows = [
        (1, "chosen", 0, 0, "user", "hi"), (1, "chosen", 0, 1, "assistant", "yes"), (1, "rejected", 1, 0, "user", "hi"), (1, "rejected", 1, 1, "assistant", "no!"), (1, "rejected", 1, 2, None, None),
        (2, "chosen", 2, 0, "user", "same"), (2, "rejected", 3, 0, "user", "same"), (3, "rejected", 5, 0, "user", "alone"), (None, "chosen", 9, 0, "user", "lost"),
    ]
    x = {r.pair_id: r for r in preference.preference(spark.createDataFrame([(*r, 1) for r in rows], "pair_id long, side string, conv_id long, turn int, role string, text string, prompt int")).collect()}
    assert x[1].prompt == "<|user|>\nhi<|end|>\n" and x[1].n_common == 1
    assert x[1].chosen == "<|assistant|>\nyes<|end|>\n" and x[1].rejected == "<|assistant|>\nno!<|end|>\n<|unknown|>\n<|end|>\n"
    (m,) = x[1].rejected_mask
    assert x[1].rejected[m.start : m.end] == "no!<|end|>"
    assert (x[2].n_common, x[2].chosen, x[2].rejected) == (1, "", "") and (x[3].n_common, x[3].chosen, x[3].chosen_conv) == (0, "", None)
    assert set(x) == {1, 2, 3}


def test_preference_pairs_share_a_prefix(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "user", "thanks"), (2, 0, "user", "yo"), (2, 1, "assistant", "two"), (2, 1, "assistant", "two"), (3, 0, "user", "nobody answers"), (5, None, None, None), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, prompt string")
    got = {r.pair_id: r for r in preference.report(df).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert (got[1].n_common, got[1].prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert got[1].chosen == "<|assistant|>\none<|end|>\n<|user|>\nthanks<|end|>\n" and got[1].rejected == "<|assistant|>\ntwo<|end|>\n<|user|>\nthanks<|end|>\n"
    assert got[1].chosen_mask == got[1].rejected_mask == "14-24"
    # the next conversation has no reply, so the rejected one ends before it; without a reply both are alike
    assert (got[2].n_common, got[2].rejected) == (1, "") and got[2].chosen.count("two") == 2
    assert (got[3].n_common, got[3].chosen, got[3].rejected) == (1, "", "") and got[5].prompt == "<|unknown|>\n<|end|>\n"
    assert preference.report(df.limit(0)).count() == 0


def test_preference_long_conversation(spark):
    rows = [(4, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(5000)] + [(5, 0, "assistant", "z" * 100_000)]
    r = preference.report(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).where("pair_id = 4").first()
    assert r.n_common == 4999 and r.chosen == "<|assistant|>\nturn 4999<|end|>\n" and len(r.rejected) == 100_000 + 14 + 8 and r.prompt.count("<|end|>") == 4999


def notice(label, words=9):
    return next(t for lab, _, _, t in licenses.NOTICES if lab == label and len(t.split()) > words)


def test_licenses(spark):
    rows = [(1, "Released under the MIT\nLicense."), (2, None), (3, ""), (4, "w " * 700 + "mit license mit-LICENSE, gnu GENERAL public license"), (5, "MIT licenses"), (5, "MIT licenses"), (6, notice("mit")), (None, "all rights reserved"), (8, "x " * 200_000 + "Licensed under CC BY-NC 4.0")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, label string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels, got[1].score) == (1, 3, "mit", "mit", 1.0)
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (708, 3, 700, 705, "gpl,mit")
    assert (got[5].n_base, got[5].labels, got[5].first_word, got[2].n_words, got[3].score) == (0, "", None, 0, 0.0)
    assert got[6].labels == "mit" and got[6].n_base == 0
    assert got[None].labels == "proprietary" and (got[8].labels, got[8].n_words) == ("cc-by-nc", 200_007)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_rows_repeat(spark):
    rows = [(5, "mit license, mit license")] * 3 + [(5, "other"), (None, None), (None, None)]
    got = sorted(str((r.doc_id, r.n_words, r.n_base)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(map(str, [(5, 4, 2)] * 3 + [(5, 1, 0)] + [(None, 0, 0)] * 2))


# hand-labelled: notices that resemble each other, alone, side by side, shortened and in foreign text
LABELLED = [
    ("Released under the Apache License, Version 2.0.", "apache"),
    ("Wir gehen mit ihm. Licensed under the Apache License, Version 2.0. Er kommt mit.", "apache"),
    ("Released under the Apache License mit freundlichen Gruessen", "apache"),
    ("Der Text steht mit allem unter der Lizenz, released under the terms of a license mit Anhang", ""),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
    ("Licensed under CC BY-SA 4.0. " + "filler text here " * 3 + "Licensed under CC BY-NC 4.0", "cc-by-nc,cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This is licensed under the Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    (notice("gpl"), "gpl"), (notice("lgpl"), "gpl,lgpl"), (notice("agpl"), "agpl,gpl"), (notice("bsd"), "bsd"), (notice("isc"), "isc"), (notice("mit"), "mit"),
    (notice("mpl"), "mpl"), (notice("unlicense"), "unlicense"), (notice("proprietary"), "proprietary"), (notice("apache", 20), "apache"),
    ("Permission was granted to a person, free of charge, to use the house and to copy the letters without limitation", ""),
    ("the free software movement and the general public read it under the terms of a license", ""),
    ("Attribution and commons are creative words in an international work licensed 4.0 times", ""),
    ("rights are all reserved, and all rights of ours", ""),
]


def test_licenses_that_resemble_each_other(spark):
    rows = [(i, pre + text + post) for i, (text, _) in enumerate(LABELLED) for pre, post in [("", ""), ("lorem " * (97 + i), " ipsum" * 90)][: 1 + (i % 2)]]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.labels == LABELLED[r.doc_id][1], LABELLED[r.doc_id][0]
