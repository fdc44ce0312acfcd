"""Decontamination: leaks that fill slots anew, insert or drop words, quote a part or stand in another context."""

import random

from tidemark.llm import decontaminate

LONG = "A farmer sells apples from two large orchards near the river and counts the baskets every evening before the market opens again in the northern valley where traders meet"


def found(spark, item, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect())


def test_other_diagonals(spark):
    w = LONG.split()
    n = len(w) // 3
    thirds = " zzq ".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    dropped = " ".join(x for i, x in enumerate(w) if i not in (9, 19))
    middle = " ".join([*w[: len(w) // 2], "zzq", *w[len(w) // 2 :]])
    assert found(spark, LONG, [thirds, dropped, middle, " ".join(w[:13]) + " is all", " ".join(w[:9]) + " is all"]) == [0, 1, 2, 3]


def test_slot_of_more_tokens(spark):
    item = "Today the teacher told the pupil Alice to bring 12 books and asked the boy Bob to carry 30 pens home"
    assert found(spark, item, ["Today the teacher told the pupil Mary Ann to bring 15 books and asked the boy Tim Lee to carry 31 pens home"]) == [0]


def test_any_context(spark):
    france = "What is the capital of France?"
    assert found(spark, france, ["Question: " + france, 'He asked "' + france + '"', "(" + france + ")", france.upper(), "so what is the capital of Italy", "Question: What is the capital of Italy?", "Paris is the capital of France."]) == [0, 1, 2, 3, 4, 5]
    more = "Tom has 5 apples. Anna has 3 apples. Who has more?"
    assert found(spark, more, ["Ben has 7 apples. Lucy has 4 apples. Who has more?", "Well: Mary Ann has 7 apples. Lucy has 4 apples. Who has more?", more.lower(), "Ben sold 7 pears. Lucy took 4 plums. Who went home?"]) == [0, 1, 2]
    assert found(spark, "Mary Ann has 5 apples left", ["and Tom has 7 apples left", "and tom has no apples left"]) == [0]


def test_slots_that_do_not_agree(spark):
    item = "He packs 3 crates on each of the first 3 days and then 5 crates on the last of the days"
    roles = "He packs 4 crates on each of the first 2 days and then 5 crates on the last of the days"
    edited = item.replace("first 3", "first 9")
    alike = item.replace("3", "7").replace("5", "7")
    part = "He packs 3 crates on each of the first 3 days and then 5 crates in 1 of 2 other ways to the 4 shops"
    chance = "He packs 4 crates on each of the first 6 days so say 7 and 9"
    assert found(spark, item, [roles, edited, alike, part, chance]) == [0, 1, 2, 3]


def plain_align(a, b):
    """Best local alignment of two token lists of (word, slot kind, may be a name): 2 for a pair, -1 for anything else."""
    best, score, back = (0, 0, 0), [[0] * (len(b) + 1) for _ in range(len(a) + 1)], {}
    pair = lambda x, y: x[0] == y[0] or (x[1] and x[1] == y[1]) or (x[2] and y[2])
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            step = [(score[i][j] + (2 if pair(x, y) else -1), (i, j)), (score[i][j + 1] - 1, (i, j + 1)), (score[i + 1][j] - 1, (i + 1, j))]
            v, back[i + 1, j + 1] = max(step, key=lambda s: s[0])
            score[i + 1][j + 1] = max(0, v)
            best = max(best, (score[i + 1][j + 1], -i, -j))
    v, i, j = best[0], 1 - best[1], 1 - best[2]
    out = []
    while v and score[i][j] > 0:
        p = back[i, j]
        if p == (i - 1, j - 1) and pair(a[i - 1], b[j - 1]):
            out.append((i - 1, j - 1))
        i, j = p
    return out[::-1]


def plain_tokens(text):
    """(word, slot kind or '', may be a name) of each token, from the template as `canonical` has it."""
    kinds, raw = decontaminate.canonical(text)
    shown = [t for t in decontaminate.tokens(text) if t not in ".!?\n"]
    can = [k not in ("<num>", "<unit>") and t.lower() != t and t[0].isupper() and t[1:].islower() and t.lower() not in decontaminate.OPENERS for k, t in zip(kinds, shown, strict=True)]
    return [(r, k if k in decontaminate.KINDS[1:] else "", c or k == "<name>") for k, r, c in zip(kinds, raw, can, strict=True)]


def test_against_plain_alignment(spark):
    """All documents against all items by plain alignment over all diagonals: copies with slots filled anew, words changed
    or left out, and unrelated text. The plain rule counts matched tokens; near its limits either answer may stand."""
    rng = random.Random(12)
    nouns = "farmer river basket market trader orchard valley baker train pupil teacher garden ladder window letter cousin".split()
    verbs = "sells counts carries brings takes opens paints builds".split()
    names = "Alice Bob Carol David Emma Frank".split()

    def item():
        return " ".join(f"the {rng.choice(nouns)} {rng.choice(names)} {rng.choice(verbs)} {rng.randrange(2, 90)} {rng.choice(nouns)} near the {rng.choice(nouns)}" for _ in range(3))

    def altered(t, share):
        return " ".join(x for w in t.split() for x in [str(rng.randrange(2, 90)) if w.isdigit() and rng.random() < 0.5 else rng.choice(names) if w in names and rng.random() < 0.5 else w] if rng.random() > share)

    items = [item() for _ in range(6)]
    noise = lambda n: " ".join(rng.choice([*nouns, *verbs, "and", "then", "a"]) for _ in range(n))
    texts = [noise(20) + " " + altered(items[i % 6], rng.choice([0, 0, 0.05, 0.1])) + " " + noise(15) for i in range(30)] + [noise(60) for _ in range(20)] + [item() for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    sure, may = set(), set()
    for d, text in enumerate(texts):
        b = plain_tokens(text)
        for i, it in enumerate(items):
            a = plain_tokens(it)
            pairs = plain_align(a, b)
            same = sum(a[x][0] == b[y][0] and not a[x][1] for x, y in pairs) / max(1, sum(not k for _, k, _ in a))
            if same >= 0.85:
                sure.add((d, i))
            if len(pairs) >= 0.4 * len(a):
                may.add((d, i))
    assert len(sure) >= 25 and sure <= got <= may


def test_items_that_share_an_id_or_have_none(spark):
    one, two, three = LONG, "Seven bakers carry nineteen loaves over the old bridge to the castle before the sun is up", "Her cousin paints the ladder green while the cat sleeps under the garden window all day"
    bench = spark.createDataFrame([(1, one, "x"), (1, two, "x"), (None, three, "x"), (2, None, "x"), (1, one, "x")], "item_id long, text string, hits string")
    docs = spark.createDataFrame([(10, one), (11, two), (12, three), (13, "nothing of it"), (14, None), (None, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [(10, 1), (11, 1), (12, None)]
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, bench).collect()) == ["13", "14", "None"]


def test_without_prefilter(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "well " + LONG), (2, "other text of no account")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 3)
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_documents_that_meet_many_items(spark, monkeypatch):
    """Items that share a window: a document's hits are dealt to rows of a few items, and each is judged."""
    monkeypatch.setattr(decontaminate, "HITS", 7)
    tail = "the river keeper counted the barrels near the mill before the flood came"
    bench = spark.createDataFrame([(k, f"{tail} {chr(97 + k % 26) * 5} {chr(97 + k // 26) * 6}") for k in range(100)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {tail} and went"), (2, "nothing of this kind was ever written down here by anyone")], "doc_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert {r.doc_id for r in got} == {1} and {r.item_id for r in got} == set(range(100))
