"""Pieces by agendas, spelling variants and the alignment of tokenizers: against the libraries and plain loops."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import agenda, crosstokens, queries, spelling
from tidemark.llm.stretches import stretches

PIECES = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
BYTES = Tokenizer.from_file(queries.BYTE_BPE)
BYTES.encode_special_tokens = True
CHARS = st.lists(st.sampled_from([*"ab ce\n\t.é▁ßﬁ\x00<>sx0\x1c　\xa0́", "😀", "the", " of", "  ", "中"]), max_size=60).map("".join)
ODD = ["", None, " ", "  ", "a  b ", " a", "\n a\n\n b \n", "▁x ▁ y▁▁", "<s></s> <0x41>", "<|endoftext|> a", "x" * 700, "ab" * 900 + " c", "\x00 é 中 😀", "ends in space "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def model():
    return agenda.Agenda(queries.PIECE_BPE)


@given(st.lists(st.one_of(st.none(), CHARS), max_size=6))
@settings(max_examples=150, deadline=None)
def test_stretches_put_together_are_the_texts(texts):
    index, offsets, names = stretches(pa.array(texts, pa.string()))
    assert len(offsets) == len(texts) + 1 and len(set(names)) == len(names)
    for t, i, j in zip(texts, offsets[:-1], offsets[1:], strict=True):
        parts = [names[k] for k in index[i:j]]
        assert "".join(f" {w}" for w in parts) == (f" {t}" if t else "")
        assert all(w and not w[-1].isspace() for w in parts[:-1])


@given(CHARS)
@settings(max_examples=300, deadline=None)
def test_agendas_give_the_librarys_ids(text):
    a = test_agendas_give_the_librarys_ids.__dict__.setdefault("a", agenda.Agenda(queries.PIECE_BPE))
    ids, ends = a.texts(pa.array([text, "x", None, text]))
    assert ids[: ends[1]].tolist() == ids[ends[3] :].tolist() == PIECES.encode(text) and ends[2] == ends[3]


def test_both_forms_of_agenda_agree(model):
    rng = np.random.default_rng(5)
    for n in (2, 7, 20, 47):
        rows = model.of_char[rng.choice([ord(c) for c in " thereings.é"], (50, n))]
        side = model._side_by_side(rows)
        assert [[x for x in r if x >= 0] for r in side.tolist()] == [model._alone(r) for r in rows.tolist()]


def test_pairs_are_looked_up_as_in_a_dictionary():
    rng = np.random.default_rng(1)
    made = {(int(a), int(b)): k for k, (a, b) in enumerate(rng.integers(0, 400, (5000, 2)))}
    pairs = agenda.Pairs(made)
    a, b = np.meshgrid(np.arange(-1, 401), np.arange(-1, 401))
    assert pairs(a.ravel(), b.ravel()).tolist() == [made.get(x, -1) for x in zip(a.ravel().tolist(), b.ravel().tolist(), strict=True)]
    assert agenda.Pairs({})(np.array([1]), np.array([2])).tolist() == [-1]


def test_pieces_of_documents(spark):
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(None, "no id", 2), (3, "again", 3), (3, "again", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = Counter(tuple(r) for r in agenda.report(docs, queries.PIECE_BPE).collect())
    want = Counter()
    for k, t, _ in rows:
        ids = PIECES.encode(t or "")
        want[k, len(ids), sha(",".join(map(str, ids))), sha(PIECES.decode(ids) if ids else "")] += 1
    assert got == want
    assert agenda.report(docs.limit(0), queries.PIECE_BPE).collect() == []


def test_other_ids_than_the_librarys_are_an_error(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a text"]})
    broken = agenda.Agenda(queries.PIECE_BPE)
    broken.made.clear()
    broken.pairs = agenda.Pairs({})
    monkeypatch.setattr(agenda, "held", lambda key, make: broken)
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    seen = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, shape: seen.setdefault("f", f))
    agenda.encode_documents(docs, queries.PIECE_BPE)
    with pytest.raises(ValueError, match="differ"):
        list(seen["f"](iter([batch])))


def plain_variants(rows):
    counts = Counter()
    for key, text in rows:
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += n
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    of = {w: [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)] for w in words}
    form = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in of.items() if xs}
    form = {w: x for w, x in form.items() if words[x] >= 2 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(of[w]), words.get(form.get(w))))
    return out


def test_variants_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    base = ["garden", "gardens", "gardén", "grden", "house", "houuse", "houusee", "aabbcc", "abacbc", "ccbbaa", "élève", "elève", "danger", "ganderx", "aaaaa", "aaaaaa", "aaaaab"]
    texts = [" ".join(rng.choice(base, 60, p=np.arange(len(base), 0, -1) / sum(range(len(base) + 1)))) for _ in range(60)]
    letters = "".join(map(chr, rng.choice([*range(97, 123), *range(0xC0, 0x100)], 3000)))
    rows = [(k, t.upper() if k % 7 == 0 else t) for k, t in enumerate(texts)] + [(None, "House1house_HOUSE"), (5, None), (6, ""), (7, "日本 house×÷house")] + [(100 + k, f"{letters} {letters[:-1]}") for k in range(3)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {tuple(r) for r in spelling.report(docs).collect()}
    assert got == plain_variants(rows) and sum(r[1] is not None for r in got) > 3 and any(len(r[0]) > 2000 for r in got)
    assert spelling.report(docs.limit(0)).collect() == []


def test_chain_of_forms_and_anagrams(spark):
    """Each word half as frequent as the next; a class of anagrams of one another has no near words."""
    chain = [("a" * 5 + "b" * k, 3 * 2**k) for k in range(20)]
    anagrams = [("".join(p), 5) for p in {tuple(np.random.default_rng(k).permutation(list("pqrstuvw"))) for k in range(300)}]
    got = {r.word: r for r in spelling.group(spark.createDataFrame(chain + anagrams, "word string, n long")).collect()}
    assert {got[w].root for w, _ in chain} == {chain[-1][0]} and got[chain[0][0]].form == chain[1][0] and got[chain[-1][0]].form is None
    assert all(got[w].n_near == 0 and got[w].root == w for w, _ in anagrams)


def plain_alignment(rows):
    of = crosstokens._byte_level()
    docs, counts = [], Counter()
    for key, text in rows:
        whole = f" {text}".encode()
        a = [(i, bytes(of[c] for c in BYTES.id_to_token(i))) for i in BYTES.encode(f" {text}", add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode()) for i in PIECES.encode(text or "")]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((key, None))
            continue
        places = []
        for side in (a, b):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            places.append([(i, e - len(x), e) for (i, x), e in zip(side, ends, strict=True)])
        links, first = [], 0
        for i, lo, hi in places[0]:
            while places[1][first][2] <= lo:
                first += 1
            k = first
            while k < len(places[1]) and places[1][k][1] < hi:
                links.append((i, places[1][k][0]))
                k += 1
        common = {e for _, _, e in places[0]} & {e for _, _, e in places[1]}
        groups = []
        for side in places:
            groups.append([[]])
            for i, _, e in side:
                groups[-1][-1].append(str(i))
                if e in common:
                    groups[-1].append([])
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in zip(groups[0][:-1], groups[1][:-1], strict=True))
        docs.append((key, (len(a), len(b), len(common), links, text)))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = Counter()
    for key, x in docs:
        out[(key, 0, 0, 0, 0, 0, 0, "") if x is None else (key, x[0], x[1], x[2], len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), sha(x[4]))] += 1
    return out, counts


def test_alignment_against_plain_loops(spark, monkeypatch):
    """Many small blocks, so that counts cross them; odd texts, repeated rows, null ids."""
    rng = np.random.default_rng(2)
    words = ["the", "garden", "élan", "naïve,", "don't", "12345", "日本語", "x😀y", "tab\there", "line\n\nline", "", "▁"]
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, " ".join(rng.choice(words[: 12 if k % 9 == 0 else 11], 30))) for k in range(80)] + [(None, "no id"), (100, "twice"), (100, "twice"), (5, "ab" * 4000)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, block int, pairs string").repartition(3)
    want, counts = plain_alignment(rows)
    got = Counter(tuple(r) for r in crosstokens.report(docs, queries.BYTE_BPE, queries.PIECE_BPE).collect())
    assert got == want
    pairs = {(r.a, r.b): r.total for r in crosstokens.pair_counts(docs, queries.BYTE_BPE, queries.PIECE_BPE).collect()}
    assert pairs == counts
    assert crosstokens.report(docs.limit(0), queries.BYTE_BPE, queries.PIECE_BPE).collect() == []


def test_blocks_keep_rows_and_bounds(monkeypatch):
    monkeypatch.setattr(crosstokens, "BLOCK_BYTES", 10)
    texts = ["aaaa", "bbbb", "cccc", "d" * 50, None, "", "eeee", "f" * 9]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": pa.array([t], pa.string())}) for k, t in enumerate(texts)]
    for some in (batches, [pa.Table.from_batches(batches).combine_chunks().to_batches()[0]]):
        blocks = [t["text"].to_pylist() for t in crosstokens._blocks(iter(some))]
        assert [t for b in blocks for t in b] == texts
        assert all(len(b) == 1 or sum(len(t or "") for t in b) <= 10 for b in blocks)


def test_a_full_lexicon_forgets_what_was_met_once(monkeypatch):
    lexicon = crosstokens.Lexicon(queries.BYTE_BPE, queries.PIECE_BPE)
    monkeypatch.setattr(crosstokens, "MEMORY", 6)
    seen = {}
    for names in (["one", "two", "three"], ["one", "four", "", "x\n"], ["five", "six", "one", "tw▁o"], ["two", "seven", "eight", "nine", "one", "ten"]):
        for w, k in zip(names, lexicon.rows(names), strict=True):
            links = sorted(lexicon.pairs[lexicon.first[k] : lexicon.first[k + 1]].tolist())
            assert seen.setdefault(w, (lexicon.n_a[k], lexicon.n_b[k], lexicon.groups[k], links)) == (lexicon.n_a[k], lexicon.n_b[k], lexicon.groups[k], links)
    assert len(lexicon.row) <= 8
