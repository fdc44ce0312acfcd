"""Benchmark decontamination by template canonicalisation.

Benchmark items and documents become token sequences in which numbers, units and names are typed placeholders. Windows
of item templates are hashed and joined with the windows of all documents; around the diagonals of the hits, item and
document are aligned within a band, so a slot may take more or fewer tokens and words may come or go. The tokens aligned
in the best passage give its coverage; its slots decide where coverage alone does not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, short_batches, stage
from tidemark.llm.recompress import U, mix
from tidemark.llm.tokens import text_slices

# Unit words and signs that become <unit>.
UNITS = frozenset(
    "% $ € £ ¥ ° mm cm m km mi mile miles inch inches ft feet foot yard yards mg g kg lb lbs oz ton tons ml l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh kph "
    "cent cents dollar dollars euro euros pound pounds percent degree degrees hz khz mhz ghz w kw j kj v volt volts amp amps pa kpa".split()
)
TOKEN = regex.compile(r"\p{N}+(?:[.,:/]\p{N}+)*|\p{L}+|[%$€£¥°]|[.!?\n]")
#: Words that are no names where they begin a sentence.
OPENERS = frozenset(
    "a an the this that these those there here it its he she we you they i my your his her our their what who whom whose which when where why how if then so "
    "and but or nor as at by for from in into of off on onto to with without after before during until while since because although though each every "
    "all any some no not none both few many most more one two is are was were be been am do does did has have had can could will would shall should may "
    "might must let given suppose assume find consider calculate compute determine solve show prove explain describe".split()
)
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
#: The same by the faster `re`, for texts of Latin-1.
LATIN = re.compile(r"[0-9²³¹¼½¾]+(?:[.,:/][0-9²³¹¼½¾]+)*|[^\W\d_²³¹¼½¾]+|[%$£¥°]|[.!?\n]")
WINDOW = 8
#: Windows of benchmark templates that may be sent to every executor; with more, windows are not prefiltered.
MOST_WINDOWS = 1_000_000
#: Items that one row of a document's hits holds at most, with their texts.
HITS = 50
#: Aligned tokens that make a leak also below the share asked for.
LONG = 13
#: Share of an item's words (not slots) from which on slots need not agree.
HIGH = 0.8
#: Widest band of diagonals that is aligned at once.
BAND = 512
END, IS_NUMBER, IS_UNIT, IS_SIGN, IS_CAPITAL, IS_OPENER = 1, 2, 4, 8, 16, 32
MULTIPLIER = U(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """What TOKEN finds."""
    text = text or ""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return TOKEN.findall(text)
    return LATIN.findall(text)


def canonical(text: str | None) -> tuple[list[str], list[str]]:
    """Template tokens and the tokens they stand for.

    Numbers are <num>; a unit word or sign next to a number is <unit>; a capitalised word (one capital, then small
    letters) that doesn't begin a sentence or line is <name>. All else is lower-cased. Sentence ends are dropped.
    """
    out: list[str] = []
    raw: list[str] = []
    begins, number = True, False
    for t in tokens(text):
        if t in ".!?\n":
            begins = True
            continue
        low = t.lower()
        if t[0].isdigit() or t[0].isnumeric():
            if out and out[-1] in UNITS and not out[-1].isalpha():
                out[-1] = UNIT
            out.append(NUMBER)
            number = True
        else:
            if number and low in UNITS:
                out.append(UNIT)
            elif not begins and low != t and t[0].isupper() and t[1:].islower():
                out.append(NAME)
            else:
                out.append(low)
            number = False
        raw.append(low)
        begins = False
    return out, raw


def _code(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


#: Kinds of slots, by number, and what stands for them in a window.
KINDS = ("", NUMBER, UNIT, NAME)
CODES = np.array([0, *(_code(k) for k in KINDS[1:])], U)


class Known(dict):
    """Numbers of tokens met, with the hash of each in lower case and its flags."""

    def __init__(self):
        self.raw, self.flag = np.zeros(1024, U), np.zeros(1024, np.uint8)

    def __missing__(self, t: str) -> int:
        n = len(self)
        if n == len(self.raw):
            self.raw, self.flag = np.resize(self.raw, 2 * n), np.resize(self.flag, 2 * n)
        low = t.lower()
        flag = END if t in ".!?\n" else IS_NUMBER if t[0].isdigit() or t[0].isnumeric() else 0
        flag |= IS_UNIT * (low in UNITS) | IS_SIGN * (low in UNITS and not low.isalpha()) | IS_CAPITAL * (low != t and t[0].isupper() and t[1:].islower()) | IS_OPENER * (low in OPENERS)
        self.raw[n], self.flag[n] = _code(low), flag
        self[t] = n
        return n


class Tokens:
    """Tokens of many texts in a row: `raw` (hash of the lower-cased token), `kind` (index in KINDS; as canonical()),
    `capital` (may be a name wherever it stands), `run` (neighbouring numbers or capitalised words have one), `text`
    (which text)."""

    __slots__ = ("capital", "kind", "raw", "run", "text")

    def __init__(self, known: Known, texts: list[str | None]):
        if len(known) > 500_000:
            known.clear()
        found = [tokens(t) for t in texts]
        size = [len(f) for f in found]
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, sum(size))
        raw, flag = known.raw[at], known.flag[at]
        text = np.repeat(np.arange(len(texts)), size)
        inside = flag & END == 0
        begins = np.ones(len(flag), bool)
        begins[1:] = ~inside[:-1] | (text[1:] != text[:-1])
        raw, flag, text, begins = raw[inside], flag[inside], text[inside], begins[inside]
        number, same = flag & IS_NUMBER > 0, text[1:] == text[:-1]
        unit = np.zeros(len(flag), bool)
        unit[1:] = (flag[1:] & IS_UNIT > 0) & number[:-1] & same
        unit[:-1] |= (flag[:-1] & IS_SIGN > 0) & number[1:] & same
        name = (flag & IS_CAPITAL > 0) & ~begins & ~unit
        self.raw, self.text, self.kind = raw, text, (number * 1 + unit * 2 + name * 3).astype(np.int8)
        self.capital = (flag & IS_CAPITAL > 0) & (flag & IS_OPENER == 0) & ~unit
        more = ((self.capital[1:] & self.capital[:-1]) | (number[1:] & number[:-1])) & ~begins[1:]
        self.run = np.concatenate([np.zeros(min(1, len(flag)), int), np.cumsum(~more)])

    def forms(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(codes, token each stands at, is it no slot) of each form that is hashed.

        The template as canonical() has it; lower-cased words with numbers alone as slots, which doesn't depend on case
        or context; and capitalised words as names also where they begin a sentence, with one slot for a run.
        """
        every = np.arange(len(self.raw))
        last = np.flatnonzero(np.diff(self.run, append=-1) != 0)
        free = np.where(self.capital, 3, np.where(self.kind == 3, 0, self.kind))
        out = []
        for kind, at in ((self.kind, every), (np.where(self.kind == 1, 1, 0), every), (free[last], last)):
            out.append((np.where(kind > 0, CODES[kind], self.raw[at]), at, kind == 0))
        return out


def _width(n: int, width: int) -> int:
    """Tokens of a window of an item of n: a third of it, from 4 (or all) to `width`, so that one change leaves some whole."""
    return min(n, width, max(4, n // 3))


def _rolled(h: np.ndarray, form: int, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(w, hashes of the windows of w tokens) for each of the rising widths."""
    x = h * MULTIPLIER + U(form + 1)
    for w in range(1, widths[-1] + 1):
        if w > 1:
            if len(h) < w:
                return
            x = x[:-1] * MULTIPLIER + h[w - 1 :]
        if w in widths:
            yield w, mix(x + U(w)).view(np.int64)


def template_windows(items: list[tuple[int, str]], width: int) -> pd.DataFrame:
    """(h, item, at, w): the windows of each item's template."""
    rows = []
    known = Known()
    for item, text in items:
        t = Tokens(known, [text])
        n = len(t.raw)
        if n < 2:
            continue
        for form, (codes, at, word) in enumerate(t.forms()):
            for w, h in _rolled(codes, form, [min(_width(n, width), len(codes))]):
                # a window of names at any place needs as many words
                rows += [(int(v), item, int(at[i]), w) for i, v in enumerate(h) if w > 1 and (form < 2 or 2 * word[i : i + w].sum() >= w)]
    return pd.DataFrame(rows, columns=["h", "item", "at", "w"]).drop_duplicates()


def _windows(widths: list[int], hashes: np.ndarray | None):
    known = Known()
    bits = min(24, max(16, int(64 * len(hashes)).bit_length())) if hashes is not None else 0
    mask = np.int64((1 << bits) - 1)
    table = []  # made once in a worker: which low bits of hashes occur

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        if hashes is not None and not table:
            table.append(np.zeros(1 << bits, bool))
            table[0][hashes & mask] = True
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in text_slices(texts):
                t = Tokens(known, texts[i:j])
                first = np.searchsorted(t.text, np.arange(j - i))
                out = []
                for form, (codes, at, _) in enumerate(t.forms()):
                    for w, h in _rolled(codes, form, widths):
                        ok = table[0][h & mask] if table else np.ones(len(h), bool)
                        k = np.flatnonzero(ok)
                        k = k[t.text[at[k]] == t.text[at[k + w - 1]]]
                        if table:
                            k = k[hashes[np.minimum(np.searchsorted(hashes, h[k]), len(hashes) - 1)] == h[k]]
                        of = t.text[at[k]]
                        out.append((keys[i:j][of], at[k] - first[of], h[k]))
                if sum(len(x[0]) for x in out):
                    key, pos, h = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.record_batch([pa.array(key, pa.int64()), pa.array(pos, pa.int32()), pa.array(h, pa.int64())], names=["doc_id", "pos", "h"])

    return rows


def _slots_agree(slots: list[tuple[str, str, str]]) -> bool:
    """Slots (type, value in the item, value in the document) are consistent: one value in the document for each value
    of the item; and if the item has two values or more of a type, so has the document."""
    seen: dict[tuple[str, str], str] = {}
    for kind, a, b in slots:
        if seen.setdefault((kind, a), b) != b:
            return False
    for kind in {k for k, _ in seen}:
        values = [b for (k, _), b in seen.items() if k == kind]
        if len(values) > 1 and len(set(values)) == 1:
            return False
    return True


def _bands(diagonals, reach: int) -> list[tuple[int, int]]:
    """Ranges of diagonals that hold the hits and `reach` more on either side; hits further apart are apart."""
    out: list[tuple[int, int]] = []
    for d in sorted(set(diagonals)):
        if out and d - out[-1][1] <= reach and d - out[-1][0] < BAND:
            out[-1] = (out[-1][0], d)
        else:
            out.append((d, d))
    return [(a - reach, b + reach) for a, b in out]


def _same(a: Tokens, b: Tokens, k: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tokens k of a and j of b are equal, or slots of one kind."""
    return (a.raw[k] == b.raw[j]) | ((a.kind[k] > 0) & (a.kind[k] == b.kind[j])) | (_named(a)[k] & _named(b)[j])


def _named(x: Tokens) -> np.ndarray:
    return x.capital | (x.kind == 3)


def _align(a: Tokens, t: Tokens, low: int, high: int) -> list[tuple[int, int]]:
    """Pairs (token of the item, token of the document) of the best passage on the diagonals low to high: 2 for a pair,
    -1 for a token that differs or that one side lacks."""
    n, d = len(a.raw), np.arange(low, high + 1)
    j = np.arange(n)[:, None] + d[None, :]
    there = (j >= 0) & (j < len(t.raw))
    pair = there & _same(a, t, np.arange(n)[:, None], np.where(there, j, 0))
    gain = np.where(pair, 2, -1).astype(np.int32)
    rise = np.arange(len(d), dtype=np.int32)
    best = np.zeros((n + 1, len(d) + 1), np.int32)
    for k in range(n):
        x = np.maximum(best[k, :-1] + gain[k], best[k, 1:] - 1)
        np.maximum(x, 0, out=x)
        best[k + 1, :-1] = np.maximum.accumulate(x + rise) - rise
    k, c = np.unravel_index(int(best.argmax()), best.shape)
    k, c = int(k), int(c)
    out = []
    while k > 0 and best[k, c] > 0:
        v = best[k, c]
        if v == best[k - 1, c] + gain[k - 1, c]:
            if pair[k - 1, c]:
                out.append((k - 1, k - 1 + low + c))
            k -= 1
        elif c and v == best[k, c - 1] - 1:
            c -= 1
        else:
            k, c = k - 1, c + 1
    return out[::-1]


def _slots(a: Tokens, t: Tokens, k: np.ndarray, j: np.ndarray) -> list[tuple[str, int, int]]:
    """Slots (kind, value in the item, value in the document) among aligned tokens."""
    kind = np.where(a.raw[k] != t.raw[j], np.where(a.kind[k] > 0, a.kind[k], 3), a.kind[k])
    return [(KINDS[x], int(p), int(q)) for x, p, q in zip(kind, a.raw[k], t.raw[j], strict=True) if x]


def _covered(a: Tokens, k: np.ndarray) -> int:
    """Tokens of the item that are aligned, or belong to a slot of which a token is."""
    return int(np.isin(a.run, a.run[k]).sum())


def _leak(a: Tokens, t: Tokens, k: np.ndarray, j: np.ndarray, width: int, coverage: float) -> bool:
    """The aligned tokens make a leak: a window of them or all the item, and the share asked for or LONG; names that
    only their capital tells, as they begin a sentence, need as many equal words. Slots need not agree where HIGH of
    the item's words stand there or most slots are filled as in the item."""
    n, m, same = len(a.raw), _covered(a, k), a.raw[k] == t.raw[j]
    words = int((same & (a.kind[k] == 0)).sum())
    if m < min(n, width) or (~same & (a.kind[k] != t.kind[j])).sum() > words:
        return False
    if m < coverage * n and (m < LONG or 2 * words < LONG):
        return False
    slots = _slots(a, t, k, j)
    all_words = int((a.kind == 0).sum())
    return (all_words > 0 and words >= HIGH * all_words) or 2 * sum(x == y for _, x, y in slots) > len(slots) or _slots_agree(slots)


def _judge(width: int, coverage: float):
    """For each (document, item) with hits: the best passage, its coverage and its slots."""
    templates: dict = {}
    known = Known()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(templates) > 10_000:
            templates.clear()
        for r in pdf.itertuples(index=False):
            t = Tokens(known, [r.text])
            for hit in r.hits:
                if hit["item_text"] not in templates:
                    templates[hit["item_text"]] = Tokens(known, [hit["item_text"]])
                a, best = templates[hit["item_text"]], None
                n = len(a.raw)
                for low, high in _bands(hit["diagonals"], min(max(8, n // 4), 64)):
                    pairs = _align(a, t, low, high)
                    if not pairs:
                        continue
                    k, j = np.array(pairs).T
                    key = (_leak(a, t, k, j, width, coverage), _covered(a, k) / n, int(k[0] - j[0]))
                    if best is None or key > best[0]:
                        slots = _slots(a, t, k, j)
                        best = (key, len(slots), sum(x != y for _, x, y in slots))
                if best and best[0][0]:
                    out.append((r.doc_id, hit["item_id"], best[0][1], -best[0][2], best[1], best[2]))
        return pd.DataFrame(out, columns=["doc_id", "item_id", "coverage", "diagonal", "n_slots", "n_changed"]).astype({"item_id": "Int64"})

    return run


def leaks(docs: DataFrame, bench: DataFrame, width: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units: one row per (doc_id, item_id).

    coverage: share of the item's template tokens that are aligned with one passage of the document; `width` of them (or
    all of a shorter item) must be. A passage below the share asked for counts from LONG aligned tokens on. n_slots of
    the aligned tokens are placeholders, n_changed filled otherwise than in the item; diagonal: token of the document
    where the item's first token stands or would stand. Items of fewer than two tokens, null texts and null doc_ids
    match nothing; items that share an id are all looked for, and those without one are found under a null item_id.
    Rows with one doc_id are judged each and the best row stays. Windows of the benchmark's templates are joined with
    those of all documents; they prefilter documents' windows in the workers only while they are MOST_WINDOWS at most.
    Only texts with hits are read again.
    """
    spark: SparkSession = docs.sparkSession
    short_batches(spark)
    shape = "doc_id long, item_id long, coverage double, diagonal long, n_slots long, n_changed long"
    items = bench.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).distinct().withColumn("item", F.xxhash64("item_id", "item_text"))

    def templates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield template_windows(list(zip(pdf["item"], pdf["item_text"], strict=True)), width)

    table = stage(items.select("item", "item_text").mapInPandas(templates, "h long, item long, at int, w int"), "templates")
    widths = sorted(r["w"] for r in table.select("w").distinct().collect())  # 4 to `width`
    if not widths:
        return spark.createDataFrame([], shape)
    some = [r["h"] for r in table.select("h").distinct().limit(MOST_WINDOWS + 1).collect()]
    hashes = np.sort(np.array(some, np.int64)) if len(some) <= MOST_WINDOWS else None
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = keyed.mapInArrow(_windows(widths, hashes), "doc_id long, pos int, h long")
    hit = found.join(table, "h").select("doc_id", "item", (F.col("pos") - F.col("at")).alias("d"))
    hit = hit.groupBy("doc_id", "item").agg(F.collect_set("d").alias("diagonals"))
    # a document that meets very many items has a row for each HITS of them
    part = F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("item")) - 1) / HITS)
    hit = hit.withColumn("part", part).join(items, "item").groupBy("doc_id", "part").agg(F.collect_list(F.struct("item_id", "item_text", "diagonals")).alias("hits")).drop("part")
    # written first: Spark then knows its size, and sends it to the texts or shuffles both
    hit = stage(hit, "hits")
    judge = _judge(width, coverage)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield judge(pdf)

    out = keyed.join(hit, "doc_id").select("doc_id", "text", "hits").mapInPandas(over, shape)
    best = F.max(F.struct("coverage", "diagonal", "n_slots", "n_changed")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[F.col("b")[n].alias(n) for n in ("coverage", "diagonal", "n_slots", "n_changed")])


def clean(docs: DataFrame, bench: DataFrame, width: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """The documents without those that hold a benchmark item; columns unchanged."""
    bad = leaks(docs.select("doc_id", "text"), bench, width, coverage).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
