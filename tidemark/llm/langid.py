"""Language identification by cross-parsing: how few phrases of a language's own text does a text need?

Training text of each language goes into a suffix automaton, words set apart by one space. A whole text, brought into
the same form, is parsed from left to right: each phrase is the longest match in the automaton, across words (one
character where nothing matches). Phrases times log2 of the training text's length is the text's cost in bits, so that
languages with more and less training text compare; the language of least cost wins.

The parse is sequential, but parses begun at different places soon share their phrase starts. So a text is cut to
stretches that are all parsed side by side, and each stretch's parse is then continued into the next one until the two
agree; from there on the next one's own parse is the text's. Where they don't agree within a stretch, the text is
parsed from its start. The counts are those of the plain parse.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, short_batches
from tidemark.llm.tokens import text_slices

WORD = regex.compile(r"\p{L}+")
#: Characters of a stretch that is parsed beside others.
STRETCH = 256
#: Entries of a table of all transitions; beyond, transitions are searched for.
MOST_ENTRIES = 16_000_000


class SuffixAutomaton:
    """All substrings of a text, as transitions of states."""

    def __init__(self, text: str):
        go: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.go = go

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse of `text` by longest matches."""
        go, n, i = self.go, 0, 0
        while i < len(text):
            state, j = 0, i
            while j < len(text):
                step = go[state].get(text[j])
                if step is None:
                    break
                state = step
                j += 1
            i = max(j, i + 1)
            n += 1
        return n


class Parser:
    """A suffix automaton as arrays, that counts the phrases of many texts at once."""

    def __init__(self, text: str):
        go = SuffixAutomaton(text).go
        letters = sorted(set(text))
        # 0 is what stands for any other character; it has no transitions
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        at = {c: k + 1 for k, c in enumerate(letters)}
        key = np.array([s * self.width + at[c] for s, t in enumerate(go) for c in t], np.int64)
        to = np.array([v for t in go for v in t.values()], np.int32)
        if len(go) * self.width <= MOST_ENTRIES:
            self.table, self.keys = np.full(len(go) * self.width, -1, np.int32), None
            self.table[key] = to
        else:
            order = np.argsort(key)
            self.table, self.keys = to[order], key[order]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """States after one more character; -1 where no match goes on."""
        key = state.astype(np.int64) * self.width + code
        if self.keys is None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.table[at], -1)

    def counts(self, chars: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each text; `chars` are code points, texts stand at `off`."""
        code, size = self.code[chars], np.diff(off)
        parts = -(-size // STRETCH)
        of = np.repeat(np.arange(len(size)), parts)
        index = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = off[of] + index * STRETCH
        length = np.minimum(STRETCH, off[of + 1] - first)
        # each stretch on its own: longest first, so that those still running stand in front
        order = np.argsort(-length, kind="stable")
        first, length, of, index = first[order], length[order], of[order], index[order]
        live = np.searchsorted(-length, -np.arange(STRETCH), "left")  # stretches of more than t characters
        begins = np.zeros(len(code), bool)
        state, own = np.zeros(len(first), np.int32), np.zeros(len(first), np.int64)
        root = np.maximum(self.step(np.zeros(self.width, np.int32), np.arange(self.width)), 0)  # 0 after a character without a match
        fresh = np.ones(len(first), bool)  # the next character begins a phrase at any rate
        for t in range(int(length.max()) if len(length) else 0):
            m = int(live[t])
            c = code[first[:m] + t]
            to = self.step(state[:m], c)
            new = fresh[:m] | (to < 0)
            begins[first[:m] + t] = new
            own[:m] += new
            state[:m] = np.where(new, root[c], to)
            fresh[:m] = state[:m] == 0
        total = np.bincount(of, own, len(size)).astype(np.int64)
        # each stretch's parse goes on in the next one until both begin a phrase at one place
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        lane = np.flatnonzero(index > 0)
        before = where[order[lane] - 1]
        state, fresh = state[before], fresh[before]
        more = np.zeros(len(lane), np.int64)
        left = np.arange(len(lane))
        lost = np.zeros(len(size), bool)
        t = 0
        while len(left):
            over = length[lane[left]] <= t
            lost[of[lane[left[over]]]] = True
            left = left[~over]
            at = first[lane[left]] + t
            c = code[at]
            to = self.step(state[left], c)
            new, there = fresh[left] | (to < 0), begins[at]
            go_on = ~(new & there)
            left, c, to, new, there = left[go_on], c[go_on], to[go_on], new[go_on], there[go_on]
            more[left] += new.astype(np.int64) - there
            state[left] = np.where(new, root[c], to)
            fresh[left] = state[left] == 0
            t += 1
        total += np.bincount(of[lane], more, len(size)).astype(np.int64)
        for i in np.flatnonzero(lost):
            total[i] = self._one(code[off[i] : off[i + 1]])
        return total

    def _one(self, code: np.ndarray) -> int:
        """Phrases of one text, character by character."""
        n, state, table, width = 0, 0, self.table, self.width
        for c in code.tolist():
            to = int(table[state * width + c]) if self.keys is None else int(self.step(np.array([state]), np.array([c]))[0])
            if state == 0 or to < 0:
                n += 1
                to = max(0, int(table[c]) if self.keys is None else int(self.step(np.array([0]), np.array([c]))[0]))
            state = to
        return n


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_text(docs: DataFrame, per_language: int = 150, letters: int = 30_000) -> dict[str, str]:
    """Training text of each language from a bounded sample of labelled documents that are not held out.

    Of documents of up to `letters` characters, about 2 * `per_language` a language, those of smallest id hash, are
    taken whole until there are `letters` characters; a language that has only longer ones is learned from its
    shortest. Depends on ids, languages and texts alone; of rows with one id and language the smallest text counts.
    """
    labelled = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    x = labelled.where(F.length("text") <= letters)
    counts = {r["lang"]: r["count"] for r in x.groupBy("lang").count().collect()}
    longer = [r["lang"] for r in labelled.select("lang").distinct().collect() if r["lang"] not in counts]
    rows = [(r["lang"], 0, r["b"]["text"]) for r in labelled.where(F.col("lang").isin(longer)).groupBy("lang").agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("b")).collect()] if longer else []
    if not counts and not rows:
        return {}
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, 2.0 * per_language / n))]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    hashed = F.xxhash64("doc_id")
    rows += [tuple(r) for r in x.where(F.pmod(hashed, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).groupBy("lang", hashed.alias("h")).agg(F.min("text").alias("text")).collect()]
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(rows):
        words = out.setdefault(lang, [])
        if sum(map(len, words)) + len(words) < letters:
            words += WORD.findall(text.lower())
    return {lang: f" {' '.join(words)} " for lang, words in out.items()}


class Model:
    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.parsers = [Parser(texts[x]) for x in self.langs]
        self.bits = np.array([math.log2(max(2, len(texts[x]))) for x in self.langs])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and phrases a character of each text."""
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.ones(n)
        words = [WORD.findall((t or "").lower()) for t in texts]
        forms = [f" {' '.join(w)} " if w else "" for w in words]
        off = np.concatenate([[0], np.cumsum([len(f) for f in forms])]).astype(np.int64)
        chars = np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32)
        phrases = np.stack([p.counts(chars, off) for p in self.parsers], 1)
        cost = phrases * self.bits
        best = cost.argmin(1)
        # bits spared against each language, as a softmax
        some = np.array([bool(w) for w in words])
        score = np.where(some, 1 / np.exp2(-np.minimum(cost - cost.min(1, keepdims=True), 60)).sum(1), 0.0)
        share = np.where(some, phrases[np.arange(n), best] / np.maximum(np.diff(off), 1), 1.0)
        return [self.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], score, share


def _from_broadcast(b: Broadcast) -> Model:
    texts = b.value
    return held(("language", zlib.crc32(repr(sorted(texts.items())).encode())), lambda: Model(texts))


def identify(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """docs with lang_pred, score and phrases_per_char added.

    `lang_pred` is a learned language, or `und` where the text is null or has no letter (then score 0); ties go to the
    first language by name. Only the text is an input of a prediction. Without `texts` the automata are built from
    `training_text(docs)`; the broadcast holds that text, bounded by languages x chars. Without any labelled row all is
    `und`. Clashing result columns of the input are replaced.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts = training_text(docs) if texts is None else texts
    shared = spark.sparkContext.broadcast(texts)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _from_broadcast(shared)
        for s in batches:
            t = [x if isinstance(x, str) else None for x in s]
            parts = [model(t[i:j]) for i, j in text_slices(t)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts]) if parts else [], "phrases_per_char": np.concatenate([p[2] for p in parts]) if parts else []})

    judge.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(judge, "lang_pred string, score double, phrases_per_char double")
    names = ("lang_pred", "score", "phrases_per_char")
    x = docs.drop(*names).withColumn("__j", udf("text"))
    return x.select(*[c for c in docs.columns if c not in names], *[F.col("__j")[n].alias(n) for n in names])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrases_per_char."""
    x = identify(docs.select("doc_id", "text", "lang"))
    return x.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "phrases_per_char")


def keep_identified(docs: DataFrame, most_phrases: float = 1.0) -> DataFrame:
    """The documents with a language: `und` goes (null texts and those without a letter), and so does text that parses no
    better than character by character (`most_phrases` phrases a character or more in its best language). Columns stay
    as they are; repeated rows are judged each, and alike; a null doc_id stays. Without any labelled row all documents
    with a letter stay."""
    texts = training_text(docs)
    if not texts:
        return docs.where(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\\p{L}")) > 0)
    x = identify(docs.withColumnsRenamed({c: f"__{c}" for c in ("lang_pred", "score", "phrases_per_char") if c in docs.columns}), texts)
    x = x.where((F.col("lang_pred") != "und") & (F.col("phrases_per_char") < most_phrases))
    back = {f"__{c}": c for c in docs.columns}
    return x.drop("lang_pred", "score", "phrases_per_char").withColumnsRenamed({k: v for k, v in back.items() if k in x.columns}).select(*docs.columns)

