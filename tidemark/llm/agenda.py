"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs, for merge-type vocabularies.

A stretch of text (`stretches`) starts as its characters. Its agenda holds each pair of neighbours whose text is a piece, by
the piece's score; the best pair, of equal scores the leftmost, becomes one symbol, and the pairs it makes with its neighbours
join the agenda. What is left when the agenda is empty are the pieces; a character that is none is spelled in bytes.

Short stretches keep their agendas side by side in matrices, of which each round takes the best pair of every row; a long one
has a heap of its own. No piece may hold a space after another character, else stretches would not be independent; that
is checked when a model is read. The ids of every batch are compared with what the sentencepiece library makes of its whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, short_batches
from tidemark.llm.stretches import spread, stretches
from tidemark.llm.tokens import text_slices

SPACE = "▁"
#: Stretches of more characters have an agenda of their own.
LONG = 48
NONE = np.int32(2**31 - 1)
#: Bits of a symbol: pieces come first, then all code points.
BITS = 21


class Pairs:
    """Which piece a pair of symbols makes: an open-addressed table in arrays, looked up for many pairs at once."""

    def __init__(self, made: dict[tuple[int, int], int]):
        self.size = 1 << max(4, (4 * len(made)).bit_length())
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.full(self.size, -1, np.int32)
        keys = np.array([a << BITS | b for a, b in made] or [0], np.int64)[: len(made)]
        values = np.fromiter(made.values(), np.int32, len(made))
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of those with one slot the last stays
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & (self.size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.size - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, -1 if it makes none; so does a pair with a symbol below 0."""
        keys = (left.astype(np.int64) << BITS) | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], -1)
        todo = np.flatnonzero((got != keys) & (got >= 0) & (keys >= 0))
        at, keys = at[todo], keys[todo]
        while len(todo):
            at = (at + 1) & (self.size - 1)
            got = self.keys[at]
            same = got == keys
            out[todo[same]] = self.values[at[same]]
            more = ~same & (got >= 0)
            todo, at, keys = todo[more], at[more], keys[more]
        return out


class Agenda:
    """A merge-type sentencepiece model, read from the library; encodes stretches by agendas of symbol pairs."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = m.vocab_size()
        pieces = {m.id_to_piece(i): i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
        if any(m.is_unused(i) for i in range(n)) or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("this model has unused pieces, or pieces that go on after a space; its stretches aren't independent")
        spelled = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        if len(spelled) < 256:
            raise ValueError("this model can't spell unknown characters in bytes")
        self.byte_ids = np.array([spelled[b] for b in range(256)], np.int32)
        self.of_char = n + np.arange(0x110000, dtype=np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[0x20] = self.of_char[ord(SPACE)]
        _, ranks = np.unique([-m.get_score(i) for i in range(n)], return_inverse=True)
        self.rank = np.append(ranks.astype(np.int32), NONE)  # the last is that of no piece
        symbol = lambda s: pieces[s] if s in pieces else n + ord(s) if len(s) == 1 else None
        made = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    made[a, b] = i
        self.pairs, self.made = Pairs(made), made

    def _side_by_side(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of many stretches, a row each, -1 after its end, merged in place: -1 where nothing is left."""
        n, width = symbols.shape
        s = np.full((n, width + 1), -1, np.int32)
        s[:, :width] = symbols
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        before = after - 2
        after[:, width] = width
        piece = np.full((n, width + 1), -1, np.int32)
        piece[:, :width] = self.pairs(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(n, width)
        rank = self.rank[piece]
        rows = np.arange(n)
        flat = [x.reshape(-1) for x in (s, after, before, piece, rank)]
        symbol, nxt, prev, makes, order = flat
        while len(rows):
            best = rank[rows].argmin(1)
            at = rows * (width + 1) + best
            live = order[at] != NONE
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            base = at - best[live]
            gone = base + nxt[at]
            symbol[at], symbol[gone] = makes[at], -1
            order[gone] = NONE
            nxt[at] = nxt[gone]
            right = base + nxt[at]
            prev[right] = at - base
            makes[at] = new = self.pairs(symbol[at], symbol[right])
            order[at] = self.rank[new]
            has = prev[at] >= 0
            left, at = base[has] + prev[at[has]], at[has]
            makes[left] = new = self.pairs(symbol[left], symbol[at])
            order[left] = self.rank[new]
        return s[:, :width]

    def _alone(self, symbols: list[int]) -> list[int]:
        """The same for one stretch, its agenda in a heap; an entry counts if both symbols are still what they were."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        rank = self.rank
        agenda = [(int(rank[i]), k, k + 1, a, b) for k, (a, b) in enumerate(zip(symbols[:-1], symbols[1:], strict=True)) if (i := self.made.get((a, b))) is not None]
        heapify(agenda)
        s = list(symbols)
        while agenda:
            _, i, j, a, b = heappop(agenda)
            if s[i] != a or s[j] != b or after[i] != j:
                continue
            s[i], s[j] = self.made[a, b], -1
            after[i] = k = after[j]
            if k < len(s):
                before[k] = i
                if (p := self.made.get((s[i], s[k]))) is not None:
                    heappush(agenda, (int(rank[p]), i, k, s[i], s[k]))
            h = before[i]
            if h >= 0 and (p := self.made.get((s[h], s[i]))) is not None:
                heappush(agenda, (int(rank[p]), h, i, s[h], s[i]))
        return [x for x in s if x >= 0]

    def encode(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many ids each has) of stretches; a stretch is a space and its name."""
        points = np.frombuffer("".join([f" {w}" for w in names]).encode("utf-32-le"), "<u4")
        symbols = self.of_char[points]
        chars = np.fromiter(map(len, names), np.int64, len(names)) + 1
        starts = np.cumsum(chars) - chars
        parts, counts = [], np.zeros(len(names), np.int64)
        edges = [0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 17, 22, 32, LONG]
        for low, width in zip(edges[:-1], edges[1:], strict=True):
            which = np.flatnonzero((chars > low) & (chars <= width))
            if len(which):
                at = starts[which, None] + np.arange(width)
                inside = np.arange(width) < chars[which, None]
                got = self._side_by_side(np.where(inside, symbols[np.where(inside, at, 0)], -1))
                counts[which] = (got >= 0).sum(1)
                parts.append((which, got[got >= 0]))
        for k in np.flatnonzero(chars > LONG).tolist():
            got = np.array(self._alone(symbols[starts[k] : starts[k] + chars[k]].tolist()), np.int32)
            counts[k] = len(got)
            parts.append((np.array([k]), got))
        begin = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int32)
        for which, got in parts:
            ids[spread(begin[which], counts[which])] = got
        if (ids >= self.n).any():
            return self._spelled(ids, counts)
        return ids, counts

    def _spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces, spelled in bytes."""
        odd = np.flatnonzero(ids >= self.n)
        octets = [chr(c).encode() for c in (ids[odd] - self.n).tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[odd] = list(map(len, octets))
        out = np.repeat(ids, sizes)
        out[spread((np.cumsum(sizes) - sizes)[odd], sizes[odd])] = self.byte_ids[np.frombuffer(b"".join(octets), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return out, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, the n + 1 offsets of texts in them)."""
        # the vocabulary's sign for a space stands for one in a text, too
        index, offsets, names = stretches(pc.replace_substring(texts, SPACE, " "))
        ids, counts = self.encode(names)
        starts = np.cumsum(counts) - counts
        lens = counts[index]
        return ids[spread(starts[index], lens)], np.concatenate([[0], np.cumsum(lens)])[offsets]


def encode_documents(docs: DataFrame, model: str, check: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text: ids by agendas, decoded by the library from them.

    With `check`, each batch of texts is encoded by the library too, and other ids than its own are an error. Null texts are
    empty: no ids, an empty text. Rows are taken one by one, so repeated rows and null ids stay; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = held(("agenda", model), lambda: Agenda(model))
        for batch in batches:
            texts = batch.column(1)
            for i, j in text_slices(texts):
                part = texts.slice(i, j - i)
                ids, ends = agenda.texts(part)
                lists = [ids[a:b].tolist() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                if check:
                    for ours, text, theirs in zip(lists, whole := [t or "" for t in part.to_pylist()], agenda.library.encode(whole, num_threads=1), strict=True):
                        if ours != theirs:
                            raise ValueError(f"ids differ from the library's in a text that begins {text[:80]!r}")
                decoded = [agenda.library.decode(x) if x else "" for x in lists]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, ids array<int>, decoded string")


def report(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256, of `encode_documents`."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encode_documents(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
