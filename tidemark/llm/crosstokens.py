"""Alignment of two tokenizers' tokens over the same bytes, in DuckDB within each block of texts, counted by Spark over all.

A block is some megabytes of documents of one Spark partition. Its texts are cut into stretches (`stretches`), at which both
tokenizers start anew; stretches that the worker has not met yet go through both. Their tokens are laid on one axis of bytes
as interval tables of DuckDB: an as-of join finds the B token that an A token starts in, a range join the B tokens that start
within an A token; a window sum over common ends numbers the groups. What a stretch has is summed up per document and, as
counts of id pairs, per block. Spark adds the pair counts of all blocks, marks the best of each B id, and brings each block
the counts of its own pairs; then each block's documents are scored. Both shuffles carry one row a block and pair: never a
row a link or a document, and no table of pairs in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.agenda import SPACE
from tidemark.llm.common import held, short_batches, stage
from tidemark.llm.stretches import joined, spread, stretches

#: Bytes of text in a block (or one longer text), and stretches that a worker remembers.
BLOCK_BYTES = 4_000_000
MEMORY = 400_000
#: Characters of stretches whose tokens are aligned at once.
AXIS_CHARS = 300_000

#: Group number of each token: how many ends both sides have in common before it.
NUMBERED = """
create or replace temp table ends as select a.hi from a join b using (hi);
create or replace temp table tokens as
  select side, t.w, t.id, t.lo, coalesce(sum((e.hi is not null)::int) over (partition by side order by t.lo rows between unbounded preceding and 1 preceding), 0)::bigint as g
  from (select 0 as side, * from a union all select 1 as side, * from b) t left join ends e using (hi)
"""
TOKENS = "select side, w, id, g from tokens order by g, side, lo"
#: The B token in which an A token starts, and the B tokens that start within an A token, by stretches of 64 bytes.
LINKS = """
with x as (select *, unnest(range(lo >> 6, (hi - 1 >> 6) + 1)) as k from a), y as (select *, lo >> 6 as k from b)
select w, a * 4294967296 + b as p from (
  select a.w, a.id as a, b.id as b from a asof join b on a.lo >= b.lo
  union all select x.w, x.id as a, y.id as b from x join y on x.k = y.k and y.lo > x.lo and y.lo < x.hi
) order by w
"""


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, by its rule: printable ones are themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Lexicon:
    """Aligned stretches that a worker has met: tokens, groups and links of each, in growing arrays."""

    def __init__(self, byte_bpe: str, pieces: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        of = _byte_level()
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(of[c] for c in vocabulary[i]) if i in vocabulary else None for i in range(max(vocabulary) + 1)]
        m = self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(m.vocab_size())]
        if any(SPACE in m.id_to_piece(i).lstrip(SPACE) for i in range(m.vocab_size())):
            raise ValueError("this vocabulary has pieces that go on after a space; its stretches aren't independent")
        self.a_size, self.b_size = (np.array([len(x or b"") for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.db = duckdb.connect(":memory:", config={"threads": 1})
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.met = np.zeros(0, np.int64)  # in how many blocks
        self.n_a, self.n_b, self.n_groups = (np.zeros(0, np.int64) for _ in range(3))  # n_a is -1 where bytes differ
        self.groups: list[str] = []
        self.first = np.zeros(1, np.int64)  # links of stretch k: first[k] to first[k + 1] of pairs, A id above B id
        self.pairs = np.zeros(0, np.int64)

    def rows(self, names: list[str]) -> np.ndarray:
        """Row of each stretch of a block; new ones are aligned first. Rows given out before are no longer valid."""
        new = [w for w in names if w not in self.row]
        if len(self.row) + len(new) > MEMORY:
            self._forget()
            new = [w for w in names if w not in self.row]
        if new:
            self._learn(new)
        out = np.fromiter(map(self.row.__getitem__, names), np.int64, len(names))
        self.met[out] += 1
        return out

    def _forget(self) -> None:
        """Leave out stretches met in one block only; if most were met in more, all."""
        keep = np.flatnonzero(self.met > 1)
        if 2 * len(keep) > MEMORY:
            self.clear()
            return
        words = list(self.row)
        self.row = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.groups = [self.groups[i] for i in keep.tolist()]
        lens = np.diff(self.first)[keep]
        self.pairs = self.pairs[spread(self.first[keep], lens)]
        self.first = np.concatenate([[0], np.cumsum(lens)])
        self.met, self.n_a, self.n_b, self.n_groups = (x[keep] for x in (np.ones_like(self.met), self.n_a, self.n_b, self.n_groups))

    def _tiled(self, ids: list[int], whole: bytes, of: list[bytes | None], size: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, starts, ends) of tokens that make up the bytes of stretches and end where those end; else None."""
        if b"".join(map(of.__getitem__, ids)) != whole:
            return None
        ids = np.array(ids, np.int64)
        ends = np.cumsum(size[ids])
        return (ids, ends - size[ids], ends) if np.isin(edges[1:], ends).all() else None

    def _learn(self, new: list[str]) -> None:
        parts = []
        for i, j in joined(new, AXIS_CHARS):
            names = [w for w in new[i:j] if SPACE not in w]
            odd = [w for w in new[i:j] if SPACE in w]
            if names:
                parts += self._aligned(names)
            # the sign for a space in a text becomes a space: bytes differ
            parts += [(odd, *np.zeros((3, len(odd)), np.int64) - [[1], [0], [0]], [""] * len(odd), np.zeros(len(odd), np.int64), np.zeros(0, np.int64))] if odd else []
        for names, *_ in parts:
            self.row.update((w, len(self.row)) for w in names)
        self.n_a, self.n_b, self.n_groups = (np.concatenate([x, *(p[k] for p in parts)]) for k, x in ((1, self.n_a), (2, self.n_b), (3, self.n_groups)))
        for p in parts:
            self.groups += p[4]
        counts = np.concatenate([p[5] for p in parts])
        self.met = np.concatenate([self.met, np.zeros(len(counts), np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.pairs = np.concatenate([self.pairs, *(p[6] for p in parts)])

    def _aligned(self, names: list[str]) -> list[tuple]:
        """Alignment of stretches. Those that end in another character than white space are tokenized in one go, as
        they would stand in a text; others can only end a text, and are tokenized each on its own."""
        inner = [w for w in names if w and not w[-1].isspace()]
        last = [w for w in names if not w or w[-1].isspace()]
        names = inner + last
        sizes = np.fromiter((len(w.encode()) + 1 for w in names), np.int64, len(names))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        whole = "".join([f" {w}" for w in names]).encode()
        texts = [" ".join(inner)] * bool(inner) + last
        ours = [i for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False) for i in e.ids]
        # the library makes nothing of an empty text, not even the space before it
        theirs = [i for t, e in zip(texts, self.b.encode(texts, num_threads=1), strict=True) for i in (e if t else [self.b.piece_to_id(SPACE)])]
        a, b = self._tiled(ours, whole, self.a_bytes, self.a_size, edges), self._tiled(theirs, whole, self.b_bytes, self.b_size, edges)
        if a is None or b is None:
            if len(names) == 1:
                return [(names, np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64), [""], np.zeros(1, np.int64), np.zeros(0, np.int64))]
            half = len(names) // 2
            return self._aligned(names[:half]) + self._aligned(names[half:])
        words = [np.searchsorted(edges, lo, "right") - 1 for _, lo, _ in (a, b)]
        for table, (ids, lo, hi), w in (("a", a, words[0]), ("b", b, words[1])):
            self.db.register(table, pa.table({"w": w, "id": ids, "lo": lo, "hi": hi}))
        for statement in NUMBERED.split(";"):
            self.db.execute(statement)
        side, w, ids, g = (c.to_numpy() for c in self.db.sql(TOKENS).to_arrow_table().columns)
        # a token is followed by a comma, the last of its side in a group by a bar or semicolon, that of a stretch by a line's end
        after = np.where(side[1:] != side[:-1], np.where(side[:-1] == 0, 1, 2), np.where(g[1:] != g[:-1], 2, 0))
        after = np.append(np.where(w[1:] != w[:-1], 3, after), 3)
        marks = (",", "|", ";", "\n")
        groups = "".join([f"{i}{marks[m]}" for i, m in zip(ids.tolist(), after.tolist(), strict=True)]).split("\n")[:-1]
        ends = np.flatnonzero(np.append(g[1:] != g[:-1], True))
        links = self.db.sql(LINKS).to_arrow_table()
        n, at = len(names), links["w"].to_numpy()
        return [(names, np.bincount(words[0], minlength=n), np.bincount(words[1], minlength=n), np.bincount(w[ends], minlength=n), groups, np.bincount(at, minlength=n), links["p"].to_numpy())]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold BLOCK_BYTES of text, and cut where they hold more."""
    kept, size = [], 0
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        i = 0
        for k, n in enumerate(lens.tolist()):
            if size + n > BLOCK_BYTES and (kept or k > i):
                yield pa.Table.from_batches([*kept, batch.slice(i, k - i)])
                kept, size, i = [], 0, k
            size += n
        kept.append(batch.slice(i))
    if size or any(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept)


ROWS = "block long, docs binary, words binary, ends binary, pairs binary, place int, a int, b int, n long"
_ROWS = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("words", pa.binary()), ("ends", pa.binary()), ("pairs", pa.binary()), ("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, "<i4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values between one end and the next."""
    total = np.concatenate([[0], np.cumsum(values)])[ends]
    return total[1:] - total[:-1]


def _align(byte_bpe: str, pieces: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held(("lexicon", byte_bpe, pieces), lambda: Lexicon(byte_bpe, pieces))
        block = TaskContext.get().partitionId() << 33
        for table in _blocks(batches):
            table = table.combine_chunks()
            index, offsets, names = stretches(table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0))
            row = lexicon.rows(names)
            row_of = row[index]
            differs = _sums(lexicon.n_a[row_of] < 0, offsets) > 0
            counted = ~np.repeat(differs, np.diff(offsets))
            of = [_sums(np.where(counted, x[row_of], 0), offsets) for x in (lexicon.n_a, lexicon.n_b, lexicon.n_groups, np.diff(lexicon.first))]
            texts = list(map(lexicon.groups.__getitem__, row.tolist()))
            digests = []
            for i, j, no in zip(offsets[:-1].tolist(), offsets[1:].tolist(), differs.tolist(), strict=True):
                digests.append("" if no or i == j else hashlib.sha256(";".join(map(texts.__getitem__, index[i:j].tolist())).encode()).hexdigest())
            # words of documents that count, and the pairs that each of the block's distinct words has
            index = index[counted]
            ends = np.concatenate([[0], np.cumsum(np.where(differs, 0, np.diff(offsets)))])
            times = np.bincount(index, minlength=len(names))
            lens = np.diff(lexicon.first)[row]
            linked = lexicon.pairs[spread(lexicon.first[row], lens)]
            known, place = np.unique(linked, return_inverse=True)
            n = np.bincount(place, np.repeat(times, lens), minlength=len(known)).astype(np.int64)
            docs = pa.table({"doc_id": table["doc_id"], **dict(zip(("n_a", "n_b", "n_groups", "n_links"), of, strict=True)), "ends": ends[1:], "groups_sha256": digests})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(docs)
            yield pa.RecordBatch.from_pylist([{"block": block, "docs": sink.getvalue().to_pybytes(), "words": _packed(index), "ends": _packed(np.cumsum(lens)), "pairs": _packed(place)}], schema=_ROWS)
            if (used := np.flatnonzero(n)).size:
                none = pa.nulls(len(used), pa.binary())
                yield pa.record_batch([pa.array(np.full(len(used), block)), none, none, none, none, pa.array(used.astype(np.int32)), pa.array((known[used] >> 32).astype(np.int32)), pa.array((known[used] & 0xFFFFFFFF).astype(np.int32)), pa.array(n[used])], schema=_ROWS)
            block += 1

    return rows


def _score(key: tuple, blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of one block, from the corpus-wide counts of its pairs."""
    out = []
    for x in blocks.to_pylist():
        docs = pa.ipc.open_stream(x["docs"]).read_all()
        words, word_ends, pairs = _unpacked(x["words"]), _unpacked(x["ends"]), _unpacked(x["pairs"])
        n = int(pairs.max()) + 1 if len(pairs) else 0
        total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = counts["place"].to_numpy()
        total[at], best[at] = counts["total"].to_numpy(), counts["best"].to_numpy()
        edges = np.concatenate([[0], word_ends])
        ends = np.concatenate([[0], docs["ends"].to_numpy()])
        of = {name: _sums(_sums(v[pairs], edges)[words], ends) for name, v in (("n_best", best), ("count_sum", total))}
        out.append(pa.table({"doc_id": docs["doc_id"], **{c: docs[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, **of, "groups_sha256": docs["groups_sha256"]}))
    return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in _RESULT})


_RESULT = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def align(docs: DataFrame, byte_bpe: str, pieces: str) -> tuple[DataFrame, DataFrame]:
    """(blocks with their counts, pairs (a, b, total, best)) of all documents; both are written, so nothing is done twice."""
    short_batches(docs.sparkSession)
    found = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_align(byte_bpe, pieces), ROWS), "aligned")
    total = found.where("place is not null").groupBy("a", "b").agg(F.sum("n").alias("total"))
    # a B id has at most as many partners as the other vocabulary has ids
    best = F.col("total") == F.max("total").over(Window.partitionBy("b"))
    return found, stage(total.withColumn("best", best.cast("int")), "pairs")


def pair_counts(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """(a, b, total, best): how many links of all documents hold each id pair, and whether it is its B id's most frequent."""
    return align(docs, byte_bpe, pieces)[1]


def report(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or that either tokenizer changes (it holds the piece vocabulary's sign for a space), has no
    tokens: zeros and ''. Every row is reported, repeated rows and null ids too, and counts; other columns are not read. An
    empty table gives no rows.
    """
    found, total = align(docs, byte_bpe, pieces)
    counts = found.where("place is not null").select("block", "place", "a", "b").join(total, ["a", "b"]).select(F.col("block").alias("of"), "place", "total", "best")
    blocks = found.where("place is null").select("block", "docs", "words", "ends", "pairs")
    return blocks.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_score, RESULT)
