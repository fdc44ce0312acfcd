"""Substring deduplication by recompression: find every repeated passage of 13 words or more.

Method. Each document's word sequence is recompressed (see `recompress`): rounds that name runs and pairs, alike in
all documents. A name is a 64-bit hash of what it stands for, so tasks give equal content equal names without an
exchange between rounds; Spark brings equal names together. Two kinds of symbols are shuffled:

* long symbols (64 words up to the whole document). One that also stands in a document with a smaller id proves its
  whole span repeated, so none of the windows inside has to be looked at again;
* anchors: each window of 13 words names one interior symbol, with its context, that every occurrence of the window
  must hold. Only windows whose anchor stands in two documents can repeat; they alone are verified, window by window.

Long symbols and windows carry a second name, made of other hashes of words: passages count as equal if both names are.
Words themselves are not compared again.

Cost follows the text, not the square of any group: every shuffle is an aggregation with map-side combining, or a join
of rows with such an aggregate that was written before, so that adaptive execution splits (or broadcasts to) hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, short_batches, stage, unstage
from tidemark.llm.recompress import C3, U, anchors, long_symbols, rolling
from tidemark.llm.words import text_chunks, texts_of

LEAST_LONG = 64


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _symbol_rows(width: int):
    """(a, check, doc_id, rk, span): anchors with their windows (check 0), long symbols with their words.

    span packs the first position and the last window, or the end, as first * 2**31 + last.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rk, ids = _column(batch, "rk"), _column(batch, "doc_id")
            for i, j, h, other, off in text_chunks(batch, "text"):
                name, doc, first, last = anchors(h, off, width)
                sym, check, d2, s, e = long_symbols(h, other, off, max(LEAST_LONG, width))
                doc = np.concatenate([doc, d2])
                span = ((np.concatenate([first, s]) - off[doc]) << 31) + np.concatenate([last, e]) - off[doc]
                yield pa.record_batch([_longs(np.concatenate([name, sym])), _longs(np.concatenate([np.zeros(len(name), U), check | U(1)])), _longs(ids[i:j][doc]), pa.array(rk[i:j][doc]), _longs(span)], names=["a", "check", "doc_id", "rk", "span"])

    return rows


def _spans(column: pa.Array) -> list[np.ndarray]:
    """Rows of an array of longs; a null row is an empty one."""
    values, none = column.values.to_numpy(zero_copy_only=False), np.zeros(0, np.int64)
    off, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return [values[off[i] : off[i + 1]] if valid[i] else none for i in range(len(column))]


def _window_rows(width: int):
    """Names of the windows that are still open: in an anchored range and not inside a span proved repeated."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rk, ids = _column(batch, "rk"), _column(batch, "doc_id")
            anchored, proved = (_spans(batch.column(batch.schema.get_field_index(n))) for n in ("anchored", "proved"))
            for i, j, h, other, off in text_chunks(batch, "text"):
                open_ = np.zeros(len(h) + 1, np.int64)
                shut = np.zeros(len(h) + 1, np.int64)
                for k in range(i, j):
                    x = anchored[k]
                    np.add.at(open_, (x >> 31) + off[k - i], 1)
                    np.add.at(open_, (x & (2**31 - 1)) + off[k - i] + 1, -1)
                    x = proved[k]
                    s, e = (x >> 31) + off[k - i], (x & (2**31 - 1)) + off[k - i]
                    np.add.at(shut, s, 1)
                    np.add.at(shut, np.maximum(e - width + 1, s), -1)
                p = np.flatnonzero((np.cumsum(open_)[:-1] > 0) & (np.cumsum(shut)[:-1] == 0))
                doc = np.searchsorted(off, p, "right") - 1
                yield pa.record_batch([_longs(rolling(h, width)[p]), _longs(rolling(other, width, C3)[p]), pa.array(rk[i:j][doc]), _longs(ids[i:j][doc]), pa.array((p - off[doc]).astype(np.int32))], names=["a", "b", "rk", "doc_id", "first"])

    return rows


def _kept(words: list[bytes], starts: np.ndarray, spans: np.ndarray, width: int) -> list[bytes]:
    """The words outside the removed windows and spans."""
    if not len(starts) and not len(spans):
        return words
    x = np.zeros(len(words) + 1, np.int32)
    np.add.at(x, starts, 1)
    np.add.at(x, np.minimum(starts + width, len(words)), -1)
    np.add.at(x, spans >> 31, 1)
    np.add.at(x, spans & (2**31 - 1), -1)
    keep = np.concatenate([[False], np.cumsum(x)[:-1] == 0, [False]])
    edge = np.flatnonzero(keep[1:] != keep[:-1]).tolist()
    return [w for s, e in zip(edge[::2], edge[1::2], strict=True) for w in words[s:e]]


def _kept_texts(width: int):
    shape = pa.struct([("n_words", pa.int64()), ("n_kept", pa.int64()), ("kept", pa.string())])

    def run(text: pa.Array, starts: pa.Array, proved: pa.Array) -> pa.Array:
        data, at = texts_of(text)
        size, left, kept = [], [], []
        for i, (p, q) in enumerate(zip(_spans(starts), _spans(proved), strict=True)):
            words = data[at[i] : at[i + 1]].tobytes().split()  # bytes split at [\x20\x09-\x0D]
            some = _kept(words, p, q, width)
            size.append(len(words))
            left.append(len(some))
            kept.append(b" ".join(some))
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(left, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], fields=list(shape))

    return F.arrow_udf(run, "n_words long, n_kept long, kept string")


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand in two documents, with the smallest doc_id."""
    return rows.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")


def kept_words(docs: DataFrame, width: int = 13, slices: int = 2) -> DataFrame:
    """docs(doc_id, text, ...) with `kept` (the words that stay, joined by one space), `n_words` and `n_kept` added.

    A word goes if a window of `width` words over it also starts in a document with a smaller doc_id. Windows are
    judged on the input. Null texts have no words. A row whose doc_id is null neither removes nor loses words. Rows
    with one doc_id don't remove each other's words; identical rows get identical results. Columns besides doc_id and
    text are carried along untouched. Symbols are matched in `slices` passes over ranges of their names, which bounds
    the disk that shuffles take at once.
    """
    short_batches(docs.sparkSession)
    base = docs.withColumn("__rk", F.hash("text"))
    slim = base.where("doc_id is not null and text is not null").select("doc_id", F.col("__rk").alias("rk"), "text")
    symbols = stage(slim.mapInArrow(_symbol_rows(width), "a long, check long, doc_id long, rk int, span long"), "symbols")
    hits = []
    for k in range(slices):
        some = symbols.where(F.pmod("a", F.lit(slices)) == k)
        seen = stage(_repeated(some, ["a", "check"]), "seen")
        hits.append(stage(some.join(seen, ["a", "check"]).where("check = 0 or doc_id > low").select("doc_id", "rk", (F.col("check") == 0).alias("anchor"), "span"), "hits"))
        unstage(seen)
    unstage(symbols)
    hit = reduce(DataFrame.union, hits)
    lists = [F.collect_set(F.when(F.col("anchor") == yes, F.col("span"))).alias(name) for yes, name in ((True, "anchored"), (False, "proved"))]
    found = stage(hit.groupBy("doc_id", "rk").agg(*lists), "found")
    for x in hits:
        unstage(x)
    anchored = found.where(F.size("anchored") > 0)
    windows = slim.join(anchored.hint("merge"), ["doc_id", "rk"]).select("doc_id", "rk", "anchored", "proved", "text")
    windows = stage(windows.mapInArrow(_window_rows(width), "a long, b long, rk int, doc_id long, first int"), "windows")
    low = stage(_repeated(windows, ["a", "b"]), "low")
    gone = windows.join(low, ["a", "b"]).where("doc_id > low").select("doc_id", "rk", "first")
    starts = stage(gone.groupBy("doc_id", "rk").agg(F.collect_set("first").alias("starts")), "starts")
    marks = starts.join(found.where(F.size("proved") > 0).select("doc_id", "rk", "proved"), ["doc_id", "rk"], "full").withColumnRenamed("rk", "__rk")
    marks = stage(marks, "marks")
    for x in (windows, low, starts, found):
        unstage(x)
    out = base.join(marks, ["doc_id", "__rk"], "left").withColumn("__kept", _kept_texts(width)("text", "starts", "proved"))
    return out.select(*docs.columns, F.col("__kept.kept").alias("kept"), F.col("__kept.n_words").alias("n_words"), F.col("__kept.n_kept").alias("n_kept"))


def report(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: see `kept_words`."""
    x = kept_words(docs.select("doc_id", "text"), width)
    return x.select("doc_id", "n_words", (F.col("n_words") - F.col("n_kept")).alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def strip_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """The documents with repeated passages cut out; untouched texts keep their spacing, and n_chars follows the text.

    A document of which nothing is left goes, unless it had no words to begin with.
    """
    names = {c: f"__in_{c}" for c in docs.columns if c in ("kept", "n_words", "n_kept")}
    x = kept_words(docs.withColumnsRenamed(names), width)
    cut = F.col("n_kept") < F.col("n_words")
    x = x.where(~cut | (F.col("n_kept") > 0)).withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return x.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
