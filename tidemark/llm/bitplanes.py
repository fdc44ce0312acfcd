"""Token ids in bit or byte planes: fixed-size blocks of ids transposed to planes, each plane zstd-compressed.

Layout of a dataset at `path`:

* `path/chunks`: Parquet as the container, one row a chunk, files in ascending document order. A chunk holds whole
  documents, about `chunk_ids` ids, cut into blocks of `block` ids (the last is shorter). Each block is transposed on its
  own: plane p is bit (or byte) p of each of its ids, and it has as many planes as its largest id needs (`widths`).
  `planes` lists the compressed planes of all blocks. `doc_ids` (without the `n_null` null ids at the front) and
  `doc_lens` say which document has which stretch.
* `path/index`: the chunk index: shard, chunk, n_null, first_doc, last_doc, n_docs, n_ids, start (ids of the shard before
  it), bytes, crc32, and where the chunk is: the file's name and its row there. Reading a range of documents (`read_ids`)
  opens only the files, and decodes only the chunks, that the index names.

Chunks are written by Spark's committer, so a lost executor or a task run twice leaves no partial or double chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches
from tidemark.llm.tokens import BATCH_BYTES, encoder, text_slices

INDEX = "shard int, chunk int, n_null int, first_doc long, last_doc long, n_docs int, n_ids long, start long, kind string, block int, bytes long, crc32 long, file string, row long"
CHUNK = "shard int, chunk int, n_null int, first_doc long, last_doc long, n_docs int, n_ids long, start long, kind string, block int, bytes long, crc32 long, widths array<int>, doc_ids binary, doc_lens binary, planes array<binary>"


#: Shifts and masks that transpose a square of 8 x 8 bits held in 64, its own inverse.
SQUARE = [(np.uint64(k), np.uint64(m)) for k, m in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0))]


def _transpose(octets: np.ndarray) -> np.ndarray:
    """Bit j of byte i and bit i of byte j change places, in each 8 bytes."""
    x = octets.view("<u8")
    for k, mask in SQUARE:
        t = (x ^ (x >> k)) & mask
        x = x ^ t ^ (t << k)
    return x.view(np.uint8)


def to_planes(ids: np.ndarray, block: int, kind: str = "bit", level: int = 3) -> tuple[list[int], list[bytes]]:
    """Planes of each block, and all compressed planes block by block, of unsigned 32-bit ids."""
    z = zstandard.ZstdCompressor(level=level)
    widths, planes = [], []
    for at in range(0, len(ids), block):
        x = np.ascontiguousarray(ids[at : at + block], "<u4")
        width, n = max(1, int(x.max()).bit_length()), len(x)
        size = (width + 7) // 8
        rows = np.zeros((size, -(-n // 8) * 8), np.uint8)
        rows[:, :n] = x.view(np.uint8).reshape(-1, 4)[:, :size].T
        if kind == "byte":
            width, rows = size, rows[:, :n]
        else:
            rows = _transpose(rows.ravel()).reshape(size, -1, 8).transpose(0, 2, 1).reshape(8 * size, -1)[:width]
        widths.append(width)
        planes += [z.compress(r.tobytes()) for r in rows]
    return widths, planes


def from_planes(widths: list[int], planes: list[bytes], n: int, block: int, kind: str = "bit") -> np.ndarray:
    """The ids again; the exact inverse of `to_planes`."""
    z = zstandard.ZstdDecompressor()
    out = np.zeros(n, "<u4")
    first = 0
    for b, width in enumerate(widths):
        x = out[b * block : (b + 1) * block]
        rows = np.stack([np.frombuffer(z.decompress(p), np.uint8) for p in planes[first : first + width]])
        first += width
        if kind == "bit":
            size = (width + 7) // 8
            square = np.zeros((8 * size, rows.shape[1]), np.uint8)
            square[:width] = rows
            rows = _transpose(np.ascontiguousarray(square.reshape(size, 8, -1).transpose(0, 2, 1)).ravel()).reshape(size, -1)[:, : len(x)]
        x.view(np.uint8).reshape(-1, 4)[:, : len(rows)] = rows.T
    return out


def _encode(tokenizer: str, end_id: int, chunk_ids: int, block: int, kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, z = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=3)
        shard, state = TaskContext.get().partitionId(), {"chunk": 0, "start": 0}
        ids, lens, raw = [], [], []

        def close() -> pa.RecordBatch:
            data = b"".join(raw)
            x = np.frombuffer(data, "<u4")
            widths, planes = to_planes(x, block, kind)
            real = [i for i in ids if i is not None]  # null ids come first
            keys = np.array(real, "<i8").tobytes()
            row = {
                "shard": shard, "chunk": state["chunk"], "n_null": len(ids) - len(real), "first_doc": real[0] if real else None, "last_doc": real[-1] if real else None, "n_docs": len(ids), "n_ids": len(x), "start": state["start"], "kind": kind, "block": block,
                "bytes": sum(map(len, planes)), "crc32": zlib.crc32(data), "widths": widths, "doc_ids": z.compress(keys), "doc_lens": z.compress(np.array(lens, "<u8").tobytes()), "planes": planes,
            }
            state["chunk"] += 1
            state["start"] += len(x)
            ids.clear(), lens.clear(), raw.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        held = 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, j in text_slices(texts, BATCH_BYTES):
                for k, data in zip(keys[i:j], enc(texts.slice(i, j - i)), strict=True):
                    ids.append(k)
                    raw.append(data + end)
                    lens.append(len(data) // 4 + 1)
                    held += lens[-1]
                    if held >= chunk_ids:
                        yield close()
                        held = 0
        if ids:
            yield close()

    return rows


_ARROW = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("n_null", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("start", pa.int64()), ("kind", pa.string()), ("block", pa.int32()),
    ("bytes", pa.int64()), ("crc32", pa.int64()), ("widths", pa.list_(pa.int32())), ("doc_ids", pa.binary()), ("doc_lens", pa.binary()), ("planes", pa.list_(pa.binary())),
])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, chunk_ids: int = 65_536, block: int = 16_384, kind: str = "bit") -> None:
    """Encode every whole text, append `end_id`, and write the dataset in ascending doc_id order.

    Null texts are empty; null doc_ids come first; rows with one doc_id follow each other in an order fixed by their
    text. Other columns are not read. An empty table gives a dataset without chunks.
    """
    short_batches(docs.sparkSession)
    tie = F.xxhash64("text")
    x = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    x.mapInArrow(_encode(tokenizer, end_id, chunk_ids, block, kind), CHUNK).write.parquet(f"{path}/chunks")
    spark = docs.sparkSession
    chunks = spark.read.schema(CHUNK).parquet(f"{path}/chunks")
    where = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    chunks.select(*[c for c in chunks.columns if c not in ("widths", "doc_ids", "doc_lens", "planes")], *where).write.parquet(f"{path}/index")


def _chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, which of those are null, lengths) of a chunk, whose checksum is verified."""
    x = from_planes(row["widths"], row["planes"], row["n_ids"], row["block"], row["kind"])
    if zlib.crc32(x.tobytes()) != row["crc32"]:
        raise ValueError(f"chunk {row['shard']}/{row['chunk']} is damaged")
    z = zstandard.ZstdDecompressor()
    keys, lens = np.frombuffer(z.decompress(row["doc_ids"]), "<i8"), np.frombuffer(z.decompress(row["doc_lens"]), "<u8").astype(np.int64)
    none = np.arange(len(lens)) < row["n_null"]
    return x, np.concatenate([np.zeros(row["n_null"], np.int64), keys]), none, lens


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            x, keys, none, lens = _chunk(row)
            ends = np.cumsum(lens)
            crcs = [zlib.crc32(x[e - n : e].tobytes()) for e, n in zip(ends, lens, strict=True)]
            yield pa.record_batch(
                [pa.array(np.full(len(keys), row["shard"], np.int32)), pa.array(keys, mask=none), pa.array(row["start"] + ends - lens), pa.array(lens), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"]
            )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a dataset, from its decoded planes: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Every chunk's checksum is verified. Shard offsets come from the chunk index, one row a shard.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index").select("shard", "n_ids")
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    docs = spark.read.schema(CHUNK).parquet(f"{path}/chunks").mapInArrow(_decode, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(before, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of a dataset, or of its documents with low <= doc_id <= high; ids are signed 32-bit.

    A range is looked up in the index first: the names of the files that hold it come to the driver (at most as many as
    the dataset has), only those are opened, and of them only the chunks that meet the range.
    """
    chunks = spark.read.schema(CHUNK).parquet(f"{path}/chunks")
    if low is not None or high is not None:
        meets = F.lit(True)
        if high is not None:
            meets &= F.col("first_doc") <= high
        if low is not None:
            meets &= F.col("last_doc") >= low
        files = [r["file"] for r in spark.read.schema(INDEX).parquet(f"{path}/index").where(meets).select("file").distinct().collect()]
        if not files:
            return spark.createDataFrame([], "doc_id long, ids array<int>")
        chunks = spark.read.schema(CHUNK).parquet(*[f"{path}/chunks/{f}" for f in files]).where(meets)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, keys, none, lens = _chunk(batch.slice(k, 1).to_pylist()[0])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(x.view("<i4")))
                yield pa.record_batch([pa.array(keys, mask=none), ids], names=["doc_id", "ids"])

    out = chunks.mapInArrow(rows, "doc_id long, ids array<int>")
    if low is not None:
        out = out.where(F.col("doc_id") >= low)
    return out if high is None else out.where(F.col("doc_id") <= high)
