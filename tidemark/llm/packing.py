"""Best-fit packing of documents into sequences, with bin counts certified by dual feasible functions.

Pieces are dealt evenly over partitions of bounded size; each packs by best-fit decreasing and computes a lower bound
of its bin count. A partition whose count exceeds the bound (a gap) gives up all bins with room left; a certified one
only its loosest tenth, as a sum of rounded-up bounds still wastes up to one bin a partition. What was given up is dealt
anew over fewer partitions and packed again; a partition keeps its former bins if packing again saves none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches, stage
from tidemark.llm.tokens import BATCH_BYTES, encoder, text_slices

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces packed together in one task.
PER_PARTITION = 20_000


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins: longest first, into the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[int] = []  # distinct room sizes, ascending
    having: dict[int, list[int]] = {}
    n = 0
    for i in order.tolist():
        x = int(lengths[i])
        k = bisect_left(rooms, x)
        if k == len(rooms):
            b, room, n = n, capacity, n + 1
        else:
            room = rooms[k]
            b = having[room].pop()
            if not having[room]:
                del having[room], rooms[k]
        bins[i], offsets[i] = b, capacity - room
        room -= x
        if room:
            if room not in having:
                having[room] = []
                insort(rooms, room)
            having[room].append(b)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = 100) -> int:
    """Bins that any packing needs, by dual feasible functions: the identity, u(k) for k up to `most_k`, and all cut-offs.

    u(k) maps x to x if (k+1)x is whole (x as a share of the capacity), else to floor((k+1)x)/k. The cut-off at e maps
    items over 1-e to 1, items under e to 0, others to themselves. Exact in integers.
    """
    if not len(lengths):
        return 0
    return bound_of_counts(np.bincount(lengths.astype(np.int64), minlength=capacity + 1), capacity, most_k)


def bound_of_counts(count: np.ndarray, capacity: int, most_k: int = 100) -> int:
    """`lower_bound` from the number of items of each length 0..capacity."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, most_k + 1):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    total, number = np.cumsum(count * x), np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    large = number[capacity] - number[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    return int(max(best, (large + -(-middle // capacity)).max()))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Token counts and checksums of each document's pieces; only documents longer than `capacity` are cut."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, j in text_slices(texts, BATCH_BYTES):
                out = []
                for key, data in zip(keys[i:j], enc(texts.slice(i, j - i)), strict=True):
                    data += end
                    out += [(key, p, at // 4, len(x) // 4, zlib.crc32(x)) for p, at in enumerate(range(0, len(data), step)) for x in [data[at : at + step]]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    short_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(rows, PIECE)


def _pack(capacity: int, last: bool):
    """Pack one partition; marks what is given up to the next round with `again`."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32", "bin"], ascending=[False, True, True, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        before = pdf["bin"].to_numpy()
        if (before >= 0).all() and len(np.unique(before)) <= n:
            names, bins = np.unique(before, return_inverse=True)
            offsets, n = pdf["offset"].to_numpy(), len(names)
        fill = np.bincount(bins, lengths, minlength=n)
        bound = lower_bound(lengths, capacity)
        again = np.zeros(n, bool)
        if not last:
            loose = np.argsort(fill, kind="stable")[: n if n > bound else max(1, n // 10)]
            again[loose] = fill[loose] < capacity
        return pdf.assign(bin=bins + (key[0] << 32), offset=offsets.astype("int64"), again=again[bins], bound=bound, bins=n)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, rounds: int = 4, per_partition: int = PER_PARTITION) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as best fit with exchange finds.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and round, bound and bins (the
    certificate of the partition that placed it; a full piece is its own). A null text is empty: one piece with the end
    id. Every row of the input is packed, repeated rows too; null doc_ids stay null. Columns besides doc_id and text
    are not read. An empty table gives no pieces.
    """
    base = stage(pieces(docs, tokenizer, end_id, capacity), "pieces")
    full = base.where(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("round"), F.lit(1).cast("long").alias("bound"), F.lit(1).cast("long").alias("bins"))
    done, todo = [full], base.where(F.col("length") < capacity).select("*", F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    shape = f"{PIECE}, bin long, offset long, part long, again boolean, bound long, bins long"
    for r in range(rounds):
        n = todo.count()
        if not n:
            break
        parts = max(1, -(-n // per_partition))
        # a first round deals rows, a later one whole bins
        part = F.pmod(F.monotonically_increasing_id(), F.lit(parts)) if r == 0 else F.pmod(F.xxhash64("bin"), F.lit(parts))
        last = r == rounds - 1 or (r > 0 and parts == 1)
        packed = stage(todo.withColumn("part", part.cast("long")).groupBy("part").applyInPandas(_pack(capacity, last), shape), "packed")
        placed = packed.where(~F.col("again"))
        # sequence ids: the round (from 1) above bit 56, then partition and bin; those of full pieces stay below bit 56
        done.append(placed.select(*base.columns, (F.col("bin") + F.lit((r + 1) << 56)).alias("sequence_id"), "offset", F.lit(r + 1).alias("round"), "bound", "bins"))
        todo = packed.where("again").select(*base.columns, "bin", "offset")
        if last:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def certificate(packed: DataFrame, capacity: int = 4096) -> dict[str, int]:
    """Sequences used and the lower bound over all pieces, from the histogram of lengths (at most `capacity` rows)."""
    rows = packed.groupBy("length").count().collect()
    count = np.zeros(capacity + 1, np.int64)
    for r in rows:
        count[r["length"]] = r["count"]
    return {"sequences": packed.select("sequence_id").distinct().count(), "bound": bound_of_counts(count, capacity)}
