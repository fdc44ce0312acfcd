"""N-gram Jaccard join: MinHash banding finds candidates, full shingle sets decide.

Documents with one shingle set form a class and are handled once. A class's MinHash signature is cut into bands; bands
are shuffled on their hashes. Buckets that hold the same members are kept once. Members of a bucket are dealt to
blocks of bounded size, and each pair of blocks meets in one place with its full shingle sets, where all its pairs are
decided with one matrix product; a pair that shares several buckets is counted in the first. Blocks give back, per
member, a count of links and one edge of a spanning forest, so that no step ever makes a row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, hashes, letter_words, release, short_batches, stage, unstage
from tidemark.llm.recompress import U, mix, rolling

#: Members of a bucket that meet in one block; a place holds two blocks at most.
BLOCK = 256
#: Words handled at once in a Python worker.
CHUNK_WORDS = 120_000
ROWS = 5


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """Bands of `rows` hashes so that a pair at `threshold` shares one with probability `recall` at least; equal sets always do."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold lies in (0, 1], recall in (0, 1)")
    if threshold == 1:
        return 1
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct names of n-word shingles; a text of fewer words has one shingle of all its words."""
    if not len(h):
        return np.zeros(0, U)
    return np.unique(rolling(h, min(n, len(h))))


def _chunks(batch: pa.RecordBatch, column: str = "h") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about CHUNK_WORDS words with their hashes and offsets."""
    lists = batch.column(batch.schema.get_field_index(column))
    release()
    off = lists.offsets.to_numpy().astype(np.int64)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_WORDS, "right")) - 1)
        part = lists.slice(i, j - i)
        o = part.offsets.to_numpy().astype(np.int64)
        yield batch.slice(i, j - i), part.values.slice(o[0], o[-1] - o[0]).to_numpy(zero_copy_only=False).view(np.uint64), o - o[0]
        i = j


def _signatures(n: int, bands: int, rows: int):
    rng = np.random.default_rng(20_240_601)
    factors = (rng.integers(1, 2**63, bands * rows, dtype=np.int64).astype(U) << U(1) | U(1))[:, None]
    salt = mix(np.arange(bands, dtype=U) + U(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, off in _chunks(batch):
                size, a, b, hands = [], [], [], []
                for i in range(part.num_rows):
                    s = shingles(h[off[i] : off[i + 1]], n)
                    low = np.full(bands * rows, 2**32, U)
                    for k in range(0, len(s), 4096):
                        low = np.minimum(low, ((s[None, k : k + 4096] * factors) >> U(32)).min(1))
                    x = salt.copy()
                    for c in low.reshape(bands, rows).T:
                        x = mix(x ^ c)
                    size.append(len(s))
                    a.append(mix(s).sum(dtype=U))
                    b.append(mix(s ^ U(0x5DEECE66D)).sum(dtype=U))
                    hands.append(x)
                flat = np.concatenate(hands).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("rk"), pa.array(size, pa.int32()), pa.array(np.array(a).view(np.int64)), pa.array(np.array(b).view(np.int64)), lists], names=["doc_id", "rk", "n", "a", "b", "bands"]
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, off in _chunks(batch):
                sets = [shingles(h[off[i] : off[i + 1]], n).view(np.int64) for i in range(part.num_rows)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.record_batch([part.column("node"), part.column("copies"), part.column("buckets"), part.column("sizes"), lists], names=["node", "copies", "buckets", "sizes", "shingles"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    if m == 2:
        x = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), x], [x, len(sets[1])]])
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[at] > 1
    who, at = who[shared], column[at[shared]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    out = np.zeros((m, m), np.float64)
    width = 2048
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, [lo, lo + width])
        x = np.zeros((m, width), np.float32)
        x[who[i:j], at[i:j] - lo] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int64)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each member the smallest index it is connected to."""
    m = len(linked)
    root = np.full(m, -1)
    for i in range(m):
        if root[i] >= 0:
            continue
        root[i] = i
        front = [i]
        while front:
            new = np.flatnonzero(linked[front].any(0) & (root < 0))
            root[new] = i
            front = new.tolist()
    return root


def _verify(threshold: float):
    t = Fraction(threshold).limit_denominator(10_000)

    def decide(bucket: int, diagonal: bool, rows: list[tuple]) -> list[tuple]:
        nodes, copies, sides, buckets, sets = zip(*rows, strict=True)
        m = len(nodes)
        size = np.array([len(s) for s in sets])
        if m < 2 or not size.all():
            return []
        both = _overlaps(list(sets))
        linked = both * (t.denominator + t.numerator) >= t.numerator * (size[:, None] + size[None, :])
        # a pair that meets in an earlier bucket has been decided there
        earlier = [[x for x in b if x < bucket] for b in buckets]
        names = {x: k for k, x in enumerate(sorted({x for b in earlier for x in b}))}
        if names:
            met = np.zeros((m, len(names)), np.float32)
            for i, b in enumerate(earlier):
                met[i, [names[x] for x in b]] = 1
            linked &= (met @ met.T) == 0
        if not diagonal:
            side = np.array(sides)
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        links = (linked * np.array(copies)[None, :]).sum(1)
        root = _forest(linked)
        return [(nodes[i], int(links[i]), nodes[root[i]]) for i in range(m) if links[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["node", "links", "peer"])

        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            heads = list(zip(*(col[n].to_pylist() for n in ("bucket", "lo", "hi", "node", "copies", "side", "buckets")), strict=True))
            off, flat = col["shingles"].offsets.to_numpy(), col["shingles"].values.to_numpy(zero_copy_only=False).view(U)
            for i, (bucket, lo, hi, node, copies, side, buckets) in enumerate(heads):
                if key != (bucket, lo, hi):
                    if rows:
                        out += decide(key[0], key[1] == key[2], rows)
                    key, rows = (bucket, lo, hi), []
                if not rows or rows[-1][0] != node:  # identical rows of the input arrive next to each other
                    rows.append((node, copies, side, buckets, flat[off[i] : off[i + 1]].copy()))
            if len(out) > 5000:
                yield flush()
        if rows:
            out += decide(key[0], key[1] == key[2], rows)
        yield flush()

    return run


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(doc_id, rk, class_id, n_links, copies) for each row with a word.

    Words are lower-cased runs of letters and digits; shingles are n words, a shorter text is one shingle of its words.
    Two rows are linked if the Jaccard similarity of their shingle sets is `threshold` or more; class_id is the
    smallest doc_id reachable by links, n_links the number of other rows linked directly, copies the rows with the same
    set, itself included. rk is `hash(text)`. Texts without words and rows without a doc_id are linked with nothing and
    not returned here. A pair at the threshold is met with probability `recall`, a more similar one with more.
    """
    short_batches(docs.sparkSession)
    bands = bands_for(threshold, recall)
    keyed = docs.where("doc_id is not null").select("doc_id", F.hash("text").alias("rk"), "text")
    words = keyed.select("doc_id", "rk", letter_words(F.col("text")).alias("w")).where("size(w) > 0")
    sig = words.select("doc_id", "rk", hashes(F.col("w")).alias("h")).mapInArrow(_signatures(n, bands, ROWS), "doc_id long, rk int, n int, a long, b long, bands array<long>")
    sig = stage(sig.withColumn("node", F.xxhash64("n", "a", "b")), "signatures")
    row = F.struct("doc_id", "rk")
    classes = stage(sig.groupBy("node").agg(F.min(row).alias("row"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node") % (1 << 40)).alias("sum"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("x")).where("m > 1")
    full = full.groupBy("m", "sum", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    active = banded.join(full, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "m")).alias("in"))
    active = stage(active.join(classes.select("node", "row", "copies"), "node").select("node", "row.doc_id", "row.rk", "copies", F.col("in.bucket").alias("buckets"), F.col("in.m").alias("sizes")), "active")
    # a merge join at any size: the texts move once, and only those of active nodes are read again
    sets = keyed.join(active.hint("merge"), ["doc_id", "rk"]).select("node", "copies", "buckets", "sizes", hashes(letter_words(F.col("text"))).alias("h"))
    sets = sets.mapInArrow(_sets(n), "node long, copies long, buckets array<long>, sizes array<long>, shingles array<long>")
    sets = sets.withColumn("at", F.explode(F.arrays_zip("buckets", "sizes"))).withColumn("blocks", F.ceil(F.col("at.sizes") / BLOCK)).withColumn("side", F.pmod(F.xxhash64("node", F.lit(3)), "blocks"))
    sets = sets.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    placed = sets.select(F.col("at.buckets").alias("bucket"), F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "node", "copies", "side", "buckets", "shingles")
    key = ["bucket", "lo", "hi"]
    links = stage(placed.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(_verify(threshold), "node long, links long, peer long"), "links")
    whole = components(links.where("node <> peer"), "node", "peer")
    named = classes.select("node", "low", "copies").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low").alias("class_id"))
    named = named.join(lows, "component").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    # written before all rows are joined with it, so that the rows of a class with very many copies can be split
    named = stage(named.select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copies"), "named")
    out = stage(sig.select("doc_id", "rk", "node").join(named, "node").drop("node"), "classified")
    for x in (sig, classes, active, named):
        unstage(x)
    return out


def report(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copies; a document without words or id is its own class."""
    found = near_duplicates(docs.select("doc_id", "text"), n, threshold, recall).select("doc_id", "class_id", "n_links", "copies")
    words = F.coalesce("text", F.lit("")).rlike("[\\p{L}\\p{N}]")
    rest = docs.where(~words | F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return found.unionByName(rest)


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The documents, one of each class: the one of smallest doc_id. Texts without words stay; of rows alike in doc_id
    and text one stays, and different texts under that smallest doc_id all stay. Columns are unchanged."""
    found = near_duplicates(docs.select("doc_id", "text"), n, threshold, recall)
    gone = found.where("doc_id <> class_id").select("doc_id", F.col("rk").alias("__rk")).distinct()
    x = docs.withColumn("__rk", F.hash("text")).join(gone, ["doc_id", "__rk"], "left_anti")
    return x.dropDuplicates(["doc_id", "__rk"]).select(*docs.columns)
