"""Bit planes and packing: exact round trips and properties against the plain tokenizer."""

import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bitplanes, packing, queries
from tidemark.llm.tokens import Encoder

TOK = Tokenizer.from_file(queries.WORD_BPE)
ODD = ["", None, " ", "\n\n", "á ́b", "it's IT'S 'll x", "ΑΣ Σ", "<|endoftext|>x <|endoftext|>", "a\tb\x0bc d\x1ce", "é́ 日本 12 3.4", "x" * 9000, "# # ##"]


def plain(text, end):
    return np.array(TOK.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_stretches_give_the_tokenizers_ids(text):
    enc = test_stretches_give_the_tokenizers_ids.__dict__.setdefault("enc", Encoder(queries.WORD_BPE))
    assert np.frombuffer(enc([text])[0], "<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([1, 8, 64]), st.sampled_from(["bit", "byte"]))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids, block, kind):
    x = np.array(ids, np.uint32)
    widths, planes = bitplanes.to_planes(x, block * 8, kind)
    assert len(planes) == sum(widths) and len(widths) == -(-len(x) // (block * 8))
    assert (bitplanes.from_planes(widths, planes, len(x), block * 8, kind) == x).all()


def test_planes_are_those_of_blocks():
    """Each block has its own planes: one large id widens its block alone, and planes change with the block size."""
    x = np.arange(1, 4097, dtype=np.uint32) % 200
    x[3000] = 2**31
    for kind, narrow, wide in (("bit", 8, 32), ("byte", 1, 4)):
        widths, planes = bitplanes.to_planes(x, 1024, kind)
        assert widths == [narrow, narrow, wide, narrow]
        z = zstandard.ZstdDecompressor()
        plane = np.frombuffer(z.decompress(planes[0]), np.uint8)
        assert plane.tolist() == (np.packbits((x[:1024] & 1).astype(np.uint8), bitorder="little") if kind == "bit" else (x[:1024] & 255).astype(np.uint8)).tolist()
        assert planes != bitplanes.to_planes(x, 2048, kind)[1] and len(bitplanes.to_planes(x, 4096, kind)[0]) == 1


def test_index_finds_chunks(spark, tmp_path):
    rows = [(i, f"text number {i} " * (1 + i % 5)) for i in range(200)] + [(None, "lost"), (-(2**63), "first of all")]
    path = str(tmp_path / "d")
    bitplanes.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, queries.WORD_BPE, chunk_ids=60, block=16)
    index = spark.read.parquet(path + "/index").collect()
    assert len(index) > 20 and sum(r.n_docs for r in index) == 202 and all(os.path.exists(f"{path}/chunks/{r.file}") for r in index)
    one = index[7]
    row = pq.ParquetFile(f"{path}/chunks/{one.file}").read().slice(one.row, 1).to_pylist()[0]
    assert (row["shard"], row["chunk"], row["crc32"]) == (one.shard, one.chunk, one.crc32)
    plain_ids = {i: plain(t, 2).tolist() for i, t in rows}
    for low, high in ((50, 61), (None, 3), (190, None), (500, 600)):
        got = {r.doc_id: r.ids for r in bitplanes.read_ids(spark, path, low, high).collect()}
        assert got == {i: v for i, v in plain_ids.items() if i is not None and (low is None or i >= low) and (high is None or i <= high)}
    assert {r.doc_id: r.ids for r in bitplanes.read_ids(spark, path).collect()} == plain_ids


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_dataset_round_trip(spark, tmp_path, kind):
    rows = [(i * 7 % 12, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (5, "second five", "x"), (5, "second five", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    bitplanes.write_ids(df, str(tmp_path / "d"), queries.WORD_BPE, chunk_ids=40, block=16, kind=kind)
    got = bitplanes.read_report(spark, str(tmp_path / "d")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at = 0
    want = sorted((-1 if i is None else i, zlib.crc32(plain(t, 2).tobytes()), len(plain(t, 2))) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = {r.doc_id: r.ids for r in bitplanes.read_ids(spark, str(tmp_path / "d")).collect()}
    assert ids[0] == plain(ODD[0], 2).tolist()


def test_empty_dataset(spark, tmp_path):
    bitplanes.write_ids(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), queries.WORD_BPE)
    assert bitplanes.read_report(spark, str(tmp_path / "e")).count() == 0


@given(st.lists(st.integers(1, 30), max_size=12))
@settings(max_examples=80, deadline=None)
def test_bound_never_exceeds_a_packing(lengths):
    x = np.array(lengths, np.int64)
    bins, offsets, n = packing.best_fit_decreasing(x, 30)
    assert packing.lower_bound(x, 30) <= n
    for b in range(n):
        at = 0
        for o, length in sorted(zip(offsets[bins == b].tolist(), x[bins == b].tolist(), strict=True)):
            assert o == at
            at += length
        assert 0 < at <= 30


def test_bound_sees_large_items():
    assert packing.lower_bound(np.array([16] * 5), 30) == 5
    assert packing.lower_bound(np.array([11] * 6), 30) == 3


def test_packing(spark):
    rows = [(i, ("ab cd " * (i % 37))[:-1] if i % 11 else None, i) for i in range(300)] + [(7, "same", 0)] * 3 + [(500, "word " * 9000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bin int").repartition(5)
    got = packing.pack(df, queries.WORD_BPE, end_id=1, capacity=64, per_partition=50).toPandas()
    for (doc, text, _), part in [((i, t, b), got[got.doc_id == i]) for i, t, b in rows if i != 7]:
        ids = plain(text, 1)
        part = part.sort_values("piece")
        assert part.length.sum() == len(ids), doc
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.length <= 64
        assert (part.length[:-1] == 64).all()
    assert (got.doc_id == 7).sum() == 4
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 64
    c = packing.certificate(packing.pack(df, queries.WORD_BPE, end_id=1, capacity=64, per_partition=50), 64)
    assert c["bound"] <= c["sequences"] == got.sequence_id.nunique() <= c["bound"] + 6  # partitions of 50 pieces, many of them large
    assert packing.pack(df.limit(0), queries.WORD_BPE).count() == 0
