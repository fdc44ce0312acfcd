"""Versioned sinks and the log source: repeats, restarts, retention, and costs that follow the batch."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import models
from tidemark.sources import storage
from tidemark.sources.logs import log_stream, parsed
from tidemark.streaming import run_once
from tidemark.streaming.tables import KeyedTable, SequencedLog, keyed_sink, sequenced_sink

ROW = "k string, n long, t timestamp, v double"


def batch(spark, rows):
    return spark.createDataFrame([(k, n, None, v) for k, n, v in rows], ROW)


@pytest.mark.parametrize("first", [False, True])
def test_keyed_table_is_a_dictionary(spark, tmp_path, first):
    rng = random.Random(4)
    table, plain = KeyedTable(str(tmp_path / "t"), ("k",), "n", first=first, buckets=3, fanout=2), {}
    past = {}
    for version in range(7):
        rows = [(rng.choice(["a", "b", "c", None, f"x{version}"]), rng.randrange(100), rng.random()) for _ in range(5)] if version != 3 else []
        rows = [(k, n, v) for i, (k, n, v) in enumerate(rows) if (k, n) not in {(r[0], r[1]) for r in rows[:i]}]
        table.write(batch(spark, rows), version)
        for k, n, v in sorted(rows, key=lambda r: r[1]):
            if first:
                plain.setdefault(k, (n, v))
            elif k not in plain or n >= plain[k][0]:
                plain[k] = (n, v)
        past[version] = dict(plain)
        table.write(batch(spark, [("a", 1_000, 0.0)]), version)  # a repeated trigger changes nothing
        assert {r.k: (r.n, r.v) for r in table.read(spark).collect()} == plain
    assert {r.k: (r.n, r.v) for r in table.read(spark, 5).collect()} == past[5]
    with pytest.raises(ValueError, match="version"):
        table.read(spark, 0)
    runs = json.loads(storage.read_text(spark, f"{tmp_path}/t/manifests/{6:012d}"))["runs"]
    assert len(runs) <= 3 and len(os.listdir(tmp_path / "t" / "manifests")) <= 2 * 3  # with checksum files


def test_a_trigger_reads_no_history(spark, tmp_path):
    """Merges take runs of one size class: most triggers touch no earlier run, and a row is merged a few times at most."""
    table = KeyedTable(str(tmp_path / "t"), ("k",), "n", buckets=2, fanout=3)
    read = []
    merge = KeyedTable._rows

    def seen(self, spark, runs, schema):
        read.append([r["name"] for r in runs])
        return merge(self, spark, runs, schema)

    KeyedTable._rows = seen
    try:
        for version in range(9):
            table.write(batch(spark, [(f"k{version}", version, 0.0)]), version)
    finally:
        KeyedTable._rows = merge
    assert len(read) == 4 and [len(x) for x in read] == [3, 3, 3, 3]
    assert table.read(spark).count() == 9


def test_a_killed_trigger_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = KeyedTable(str(tmp_path / "t"), ("k",), "n", buckets=2)
    table.write(batch(spark, [("a", 1, 1.0)]), 0)

    def dies(*a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(storage, "write_text", dies)
        with pytest.raises(RuntimeError):
            table.write(batch(spark, [("a", 2, 2.0), ("b", 1, 1.0)]), 1)
    assert [(r.k, r.n) for r in table.read(spark).collect()] == [("a", 1)] and table.version(spark) == 0
    table.write(batch(spark, [("a", 3, 3.0)]), 1)
    assert [(r.k, r.n) for r in table.read(spark).collect()] == [("a", 3)]


def test_rows_behind_the_retention_go(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), "n", time="t", keep_s=172_800, buckets=1, fanout=2)
    for day in range(6):
        table.write(spark.createDataFrame([(f"d{day}", day)], "k string, day int").selectExpr("k", "cast(day as long) as n", f"timestamp_seconds(86400 * {day}) as t", "0d as v"), day)
        assert {r.k for r in table.read(spark).collect()} == {f"d{d}" for d in range(max(0, day - 2), day + 1)}
    runs = json.loads(storage.read_text(spark, f"{tmp_path}/t/manifests/{5:012d}"))["runs"]
    assert sum(spark.read.parquet(f"{tmp_path}/t/runs/{r['name']}").count() for r in runs) < 6


def feed(spark, path, files, schema):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_streams_into_both_sinks(spark, tmp_path):
    files = [[(rng.choice("abc"), 10 * i + j, None, 0.5) for j in range(6)] for i, rng in enumerate(map(random.Random, range(5)))]
    table, log = KeyedTable(str(tmp_path / "t"), ("k",), "n"), SequencedLog(str(tmp_path / "log"), "k", "n")
    run_once(keyed_sink(feed(spark, tmp_path / "in", files, ROW), table), str(tmp_path / "c1"))
    run_once(sequenced_sink(spark.readStream.schema(ROW).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), log), str(tmp_path / "c2"))
    rows = [r for f in files for r in f]
    assert {r.k: r.n for r in table.read(spark).collect()} == {k: max(r[1] for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    got = sorted((r.seq, r.n) for r in log.since(spark, 0).collect())
    assert [s for s, _ in got] == list(range(1, 31)) and sorted(n for _, n in got) == sorted(r[1] for r in rows)


def test_numbers_have_no_gap_and_mirrors_follow_from_any_point(spark, tmp_path, monkeypatch):
    log = SequencedLog(str(tmp_path / "log"), "k", "n")
    rng = random.Random(9)
    batches = [[(rng.choice("abcd"), 100 * e + j, rng.random()) for j in range(rng.randrange(1, 9))] for e in range(4)]
    for e, rows in enumerate(batches):
        frame = batch(spark, rows).repartition(3)
        if e == 2:  # dies before its numbers are in place, then comes again
            with monkeypatch.context() as m:
                put = storage.write_text
                m.setattr(storage, "write_text", lambda s, p, t: (_ for _ in ()).throw(OSError("killed")) if "/triggers/" in p else put(s, p, t))
                with pytest.raises(OSError):
                    log.write(frame, e)
        log.write(frame, e)
        log.write(frame, e)
    rows = sorted(log.since(spark, 0).collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(1, sum(map(len, batches)) + 1)) == list(range(1, log.last(spark) + 1))
    assert [r.n for r in rows] == sorted(n for b in batches for _, n, _ in b)
    want = {r.k: r.v for r in rows}
    for start in (0, 3, log.last(spark) - 1):
        mirror = models.Mirror()
        for r in rows[: start]:
            mirror.apply(r.seq, r.k, r.v)
        for r in sorted(log.since(spark, start).collect(), key=lambda r: r.seq):
            assert mirror.apply(r.seq, r.k, r.v) == "applied"
        assert mirror.latest == want and mirror.gaps == 0
    late = models.Mirror()
    for r in sorted(log.snapshot(spark).collect(), key=lambda r: r.seq):
        assert late.apply(r.seq, r.k, r.v, snapshot=True) == "snapshot"
    assert late.latest == want and late.seq == log.last(spark)
    with pytest.raises(LookupError):
        log.since(spark, log.last(spark))


def test_each_line_of_a_log_once(spark, tmp_path):
    """Files that grow between triggers, a line that isn't ended yet, rotation, a restart from the checkpoint."""
    folder, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    lines = lambda: parsed(log_stream(spark, str(folder), ".jsonl"), "id long, note string")

    def work():
        q = lines().writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.id for r in spark.read.schema("file string, at long, id long, note string").parquet(out).collect())

    row = lambda i: json.dumps({"id": i, "note": "é" * (i % 5)})
    assert work() == []
    folder.mkdir()
    with open(folder / "a.jsonl", "w") as f:
        f.write("".join(row(i) + "\n" for i in range(5)) + row(5)[:7])
    assert work() == list(range(5))
    with open(folder / "a.jsonl", "a") as f:
        f.write(row(5)[7:] + "\nnot json\n\n" + row(6))
    assert work() == list(range(6))
    with open(folder / "b.jsonl", "w") as f:
        f.write(row(7) + "\n")
    (folder / "c.other").write_text(row(99) + "\n")
    assert work() == list(range(8))  # the last line of a file that has a successor is complete
    assert work() == list(range(8))


def test_parts_of_a_file_share_its_lines(spark, tmp_path, monkeypatch):
    from tidemark.sources import logs

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("j")).orderBy("event_id").collect()
    text = [r.j for r in events]
    (tmp_path / "x.log").write_text("\n".join(text) + "\n")
    monkeypatch.setattr(logs, "TASK_BYTES", 777)
    monkeypatch.setattr(logs, "READ_BYTES", 100)
    reader = logs._Reader({"path": str(tmp_path)})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    got = [line for p in parts for b in reader.read(p) for line in b.column(2).to_pylist()]
    assert got == text and len(parts) > 20
    at = [a for p in parts for b in reader.read(p) for a in b.column(1).to_pylist()]
    assert at == sorted(set(at)) and at[0] == 0
