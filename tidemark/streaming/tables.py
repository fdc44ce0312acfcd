"""Sinks as tables with versions: the latest or first row of each key, and a log with one sequence of numbers.

A keyed table is a list of runs. A trigger adds one run with its own rows only; runs of one size class are merged into one
of the next as soon as there are `fanout` of them, so the work of a trigger follows its rows, not what was stored before.
Readers merge the runs of a version. A version is a small manifest that is put in place when everything it names has been
written: a trigger that is killed leaves the version before it, and one that is repeated changes nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.sources import storage


@dataclass(frozen=True)
class KeyedTable:
    """One row of each key at `path`: of largest `order` (of equal ones the later trigger's), or with `first` the first
    written. With `time` and `keep_s`, rows that lie more than so many seconds behind the newest go: readers don't see
    them, and merges leave them out. Rows are written in `buckets` by a hash of the key. `versions` of them stay readable."""

    path: str
    key: tuple[str, ...]
    order: str
    first: bool = False
    time: str | None = None
    keep_s: float | None = None
    buckets: int = 16
    fanout: int = 4
    versions: int = 3

    def _manifest(self, spark: SparkSession, version: int | None = None) -> dict | None:
        found = [int(n) for n in storage.names(spark, f"{self.path}/manifests") if n.isdigit()]
        if version is None:
            version = max(found, default=-1)
        return json.loads(storage.read_text(spark, f"{self.path}/manifests/{version:012d}")) if version in found else None

    def version(self, spark: SparkSession) -> int | None:
        """Number of the newest version."""
        m = self._manifest(spark)
        return m and m["version"]

    def _merged(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c != "__bucket"]
        pick = F.min_by if self.first else F.max_by
        by = F.struct("__version", self.order) if self.first else F.struct(self.order, "__version")
        return rows.groupBy(*self.key).agg(pick(F.struct(*columns), by).alias("__r")).select("__r.*")

    def _since(self, newest: float | None):
        """Condition of rows that are kept."""
        if self.time is None or self.keep_s is None or newest is None:
            return F.lit(True)
        return F.coalesce(F.col(self.time).cast("double") >= newest - self.keep_s, F.lit(True))

    def _put(self, rows: DataFrame, run: str) -> None:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/runs/{run}")

    def _rows(self, spark: SparkSession, runs: list[dict], schema: str) -> DataFrame:
        paths = [f"{self.path}/runs/{r['name']}" for r in runs]
        x = spark.read.schema(f"{schema}, __version long")
        return x.option("recursiveFileLookup", "true").parquet(*paths) if paths else spark.createDataFrame([], f"{schema}, __version long")

    def write(self, batch: DataFrame, version: int) -> None:
        """Add a batch as a version; a version that is there already, or an older one, is left as it is."""
        spark = batch.sparkSession
        m = self._manifest(spark) or {"version": -1, "runs": [], "newest": None}
        if version <= m["version"]:
            return
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        newest = m["newest"]
        self._put(self._merged(batch.withColumn("__version", F.lit(version).cast("long"))), f"{version:012d}-0")
        runs = [*m["runs"], {"name": f"{version:012d}-0", "level": 0}]
        if self.time is not None:
            top = self._rows(spark, runs[-1:], ddl).agg(F.max(F.col(self.time).cast("double"))).first()[0]
            newest = max(v for v in (newest, top) if v is not None) if (newest, top) != (None, None) else None
        level = 0
        while len(same := [r for r in runs if r["level"] == level]) >= self.fanout:
            level += 1
            name = f"{version:012d}-{level}"
            self._put(self._merged(self._rows(spark, same, ddl)).where(self._since(newest)), name)
            runs = [r for r in runs if r not in same] + [{"name": name, "level": level}]
        storage.write_text(spark, f"{self.path}/manifests/{version:012d}", json.dumps({"version": version, "runs": runs, "newest": newest, "schema": ddl}))
        self._vacuum(spark)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The table as of a version that is kept, the newest by default."""
        m = self._manifest(spark, version)
        if m is None:
            raise ValueError(f"{self.path} has no version {'yet' if version is None else version}")
        return self._merged(self._rows(spark, m["runs"], m["schema"])).where(self._since(m["newest"])).drop("__version")

    def _vacuum(self, spark: SparkSession) -> None:
        """Old manifests, and runs that no kept one names, but for runs of a version under way."""
        found = [n for n in storage.names(spark, f"{self.path}/manifests") if n.isdigit()]
        old, kept = found[: -self.versions], found[-self.versions :]
        if not old:
            return
        named = {r["name"] for n in kept for r in json.loads(storage.read_text(spark, f"{self.path}/manifests/{n}"))["runs"]}
        for n in old:
            storage.remove(spark, f"{self.path}/manifests/{n}")
        for run in storage.names(spark, f"{self.path}/runs"):
            if run not in named and run[:12] <= kept[-1]:
                storage.remove(spark, f"{self.path}/runs/{run}")


def keyed_sink(stream: DataFrame, table: KeyedTable) -> DataStreamWriter:
    """Sink of a stream into a keyed table, a version a trigger."""
    return stream.writeStream.foreachBatch(table.write)


@dataclass(frozen=True)
class SequencedLog:
    """A log whose rows have numbers 1, 2, ... without gaps over all triggers, and the latest row of each topic beside it.

    A trigger's rows are numbered in the order of `order`: they are dealt to ranges of it, sorted and written, so that
    their places are fixed; rows of each range are counted, and the number of a row is what came before its trigger, the
    ranges before its own, and its place. A trigger that is repeated, also by an executor's or the driver's death, gives
    the same numbers once.
    """

    path: str
    topic: str
    order: str

    @property
    def latest(self) -> KeyedTable:
        return KeyedTable(f"{self.path}/latest", (self.topic,), "seq")

    def _manifests(self, spark: SparkSession) -> list[int]:
        return [int(n) for n in storage.names(spark, f"{self.path}/triggers") if n.isdigit()]

    def _trigger(self, spark: SparkSession, n: int) -> dict:
        return json.loads(storage.read_text(spark, f"{self.path}/triggers/{n:012d}"))

    def last(self, spark: SparkSession) -> int:
        """The number of the newest row, 0 if there is none."""
        done = self._manifests(spark)
        return self._trigger(spark, done[-1])["last"] if done else 0

    def write(self, batch: DataFrame, epoch: int) -> None:
        """Number and append a trigger's rows, unless that trigger is there."""
        spark = batch.sparkSession
        done = self._manifests(spark)
        if epoch in done:
            return
        before = self._trigger(spark, done[-1])["last"] if done else 0
        raw, place = f"{self.path}/raw/{epoch:012d}", F.monotonically_increasing_id()
        batch.repartitionByRange(self.order).sortWithinPartitions(self.order).withColumn("__at", place).write.mode("overwrite").parquet(raw)
        rows = spark.read.parquet(raw).withColumn("__part", F.shiftright("__at", 33))
        counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a range
        earlier = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.select("__part", earlier.alias("__before"))
        inside = F.col("__at").bitwiseAND((1 << 33) - 1)
        numbered = rows.join(offsets, "__part").withColumn("seq", (F.lit(before + 1) + F.col("__before") + inside).cast("long")).drop("__part", "__at", "__before")
        numbered.write.mode("overwrite").parquet(f"{self.path}/log/{epoch:012d}")
        log = spark.read.schema(numbered.schema).parquet(f"{self.path}/log/{epoch:012d}")
        n = log.count()
        self.latest.write(log, epoch)
        storage.write_text(spark, f"{self.path}/triggers/{epoch:012d}", json.dumps({"first": before + 1, "last": before + n}))
        storage.remove(spark, raw)

    def since(self, spark: SparkSession, seq: int) -> DataFrame:
        """Rows after a number, of triggers that are done; only folders that hold such rows are read."""
        triggers = [n for n in self._manifests(spark) if self._trigger(spark, n)["last"] > seq]
        if not triggers:
            raise LookupError("nothing has been written after this number")
        return spark.read.parquet(*[f"{self.path}/log/{n:012d}" for n in triggers]).where(F.col("seq") > seq)

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """What a new reader starts from: the latest row of each topic under its own number, the largest of which is the
        number that `since` goes on from."""
        return self.latest.read(spark)


def sequenced_sink(stream: DataFrame, log: SequencedLog) -> DataStreamWriter:
    """Sink of a stream into a sequenced log."""
    return stream.writeStream.foreachBatch(log.write)
