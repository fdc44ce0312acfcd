"""Tables of SQLite files, read in parallel by ranges of row ids, with comparisons evaluated by SQLite."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

ROWS = 10_000
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
_SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _kind(declared: str) -> str:
    """Type of a column by SQLite's rules of affinity."""
    d = declared.upper()
    for words, kind in ((("INT",), "bigint"), (("CHAR", "CLOB", "TEXT"), "string"), (("REAL", "FLOA", "DOUB", "NUM", "DEC"), "double"), (("BLOB",), "binary")):
        if any(w in d for w in words):
            return kind
    return "string"


def _value(kind: str, v):
    """A stored value as its column's type; SQLite may hold any type anywhere, and what doesn't fit is null."""
    if v is None:
        return None
    if kind == "string":
        return v if isinstance(v, str) else None if isinstance(v, bytes) else str(v)
    if kind == "binary":
        return v if isinstance(v, bytes) else None
    if kind == "double":
        return float(v) if isinstance(v, (int, float)) else None
    return v if isinstance(v, int) and -(2**63) <= v < 2**63 else None


class _Rows(ds.InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.n = options["path"], options["table"], int(options.get("partitions", "8"))
        self.kinds = {f.name: f.dataType.simpleString() for f in schema}
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """SQLite leaves out rows that can't pass; Spark evaluates all filters again, as stored values may be of other types."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1 and (kind := self.kinds.get(column[0])) in ("bigint", "double", "string"):
                fits = lambda v, kind=kind: isinstance(v, str) if kind == "string" else isinstance(v, (int, float)) and not isinstance(v, bool)
                if type(f) in _SIGNS and fits(f.value):
                    self.tests.append((f"{_name(column[0])} {_SIGNS[type(f)]} ?", [f.value]))
                elif isinstance(f, ds.In) and f.value and len(f.value) <= 500 and all(map(fits, f.value)):
                    self.tests.append((f"{_name(column[0])} in ({', '.join('?' * len(f.value))})", list(f.value)))
                elif isinstance(f, ds.IsNotNull):
                    self.tests.append((f"{_name(column[0])} is not null", []))
            yield f

    def partitions(self) -> list[_Rows]:
        with closing(_open(self.path)) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_name(self.table)}").fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.n))
        return [_Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        where = " and ".join(["rowid between ? and ?", *(t for t, _ in self.tests)])
        given = [partition.low, partition.high, *(v for _, vs in self.tests for v in vs)]
        with closing(_open(self.path)) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            found = db.execute(f"select {', '.join(map(_name, self.kinds))} from {_name(self.table)} where {where}", given)
            while rows := found.fetchmany(ROWS):
                columns = zip(*rows, strict=True)
                yield pa.record_batch([pa.array([_value(k, v) for v in c], _ARROW[k]) for k, c in zip(self.kinds.values(), columns, strict=True)], names=list(self.kinds))


class SqliteTable(ds.DataSource):
    """Format `sqlite_table`, with options path, table and partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with closing(_open(self.options["path"])) as db:
            columns = db.execute(f"pragma table_info({_name(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"{self.options['path']} has no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {_kind(c[2])}" for c in columns)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options), schema)


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors reach under one path, opened read-only.

    Ranges of row ids are read beside each other; a table without them can't be read. Column types are those of SQLite's
    affinities; stored values of another type are null (numbers in text columns are text). Comparisons with literals are
    evaluated by SQLite first where the session has `spark.sql.python.filterPushdown.enabled`, which is set here.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", str(partitions)).load()
