"""A folder of log files as a stream: each complete line once, from where the last trigger ended."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, line string"
#: Bytes of a file that one task reads, of one batch, and of a file's end that are searched for its last line's.
TASK_BYTES, READ_BYTES, TAIL_BYTES = 64_000_000, 4_000_000, 1_000_000


class _Part(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Reader(DataSourceStreamReader):
    """Offsets are (file, byte): files are taken in the order of their names, and all but the last are complete. The last
    one grows; of it only lines that have ended are read, and its last name and byte are kept by Spark's checkpoint."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", "")

    def _open(self) -> tuple[afs.FileSystem, str]:
        return afs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (afs.LocalFileSystem(), self.path)

    def _files(self) -> list[tuple[str, int]]:
        store, root = self._open()
        infos = store.get_file_info(afs.FileSelector(root, allow_not_found=True))
        return sorted((i.base_name, i.size) for i in infos if i.type == afs.FileType.File and i.base_name.endswith(self.suffix) and i.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:
        files = self._files()
        if not files:
            return self.initialOffset()
        name, size = files[-1]
        store, root = self._open()
        end = size
        with store.open_input_file(f"{root}/{name}") as f:
            while end:
                low = max(0, end - TAIL_BYTES)
                f.seek(low)
                found = f.read(end - low).rfind(b"\n")
                if found >= 0:
                    return {"file": name, "byte": low + found + 1}
                end = low
        return {"file": name, "byte": 0}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        out = []
        for name, size in self._files():
            if start["file"] <= name <= end["file"]:
                low = start["byte"] if name == start["file"] else 0
                high = end["byte"] if name == end["file"] else size
                out += [_Part(name, a, min(a + TASK_BYTES, high)) for a in range(low, high, TASK_BYTES)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the partition's bytes."""
        store, root = self._open()
        with store.open_input_file(f"{root}/{partition.file}") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                if f.read(1) != b"\n":  # the line that began before belongs to the part before
                    at = self._line_end(f, at)
            while at < partition.end:
                f.seek(at)
                data = f.read(min(READ_BYTES, partition.end - at))
                if data[-1:] != b"\n":
                    end = self._line_end(f, at + len(data))
                    f.seek(at + len(data))
                    data += f.read(end - at - len(data))
                lines, places, p = data.split(b"\n"), [], at
                if not lines[-1]:
                    lines.pop()
                for line in lines:
                    places.append(p)
                    p += len(line) + 1
                texts = [x.decode("utf-8", "replace").removesuffix("\r") for x in lines]
                yield pa.record_batch([pa.array([partition.file] * len(lines)), pa.array(places, pa.int64()), pa.array(texts)], names=["file", "at", "line"])
                at += len(data)

    @staticmethod
    def _line_end(f, at: int) -> int:
        """Where the line that byte `at` is in has ended: after its newline, or at the end of the file."""
        f.seek(at)
        while chunk := f.read(65_536):
            found = chunk.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(chunk)
        return at

    def commit(self, end: dict) -> None:
        pass


class LogFolder(DataSource):
    """Stream format `log_folder`: (file, at, line) of the files of a folder, with options path and suffix."""

    @classmethod
    def name(cls) -> str:
        return "log_folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def log_stream(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(file, at, line) of a folder whose files are written one after the other, in the order of their names: each line
    once, as soon as it has ended or a later file exists. A query that starts again goes on behind its last finished
    trigger, and repeats an unfinished one over the same bytes. A missing folder has no lines yet."""
    spark.dataSource.register(LogFolder)
    return spark.readStream.format("log_folder").option("path", path).option("suffix", suffix).load()


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Lines of JSON as columns; lines that are no such objects are left out."""
    r = F.from_json("line", f"{schema}, `__bad` string", {"columnNameOfCorruptRecord": "__bad"})
    return lines.select("file", "at", r.alias("r")).where("r is not null and r.__bad is null").select("file", "at", "r.*").drop("__bad")

