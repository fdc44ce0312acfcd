"""Streams with timers: as-of join of two streams, failover between transports when one falls silent.

Both use `transformWithStateInPandas`, which needs Spark's RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType


def use_rocksdb(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _AsOf(StatefulProcessor):
    """Right rows of a key by time, and left rows that still wait for the watermark."""

    def __init__(self, tolerance: int | None, values: list[str], columns: list[str]):
        self.tolerance, self.values, self.columns = tolerance, values, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.right = handle.getMapState("right", "at long", "tie long, row binary")
        self.left = handle.getMapState("left", "at long, n long", "row binary")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # structs come as dictionaries
        n = self.count.get()[0] if self.count.exists() else 0
        due = set()
        for pdf in rows:
            # columns come in the order of the union, under names of Spark's own
            pdf = pdf.rename(columns=dict(zip(pdf.columns[-5:], ["at", "tie", "is_left", "l", "r"], strict=True)))
            for at, tie, is_left, mine, theirs in zip(pdf["at"].tolist(), pdf["tie"].tolist(), pdf["is_left"].tolist(), pdf["l"], pdf["r"], strict=True):
                row = list((mine if is_left else theirs).values())
                if is_left:
                    self.left.updateValue((at, n), (pickle.dumps(row),))
                    n += 1
                    due.add(at)
                elif not self.right.containsKey((at,)) or self.right.getValue((at,))[0] <= tie:
                    self.right.updateValue((at,), (tie, pickle.dumps(row)))
        self.count.update((n,))
        # one timer a time: the watermark has to reach the left row, as right rows before it may still come
        for at in due:
            self.handle.registerTimer(at)
        self._evict(timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(k for k in self.left.keys() if k[0] <= until)
        times = sorted(k[0] for k in self.right.keys())
        out, i = [], 0
        for at, n in waiting:
            while i < len(times) and times[i] <= at:
                i += 1
            found = None
            if i and (self.tolerance is None or at - times[i - 1] <= self.tolerance):
                found = pickle.loads(self.right.getValue((times[i - 1],))[1])  # noqa: S301  our own checkpoint
            out.append((*pickle.loads(self.left.getValue((at, n))[0]), *(found or [None] * len(self.values))))  # noqa: S301
            self.left.removeKey((at, n))
        self._evict(timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def _evict(self, watermark: int) -> None:
        """Right rows go once no row that may still come can have them: those a waiting row may need stay, and of the others
        up to the watermark the last, or none beyond the tolerance."""
        oldest = min([k[0] for k in self.left.keys()] + [max(watermark, 0)])
        times = sorted(k[0] for k in self.right.keys() if k[0] <= oldest)
        for at in times[:-1]:
            self.right.removeKey((at,))
        if times and self.tolerance is not None and times[-1] < oldest - self.tolerance:
            self.right.removeKey((times[-1],))

    def close(self) -> None:
        pass


def stream_asof(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], late: str = "10 seconds", tolerance_ms: int | None = None, tie: str | None = None, prefix: str = "r_") -> DataFrame:
    """Each row of a stream with the last row of another at or before it, per key: what `asof_join` gives for the same rows.

    `on` is a timestamp of both, in whole milliseconds. A left row is emitted once the watermark, `late` behind the newest
    row of either, has passed it; rows that come later than that are dropped. Of right rows with one time the one of the
    largest `tie` counts (without it, or if equal, the last to come). Without a match within the tolerance values are null.
    Rows without a time are left out, a null `tie` is 0.
    State holds left rows until the watermark, and right rows from there back to the tolerance, without one the last.
    """
    names = left.columns
    ms = F.unix_millis(F.col(on))
    tag = [F.col(by), F.col(on), ms.alias("at_ms")]
    packed = lambda df, cols: F.struct(*[df[c] for c in cols])
    types = StructType([*[left.schema[c] for c in names], *[StructField(prefix + c, right.schema[c].dataType) for c in [on, *values]]])
    empty = lambda df, cols: F.lit(None).cast(StructType([df.schema[c] for c in cols]))
    lt = left.select(*tag, F.lit(0).cast("long").alias("tie_no"), F.lit(True).alias("is_left"), packed(left, names).alias("left_row"), empty(right, [on, *values]).alias("right_row"))
    rt = right.select(*tag, F.coalesce(F.col(tie).cast("long") if tie else F.lit(0), F.lit(0)).cast("long").alias("tie_no"), F.lit(False).alias("is_left"), empty(left, names).alias("left_row"), packed(right, [on, *values]).alias("right_row"))
    both = lt.unionByName(rt).where(F.col(on).isNotNull()).withWatermark(on, late)

    return both.groupBy(by).transformWithStateInPandas(_AsOf(tolerance_ms, [on, *values], types.names), types, "append", "eventTime")


class _Failover(StatefulProcessor):
    """Which transport a feed uses, and when its main one was last heard of."""

    def __init__(self, main: str, spare: str, silent_ms: int):
        self.main, self.spare, self.silent = main, spare, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "using string, heard long, changes long")

    def _change(self, key: tuple, using: str, at: int, heard: int, changes: int) -> pd.DataFrame:
        before = self.spare if using == self.main else self.main
        self.state.update((using, heard, changes + 1))
        return pd.DataFrame({"feed": [key[0]], "was": [before], "became": [using], "at_ms": [at], "changes": [changes + 1]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        using, heard, changes = self.state.get() if self.state.exists() else (self.main, None, 0)
        first = not self.state.exists()
        if any((pdf["transport"] == self.main).any() for pdf in rows):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.silent)
            if using != self.main:
                yield self._change(key, self.main, now, now, changes)
            else:
                self.state.update((using, now, changes))
        elif first:
            # only the spare one so far: the main one has as long to be heard of
            self.state.update((using, now, changes))
            self.handle.registerTimer(now + self.silent)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        using, heard, changes = self.state.get()
        if using == self.main:
            yield self._change(key, self.spare, timerValues.getCurrentProcessingTimeInMs(), heard, changes)

    def close(self) -> None:
        pass


def failover(messages: DataFrame, main: str = "md", spare: str = "rest", silent_ms: int = 15_000) -> DataFrame:
    """(feed, was, became, at_ms, changes) of a stream messages(feed, transport, ...): a feed leaves its main transport when
    nothing has come by it for `silent_ms` of the clock, and returns with its next message. Each change is one row, made by
    a processing-time timer, so also while no feed sends anything; a feed that stays silent changes once."""
    return messages.select("feed", "transport").groupBy("feed").transformWithStateInPandas(
        _Failover(main, spare, silent_ms), "feed string, was string, became string, at_ms long, changes long", "append", "processingTime"
    )
