"""Streams over files: the same operators as in batch, with watermarks for late rows and keyed state for folds."""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """ticks(seq, asset, ts, price) as they arrive in a folder of Parquet files."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.select(F.col("event_id").alias("seq"), F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 seconds") -> DataFrame:
    """Bars per asset and tumbling window, final once the watermark has passed the window: later rows don't change them."""
    w = ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "asset")
    return w.agg(F.count("*").alias("n"), F.min_by("price", "seq").alias("open"), F.max_by("price", "seq").alias("close"), F.sum("price").alias("total")).select("asset", F.col("window.start").alias("start"), "n", "open", "close", "total")


def dedup_rounds(rounds: DataFrame, late: str = "1 hour") -> DataFrame:
    """First row of each (asset, ts) within the watermark."""
    return rounds.withWatermark("ts", late).dropDuplicatesWithinWatermark(["asset", "ts"])


def fold_stream(ticks: DataFrame, by: str, order: str, start: Callable[[], Any], step: Callable[[Any, Any], dict | None], schema: str, idle_ms: int | None = None) -> DataFrame:
    """Keyed fold of a stream: step(state, row) in arrival order, rows of one trigger ordered by `order`.

    The state is the same object that folds batches; it is pickled between triggers and checkpointed by Spark. With
    `idle_ms` (the stream then needs a watermark) a key's state goes once the watermark is so far past its last trigger.
    A trigger's rows of one key are sorted together, so triggers bound memory (`maxFilesPerTrigger`).
    """
    names = [f.split()[0] for f in schema.split(",")]

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else start()  # noqa: S301  our own checkpoint
        rows = pd.concat(list(pdfs)).sort_values(order)
        out = [r for row in rows.itertuples(index=False) if (r := step(held, row)) is not None]
        state.update((pickle.dumps(held),))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle_ms + 1)
        yield pd.DataFrame(out, columns=names)

    return ticks.groupBy(by).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout)


def _ms(times: pd.Series) -> list[int]:
    """Epoch milliseconds of a column of timestamps."""
    return [int(t.timestamp() * 1000) for t in times]


def freeze_strikes(rounds: DataFrame, grids: tuple[int, ...] = (300, 900, 3600), late: str = "10 seconds", keep: int = 600, idle_ms: int | None = None) -> DataFrame:
    """(asset, grid_s, window_start, price, round_at, round_id): the round in effect at each window boundary, once.

    rounds: (asset, ts, price, round_id) with millisecond times. A boundary is frozen when the watermark reaches it, i.e.
    when a round `late` after it has been seen; rounds that come later than that no longer change it, but count for the
    boundaries after it. Boundaries before an asset's first round have no strike. Of rounds with one time the first
    stays, and takes over a round id that only a later one has. An asset's last `keep` rounds are held as state. With
    `idle_ms`, a boundary so far behind the asset's last round has no strike, and an asset's state goes once the watermark
    is so far past its newest round.
    """
    schema = "asset string, grid_s int, window_start timestamp, price double, round_at timestamp, round_id long"

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, frozen = pickle.loads(state.get[0]) if state.exists else ([], {})  # noqa: S301  our own checkpoint
        for pdf in () if state.hasTimedOut else pdfs:
            for at, price, number in zip(_ms(pdf["ts"]), pdf["price"], pdf["round_id"], strict=True):
                number = None if pd.isna(number) else int(number)
                i = bisect_left(known, at, key=lambda r: r[0])
                if i < len(known) and known[i][0] == at:
                    if known[i][2] is None:
                        known[i] = (*known[i][:2], number)
                else:
                    known.insert(i, (at, float(price), number))
        now, out = state.getCurrentWatermarkMs(), []
        if known:
            # a boundary is due until it is frozen: older rounds may come before the first one is
            due = {g: frozen[g] + g * 1000 if g in frozen else -(-known[0][0] // (g * 1000)) * g * 1000 for g in grids}
            gone = idle_ms is not None and now > known[-1][0] + idle_ms
            for g in grids:
                w = due[g]
                while w <= (min(now, known[-1][0] + idle_ms) if gone else now):
                    i = bisect_right(known, w, key=lambda r: r[0])
                    if i and (idle_ms is None or w - known[i - 1][0] <= idle_ms):
                        at, price, number = known[i - 1]
                        out.append((key[0], g, pd.Timestamp(w, unit="ms", tz="UTC"), price, pd.Timestamp(at, unit="ms", tz="UTC"), number))
                    frozen[g] = w
                    w += g * 1000
                due[g] = w
            if gone:
                if state.exists:
                    state.remove()
            else:
                del known[:-keep]
                state.update((pickle.dumps((known, frozen)),))
                state.setTimeoutTimestamp(max(min(due.values()), now + 1))
        pdf = pd.DataFrame(out, columns=["asset", "grid_s", "window_start", "price", "round_at", "round_id"])
        yield pdf.astype({"round_id": "Int64"})

    return rounds.withWatermark("ts", late).groupBy("asset").applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def settle_positions(quotes: DataFrame, open_position: Callable[[Any], Any], late: str = "0 seconds", grace_ms: int = 5000) -> DataFrame:
    """(market, outcome_up, filled, won, pnl, tp_pnl, peak, trough, quotes): each market's position, once it has settled.

    quotes: (market, ts, window_end, up_bid, up_ask, underlying). A quote counts when the watermark has reached it, so
    positions see quotes in time order, in whatever order they come within `late`. `open_position(first quote)` makes the
    position; quotes until the window's end move it. It settles when the watermark reaches the end and the grace period,
    against the market's first price, with the last price until then; after that its state is gone. Quotes after the grace
    period are ignored, whenever they come, and a market whose first quote comes after its end has no position.
    """
    schema = "market string, outcome_up int, filled int, won int, pnl double, tp_pnl double, peak double, trough double, quotes long"
    names = [f.split()[0] for f in schema.split(",")]
    some = lambda v: None if v is None or pd.isna(v) else float(v)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None  # noqa: S301  our own checkpoint
        for pdf in () if state.hasTimedOut else pdfs:
            for at, end, r in zip(_ms(pdf["ts"]), _ms(pdf["window_end"]), pdf.itertuples(index=False), strict=True):
                if at <= end + grace_ms:
                    held = held or {"position": None, "strike": None, "last": None, "end": end, "n": 0, "waiting": []}
                    held["waiting"].append((at, some(r.up_bid), some(r.up_ask), some(r.underlying), SimpleNamespace(**r._asdict())))
        if held is None:
            return
        now, end = state.getCurrentWatermarkMs(), held["end"]
        first_last = lambda q: (q[0], *((v is not None, v or 0.0) for v in q[1:4]))
        for at, bid, ask, price, r in sorted((q for q in held["waiting"] if q[0] <= now), key=first_last):
            if held["position"] is None and at <= end:
                held["position"], held["strike"] = open_position(r), price
            if held["position"] is not None:
                held["last"] = price
                if at <= end:
                    held["position"].on_quote(bid, ask)
                    held["n"] += 1
        held["waiting"] = [q for q in held["waiting"] if q[0] > now]
        if now < end + grace_ms:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(min([q[0] for q in held["waiting"]] + [end + grace_ms]), now + 1))
            return
        if state.exists:
            state.remove()
        p = held["position"]
        if p is not None:
            row = p.settle(held["last"], held["strike"]) | {"market": key[0], "peak": p.peak, "trough": p.trough, "quotes": held["n"]}
            yield pd.DataFrame([row], columns=names).astype({"outcome_up": "Int64", "filled": "Int64", "won": "Int64"})

    return quotes.withWatermark("ts", late).groupBy("market").applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_latest(stream: DataFrame, path: str, key: list[str], order: str) -> DataStreamWriter:
    """Sink of the latest row of each key: each batch is merged with the table before it and written as a new version."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark, old = batch.sparkSession, f"{path}/v={epoch - 1}"
        new = batch if epoch == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(old))
        latest = new.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return stream.writeStream.foreachBatch(merge)


def insert_first(stream: DataFrame, path: str, key: list[str], order: str) -> DataStreamWriter:
    """Sink in which the first writer of a key wins: rows whose key is stored already are left out."""

    def append(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(*key).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if epoch:
            first = first.join(spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(*[f"{path}/b={i}" for i in range(epoch)]).select(*key), key, "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/b={epoch}")

    return stream.writeStream.foreachBatch(append)


def run_once(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Work off all that is there, file by file, and stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
