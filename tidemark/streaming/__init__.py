"""Structured Streaming counterparts: windows, deduplication, keyed folds and tables, as-of joins, timers and sequenced logs."""

from tidemark.streaming.streams import bars, dedup_rounds, event_stream, fold_stream, freeze_strikes, insert_first, run_once, settle_positions, upsert_latest
from tidemark.streaming.tables import KeyedTable, SequencedLog, keyed_sink, sequenced_sink
from tidemark.streaming.timed import failover, stream_asof, use_rocksdb

__all__ = [
    "KeyedTable",
    "SequencedLog",
    "bars",
    "dedup_rounds",
    "event_stream",
    "failover",
    "fold_stream",
    "freeze_strikes",
    "insert_first",
    "keyed_sink",
    "run_once",
    "sequenced_sink",
    "settle_positions",
    "stream_asof",
    "upsert_latest",
    "use_rocksdb",
]
