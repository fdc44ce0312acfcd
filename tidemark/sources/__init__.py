"""Sources and sinks: JSONL, CSV candles, lane files, status snapshots, append tables, SQLite tables, log folders, synthetic series."""

from tidemark.sources.files import (
    append_json,
    append_rows,
    candle_path,
    candles,
    decisions_jsonl,
    find_runs,
    lane_config,
    lanes,
    latest_rows,
    quotes_jsonl,
    settled_jsonl,
    simulated_autoregression,
    simulated_jumps,
    simulated_panel,
    simulated_regimes,
    simulated_returns,
    write_flag,
    write_snapshot,
)
from tidemark.sources.logs import log_stream, parsed
from tidemark.sources.sqlite import sqlite_table

__all__ = [
    "append_json",
    "append_rows",
    "candle_path",
    "candles",
    "decisions_jsonl",
    "find_runs",
    "lane_config",
    "lanes",
    "log_stream",
    "parsed",
    "latest_rows",
    "quotes_jsonl",
    "settled_jsonl",
    "simulated_autoregression",
    "simulated_jumps",
    "simulated_panel",
    "simulated_regimes",
    "simulated_returns",
    "sqlite_table",
    "write_flag",
    "write_snapshot",
]
