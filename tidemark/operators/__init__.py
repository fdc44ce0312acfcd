"""Operators on DataFrames: as-of and range joins, ordered folds, scans and windows that cut keys, throttles, picks by rank;
`scores` and `variance` hold forecast scores and realised variance, `selection` ranks without sorting, `markov` hidden chains."""

from tidemark.operators.asof import asof_join, interval_parts, interval_totals, nearest_join, range_join
from tidemark.operators.folds import fold_blocks, fold_per_key
from tidemark.operators.ordered import excursions, keep_last, nearest_rank, running_sum, seq_gaps, systematic_sample, throttle
from tidemark.operators.scans import breach, decayed, drawdown, positions, running_totals, scan, windowed

__all__ = ["asof_join", "breach", "decayed", "drawdown", "excursions", "fold_blocks", "fold_per_key", "interval_parts", "interval_totals", "keep_last", "nearest_join", "nearest_rank", "positions", "range_join", "running_sum", "running_totals", "scan", "seq_gaps", "systematic_sample", "throttle", "windowed"]
