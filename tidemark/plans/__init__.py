"""Query plans. Importing this package registers all queries."""

from tidemark.plans import alignment, decisions, folds, ledger, metrics, parsing, windows

__all__ = ["alignment", "decisions", "folds", "ledger", "metrics", "parsing", "windows"]
