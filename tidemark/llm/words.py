"""Words of UTF-8 texts as numpy arrays: where they stand and two hashes of each, without a Python object a word.

A word is `[^\\x20\\x09-\\x0D]+`. Its hashes are polynomials over its bytes, from prefix sums of a stretch of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.recompress import C1, C3, U, mix

#: Bytes of text handled at once; a longer text is one chunk, whose words are hashed stretch by stretch.
CHUNK_BYTES = 800_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd bases whose powers differ as long as can be (3 modulo 8), and a value for each byte.
BASES = (U(int(C1) & ~7 | 3), U(int(C3) & ~7 | 3))
VALUES = [mix(np.arange(1, 257, dtype=U) * base) for base in BASES]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of each base and of its inverse, n at least; those of a usual chunk are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    size = max(n, CHUNK_BYTES + 2)
    out = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, x)])) for b in BASES for x in (b, U(pow(int(b), -1, 1 << 64)))]
    if size == CHUNK_BYTES + 2:
        _POWERS[:] = out
    return out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and the n + 1 offsets of its rows."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), at


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) bytes of the words of the texts at `at`, and the n + 1 offsets of texts in words."""
    part = data[at[0] : at[-1]]
    inside = ~SPACE[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[at[:-1] - at[0]] = edge[-1] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts) + at[0], np.flatnonzero(ends) + at[0] + 1
    return s, e, np.searchsorted(s, at)


def hashed(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the words (s, e)."""
    out = np.zeros((2, len(s)), U)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + CHUNK_BYTES, "right")))
        base = s[i]
        part, a, b = data[base : e[j - 1]], s[i:j] - base, e[i:j] - base
        powers = _powers(len(part) + 1)
        for k in (0, 1):
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(VALUES[k][part] * powers[2 * k][: len(part)], out=sums[1:])
            out[k, i:j] = mix((sums[b] - sums[a]) * powers[2 * k + 1][a] + (b - a).astype(U))
        i = j
    return out[0], out[1]


def text_chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, first hashes, second hashes, offsets) of the words of rows i to j, about CHUNK_BYTES bytes at a time."""
    data, at = texts_of(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        s, e, off = words(data, at[i : j + 1])
        yield i, j, *hashed(data, s, e), off
        i = j
