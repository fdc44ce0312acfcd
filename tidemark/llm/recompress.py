"""Recompression of word sequences: rounds of naming runs and pairs, in numpy over whole batches of documents.

A symbol's name is a hash of what it stands for, so all tasks name alike without talking to each other: equal
substrings get equal interior symbols wherever they stand. `ctx` is the stretch of words that a symbol's making
looked at; a window that holds the whole stretch holds the symbol in each of its occurrences.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * C2
    x = (x ^ (x >> U(27))) * C3
    return x ^ (x >> U(31))


class Symbols:
    """A level: names, spans [s, e) in words, contexts [cs, ce), document index."""

    __slots__ = ("ce", "cs", "doc", "e", "s", "sym")

    def __init__(self, sym, s, e, cs, ce, doc):
        self.sym, self.s, self.e, self.cs, self.ce, self.doc = sym, s, e, cs, ce, doc

    def __len__(self):
        return len(self.sym)


def words_level(h: np.ndarray, offsets: np.ndarray) -> Symbols:
    """Level of single words. offsets: n_docs + 1 word positions."""
    n = np.arange(len(h), dtype=np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    return Symbols(h, n, n + 1, n, n + 1, doc)


def _edges(x: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of the neighbours; beyond a document's end: one word past it, which no window holds."""
    same = x.doc[1:] == x.doc[:-1]
    before, after = x.cs - 1, x.ce + 1
    before[0] = min(x.cs[0], x.s[0]) - 1
    before[1:] = np.where(same, x.cs[:-1], x.s[1:] - 1)
    after[:-1] = np.where(same, x.ce[1:], x.e[:-1] + 1)
    after[-1] = x.e[-1] + 1
    return before, after


def runs(x: Symbols) -> Symbols:
    """Name each maximal run of one symbol (two or more) by the symbol and the run's length."""
    if not len(x):
        return x
    before, after = _edges(x)
    start = np.ones(len(x), bool)
    start[1:] = (x.sym[1:] != x.sym[:-1]) | (x.doc[1:] != x.doc[:-1])
    at = np.flatnonzero(start)
    last = np.append(at[1:], len(x)) - 1
    k = last - at + 1
    sym = x.sym[at]
    more = k > 1
    if more.any():
        sym = sym.copy()
        sym[more] = mix(sym[more] * C1 + k[more].astype(U) * C3 + U(1))
    return Symbols(sym, x.s[at], x.e[last], np.minimum(before[at], x.cs[at]), np.maximum(after[last], x.ce[last]), x.doc[at])


def pairs(x: Symbols, salt: int) -> tuple[Symbols, np.ndarray]:
    """Name each pair of a left-class and a right-class symbol; classes come from a salted bit of the name.

    Also returns which symbols of the new level are new pairs.
    """
    if len(x) < 2:
        return x, np.zeros(len(x), bool)
    left = (mix(x.sym + U(salt * int(C1) % 2**64)) >> U(63)).astype(bool)
    first = np.zeros(len(x), bool)
    first[:-1] = left[:-1] & ~left[1:] & (x.doc[1:] == x.doc[:-1])
    second = np.zeros(len(x), bool)
    second[1:] = first[:-1]
    before, after = _edges(x)
    keep = np.flatnonzero(~second)
    new = first[keep]
    nxt = np.minimum(keep + 1, len(x) - 1)
    sym = np.where(new, mix(x.sym[keep] * C1 + (x.sym[nxt] ^ C2) * C3 + U(2)), x.sym[keep])
    e = np.where(new, x.e[nxt], x.e[keep])
    cs = np.where(new, x.cs[keep], np.minimum(before[keep], x.cs[keep]))
    ce = np.where(new, np.maximum(x.ce[keep], x.ce[nxt]), np.maximum(after[keep], x.ce[keep]))
    return Symbols(sym, x.s[keep], e, cs, ce, x.doc[keep]), new


def rolling(h: np.ndarray, width: int, factor: np.uint64 = C1) -> np.ndarray:
    """64-bit name of each window of `width` words (windows over document ends included)."""
    n = max(0, len(h) - width + 1)
    a = np.full(n, U(width))
    for k in range(width):
        a = (a ^ h[k : k + n]) * factor
        a ^= a >> U(32)
    return mix(a)


def stretches(h: np.ndarray):
    """A function (s, e) -> 64-bit names of the words s to e, by prefix sums; equal words, equal names."""
    power = np.cumprod(np.concatenate([[U(1)], np.full(len(h), C1)]))
    back = np.cumprod(np.concatenate([[U(1)], np.full(len(h), U(pow(int(C1), -1, 1 << 64)))]))
    sums = np.concatenate([[U(0)], np.cumsum(mix(h + C3) * power[:-1])])
    return lambda s, e: mix((sums[e] - sums[s]) * back[s]) + (e - s).astype(U)


def anchors(h: np.ndarray, offsets: np.ndarray, width: int, levels: int = 2):
    """Anchor of each window of `width` words: a symbol with its context, which every occurrence of the window holds.

    The symbol is of the highest level that fits, of most words, and then of smallest hash. Its context (all words that
    its making looked at) is in the window too and gives the anchor its name, which is rarer than the symbol's. A window
    that holds no symbol (it lies in a long run) is named by itself. Runs of windows with one anchor come as one row.
    Returns (anchor, document, first window, last window), positions counted over all documents.
    """
    n = len(h)
    lens = np.diff(offsets)
    starts = np.repeat(offsets[:-1], np.maximum(lens - width + 1, 0)) + _ramp(np.maximum(lens - width + 1, 0))
    if not len(starts):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, z
    base = runs(words_level(h, offsets))
    tower = [base]
    for r in range(levels):
        tower.append(pairs(tower[-1], r + 1)[0])
    named = stretches(h)
    spot = np.full(len(starts), -1, np.int64)
    at, to, level_of = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), U)
    left = np.arange(len(starts))
    for level in range(len(tower) - 1, -1, -1):
        x = tower[level]
        p = starts[left]
        lo = np.concatenate([[0], np.cumsum(np.bincount(np.maximum(x.cs + 1, 0), minlength=n + 2)[: n + 1])])[p + 1]
        hi = np.cumsum(np.bincount(np.minimum(x.ce, n + 1), minlength=n + 2))[p + width] - 1
        has = hi >= lo
        if not has.any():
            continue
        lo, hi, who = lo[has], hi[has], left[has]
        key = (mix(x.sym + U(level + 77)) >> U(5)) | ((31 - np.minimum(x.e - x.s, 31)).astype(U) << U(59))
        best, where = key[lo], lo.copy()
        for j in range(1, int((hi - lo).max()) + 1):
            i = np.flatnonzero(lo + j <= hi)
            k = key[lo[i] + j]
            less = k < best[i]
            best[i[less]] = k[less]
            where[i[less]] = lo[i[less]] + j
        spot[who] = where * 8 + level
        at[who], to[who], level_of[who] = x.cs[where], x.ce[where], U(level + 1)
        left = left[~has]
        if not len(left):
            break
    spot[left] = -2 - starts[left]
    at[left], to[left] = starts[left], starts[left] + width
    cut = np.ones(len(starts), bool)
    cut[1:] = (spot[1:] != spot[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(starts)) - 1
    doc = np.searchsorted(offsets, starts[first], "right") - 1
    return named(at[first], to[first]) ^ (level_of[first] * C2), doc, starts[first], starts[last]


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    ends = np.cumsum(counts)
    return out - np.repeat(ends - counts, counts)


def long_symbols(h: np.ndarray, other: np.ndarray, offsets: np.ndarray, least: int, rounds: int = 40):
    """Symbols of at least `least` words from further rounds, and each document as a whole: (name, check, doc, s, e).

    The name fixes the content; `check` is a second name, from other word hashes.
    """
    x = words_level(h, offsets)
    out = []
    lens = np.diff(offsets)
    for r in range(rounds):
        n = len(x)
        x, new = pairs(runs(x), r + 1)
        take = new & ((x.e - x.s) >= least)
        if take.any():
            out.append((x.sym[take], x.doc[take], x.s[take], x.e[take]))
        if len(x) <= len(lens) or (len(x) == n and r > 8):
            break
    whole = np.flatnonzero(lens >= least)
    out.append((stretches(h)(offsets[whole], offsets[whole + 1]) ^ C2, whole, offsets[whole], offsets[whole + 1]))
    sym, doc, s, e = (np.concatenate(v) for v in zip(*out, strict=True))
    return sym, stretches(other)(s, e), doc, s, e
