"""Texts as sequences of stretches: where one text repeats a word, or a batch does, work is done once.

A text, with one space before it, is cut in front of each space that follows a character other than white space. So every
stretch begins with a space; it is named by what comes after that space ('' for a space alone).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r"(?<=\S) ")


def stretches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of each stretch's name, the n + 1 offsets of texts in those, distinct names) of a batch; null texts are empty
    and have none.

    Cutting at every space is right for most texts. Where a part is empty or ends with white space before another space,
    the text is cut anew by the rule.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.split_pattern(texts, " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    index, names = coded.indices.to_numpy().astype(np.int32), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    offsets = offsets - offsets[0]
    words = coded.dictionary
    loose = pc.or_(pc.equal(words, ""), pc.not_equal(pc.utf8_rtrim_whitespace(words), words)).to_numpy(zero_copy_only=False)
    odd = loose[index]
    filled = offsets[:-1] < offsets[1:]
    odd[offsets[1:][filled] - 1] = False
    sums = np.concatenate([[0], np.cumsum(odd)])
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    again = np.flatnonzero((sums[offsets[1:]] > sums[offsets[:-1]]) | empty)
    if not len(again):
        return index, offsets, names
    known = {w: i for i, w in enumerate(names)}
    out, at, ends = [], 0, np.diff(offsets)
    for k in again.tolist():
        text = texts[k].as_py()
        cut = CUT.split(f" {text}") if text else []
        if cut:
            cut[0] = cut[0][1:]
        out += [index[at : offsets[k]], np.fromiter((known.setdefault(w, len(known)) for w in cut), np.int32, len(cut))]
        at, ends[k] = offsets[k + 1], len(cut)
    out.append(index[at:])
    index = np.concatenate(out)
    used, index = np.unique(index, return_inverse=True)
    names = list(known)
    return index.astype(np.int32), np.concatenate([[0], np.cumsum(ends)]), [names[i] for i in used.tolist()]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs that start at `starts`, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def joined(names: list[str], chars: int = 200_000):
    """Index ranges of names with about `chars` characters, one name at least."""
    i = 0
    while i < len(names):
        j, n = i, 0
        while j < len(names) and (j == i or n + len(names[j]) < chars):
            n += len(names[j]) + 1
            j += 1
        yield i, j
        i = j
