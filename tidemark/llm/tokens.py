"""Exact, fast use of the tokenizers library: whole texts, encoded stretch by stretch with a bounded memory of stretches."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import held
from tidemark.llm.stretches import spread

#: Stretches kept in a worker's memory; when full it starts anew. It only saves time.
MEMORY = 800_000
#: Bytes of text encoded at once: the more, the more often a word is met again.
BATCH_BYTES = 8_000_000
#: A Latin word and ASCII signs after it: two pieces to this kind of tokenizer.
WORD_SIGNS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A text is cut at spaces and newlines. The tokenizer given must drop white space, lower-case, set letters apart from
    signs, and never let a token or a normalisation reach across white space (checked on construction by an example);
    so the ids of a text are those of its stretches in a row, a Latin text may be lower-cased first, and a Latin word
    with signs after it is its word and its signs.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # lower-case ASCII words need neither the normalizer nor the rules that set words apart
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        for probe in ("It's  a\n\nprobe, OF 12 words...\n", "Élan (vital)!? naïve-té, don't. ÀÉÎ***"):
            if self.tok.encode(probe, add_special_tokens=False).ids != np.frombuffer(self([probe])[0], "<u4").tolist():
                raise ValueError("this tokenizer keeps case or white space; encode whole texts instead")

    def _encode(self, some: list[str]) -> None:
        """Ids of stretches. Latin words go many to a call: each is one piece, whose last token alone ends a word."""
        ascii, latin, rest = [], [], []
        for w in some:
            (rest if not w.isalpha() else ascii if w.isascii() and w.islower() else latin if _latin(w) else rest).append(w)
        for tok, words in ((self.plain, ascii), (self.tok, latin)):
            groups = [words[i : i + 500] for i in range(0, len(words), 500)]
            for i in range(0, len(groups), 40):
                part = groups[i : i + 40]
                for group, e in zip(part, tok.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False), strict=True):
                    ids = np.array(e.ids, "<u4")
                    ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
                    if len(ends) != len(group):
                        rest += group
                        continue
                    data = ids.tobytes()
                    self.known.update(zip(group, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            self.known.update(zip(part, (array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def _learn(self, names: list[str]) -> None:
        new = [w for w in names if w not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known = {"": b""}
            new = [w for w in names if w]
        if not new:
            return
        known = self.known
        # of a Latin word in capitals, and of one with signs after it, what is left is perhaps known
        latin = {w for w in new if _latin(w) and "<|" not in w}
        small = {w: v for w in latin if (v := w.lower()) != w}
        plain = {v for w in new if (v := small.get(w, w)) not in known}
        apart = {c: m.groups() for c in plain if c[-1] < "@" and (c in latin or c.isascii()) and "<|" not in c and (m := WORD_SIGNS.fullmatch(c))}
        words = {p for m in apart.values() for p in m if p not in known}
        self._encode([*words, *(w for w in plain if w not in apart and w not in words)])
        for c, (word, signs) in apart.items():
            known[c] = known[word] + known[signs]
        for w, v in small.items():
            known[w] = known[v]

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(texts):
            return []
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        names, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._learn(names)
        found = list(map(self.known.__getitem__, names))
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(lens) - lens
        lens = lens[at]
        ends = np.concatenate([[0], np.cumsum(lens)])
        data = ids[spread(starts[at], lens)]
        ends = ends[parts.offsets.to_numpy()].tolist()
        return [data[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def encoder(path: str) -> Encoder:
    """The worker's encoder."""
    return held(("encoder", path), lambda: Encoder(path))


def text_slices(texts: list[str | None] | pa.Array, chars: int = 2_000_000):
    """Index ranges of about `chars` characters (of an Arrow array: bytes), one text at least."""
    if isinstance(texts, pa.Array):
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        i, before = 0, 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, before + chars, "right")))
            yield i, j
            i, before = j, int(ends[j - 1])
        return
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= chars):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j
