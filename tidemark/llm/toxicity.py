"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy, over all overlapping windows.

A word is a row of numbers from two inputs: its hashed word embedding and the mean of its hashed character n-gram
embeddings, each with log-odds of toxic text learned beside them. Windows of 32 words every 16 words run through a GRU
in both directions; attention pools the states to one logit; a text's logit is that of its worst window. All of it is
trained here, on a bounded sample of labelled rows, and sent to the executors as one small broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches
from tidemark.llm.langid import held_out
from tidemark.llm.recompress import C1, U, mix
from tidemark.llm.tokens import text_slices

WORD = regex.compile(r"\p{L}+")
WINDOW, STRIDE = 32, 16
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 16
DIM, HIDDEN, ATTEND = 6, 12, 8
#: Labelled rows of each class that training reads at most; more labels don't change the model's cost.
PER_CLASS = 1500
#: Characters of a class's texts at which training takes no further one; each is read whole.
MOST_CHARS = 20_000_000
#: Words whose projected inputs a worker remembers; when full it starts anew.
MEMORY = 150_000
EMPTY_LOGIT = -20.0


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def char_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words' character 3- and 4-grams with their ends marked, and of their first 6: (buckets, count of each word)."""
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(U)
    size = np.array([len(w) + 2 for w in words])
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(end, size) - np.arange(len(code))  # characters to the word's end, itself included
    ids, owners = [], []
    for k, where in ((3, left >= 3), (4, left >= 4), (6, (left == np.repeat(size, size)) & (left >= 6))):
        at = np.flatnonzero(where)
        h = np.full(len(at), U(k))
        for j in range(k):
            h = mix(h ^ code[at + j] * C1)
        ids.append((h & U(CHAR_BUCKETS - 1)).astype(np.int64))
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(ids)[order], np.bincount(owners, minlength=len(words))


def word_id(word: str) -> int:
    return zlib.crc32(word.encode(), 7) & (WORD_BUCKETS - 1)


def _log_odds(docs: list[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    """Shrunken log-odds of toxic against other documents that hold a bucket."""
    n = np.zeros((2, buckets))
    for ids, label in zip(docs, y, strict=True):
        n[label, ids] += 1
    size = np.bincount(y, minlength=2)[:, None] + 1.0
    rate = (n + 0.5) / size
    total = n.sum(0)
    return (np.log(rate[1] / rate[0]) * total / (total + 6)).astype(np.float32)


@dataclass
class Net:
    """Embeddings and log-odds of word and character buckets, and the network's weights."""

    word: np.ndarray
    char: np.ndarray
    word_odds: np.ndarray
    char_odds: np.ndarray
    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    bias: float = float(np.log(0.7 / 0.3))
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    @property
    def width(self) -> int:
        return 2 * (DIM + 1) + 1

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of words (word row, mean of character rows, largest character log-odds), word and character buckets."""
        x = np.zeros((len(words), self.width), np.float32)
        ids = np.array([word_id(w) for w in words], np.int64)
        grams, sizes = char_ids(words)
        starts, odds = np.cumsum(sizes) - sizes, self.char_odds[grams]
        x[:, :DIM] = self.word[ids]
        x[:, DIM] = self.word_odds[ids]
        x[:, DIM + 1 : -2] = np.add.reduceat(self.char[grams], starts, axis=0) / sizes[:, None]
        x[:, -2] = np.add.reduceat(odds, starts) / sizes
        x[:, -1] = np.maximum.reduceat(odds, starts)
        return x, ids, grams, sizes

    def project(self, words: list[str]) -> np.ndarray:
        """Rows of the table of projected inputs (both directions) for words."""
        rows = self.rows
        new = list(set(words) - rows.keys())
        if self.table is None or len(rows) + len(new) > MEMORY:
            rows.clear()
            new = list(set(words))
            self.table = np.zeros((max(MEMORY // 8, len(new)) + 1, 6 * HIDDEN), np.float32)  # row 0: no word
        if len(rows) + len(new) + 1 > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(new)), 6 * HIDDEN), np.float32)])
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            at = len(rows) + 1
            self.table[at : at + len(some)] = self.features(some)[0] @ self.weights["wx"] + self.weights["bx"]
            rows.update(zip(some, range(at, at + len(some)), strict=True))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Logit of each text's worst window."""
        out = np.full(len(texts), EMPTY_LOGIT)
        found = [words_of(t) for t in texts]
        off = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        ids = self.project([w for f in found for w in f])
        starts, owner = [], []
        for i in range(len(texts)):
            n = off[i + 1] - off[i]
            if n:
                s = np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE) + off[i]
                starts.append(s)
                owner.append(np.full(len(s), i))
        if not starts:
            return out
        starts, owner = np.concatenate(starts), np.concatenate(owner)
        for k in range(0, len(starts), 2048):
            s, o = starts[k : k + 2048], owner[k : k + 2048]
            at = s[:, None] + np.arange(WINDOW)
            real = at < off[o + 1][:, None]
            win = np.where(real, ids[np.minimum(at, len(ids) - 1)], 0)
            np.maximum.at(out, o, forward(self.weights, self.table, win, real)[0])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.scale * (self.logits(texts) - self.shift) + self.bias
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _gru(u: np.ndarray, px: np.ndarray, win: np.ndarray, real: np.ndarray, steps, keep: bool):
    """States of one direction; keep: what going back needs."""
    h = np.zeros((len(win), HIDDEN), np.float32)
    states, saved = np.zeros((WINDOW, len(win), HIDDEN), np.float32), []
    every = real.all()
    for t in steps:
        x = px[win[:, t]]
        hu = h @ u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if not every:
            new = np.where(real[:, t, None], new, h)
        if keep:
            saved.append((t, h, z, r, c, hu[:, 2 * HIDDEN :]))
        states[t] = h = new
    return states, saved


def forward(w: dict, table: np.ndarray, win: np.ndarray, real: np.ndarray, keep: bool = False):
    """Logits of windows of table rows; with keep also what training needs."""
    f, fs = _gru(w["uf"], table[:, : 3 * HIDDEN], win, real, range(WINDOW), keep)
    b, bs = _gru(w["ub"], table[:, 3 * HIDDEN :], win, real, range(WINDOW - 1, -1, -1), keep)
    h = np.concatenate([f, b], 2)
    u = np.tanh(h @ w["wa"] + w["ba"])
    a = u @ w["va"]
    a = np.where(real.T, a, -1e9)
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, h)
    return pooled @ w["wo"] + w["bo"], (fs, bs, h, u, a, pooled)


def _back_gru(u, saved, dstates, win, real, dpx):
    """Adds gradients of projected inputs to dpx, returns that of u."""
    du, dh = np.zeros_like(u), np.zeros((len(win), HIDDEN), np.float32)
    for t, h, z, r, c, hc in reversed(saved):
        dh = dh + dstates[t]
        live = real[:, t, None]
        d = np.where(live, dh, 0)
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        g = np.concatenate([dz, dr, dc], 1)
        gu = np.concatenate([dz, dr, dc * r], 1)
        np.add.at(dpx, win[:, t], g)
        du += h.T @ gu
        dh = np.where(live, d * z, dh) + gu @ u.T
    return du


def gradients(w: dict, table: np.ndarray, win: np.ndarray, real: np.ndarray, y: np.ndarray):
    """Gradients of the mean cross-entropy of windows, of weights and of table rows."""
    logit, (fs, bs, h, u, a, pooled) = forward(w, table, win, real, keep=True)
    g: dict[str, np.ndarray] = {}
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    g["wo"], g["bo"] = pooled.T @ d, np.array([d.sum()], np.float32)
    dp = d[:, None] * w["wo"]
    dh = a[:, :, None] * dp
    da = np.einsum("tbh,bh->tb", h, dp)
    da = a * (da - (a * da).sum(0))
    g["va"] = np.einsum("tba,tb->a", u, da)
    du = da[:, :, None] * w["va"] * (1 - u * u)
    g["wa"], g["ba"] = np.einsum("tbh,tba->ha", h, du), du.sum((0, 1))
    dh = dh + du @ w["wa"].T
    dpx = np.zeros_like(table)
    g["uf"] = _back_gru(w["uf"], fs, dh[:, :, :HIDDEN], win, real, dpx[:, : 3 * HIDDEN])
    g["ub"] = _back_gru(w["ub"], bs, dh[:, :, HIDDEN:], win, real, dpx[:, 3 * HIDDEN :])
    return g, dpx


FOLDS = 5


def train(texts: list[str], labels: list[int], seed: int = 5, epochs: int = 5, batch: int = 96) -> Net:
    """A net from labelled texts.

    Log-odds are learned in folds: a text that trains the weights or sets the threshold sees those of the other folds,
    so that no text grades its own work; the net keeps those of all texts. One fold sets the threshold and trains no
    weights. With fewer than five texts of a class the net scores everything below 0.7.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    fold = np.zeros(len(y), int)
    for c in (0, 1):
        at = rng.permutation(np.flatnonzero(y == c))
        fold[at] = np.arange(len(at)) % FOLDS
    scale = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    bag = lambda n: (rng.normal(size=(n, DIM)) * 0.1).astype(np.float32)
    net = Net(bag(WORD_BUCKETS), bag(CHAR_BUCKETS), np.zeros(WORD_BUCKETS, np.float32), np.zeros(CHAR_BUCKETS, np.float32), {})
    w = net.weights = {
        "wx": scale(net.width, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32), "uf": scale(HIDDEN, 3 * HIDDEN), "ub": scale(HIDDEN, 3 * HIDDEN), "wa": scale(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32),
        "va": scale(ATTEND), "wo": scale(2 * HIDDEN), "bo": np.zeros(1, np.float32),
    }
    if len(set(labels)) < 2 or min(np.bincount(y, minlength=2)) < 5:
        net.scale, net.shift = 0.0, 0.0
        net.bias = -5.0
        return net
    shared: dict[str, str] = {}
    found = [[shared.setdefault(v, v) for v in words_of(t)] for t in texts]
    some = [sorted(set(f)) for f in found]
    none = np.zeros(0, np.int32)
    word_sets = [np.unique([word_id(x) for x in v]).astype(np.int32) if v else none for v in some]
    char_sets = [np.unique(char_ids(v)[0]).astype(np.int32) if v else none for v in some]

    def odds(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _log_odds([word_sets[i] for i in docs], y[docs], WORD_BUCKETS), _log_odds([char_sets[i] for i in docs], y[docs], CHAR_BUCKETS)

    others = [odds(np.flatnonzero(fold != k)) for k in range(FOLDS)]
    windows, target, of = [], [], []
    for i in np.flatnonzero(fold > 0):
        f = found[i]
        if not f:
            continue
        net.word_odds, net.char_odds = others[fold[i]]
        x = net.features(some[i])[0]
        value = dict(zip(some[i], (x[:, DIM] + x[:, -1]).tolist(), strict=True))
        worths = np.array([value[v] for v in f])
        starts = np.arange(0, max(len(f) - WINDOW + STRIDE, 1), STRIDE)
        worth = np.array([np.sort(worths[s : s + WINDOW])[-3:].sum() for s in starts])
        take = np.argsort(-worth)[: 2 if y[i] else 1].tolist()
        if not y[i]:
            take += rng.integers(0, len(starts), 2).tolist()
        windows += [f[starts[s] : starts[s] + WINDOW] for s in take]
        target += [int(y[i])] * len(take)
        of += [fold[i]] * len(take)
    of = np.array(of)
    epochs = max(epochs, min(25, 20_000 // len(windows)))
    target = np.array(target, np.float32)
    moments: dict[str, list[np.ndarray]] = {}
    step = 0

    def adam(name: str, p: np.ndarray, g: np.ndarray, rate: float) -> None:
        m = moments.setdefault(name, [np.zeros_like(p), np.zeros_like(p)])
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.99 * m[1] + 0.01 * g * g
        p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)

    for epoch in range(epochs):
        batches = [at for k in range(1, FOLDS) for at in np.array_split(rng.permutation(np.flatnonzero(of == k)), max(1, (of == k).sum() // batch))]
        for b in rng.permutation(len(batches)):
            at = batches[b]
            if not len(at):
                continue
            net.word_odds, net.char_odds = others[of[at[0]]]
            step += 1
            some = sorted({x for i in at for x in windows[i]})
            row = {x: k + 1 for k, x in enumerate(some)}
            x, ids, grams, sizes = net.features(some)
            table = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), x @ w["wx"] + w["bx"]])
            win = np.zeros((len(at), WINDOW), np.int64)
            for k, i in enumerate(at):
                win[k, : len(windows[i])] = [row[v] for v in windows[i]]
            g, dpx = gradients(w, table, win, win > 0, target[at])
            dpx = dpx[1:]
            g["wx"], g["bx"] = x.T @ dpx, dpx.sum(0)
            dx = dpx @ w["wx"].T
            rate = 0.01 * (1 - epoch / (epochs + 1))
            np.add.at(net.word, ids, -2 * rate * dx[:, :DIM])
            np.add.at(net.char, grams, np.repeat(-2 * rate * dx[:, DIM + 1 : -2] / sizes[:, None], sizes, axis=0))
            for name, p in w.items():
                adam(name, p, g[name], rate)
    held = np.flatnonzero(fold == 0)
    net.word_odds, net.char_odds = others[0]
    z = np.concatenate([net.logits([texts[i] for i in held[k : k + 50]]) for k in range(0, len(held), 50)])
    cuts = np.unique(z)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    f1 = [2 * ((z >= c) & (y[held] == 1)).sum() / max(1e-9, (z >= c).sum() + (y[held] == 1).sum()) for c in cuts]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
    net.shift, net.scale = float(cuts[best[len(best) // 2]]), 1.0
    net.word_odds, net.char_odds = odds(np.arange(len(y)))
    net.rows, net.table = {}, None
    return net


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts: of each class the `per_class` ids of smallest hash among those not held out, one
    whole text each (the smallest of rows with one id), as far as texts don't exceed MOST_CHARS characters together. A
    longer first text is taken all the same, as a class needs one."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    rows = [r for c in (0, 1) for r in y.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class).collect()]
    if not rows:
        return [], []
    few = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in rows], "doc_id long, toxic int")
    # at most 2 * per_class rows
    mine = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")
    sizes = {(r["doc_id"], r["toxic"]): r["n"] for r in mine.groupBy("doc_id", "toxic").agg(F.length(F.min("text")).alias("n")).collect()}
    taken, total = [], {0: 0, 1: 0}
    for r in rows:
        n = sizes.get((r["doc_id"], int(r["toxic"])))
        if n is not None and (not total[int(r["toxic"])] or total[int(r["toxic"])] + n <= MOST_CHARS):
            taken.append(r["doc_id"])
            total[int(r["toxic"])] += n
    got = mine.where(F.col("doc_id").isin(taken)).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in got], [r["toxic"] for r in got]


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row: score in 0 to 1, predicted is 1 from 0.7. Only the text is an
    input of a score; null, empty and wordless texts score near 0. Repeated rows are scored each; a null doc_id stays."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            s = np.concatenate([model.scores(texts[i:j]) for i, j in text_slices(texts, 1_000_000)])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.7).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    x = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return x.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Train on a bounded sample of labels that aren't held out, then score all documents."""
    return score(docs, train(*sample(docs, labels, per_class)))
