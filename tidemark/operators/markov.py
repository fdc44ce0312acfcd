"""Gaussian hidden Markov models of long series: each key is cut into parts, and parts meet in products of small matrices.

A row multiplies the probabilities of states by one k x k matrix, so a part is the product of its rows' matrices. Products of
all parts of a key, one row a part, give what enters each part from before and behind; with that each part makes its own
expected counts, and their sums the next model. Most likely paths are the same with sums and maxima of logarithms.
One round of Baum-Welch is one Spark job for all keys and all models that are fitted side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions.statistics import _emission
from tidemark.operators.scans import SIZE
from tidemark.operators.selection import ranks

#: Keys whose models (some dozen numbers each) the driver holds between rounds; more are an error.
MOST_KEYS = 100_000


@dataclass
class Model:
    """States by probability of the first row, transitions, means and deviations; `done` once it doesn't change any more;
    `rows` that it is fitted to."""

    pi: np.ndarray
    trans: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    loglik: float = -math.inf
    done: bool = False
    rows: int = 0

    def ordered(self) -> Model:
        """States by ascending mean."""
        o = np.argsort(self.mu, kind="stable")
        return replace(self, pi=self.pi[o], trans=self.trans[np.ix_(o, o)], mu=self.mu[o], sigma=self.sigma[o])


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matrix products of two stacks (k, k, n): rows lie last, so that numpy's loops run over them and not over states."""
    out = x[:, 0, None] * y[0]
    for i in range(1, len(y)):
        out += x[:, i, None] * y[i]
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """What each matrix or vector of a stack sums up to; the stack is divided by it."""
    total = np.maximum(x.reshape(-1, x.shape[-1]).sum(0), 1e-300)
    x /= total
    return total


def _grids(e: np.ndarray) -> list[tuple[slice, int, np.ndarray]]:
    """Rows (k, n) as blocks of one length, then those left over as blocks of one row: (rows, blocks, (length, k, blocks)).
    Steps are taken in all blocks side by side."""
    n = e.shape[1]
    length = max(1, math.isqrt(n // 10))
    blocks = n // length
    whole = blocks * length
    out = [(slice(0, whole), blocks, np.ascontiguousarray(e[:, :whole].reshape(-1, blocks, length).transpose(2, 0, 1)))]
    return out + [(slice(whole, n), n - whole, np.ascontiguousarray(e[None, :, whole:]))] * (whole < n)


def _block_products(a: np.ndarray, grids: list) -> tuple[np.ndarray, np.ndarray]:
    """(matrices of sum one, logs of their sizes) of all blocks in order."""
    found, sizes = [], []
    for _, blocks, e in grids:
        m, total = a[:, :, None] * e[0], np.empty((len(e), blocks))
        total[0] = _scaled(m)
        for t in range(1, len(e)):
            m = a.T @ m
            m *= e[t]
            total[t] = _scaled(m)
        found.append(m)
        sizes.append(np.log(total).sum(0))
    return np.concatenate(found, axis=2), np.concatenate(sizes)


def _prefixes(m: np.ndarray) -> np.ndarray:
    """Products of each matrix of a stack with all before it, of sum one, by doubling steps."""
    m, shift = m.copy(), 1
    while shift < m.shape[2]:
        more = _times(m[:, :, :-shift], m[:, :, shift:])
        _scaled(more)
        m[:, :, shift:] = more
        shift *= 2
    return m


def product(a: np.ndarray, e: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
    """(matrix of sum one, log of its size) of a part: from states before it to states at its end. The first part of a key
    starts with its own row's states, without a transition."""
    rows = e.T[:, int(first) :]
    top = rows.max(0)
    rows = rows / top  # rows that are unlikely in all states don't vanish
    m, size = _block_products(a, _grids(rows)) if rows.shape[1] else (np.empty((*a.shape, 0)), np.empty(0))
    if first:
        start = np.diag(e[0])[:, :, None].copy()
        size = np.concatenate([np.log(_scaled(start)), size])
        m = np.concatenate([start, m], axis=2)
    while m.shape[2] > 1:
        n = m.shape[2] // 2 * 2
        pairs = _times(m[:, :, :n:2], m[:, :, 1:n:2])
        size = np.concatenate([size[:n:2] + size[1:n:2] + np.log(_scaled(pairs)), size[n:]])
        m = np.concatenate([pairs, m[:, :, n:]], axis=2)
    return m[:, :, 0], float(size[0] + np.log(top).sum())


def ends(parts: list[tuple[np.ndarray, float]], pi: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """(probabilities that enter each part, those from behind it, log-likelihood) of a key's parts in order."""
    before, loglik, v = [], 0.0, pi
    for m, size in parts:
        before.append(v)
        v = v @ m
        total = max(float(v.sum()), 1e-300)
        v, loglik = v / total, loglik + size + math.log(total)
    behind, w = [], np.ones(len(pi))
    for m, _ in reversed(parts):
        behind.append(w)
        w = m @ w
        w = w / max(float(w.sum()), 1e-300)
    return before, behind[::-1], loglik


def _densities(x: np.ndarray, m: Model) -> np.ndarray:
    """Density of each row (n, k) in each state, held state by state."""
    return np.stack([_emission(x, mu, sigma)[:, 0] for mu, sigma in zip(m.mu, m.sigma, strict=True)]).T


def counts(x: np.ndarray, m: Model, enter: np.ndarray, behind: np.ndarray, first: bool) -> np.ndarray:
    """Expected counts of a part in one row: states at its first row, weight, sum and squares about the model's means of
    each state, transitions."""
    a, k = m.trans, len(m.mu)
    e, d = _densities(x, m).T, x - m.mu[:, None]
    e = e / e.max(0)
    start, weight, s1, s2, xi = np.zeros(k), np.zeros(k), np.zeros(k), np.zeros(k), np.zeros((k, k))
    if first:
        enter = enter * e[:, 0]
        enter = enter / max(float(enter.sum()), 1e-300)
    e, rest = e[:, int(first) :], d[:, int(first) :]
    before_first = behind
    if e.shape[1]:
        grids = _grids(e)
        blocks = _block_products(a, grids)[0]
        ahead = _prefixes(blocks)
        after = _prefixes(blocks[:, :, ::-1].transpose(1, 0, 2))[:, :, ::-1]  # of transposed blocks: what is behind each, itself included
        enters = np.concatenate([enter[:, None], np.einsum("i,ijn->jn", enter, ahead[:, :, :-1])], axis=1)
        leaves = np.concatenate([np.einsum("i,ijn->jn", behind, after[:, :, 1:]), behind[:, None]], axis=1)
        before_first = behind @ after[:, :, 0]
        at = 0
        for rows, n, g in grids:
            v, w = enters[:, at : at + n], leaves[:, at : at + n]
            at += n
            _scaled(v), _scaled(w)
            prev, state, back = np.empty_like(g), np.empty_like(g), np.empty_like(g)
            for t in range(len(g)):
                prev[t] = v
                state[t] = a.T @ v
                v = state[t] * g[t]
                _scaled(v)
            for t in reversed(range(len(g))):
                back[t] = g[t] * w
                w = a @ back[t]
                _scaled(w)
            state *= back
            total = np.maximum(state.sum(1, keepdims=True), 1e-300)
            state /= total
            back /= total
            xi += (prev @ back.transpose(0, 2, 1)).sum(0)
            dev = _grids(rest)[0][2] if rows.start == 0 else rest[None, :, rows]
            weight += state.sum((0, 2))
            state *= dev
            s1 += state.sum((0, 2))
            state *= dev
            s2 += state.sum((0, 2))
    if first:
        start = enter * before_first
        start = start / max(float(start.sum()), 1e-300)
        weight, s1, s2 = weight + start, s1 + start * d[:, 0], s2 + start * d[:, 0] ** 2
    return np.concatenate([start, weight, s1, s2, (a * xi).ravel()])


def improved(m: Model, c: np.ndarray, loglik: float, tol: float) -> Model:
    """The next model from summed counts, or the same one if its likelihood has settled."""
    k = len(m.mu)
    if abs(loglik - m.loglik) < tol:
        return replace(m, done=True)
    pi, weight, s1, s2 = (c[i * k : (i + 1) * k] for i in range(4))
    weight, xi = np.maximum(weight, 1e-9), c[4 * k :].reshape(k, k)
    shift = s1 / weight
    trans = xi / np.maximum(xi.sum(1, keepdims=True), 1e-9) if xi.sum() > 0 else m.trans
    return replace(m, pi=pi, trans=trans, mu=m.mu + shift, sigma=np.sqrt(np.maximum(s2 / weight - shift**2, 1e-18)), loglik=loglik)


def _cut(df: DataFrame, key: str, value: str, at: str, size: int) -> DataFrame:
    """A row for each part with its values in order, dealt once and kept: (key, part, v)."""
    part = F.floor((F.col(at) - 1) / size)
    x = df.select(F.col(key).alias("key"), part.alias("part"), F.col(at).alias("at"), F.col(value).cast("double").alias("x"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["key", "part"]].head(1).assign(v=[pdf["x"].to_numpy()[np.argsort(pdf["at"].to_numpy(), kind="stable")]])

    packed = x.groupBy("key", "part").applyInPandas(pack, StructType([x.schema["key"], *StructType.fromDDL("part long, v array<double>").fields]))
    # a fixed number of partitions, which AQE doesn't merge: rounds find them dealt by part
    return packed.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "part").persist(StorageLevel.MEMORY_AND_DISK)


def _starts(parts: DataFrame, states: list[int], restarts: int, seed: int, size: int) -> dict:
    """First models of each key: at quantiles, and with `restarts` at seeded draws of its values, those of `hmm_fit`."""
    if parts.select("key").distinct().limit(MOST_KEYS + 1).count() > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: fit them in groups")
    x = parts.select("key", F.explode("v").alias("x"))
    n = F.col("n")
    wanted = {f"q{k}_{i}": F.floor(n * ((i + 0.5) / k)) for k in states for i in range(k)}
    spread = x.groupBy(F.col("key").alias("k")).agg(F.var_pop("x").alias("var"))
    rows = ranks(x, ["key"], "x", wanted, few=True).join(spread, F.col("key").eqNullSafe(F.col("k"))).collect()  # a row a key
    drawn = {(row["key"], k, r): (np.random.default_rng(seed + r).choice(row["n"], k) + 1).tolist() for row in rows for k in states if k > 1 for r in range(1, restarts)}
    values: dict = {}
    if drawn:
        kind = x.schema["key"].dataType.simpleString()
        places = x.sparkSession.createDataFrame(sorted({(key, p) for (key, _, _), ps in drawn.items() for p in ps}, key=str), f"of {kind}, place long")
        of_part = F.col("part") == F.floor((F.col("place") - 1) / size)
        value = F.get("v", F.pmod(F.col("place") - 1, F.lit(size)).cast("int")).alias("x")
        found = parts.join(places, F.col("key").eqNullSafe(F.col("of")) & of_part).select("of", "place", value).collect()  # k values a start
        values = {(v["of"], v["place"]): v["x"] for v in found}
    out = {}
    for row in rows:
        for k in states:
            for r in range(restarts if k > 1 else 1):
                mu = np.array([row[f"q{k}_{i}"] for i in range(k)] if r == 0 else sorted(values[row["key"], p] for p in drawn[row["key"], k, r]))
                sigma = np.full(k, math.sqrt(max(row["var"] / k, 1e-18))) * (np.linspace(0.6, 1.6, k) if k > 1 else 1.0)
                trans = np.full((k, k), 0.1 / (k - 1)) if k > 1 else np.ones((1, 1))
                np.fill_diagonal(trans, 0.9 if k > 1 else 1.0)
                out[row["key"], k, r] = Model(np.full(k, 1 / k), trans, mu, sigma, rows=row["n"])
    return out


def _round(x: DataFrame, models: dict) -> dict:
    """(log-likelihood, summed counts) of each model (key, k, start), in one job."""
    shared = x.sparkSession.sparkContext.broadcast(models)
    of: dict = {}
    for key, k, r in models:
        of.setdefault(key, []).append((k, r))
    kind = x.schema["key"].dataType.simpleString()

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v, rows = pdf["v"].iloc[0], []
        for k, r in of.get(key[0], []):
            m = shared.value[key[0], k, r]
            matrix, size = product(m.trans, _densities(v, m), key[1] == 0)
            rows.append((key[0], key[1], k, r, matrix.ravel(), size))
        return pd.DataFrame(rows, columns=["key", "part", "k", "r", "m", "size"])

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        before, behind, loglik = ends([(np.array(m).reshape(key[1], key[1]), s) for m, s in zip(pdf["m"], pdf["size"], strict=True)], shared.value[key].pi)
        return pdf[["key", "part", "k", "r"]].assign(enter=before, behind=behind, loglik=loglik)

    def count(key: tuple, pdf: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        v = pdf["v"].iloc[0]
        rows = [(key[0], p.k, p.r, p.loglik, counts(v, shared.value[key[0], p.k, p.r], np.array(p.enter), np.array(p.behind), key[1] == 0)) for p in met.itertuples()]
        return pd.DataFrame(rows, columns=["key", "k", "r", "loglik", "c"])

    made = x.groupBy("key", "part").applyInPandas(products, f"key {kind}, part long, k int, r int, m array<double>, size double")
    met = made.groupBy("key", "k", "r").applyInPandas(meet, f"key {kind}, part long, k int, r int, enter array<double>, behind array<double>, loglik double")
    met = met.select(F.col("key").alias("of"), F.col("part").alias("at_part"), "k", "r", "enter", "behind", "loglik")
    each = x.groupBy("key", "part").cogroup(met.groupBy("of", "at_part")).applyInPandas(count, f"key {kind}, k int, r int, loglik double, c array<double>")
    cells = max(5 * k + k * k for _, k, _ in models)
    sums = each.groupBy("key", "k", "r").agg(F.first("loglik").alias("loglik"), *[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(cells)]).collect()  # a row a model
    return {(s["key"], s["k"], s["r"]): (s["loglik"], np.array([s[f"c{i}"] for i in range(4 * s["k"] + s["k"] ** 2)])) for s in sums}


def fit(df: DataFrame, key: str, value: str, at: str, states: list[int], rounds: int = 40, tol: float = 1e-5, restarts: int = 1, seed: int = 11, size: int = SIZE) -> dict:
    """{(key, number of states): Model} by Baum-Welch, the likeliest of `restarts` fits, states by ascending mean.

    df: rows with a key, their place in it from 1 (`positions`) and a value that is no null. The first fit starts at
    quantiles, others at values of seeded ranks. Each round is a job in which no task holds more than a part of `size`
    rows; the driver holds models only.
    """
    x = _cut(df, key, value, at, size)
    try:
        models = _starts(x, states, restarts, seed, size)
        for _ in range(rounds):
            todo = {n: m for n, m in models.items() if not m.done}
            if not todo:
                break
            models |= {n: improved(models[n], c, loglik, tol) for n, (loglik, c) in _round(x, todo).items()}
    finally:
        x.unpersist()
    best: dict = {}
    for (name, k, _), m in sorted(models.items(), key=lambda i: i[0][2]):
        if (name, k) not in best or m.loglik > best[name, k].loglik:
            best[name, k] = m
    return {n: m.ordered() for n, m in best.items()}


def _steps(x: np.ndarray, m: Model, first: bool) -> np.ndarray:
    """Log weights of going from state to state at each row."""
    w = np.log(m.trans + 1e-300)[None, :, :] + np.log(_emission(x, m.mu, m.sigma))[:, None, :]
    if first:
        w[0] = np.where(np.eye(len(m.mu), dtype=bool), np.diag(w[0] - np.log(m.trans + 1e-300))[:, None], -np.inf)
    return w


def paths(df: DataFrame, key: str, value: str, at: str, models: dict, size: int = SIZE) -> DataFrame:
    """df with `state`, of each key's most likely path under its model (`models`: key to Model). Ties take the lower state."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(models)
    x = df.withColumn("__part", F.floor((F.col(at) - 1) / size))
    out = StructType([*df.schema.fields, StructField("state", LongType())])

    def best(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w = _steps(pdf.sort_values(at)[value].to_numpy(float), shared.value[key_[0]], key_[1] == 0)
        while len(w) > 1:
            odd = len(w) % 2
            w = np.concatenate([(w[: len(w) - odd : 2, :, :, None] + w[1::2, None, :, :]).max(2), w[len(w) - odd :]])
        return pd.DataFrame({"key": [key_[0]], "part": [key_[1]], "w": [w[0].ravel()]})

    def meet(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, m = pdf.sort_values("part"), shared.value[key_[0]]
        v, enter = np.log(m.pi + 1e-300), []
        for w in pdf["w"]:
            enter.append(v)
            v = (v[:, None] + np.array(w).reshape(len(v), -1)).max(0)
        last, ends_ = int(v.argmax()), []
        for v, w in zip(reversed(enter), reversed(pdf["w"].tolist()), strict=True):
            ends_.append(last)
            last = int((v + np.array(w).reshape(len(v), -1)[:, last]).argmax())
        return pdf[["key", "part"]].assign(enter=enter, last=ends_[::-1])

    def trace(key_: tuple, pdf: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        w, v, back = _steps(pdf[value].to_numpy(float), shared.value[key_[0]], key_[1] == 0), np.array(met["enter"].iloc[0]), []
        for step in w:
            s = v[:, None] + step
            back.append(s.argmax(0))
            v = s.max(0)
        path = [int(met["last"].iloc[0])]
        for b in back[:0:-1]:
            path.append(int(b[path[-1]]))
        return pdf.assign(state=path[::-1])[out.names]

    made = x.groupBy(key, "__part").applyInPandas(best, f"key {kind}, part long, w array<double>")
    met = made.groupBy("key").applyInPandas(meet, f"key {kind}, part long, enter array<double>, last long")
    met = met.select(F.col("key").alias("__of"), F.col("part").alias("__at_part"), "enter", "last")
    return x.groupBy(key, "__part").cogroup(met.groupBy("__of", "__at_part")).applyInPandas(trace, out)
