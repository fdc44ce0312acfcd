"""Dense statistics in numpy for one key's series: HAR, logistic regression, hidden Markov models, generalised normal."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def har_rows(rv: np.ndarray, ret: np.ndarray, week: int = 5, month: int = 22) -> np.ndarray:
    """HAR features (1, last, weekly and monthly mean variance, squared fall) of each bar from the month-th on."""
    sums = np.concatenate([[0.0], np.cumsum(rv)])
    t = np.arange(month, len(rv))
    mean = lambda k: (sums[t + 1] - sums[t + 1 - k]) / k
    return np.column_stack([np.ones(len(t)), rv[t], mean(week), mean(month), np.minimum(ret[t], 0.0) ** 2])


def har_walk(rv: np.ndarray, ret: np.ndarray, refit: int = 5, window: int = 400, month: int = 22) -> tuple[list[float], float]:
    """Walk-forward HAR forecasts of each bar's variance from the bars before it, and their R2.

    The model sees the last `window` bars and is refitted after every `refit`-th, once there are five more than a month
    of them and two rows more than features. Forecasts start a bar after the first month and stay in [0, 5 x the
    largest variance so far]. R2 is NaN for three forecasts or fewer.
    """
    beta, out, truth = None, [], []
    for t in range(len(rv)):
        low = max(0, t - window)
        if beta is not None and t - low >= month and t >= month + 1:
            last = np.array([1.0, rv[t - 1], rv[t - 5 : t].mean(), rv[t - month : t].mean(), min(ret[t - 1], 0.0) ** 2])
            out.append(float(np.clip(last @ beta, 0.0, 5 * rv[: t + 1].max())))
            truth.append(rv[t])
        if t % refit == 0:
            low = max(0, t + 1 - window)
            x, y = har_rows(rv[low : t + 1], ret[low : t + 1], month=month)[:-1], rv[low + month + 1 : t + 1]
            if t + 1 - low >= month + 5 and len(x) >= 7:
                beta = np.linalg.pinv(x.T @ x + np.diag([0.0] + [1e-12] * 4), rcond=1e-15) @ (x.T @ y)
    y = np.array(truth)
    spread = ((y - y.mean()) ** 2).sum() if len(y) > 3 else 0.0
    return out, float(1 - ((y - np.array(out)) ** 2).sum() / spread) if spread > 0 else math.nan


def standardize(x: np.ndarray) -> np.ndarray:
    """Columns less their mean, in sample standard deviations; a column that hardly varies is only centred."""
    sd = x.std(axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    return (x - x.mean(axis=0)) / np.where(sd < 1e-10, 1.0, sd)


def ols(df: DataFrame, columns: list[str], target: str) -> dict[str, float]:
    """Least squares by the normal equations: one aggregation of products, a small system on the driver. Terms that
    depend on others share their effect."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"x{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(F.col(a) * F.col(target)).alias(f"y{i}") for i, a in enumerate(columns)]).first()
    xtx = np.zeros((len(columns), len(columns)))
    for i, (a, b) in enumerate(pairs):
        j, k = columns.index(a), columns.index(b)
        xtx[j, k] = xtx[k, j] = row[f"x{i}"] or 0.0
    scale = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
    y = np.array([row[f"y{i}"] or 0.0 for i in range(len(columns))])
    beta = np.linalg.pinv(xtx / np.outer(scale, scale), rcond=1e-13) @ (y / scale) / scale
    return dict(zip(columns, map(float, beta), strict=True))


def expanding_logit(df: DataFrame, fold: str, columns: list[str], y: str, folds: int, rounds: int = 25, tol: float = 1e-6) -> dict[int, np.ndarray]:
    """Logistic regressions on all rows of the folds before each fold 1, 2, ...: {fold: intercept and slopes}.

    Features are standardised with the training rows' moments; slopes are given for the raw features. Each round sums
    gradients and products over all rows, for all folds at once. Folds without both classes or a solution are left out.
    """
    p = len(columns)
    past = df.where(F.col(fold) < folds - 1).withColumn("__to", F.explode(F.sequence(F.col(fold) + 1, F.lit(folds - 1))))
    moments = past.groupBy("__to").agg(F.count("*").alias("n"), F.min(y).alias("low"), F.max(y).alias("high"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).collect()  # folds - 1 rows
    mean = {r["__to"]: np.array([r[f"m{i}"] for i in range(p)]) for r in moments if r["n"] >= 5 and r["low"] != r["high"]}
    sd = {r["__to"]: np.array([s if (s := r[f"s{i}"] or 1.0) >= 1e-10 else 1.0 for i in range(p)]) for r in moments if r["__to"] in mean}
    beta = {f: np.zeros(p + 1) for f in mean}
    open_ = set(beta)
    for _ in range(rounds):
        if not open_:
            break
        listed = lambda v: F.array(*[F.lit(float(e)) for e in v])
        pick = lambda table: F.element_at(F.create_map(*[e for f in sorted(open_) for e in (F.lit(f), listed(table[f]))]), F.col("__to"))
        x = past.where(F.col("__to").isin(sorted(open_))).withColumns({"__m": pick(mean), "__s": pick(sd), "__b": pick(beta)})
        x = x.withColumns({"__x0": F.lit(1.0)} | {f"__x{i + 1}": (F.col(c) - F.col("__m")[i]) / F.col("__s")[i] for i, c in enumerate(columns)})
        odds = sum((F.col("__b")[i] * F.col(f"__x{i}") for i in range(1, p + 1)), F.col("__b")[0])
        x = x.withColumn("__p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds)))))
        x = x.withColumn("__w", F.greatest(F.col("__p") * (1 - F.col("__p")), F.lit(1e-9)))
        sums = [F.sum(F.col("__w") * F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"h{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
        for r in x.groupBy("__to").agg(*sums, *[F.sum(F.col(f"__x{i}") * (F.col(y) - F.col("__p"))).alias(f"g{i}") for i in range(p + 1)]).collect():  # folds - 1 rows
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
            try:
                step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(p + 1)]))
            except np.linalg.LinAlgError:
                step = np.full(p + 1, np.nan)
            f = r["__to"]
            beta[f] = beta[f] + step
            if not np.abs(step).max() >= tol:
                open_.discard(f)
    out = {}
    for f, b in beta.items():
        if np.isfinite(b).all():
            slopes = b[1:] / sd[f]
            out[f] = np.concatenate([[b[0] - slopes @ mean[f]], slopes])
    return out


def irls(x: np.ndarray, y: np.ndarray, rounds: int = 25, tol: float = 1e-6) -> np.ndarray | None:
    """Logistic regression by reweighted least squares; None without both classes, five rows or a solution."""
    if len(y) < 5 or len(set(y.tolist())) < 2:
        return None
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        try:
            d = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (y - p))
        except np.linalg.LinAlgError:
            return None
        b = b + d
        if np.abs(d).max() < tol:
            break
    return b if np.isfinite(b).all() else None


def fama_macbeth(betas: DataFrame) -> DataFrame:
    """Mean, standard error and t per term over periods of (period, term, beta); periods without a beta don't count."""
    betas = betas.where("beta is not null and not isnan(beta)")
    g = betas.groupBy("term").agg(F.count("*").alias("periods"), F.avg("beta").alias("mean"), (F.stddev_samp("beta") / F.sqrt(F.count("*"))).alias("se"))
    return g.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))


def _emission(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)) + 1e-300


def _scan(start: np.ndarray, a: np.ndarray, e: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Forward probabilities, each row scaled to sum one, and the scales: rows v_t ~ (v_(t-1) a) * e_t.

    Rows are products of matrices a * e_t, so the series is cut into blocks: all blocks' running products are formed
    side by side, then the blocks are entered one after the other.
    """
    n, k = e.shape
    blocks = -(-n // block)
    step = np.broadcast_to(np.eye(k), (blocks * block, k, k)).copy()
    step[:n] = a[None, :, :] * e[:, None, :]
    if n:
        step[0] = np.diag(e[0])
    step = step.reshape(blocks, block, k, k)
    norm, held = np.zeros((blocks, block)), np.broadcast_to(np.eye(k), (blocks, k, k))
    products = np.zeros_like(step)
    for i in range(block):
        held = held @ step[:, i]
        size = np.maximum(held.sum((1, 2)), 1e-300)
        held = held / size[:, None, None]
        products[:, i], norm[:, i] = held, np.log(size)
    log_size, rows, v = np.zeros((blocks, block)), np.zeros((blocks, block, k)), start
    for b in range(blocks):
        rows[b] = v @ products[b]
        total = np.maximum(rows[b].sum(1), 1e-300)
        log_size[b] = np.log(total) + np.cumsum(norm[b])
        rows[b] /= total[:, None]
        v = rows[b, -1]
    rows, log_size = rows.reshape(-1, k)[:n], log_size.reshape(-1)[:n]
    scales = log_size.copy()
    inside = np.arange(n) % block > 0
    scales[inside] -= log_size[np.flatnonzero(inside) - 1]
    return rows, np.exp(scales)


def hmm_fit(x: np.ndarray, k: int, rounds: int = 40, tol: float = 1e-5, restarts: int = 1, seed: int = 11) -> dict:
    """Gaussian hidden Markov model by Baum-Welch with scaling, the likeliest of `restarts` fits; states by ascending
    mean. The first fit starts at quantiles, the others at seeded draws of the data."""
    fits = [_hmm_once(x, k, rounds, tol, np.random.default_rng(seed + r) if r else None) for r in range(max(1, restarts if k > 1 else 1))]
    return max(fits, key=lambda m: m["loglik"])


def _hmm_once(x: np.ndarray, k: int, rounds: int, tol: float, rng: np.random.Generator | None) -> dict:
    n = len(x)
    s = np.sort(x)
    mu = np.array([s[min(n - 1, int(n * (i + 0.5) / k))] for i in range(k)]) if n else np.zeros(k)
    if rng is not None and n:
        mu = np.sort(rng.choice(x, k))
    sd = np.full(k, math.sqrt(max(x.var() / k, 1e-18))) if n else np.ones(k)
    sd = sd * np.linspace(0.6, 1.6, k) if k > 1 else sd
    pi, a = np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
    if k > 1:
        np.fill_diagonal(a, 0.9)
    last = -math.inf
    for _ in range(rounds):
        e = _emission(x, mu, sd)
        alpha, c = _scan(pi, a, e)
        # emission times backward probability is a scan of the reversed series, up to a factor a row, which g divides out
        back = _scan(np.ones(k), a.T, e[::-1])[0][::-1]
        beta = np.concatenate([back[1:] @ a.T, np.ones((min(n, 1), k))])
        ll = float(np.log(c).sum())
        if abs(ll - last) < tol:
            break
        last = ll
        g = alpha * beta
        g /= np.maximum(g.sum(1, keepdims=True), 1e-300)
        if n > 1:
            ahead = back[1:] / np.maximum(np.einsum("ti,ij,tj->t", alpha[:-1], a, back[1:]), 1e-300)[:, None]
            xi = a * (alpha[:-1].T @ ahead)
            a = xi / np.maximum(xi.sum(1, keepdims=True), 1e-9)
        pi, weight = g[0], np.maximum(g.sum(0), 1e-9)
        mu = (g * x[:, None]).sum(0) / weight
        sd = np.sqrt(np.maximum((g * (x[:, None] - mu) ** 2).sum(0) / weight, 1e-18))
    order = np.argsort(mu, kind="stable")
    return {"mu": mu[order], "sigma": sd[order], "pi": pi[order], "trans": a[np.ix_(order, order)], "loglik": last}


def viterbi(x: np.ndarray, m: dict) -> np.ndarray:
    """Most likely state path."""
    e, a = np.log(_emission(x, m["mu"], m["sigma"])), np.log(m["trans"] + 1e-300)
    v, back = np.log(m["pi"] + 1e-300) + e[0], []
    for t in range(1, len(x)):
        s = v[:, None] + a
        back.append(s.argmax(0))
        v = s.max(0) + e[t]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def lower_gamma(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma function of arrays: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    for low in (True, False):
        at = (x > 0) & ((x < a + 1) == low)
        if not at.any():
            continue
        p, v = a[at], x[at]
        scale = np.exp(p * np.log(v) - v - (math.lgamma(p.flat[0]) if (p == p.flat[0]).all() else log_gamma(p)))
        if low:
            term = total = 1 / p
            for n in range(1, 500):
                term = term * v / (p + n)
                total = total + term
                if (np.abs(term) <= 1e-15 * np.abs(total)).all():
                    break
            out[at] = total * scale
            continue
        tiny = 1e-300
        b = v + 1 - p
        c, d = np.full(p.shape, 1 / tiny), 1 / b
        h = d
        for n in range(1, 500):
            up = -n * (n - p)
            b = b + 2
            d = 1 / np.where(np.abs(up * d + b) < tiny, tiny, up * d + b)
            c = np.where(np.abs(b + up / c) < tiny, tiny, b + up / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[at] = 1 - scale * h
    return out


def gennorm_up(z, shape, scale) -> np.ndarray:
    """P(X >= -z) of a generalised normal with density ~ exp(-|x / scale|^shape / shape): of ending over a strike that
    lies z below; of arrays. Half for degenerate shapes or scales."""
    z, shape, scale = np.broadcast_arrays(np.asarray(z, float), np.asarray(shape, float), np.asarray(scale, float))
    ok = (shape > 0) & (scale > 0)
    k = np.where(ok, shape, 1.0)
    g = 0.5 * lower_gamma(1 / k, (np.abs(z) / np.where(ok, scale, 1.0)) ** k / k)
    return np.where(ok, 0.5 + np.copysign(g, z), 0.5)


def implied_scale(z, p, shape: float, low: float = 1e-6, high: float = 1.0, steps: int = 60) -> np.ndarray:
    """Scale in [low, high] at which the chance of ending at a strike z above, or over it, is p, by geometric bisection.

    The chance is taken to grow with the scale, as it does for a strike above (z > 0) and p under one half; otherwise the
    search runs to an end of the range. NaN for p outside (0, 1) or a strike at the money.
    """
    z, p = np.broadcast_arrays(np.asarray(z, float), np.asarray(p, float))
    lo, hi = np.full(z.shape, low), np.full(z.shape, high)
    for _ in range(steps):
        m = np.sqrt(lo * hi)
        over = gennorm_up(-z, shape, m) > p
        lo, hi = np.where(over, lo, m), np.where(over, m, hi)
    return np.where((p > 0) & (p < 1) & (np.abs(z) >= 1e-9), np.sqrt(lo * hi), np.nan)
