"""Expression builders over SQL text, alike in Spark SQL and DuckDB; double literals carry an exponent in both.

Each takes and gives SQL text. `column` turns one into a Column, `register_all` makes SQL functions of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Rational approximation of the normal tail (Hart 1968, as given by West 2005), highest power first.
TAIL_NUM = ("3.52624965998911e-2", "0.700383064443688e0", "6.37396220353165e0", "33.912866078383e0", "112.079291497871e0", "221.213596169931e0", "220.206867912376e0")
TAIL_DEN = ("8.83883476483184e-2", "1.75566716318264e0", "16.064177579207e0", "86.7807322029461e0", "296.564248779674e0", "637.333633378831e0", "793.826512519948e0", "440.413735824752e0")


def _horner(coefficients: tuple[str, ...], z: str) -> str:
    out = coefficients[0]
    for c in coefficients[1:]:
        out = f"({out} * {z} + {c})"
    return out


def clamp(x: str, low: str, high: str) -> str:
    return f"least(greatest({x}, {low}), {high})"


def normal_cdf(x: str) -> str:
    """P(N(0, 1) <= x), within 3e-16."""
    z = f"abs({x})"
    bulk = f"exp(-{z} * {z} / 2e0) * {_horner(TAIL_NUM, z)} / {_horner(TAIL_DEN, z)}"
    far = f"exp(-{z} * {z} / 2e0) / (2.506628274631e0 * ({z} + 1e0 / ({z} + 2e0 / ({z} + 3e0 / ({z} + 4e0 / ({z} + 0.65e0))))))"
    tail = f"case when {z} > 37e0 then 0e0 when {z} < 7.07106781186547e0 then {bulk} else {far} end"
    return f"(case when {x} > 0e0 then 1e0 - {tail} else {tail} end)"


def sigmoid(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


def logit(p: str, eps: str = "1e-6") -> str:
    q = clamp(p, eps, f"1e0 - {eps}")
    return f"ln({q} / (1e0 - {q}))"


def entropy(p: str) -> str:
    """Binary entropy in bits, p clamped by 1e-9."""
    q = clamp(p, "1e-9", "1e0 - 1e-9")
    return f"(-({q} * ln({q}) + (1e0 - {q}) * ln(1e0 - {q})) / ln(2e0))"


def digital_z(spot: str, strike: str, sigma: str, tau: str, mu: str = "0e0") -> str:
    """Deviations that a lognormal's end lies over the strike, with per-second drift and volatility; null for degenerate inputs."""
    ok = f"{spot} > 0e0 and {strike} > 0e0 and {sigma} > 0e0 and {tau} > 0e0"
    return f"(case when {ok} then (ln({spot} / {strike}) + ({mu} - {sigma} * {sigma} / 2e0) * {tau}) / ({sigma} * sqrt({tau})) end)"


def digital_of(z: str) -> str:
    """Probability of `digital_z`: 0.5 for degenerate inputs, clamped by 1e-6. It uses z many times, so a query binds z to a column first."""
    return f"(case when {z} is not null then {clamp(normal_cdf(z), '1e-6', '1e0 - 1e-6')} else 0.5e0 end)"


def digital_prob(spot: str, strike: str, sigma: str, tau: str, mu: str = "0e0") -> str:
    """P(spot ends over strike) as one expression, for short inputs."""
    return digital_of(digital_z(spot, strike, sigma, tau, mu))


def bridge_prob(spot: str, strike: str, sigma: str, minutes: str) -> str:
    """Driftless P(up) with per-minute volatility; null for non-positive inputs."""
    ok = f"{spot} > 0e0 and {strike} > 0e0 and {sigma} > 0e0 and {minutes} > 0e0"
    return f"(case when {ok} then {normal_cdf(f'(ln({spot} / {strike}) / ({sigma} * sqrt({minutes})))')} end)"


def taker_fee(p: str) -> str:
    q = clamp(p, "0e0", "1e0")
    return f"(0.072e0 * {q} * (1e0 - {q}))"


def venue_fee(venue: str, p: str) -> str:
    return f"(case when {venue} = 'polymarket' then 0e0 else {taker_fee(p)} end)"


def kelly(p: str, price: str, cap: str = "0.02e0", fraction: str = "0.5e0") -> str:
    """Fraction of equity: half Kelly of a binary contract, between 0 and the cap."""
    return f"(case when {price} > 0e0 and {price} < 1e0 then {clamp(f'{fraction} * ({p} - {price}) / (1e0 - {price})', '0e0', cap)} else 0e0 end)"


def mid(bid: str, ask: str) -> str:
    return f"(case when {bid} is not null and {ask} is not null then ({bid} + {ask}) / 2e0 else coalesce({ask}, {bid}) end)"


def imbalance(bid_size: str, ask_size: str) -> str:
    return f"(case when {bid_size} + {ask_size} > 0e0 then ({bid_size} - {ask_size}) / ({bid_size} + {ask_size}) else 0e0 end)"


def expected_value(edge: str, confidence: str) -> str:
    return f"({edge} - 0.005e0 - 0.5e0 * (1e0 - {confidence}) * 0.02e0)"


def decile(p: str) -> str:
    return f"cast(least(9, floor({p} * 10e0)) as bigint)"


def band(p: str) -> str:
    return f"(case when {p} < 0.45e0 then 'lo' when {p} < 0.55e0 then 'mid' else 'hi' end)"


def net_per_contract(won: str, price: str, fee: str) -> str:
    return f"({won} - {price} - {fee})"


def anchor(p: str, alpha: str, least_div: str = "0.02e0") -> str:
    """Log-odds shrinkage of p towards the structural alpha: weight min(.85, .35 + 2.1 x divergence)."""
    lam = f"least(0.85e0, 0.35e0 + 6e0 * abs({p} - {alpha}) * 0.35e0)"
    return f"(case when {alpha} is null then {p} when abs({p} - {alpha}) < {least_div} then {p} else {sigmoid(f'(1e0 - {lam}) * {logit(p)} + {lam} * {logit(alpha)}')} end)"


def sigma_multiplier(kappa: str) -> str:
    return f"sqrt({clamp(kappa, '0.6e0', '1.6e0')})"


def kappa_regime(kappa: str) -> str:
    return f"(case when {kappa} is null then 'unknown' when {kappa} < 0.8e0 then 'compressing' when {kappa} > 1.25e0 then 'expanding' else 'stable' end)"


def temperature(stability: str, calib_err: str, panic: str) -> str:
    return f"((1e0 + 2e0 * (1e0 - {stability}) + 3e0 * greatest(0e0, {calib_err} - 0.1e0)) * case when {panic} then 1.5e0 else 1e0 end)"


def confidence(p: str, stability: str, move: str) -> str:
    return f"((1e0 - {entropy(p)}) * (0.4e0 + 0.6e0 * {stability}) * (0.5e0 + 0.5e0 * {move}))"


def classify_regime(n: str, vol: str, mean: str, sd: str, efficiency: str) -> str:
    """panic, or volatility state / trend state, from moments before this row."""
    high, low = f"(case when {n} > 5 then {mean} + 0.5e0 * {sd} else {vol} end)", f"(case when {n} > 5 then {mean} - 0.5e0 * {sd} else {vol} end)"
    state = f"case when {vol} >= {high} then 'high_vol' when {vol} <= {low} then 'low_vol' else 'mid_vol' end"
    trend = f"case when {efficiency} >= 0.45e0 then 'trend' when {efficiency} <= 0.2e0 then 'mean_revert' else 'chop' end"
    return f"(case when {n} > 10 and {vol} > {mean} + 2e0 * {sd} then 'panic' else ({state}) || '/' || ({trend}) end)"


def column(builder: Callable[..., str], *args: str) -> Column:
    """A builder's expression as a Column: column(normal_cdf, "z")."""
    return F.expr(builder(*args))


#: Names and parameters of what `register_all` makes SQL functions of.
FUNCTIONS: dict[str, tuple[Callable[..., str], tuple[str, ...]]] = {
    "tm_normal_cdf": (normal_cdf, ("x",)),
    "tm_sigmoid": (sigmoid, ("x",)),
    "tm_logit": (logit, ("p",)),
    "tm_entropy": (entropy, ("p",)),
    "tm_digital_prob": (digital_prob, ("spot", "strike", "sigma", "tau")),
    "tm_bridge_prob": (bridge_prob, ("spot", "strike", "sigma", "minutes")),
    "tm_taker_fee": (taker_fee, ("p",)),
    "tm_kelly": (kelly, ("p", "price")),
    "tm_anchor": (anchor, ("p", "alpha")),
    "tm_sigma_multiplier": (sigma_multiplier, ("kappa",)),
}


def register_all(spark: SparkSession) -> list[str]:
    """Create the functions in the session; Spark inlines them, so they cost no more than their expressions."""
    for name, (f, params) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({', '.join(f'{p} double' for p in params)}) returns double return {f(*params)}")
    return list(FUNCTIONS)
