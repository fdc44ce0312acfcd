"""Windows that cut keys and scans of associative steps, against whole windows and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import breach, decayed, drawdown, positions, running_sum, running_totals, scan, variance, windowed
from tidemark.operators.scans import halo

BUCKET = "floor(t / 10e0)"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = [(k, None if rng.random() < 0.03 else rng.randrange(200), n, None if rng.random() < 0.1 else rng.uniform(-5, 5)) for n, k in enumerate(["a"] * 400 + ["b"] * 30 + [None] * 60 + ["c"])]
    rng.shuffle(out)
    return spark.createDataFrame(out, "k string, t int, n int, v double").repartition(5)


def ordered(df):
    """Rows of each key in order, nulls first."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.t is not None, r.t or 0, r.n)):
        out.setdefault(r.k, []).append(r)
    return out


def test_positions_with_null_times_and_keys(rows):
    got = ordered(positions(rows, ["k"], ["t", "n"], BUCKET))
    assert all([r.i for r in part] == list(range(1, len(part) + 1)) for part in got.values()) and sum(map(len, got.values())) == rows.count()
    assert positions(rows.limit(0), ["k"], ["t", "n"], BUCKET).collect() == []


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_windows_with_halos_are_whole_windows(rows, size):
    def columns(w):
        return {"was": F.lag("v", 3).over(w), "nxt": F.lead("n", 2).over(w), "total": F.sum("v").over(w.rowsBetween(-6, 0)), "seen": F.count("*").over(w.rowsBetween(-6, 2))}

    def again(w):
        return {"then": F.lag("seen").over(w)}

    if size == 7:
        cut = windowed(rows, ["k"], ["t", "n"], columns, 7, 2, BUCKET, size)
        whole = windowed(rows, ["k"], ["t", "n"], columns, 7, 2)
    else:
        cut = windowed(rows, ["k"], ["t", "n"], [columns, again], 7, 2, BUCKET, size)
        whole = windowed(rows, ["k"], ["t", "n"], [columns, again], 7, 2)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect())) and cut.columns == whole.columns


def test_one_key_is_cut_into_even_parts(rows):
    one = rows.where("k = 'a'")
    parts = halo(one, ["k"], ["t", "n"], BUCKET, 5, 1, 50).groupBy("__part").agg(F.count_if("__own").alias("own"), F.count("*").alias("all")).collect()
    assert [p.own for p in parts if p.own] == [50] * 8 and all(p.all <= 56 for p in parts)
    with pytest.raises(ValueError, match="halo"):
        halo(one, ["k"], ["t", "n"], BUCKET, 51, 0, 50)


def test_running_sums_lose_no_row(spark, rows):
    x = spark.createDataFrame([(1, 2.0), (None, 3.0), (40, 4.0), (None, None)], "t int, v double")
    got = running_sum(x, ["t", "v"], "v", BUCKET, "run").collect()
    assert sorted((r.t or 0, r.run) for r in got) == [(0, 0.0), (0, 3.0), (1, 5.0), (40, 9.0)]
    for part in ordered(running_totals(rows, ["k"], ["t", "n"], {"s": F.col("v"), "c": F.lit(1)}, BUCKET)).values():
        total = 0.0
        for i, r in enumerate(part):
            total += r.v or 0.0
            assert r.s == pytest.approx(total) and r.c == i + 1
    by = ordered(running_sum(rows, ["t", "n"], "v", BUCKET, "s", by=["k"]))
    assert {k: len(p) for k, p in by.items()} == {k: len(p) for k, p in ordered(rows).items()}


@pytest.mark.parametrize("size", [3, 40, 100_000])
def test_scans_are_plain_loops(spark, rows, size):
    x = rows.withColumn("dt", F.abs("n") % 5 + 0.5)
    falls = ordered(scan(x, ["k"], ["t", "n"], drawdown("v"), BUCKET, size))
    trips = ordered(scan(x, ["k"], ["t", "n"], breach("v", 9.0), BUCKET, size))
    means = ordered(scan(x, ["k"], ["t", "n"], decayed(["v"], lambda pdf: 0.5 ** pdf["dt"].to_numpy(), ["y"]), BUCKET, size))
    assert set(falls) == {"a", "b", "c", None} and any(r.first for part in trips.values() for r in part)
    for k, part in falls.items():
        cum = peak = worst = y = 0.0
        low, tripped = np.inf, False
        for r, b, m in zip(part, trips[k], means[k], strict=True):
            cum += r.v or 0.0
            peak = max(peak, cum)
            worst = max(worst, peak - cum)
            y = y * 0.5 ** m.dt + (m.v or 0.0)
            low = min(low, cum)
            assert (r.cum, r.peak, r.drawdown, r.worst, b.run, m.y) == pytest.approx((cum, peak, peak - cum, worst, cum, y), abs=1e-9)
            assert (b.tripped, b.first) == (low <= -9, low <= -9 and not tripped)
            tripped = low <= -9
    assert scan(x.limit(0), ["k"], ["t", "n"], drawdown("v"), BUCKET).collect() == []


def test_scan_over_a_whole_table(rows):
    got = scan(rows.select("t", "n", "v"), [], ["t", "n"], drawdown("v"), BUCKET, 20)
    total = 0.0
    for r in sorted(got.collect(), key=lambda r: (r.t is not None, r.t or 0, r.n)):
        total += r.v or 0.0
        assert r.cum == pytest.approx(total, abs=1e-9)


def test_variance_in_parts_is_that_of_whole_keys(spark):
    rng = np.random.default_rng(3)
    prices = np.exp(np.cumsum(rng.normal(0, 0.01, (2, 500)), axis=1))
    prices[0, 250] *= 1.5
    df = spark.createDataFrame([(c, k, float(p) if k % 37 else None) for c, row in zip("xy", prices, strict=True) for k, p in enumerate(row)], "coin string, step long, px double")
    by, order, cut = ["coin"], ["step"], {"bucket": "floor(step / 30e0)", "size": 60}
    r = variance.log_returns(df, by, order, "px", **cut)
    whole = variance.log_returns(df, by, order, "px")
    w = Window.partitionBy("coin").orderBy("step")
    now, before = F.col("px"), F.lag("px").over(w)
    assert whole.withColumn("want", F.when((now > 0) & (before > 0), F.log(now / before))).where(~F.col("r").eqNullSafe(F.col("want"))).count() == 0
    for f in (
        lambda x, **kw: x,
        lambda x, **kw: variance.rolling_moments(x, by, order, "r", 20, **kw),
        lambda x, **kw: variance.realized_variance(x, by, order, "r", **kw),
        lambda x, **kw: variance.bipower(x, by, order, "r", **kw),
        lambda x, **kw: variance.jumps(x, by, order, "r", **kw),
        lambda x, **kw: variance.decompose(x, by, order, "step", "r", **kw),
        lambda x, **kw: variance.fixed_bars(x, by, order, "r", 9, bucket=kw.get("bucket")),
        lambda x, **kw: variance.changed(x.withColumn("q", F.floor(F.col("px") * 20)), by, order, "q", **kw),
    ):
        got, want = (sorted([f"{v:.9e}" if isinstance(v, float) else str(v) for v in row] for row in z.collect()) for z in (f(r, **cut), f(whole)))
        assert got == want and got
