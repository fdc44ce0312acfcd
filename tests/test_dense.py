"""Queries over many rows within a short time: no pairs of rows are made, and results stay those of the SQL."""

import datetime
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare
from tidemark import registry
from tidemark.operators import interval_totals
from tidemark.operators.bands import count_distances
from tidemark.plans import alignment, folds

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def folder(spark, path, n, ids):
    """Tables of the smallest size, but n ticks of two assets at one a second or more, whose ids repeat after `ids`."""
    for t in os.listdir(SF):
        if t != "events.parquet":
            os.symlink(f"{SF}/{t}", path / t)
    rng, began = random.Random(5), datetime.datetime(2024, 1, 1, 3)
    rows = [(i % ids, began + datetime.timedelta(seconds=i // 2 + 40_000 * (i // 800)), rng.randrange(40), "ab"[i % 3 == 0], round(rng.uniform(-0.2, 9), 2), f'{{"k": {rng.randrange(100)}}}') for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("width", [(7, -1), (5, 5), (0, 0), (20, 3)])
def test_interval_totals(spark, width):
    """Each left row's interval holds what all pairs give, at its ends, over empty stretches and with equal times; keys and
    times that are null hold nothing."""
    before, after = width
    rng = random.Random(3)
    lt = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 90)])) for i in range(120)]
    rt = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 20), *range(60, 90)]), rng.choice([None, 1.5, -2.0, 7.25])) for _ in range(150)]
    left, right = spark.createDataFrame(lt, "i long, k string, t long"), spark.createDataFrame(rt, "k string, t long, v double")
    got = {r.i: (r.n, r.s, r.top) for r in interval_totals(left, right, ["k"], "t", before, after, ["i"], {"s": F.col("r.v")}, {"top": F.col("r.v")}).collect()}
    want = {}
    for i, k, t in lt:
        found = [v for k2, t2, v in rt if k is not None and k == k2 and None not in (t, t2) and t - before <= t2 <= t + after]
        known = [v for v in found if v is not None]
        if found:
            want[i] = (len(found), sum(known) if known else None, max(known, default=None))
    assert got == want


@pytest.mark.parametrize("name", ["causal_var_features", "lookback_join"])
@pytest.mark.parametrize("ids", [2000, 700])
def test_rounds_are_not_paired_with_ticks(spark, tmp_path, monkeypatch, name, ids):
    """Only rounds whose id another one has meet their ticks one by one, and only where order counts."""
    paired = []
    join = alignment.range_join
    monkeypatch.setattr(alignment, "range_join", lambda left, *a, **k: (paired.append(left.count()), join(left, *a, **k))[1])
    assert compare(spark, folder(spark, tmp_path, 2000, ids), QUERIES[name], SQL[name]) is None
    assert sum(paired) == 0 or (ids < 2000 and name == "causal_var_features")


def test_lead_and_lag_join_no_rows(spark):
    """Neighbours come from windows: a join on asset and group alone would pair all of their rows."""
    plan = QUERIES["leadlag_ccf"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan


@pytest.mark.parametrize("name", ["cross_venue_ev", "basis_quantiles", "arb_lock"])
def test_venues_are_not_paired_row_by_row(spark, tmp_path, name):
    """Ticks of a second apart: the same rows as all pairs give, and no join but the one with the widest quote of a window."""
    path = folder(spark, tmp_path, 2400, 2400)
    assert compare(spark, path, QUERIES[name], SQL[name]) is None
    joins = QUERIES[name](spark, path)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins <= {"cross_venue_ev": 1, "basis_quantiles": 1, "arb_lock": 0}[name]


def test_counted_distances():
    """Distances and how often they occur, for values on a grid and for values that are all different."""
    rng = np.random.default_rng(2)
    for grid in (4, 10**6):
        t, s = rng.integers(0, 300, 200), rng.integers(0, 300, 170)
        v, w = rng.integers(0, grid, 200) / 4, rng.integers(0, grid, 170) / 4
        want = Counter(abs(v[i] - w[j]) for i in range(200) for j in range(170) if abs(int(t[i]) - int(s[j])) <= 25)
        d, n = count_distances(t, v, s, w, 25)
        assert dict(zip(d.tolist(), n.tolist(), strict=True)) == want
    assert len(count_distances(t[:0], v[:0], s, w, 25)[0]) == 0


def test_calibration_rows_are_read_once(spark):
    """A calibration row and its decision are the same line item: no join, one scan."""
    plan = folds._calib(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1
