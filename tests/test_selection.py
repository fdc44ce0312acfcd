"""Ranks by refined counts against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.selection import ranks


@pytest.mark.parametrize(("passes", "n"), [(1, 4), (2, 8), (2, 1024), (3, 2)])
def test_ranks_are_those_of_sorted_values(spark, passes, n):
    rng = random.Random(n)
    values = {
        "even": [rng.uniform(-1, 1) for _ in range(700)],
        "heavy": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        "ties": [float(rng.randrange(3)) for _ in range(500)],
        "one": [5.0] * 60,
        "single": [-0.0],
        "edge": [1.7e308, -1.7e308, 0.0, 1.0],
        None: [1.0, 2.0, 3.0],
    }
    rows = [(k, v, "x") for k, vs in values.items() for v in vs] + [("even", None, "x"), ("even", float("nan"), "x"), ("empty", None, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, value double, n string")
    wanted = {"p0": F.lit(0), "mid": F.floor(F.col("n") / 2), "p95": F.floor(0.95 * (F.col("n") - 1)), "last": F.col("n") - 1, "beyond": F.col("n")}
    got = {r.k: r for r in ranks(df, ["k"], "value", wanted, passes, n).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        s, m = sorted(vs), len(vs)
        assert tuple(got[k]) == (k, m, s[0], s[m // 2], s[int(0.95 * (m - 1))], s[-1], None)


def test_ranks_of_nothing_and_of_infinity(spark):
    df = spark.createDataFrame([], "k string, value double")
    assert ranks(df, ["k"], "value", {"m": F.lit(0)}).collect() == []
    with pytest.raises(Exception, match="infinite"):
        ranks(spark.createDataFrame([("a", float("inf"))], "k string, value double"), ["k"], "value", {"m": F.lit(0)}).collect()
