"""SQLite tables and designs of feature groups on users' frames."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.statistics import fama_macbeth, irls, standardize
from tidemark.operators.design import Design, Group, one_hot
from tidemark.sources import find_runs, simulated_panel, sqlite, storage, write_flag, write_snapshot


@pytest.fixture
def ledger(tmp_path):
    path = str(tmp_path / "led ger.db")
    with sqlite3.connect(path) as db:
        db.execute('create table settled (id integer primary key, "the side" text, pnl real, won int, raw blob, note)')
        db.executemany("insert into settled values (?, ?, ?, ?, ?, ?)", [(i * 3, "up" if i % 2 else "down", None if i % 7 == 0 else i / 2, i % 3, b"\x00\x01", i) for i in range(1, 501)])
        db.execute("insert into settled values (9000, 'odd', 'no number', 'text', 'text', x'00')")
        db.execute("create table empty (a int, b text)")
    return path


def test_sqlite_tables_in_ranges(spark, ledger):
    x = sqlite.sqlite_table(spark, ledger, "settled", partitions=5)
    assert x.schema.simpleString() == "struct<id:bigint,the side:string,pnl:double,won:bigint,raw:binary,note:string>"
    assert x.rdd.getNumPartitions() == 5
    rows = {r.id: r for r in x.collect()}
    assert len(rows) == 501 and rows[3].pnl == 0.5 and rows[21].pnl is None and rows[30].note == "10" and bytes(rows[3].raw) == b"\x00\x01"
    assert tuple(rows[9000]) == (9000, "odd", None, None, None, None)
    assert sqlite.sqlite_table(spark, ledger, "empty").collect() == []
    with pytest.raises(Exception, match="no table"):
        sqlite.sqlite_table(spark, ledger, "missing").collect()


def test_sqlite_evaluates_comparisons(spark, ledger):
    x = sqlite.sqlite_table(spark, ledger, "settled", partitions=2)
    for where, want in (("pnl > 200 and won = 1", lambda i: i % 7 and i / 2 > 200 and i % 3 == 1), ("`the side` = 'up' and id in (3, 6, 9)", lambda i: i in (1, 3)), ("pnl is null", lambda i: i % 7 == 0), ("id <= 30 and pnl is not null", lambda i: i <= 10 and i % 7)):
        got = sorted(r.id for r in x.where(where).collect() if r.id != 9000)
        assert got == [3 * i for i in range(1, 501) if want(i)]
    reader = sqlite._Reader({"path": ledger, "table": "settled"}, x.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(reader.pushFilters([GreaterThan(("pnl",), 240), EqualTo(("the side",), "up"), EqualTo(("won",), "1")]))) == 3
    assert len(reader.tests) == 2 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 12


def test_feature_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(d, float(rng.normal()), None if i % 11 == 0 else float(rng.normal()), ["high_vol/x", "trending", "high_vol trending", None, "calm"][i % 5], int(rng.random() < 0.5)) for d in range(3) for i in range(60)]
    df = spark.createDataFrame([*rows, (9, 1.0, 1.0, None, 1)], "day int, mid double, z double, regime string, y int")
    design = Design({"mid": Group({"logit_mid": F.col("mid")}), "dist": Group({"z": F.col("z"), "zz": F.col("z") * F.col("z")}), "regime": one_hot("regime", {"high": "high_vol", "trend": "trending"})})
    assert design.names(["mid", "regime"]) == ["intercept", "logit_mid", "high", "trend"]
    got = design.rows(df, ["dist", "regime"], ["day", "regime"])
    assert got.count() == sum(r[2] is not None for r in rows) + 1
    assert {(r.regime, r.high, r.trend) for r in got.collect()} == {("high_vol/x", 1, 0), ("trending", 0, 1), ("high_vol trending", 1, 0), (None, 0, 0), ("calm", 0, 0)}
    fits = design.fits(df, {"base": ["mid"], "all": ["mid", "dist", "regime"], "none": []}, "y", "day").collect()
    assert {r.period for r in fits} == {0, 1, 2} and len(fits) == 3 * (2 + 6 + 1)
    part = [r for r in rows if r[0] == 1]
    want = irls(np.column_stack([np.ones(len(part)), standardize(np.array([[r[1]] for r in part]))]), np.array([r[4] for r in part], float))
    assert [r.beta for t in ("intercept", "logit_mid") for r in fits if (r.combination, r.period, r.term) == ("base", 1, t)] == pytest.approx(want.tolist())
    with pytest.raises(ValueError, match="names"):
        design.rows(df, ["dist"], ["z"])


def test_planted_signals_are_found(spark):
    """The panel's signal has a mean coefficient of its size over periods, and what has no part in outcomes has none."""
    panel = simulated_panel(spark, 30, 200)
    design = Design({"mid": Group({"odds": F.log(F.col("mid") / (1 - F.col("mid")))}), "signal": Group({"signal": F.col("signal")}), "noise": Group({"noise": F.col("noise")})})
    t = {r.term: r for r in fama_macbeth(design.fits(panel, {"all": ["mid", "signal", "noise"]}, "y", "period")).collect()}
    assert t["signal"].t > 10 and t["odds"].t > 3 and abs(t["noise"].t) < 3
    assert t["signal"].mean == pytest.approx(1.2 / 3**0.5, abs=0.1)  # per standard deviation of the signal


def test_small_files_through_hadoop(spark, tmp_path):
    base = f"file://{tmp_path}"
    for n in ("run-2", "run-10", "run-1", "other"):
        (tmp_path / n).mkdir()
    assert find_runs(base, "run-", 2, spark) == [f"{base}/run-10", f"{base}/run-2"] and find_runs(str(tmp_path), "run-", 2) == [f"{tmp_path}/run-10", f"{tmp_path}/run-2"]
    assert find_runs(f"{base}/missing", "run-", spark=spark) == []
    for doc in ({"a": 1}, {"a": "é"}):
        write_snapshot(doc, f"{base}/s.json", spark)
        assert json.loads(storage.read_text(spark, f"{base}/s.json")) == doc
    assert write_flag(f"{base}/flag", True, "due", spark) and (tmp_path / "flag").read_text() == "due"
    assert not write_flag(f"{base}/flag", False, spark=spark) and not write_flag(f"{base}/flag", False, spark=spark)
