"""One SQL text for two engines: fixture views over the parquet tables, and the few spots where dialects differ.

A text may use the views ticks, rounds, quotes, decisions, settlements and calib, all parquet tables, and the macros
LAST_SEEN(x), MICROS(ts), JSON_INT(col, key) and R(x) (round to nine decimals). It is one select, or `with ... select`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.registry import query

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "ticks": "select event_id as seq, event_type as asset, MICROS(ts) / 1e6 as ts_s, MICROS(ts) as ts_us, value as price, JSON_INT(props, 'k') as k, user_id from events",
    "rounds": "select asset, ts_us, price, seq as round_id from ticks where k % 10 = 0",
    "quotes": """select seq, ts_us, ts_s, asset, case when user_id % 2 = 0 then 'polymarket' else 'kalshi' end as venue,
  concat(asset, '|', cast(ts_us - ts_us % 86400000000 as string)) as market, ts_us - ts_us % 86400000000 as window_start_us, price as underlying,
  case when seq % 41 = 0 then null else greatest(0.001e0, (k + 0.5e0) / 100e0 - (seq % 7 + 1) / 200e0) end as up_bid,
  case when seq % 43 = 0 then null else least(0.999e0, (k + 0.5e0) / 100e0 + (seq % 7 + 1) / 200e0) end as up_ask,
  price as up_bid_size, (user_id % 10 + 1) * 10e0 as up_ask_size from ticks""",
    "decisions": """select l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber as id, MICROS(l_shipdate) as ts_us, l_orderkey as market,
  concat('A', cast(l_suppkey % 7 as string)) as asset, case when l_returnflag = 'R' then 'kalshi' else 'polymarket' end as venue,
  case l_linenumber % 5 when 0 then '5m' when 1 then '15m' when 2 then '1h' when 3 then '4h' else '1D' end as tf,
  case when l_linestatus = 'F' then 'directional' else 'threshold' end as kind, (l_quantity - 25.5e0) / 10e0 as z_dist, l_extendedprice as spot,
    (l_partkey % 89 + 5.5e0) / 100e0 as book_mid_up,
  least(0.99e0, greatest(0.01e0, (l_partkey % 89 + 5.5e0) / 100e0 + (l_discount - 0.05e0))) as p_cal, l_tax * 5e0 as confidence, (l_suppkey % 10) / 10e0 as move_prob,
  case when l_discount > 0.05e0 then 'up' else 'down' end as side, abs(l_discount - 0.05e0) - 0.005e0 as ev,
  concat(case l_returnflag when 'A' then 'low_vol' when 'N' then 'mid_vol' else 'high_vol' end, '/', case l_linestatus when 'F' then 'trend' else 'chop' end) as regime,
  case when abs(l_discount - 0.05e0) - 0.005e0 > 0.01e0 and l_tax > 0.01e0 and l_suppkey % 10 > 3 then 'TRADE' else 'SKIP' end as decision
  from lineitem""",
    "settlements": """select o_orderkey as id, MICROS(o_orderdate) as ts_us, o_orderkey as market, concat('A', cast(o_custkey % 7 as string)) as asset,
  case when o_custkey % 3 = 0 then 'kalshi' else 'polymarket' end as venue,
  case substr(o_orderpriority, 1, 1) when '1' then '5m' when '2' then '15m' when '3' then '1h' when '4' then '4h' else '1D' end as tf,
  case when o_custkey % 2 = 0 then 'up' else 'down' end as side, case when o_orderstatus = 'P' then 0 else 1 end as filled,
  case when o_orderstatus = 'P' then null else 0.30e0 + (o_custkey % 36) / 100e0 end as fill_price,
  case when o_orderstatus = 'P' then null when (o_orderkey * 7919) % 100 < 30 + o_custkey % 36 then 1 else 0 end as won,
  case when o_orderstatus = 'P' then null else ((case when (o_orderkey * 7919) % 100 < 30 + o_custkey % 36 then 1 else 0 end) - (0.30e0 + (o_custkey % 36) / 100e0)) * (20e0 / (0.30e0 + (o_custkey % 36) / 100e0)) end as pnl,
  cast((o_orderkey * 7919 + o_custkey) % 2 as int) as outcome_up, o_totalprice as strike from orders""",
    "calib": """select id, ts_us, market, asset, tf, book_mid_up as market_mid, p_cal, case when id % 50 = 1 then null else 1e0 / (1e0 + exp(-z_dist)) end as alpha_up,
  case when (market * 7919 + id % 100000 * 31) % 100 < 100e0 * book_mid_up + 40e0 * (p_cal - book_mid_up) then 1 else 0 end as outcome_up
  from decisions""",
}


def _balanced(text: str, name: str, put) -> str:
    """Replace name(args) with put(args), nested calls included."""
    while m := re.search(rf"\b{name}\(", text):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[: m.start()] + put(text[m.end() : i - 1]) + text[i:]
    return text


def render(sql: str, engine: str, sf_dir: str = "") -> str:
    """The statement for `spark` (over parquet files in sf_dir) or `duckdb` (over registered tables)."""
    sql = sql.strip()
    need, todo = [], [sql]
    while todo:
        t = todo.pop()
        for v in VIEWS:
            if re.search(rf"\b{v}\b", t) and v not in need:
                need.append(v)
                todo.append(VIEWS[v])
    parts = [f"{v} as ({VIEWS[v]})" for v in VIEWS if v in need]
    if engine == "spark":
        text = " ".join([*parts, sql])
        parts = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if re.search(rf"\b{t}\b", text)] + parts
    if m := re.match(r"with\s+(recursive\s+)?", sql, re.I):
        head, sql = m[0].strip() + " ", ", ".join([*parts, sql[m.end() :].strip()])
    else:
        head = "with " + ", ".join(parts) + " " if parts else ""
    out = head + sql
    out = _balanced(out, "R", lambda a: f"round({a}, 9)")
    if engine == "spark":
        out = _balanced(out, "LAST_SEEN", lambda a: f"last_value({a}) ignore nulls")
        out = _balanced(out, "MICROS", lambda a: f"unix_micros(cast({a} as timestamp))")
        return _balanced(out, "JSON_INT", lambda a: "cast(get_json_object({}, '$.{}') as bigint)".format(*(x.strip().strip("'") for x in a.split(","))))
    out = _balanced(out, "LAST_SEEN", lambda a: f"last_value({a} ignore nulls)")
    out = _balanced(out, "MICROS", lambda a: f"epoch_us({a})")
    return _balanced(out, "JSON_INT", lambda a: "cast(json_extract_string({}, '$.{}') as bigint)".format(*(x.strip().strip("'") for x in a.split(","))))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    return spark.sql(render(f"select * from {name}", "spark", sf_dir))


def rounded(df: DataFrame, digits: int | dict[str, int] = 9) -> DataFrame:
    """df with its doubles rounded, all alike or each its own way, as R() does in the SQL."""
    places = digits if isinstance(digits, dict) else {f.name: digits for f in df.schema if f.dataType.typeName() == "double"}
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def sql_query(name: str, sql: str) -> None:
    """Register a query whose plan is one SQL text in both engines."""
    query(name, render(sql, "duckdb"))(lambda spark, sf_dir: spark.sql(render(sql, "spark", sf_dir)))


def oracle(sql: str) -> str:
    return render(sql, "duckdb")
