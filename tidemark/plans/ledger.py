"""Reads of the ledger: scans, totals, groups, curves and top-k over decisions and settlements."""

from pyspark.sql import functions as F

from tidemark.functions import expressions as x
from tidemark.operators import ledger as book
from tidemark.operators import breach, drawdown, running_sum, running_totals, scan
from tidemark.operators.selection import ranks
from tidemark.plans.dialect import oracle, render, rounded, sql_query, view
from tidemark.registry import query

#: Running totals over a whole table go day by day (or by stretches of ids), so that no task reads the table.
DAY, STRETCH = "floor(ts_us / 86400000000e0)", "floor(id / 1000000e0)"

FEE = x.venue_fee("venue", "fill_price")


def _filled(spark, sf):
    """Settlements that were filled."""
    return view(spark, sf, "settlements").where("filled = 1")


sql_query("recent_rows", "select id, ts_us, market, asset, tf, side, filled, R(pnl) as pnl from settlements order by id desc limit 50")
sql_query("recent_filled", "select id, ts_us, market, asset, side, R(fill_price) as fill_price, won, R(pnl) as pnl from settlements where filled = 1 order by id desc limit 50")
query("settlement_totals", oracle("""
select round(coalesce(sum(case when filled = 1 then pnl end), 0e0), 4) as pnl, cast(coalesce(sum(filled), 0) as bigint) as filled,
    cast(coalesce(sum(won), 0) as bigint) as won,
  count(*) as settled, round(coalesce(avg(case when filled = 1 then won end), 0e0), 9) as winrate from settlements"""))(
    lambda spark, sf: rounded(book.totals(view(spark, sf, "settlements")), {"pnl": 4, "winrate": 9})
)
query("pnl_today", oracle("""
with d as (select max(ts_us) - max(ts_us) % 86400000000 as midnight from settlements)
select midnight, round(coalesce(sum(pnl), 0e0), 4) as pnl, count(pnl) as trades
  from d left join settlements on filled = 1 and ts_us >= midnight
  group by midnight"""))(
    lambda spark, sf: rounded(book.last_day(view(spark, sf, "settlements"), "ts_us", "pnl"), {"pnl": 4})
)
query("throughput_decisions", oracle("select tf, asset, count(*) as evaluated, cast(sum(case when decision = 'TRADE' then 1 else 0 end) as bigint) as trades from decisions group by tf, asset"))(
    lambda spark, sf: view(spark, sf, "decisions").groupBy("tf", "asset").agg(F.count("*").alias("evaluated"), F.count_if(F.col("decision") == "TRADE").alias("trades"))
)
query("throughput_settlements", oracle("select tf, asset, count(*) as filled, R(avg(won)) as winrate, round(sum(pnl), 4) as pnl from settlements where filled = 1 group by tf, asset"))(
    lambda spark, sf: rounded(book.trades(_filled(spark, sf), ["tf", "asset"], pnl="pnl").withColumnRenamed("n", "filled").drop("wins"), {"winrate": 9, "pnl": 4})
)
query("throughput", oracle("""
with d as (select tf, count(*) as evaluated, cast(sum(case when decision = 'TRADE' then 1 else 0 end) as bigint) as trades
  from decisions
  group by tf),
s as (select tf, count(*) as filled, avg(won) as winrate, sum(pnl) as pnl from settlements where filled = 1 and tf <> '4h' group by tf)
select coalesce(d.tf, s.tf) as tf, coalesce(evaluated, 0) as evaluated, coalesce(trades, 0) as trades, coalesce(filled, 0) as filled, R(winrate) as winrate,
    round(coalesce(pnl, 0e0), 4) as pnl
from d full outer join s on d.tf = s.tf"""))(
    lambda spark, sf: rounded(book.throughput(view(spark, sf, "decisions"), _filled(spark, sf).where("tf <> '4h'"), ["tf"]), {"winrate": 9, "pnl": 4})
)
query("winrate_by_asset_tf", oracle("select asset, tf, count(*) as n, R(avg(won)) as winrate from settlements where filled = 1 group by asset, tf"))(
    lambda spark, sf: rounded(book.trades(_filled(spark, sf), ["asset", "tf"]).select("asset", "tf", "n", "winrate"))
)
sql_query("ev_by_regime", "select regime, count(*) as n, R(avg(ev)) as ev from decisions group by regime")
sql_query("markets_having_20", "select market, count(*) as n from quotes group by market having count(*) >= 20")
sql_query("ll_span", "select count(*) as n, min(ts_us) as first_us, max(ts_us) as last_us, R((max(ts_us) - min(ts_us)) / 1e6) as elapsed_s from ticks")
sql_query("distinct_assets", "select distinct asset from ticks where price > 0")
query("daily_up_rate", oracle("""
select cast(floor(ts_us / 86400000000e0) as bigint) as day, count(*) as n, R(avg(outcome_up)) as up_rate
  from settlements
  group by cast(floor(ts_us / 86400000000e0) as bigint) having count(*) >= 5"""))(
    lambda spark, sf: rounded(book.daily_rate(view(spark, sf, "settlements"), "ts_us", "outcome_up", 5))
)
query("equal_weight_days", oracle("""
with d as (select cast(floor(ts_us / 86400000000e0) as bigint) as day, count(*) as n, avg(outcome_up) as r
  from settlements
  group by cast(floor(ts_us / 86400000000e0) as bigint))
select count(*) as days, R(avg(r)) as mean_rate, max(day) as last_day, R(max_by(r, day)) as last_rate from d"""))(
    lambda spark, sf: rounded(book.equal_days(book.daily_rate(view(spark, sf, "settlements"), "ts_us", "outcome_up")))
)
query("asset_drift", oracle("""
select asset, count(*) as n, R(min_by(price, ts_us)) as first_price, R(max_by(price, ts_us)) as last_price,
    R(100e0 * case when min_by(price, ts_us) > 0e0 then max_by(price, ts_us) / min_by(price, ts_us) - 1e0 end) as drift_pct
  from ticks
  group by asset"""))(
    lambda spark, sf: rounded(book.drift(view(spark, sf, "ticks"), ["asset"], "ts_us", "price").withColumn("drift_pct", F.col("drift") * 100).drop("drift"))
)
query("down_regime", oracle("""
with d as (select asset, case when min_by(price, ts_us) > 0e0 then max_by(price, ts_us) / min_by(price, ts_us) - 1e0 end as drift
  from ticks
  group by asset)
select count(*) as assets, R(avg(case when drift < 0e0 then 1e0 else 0e0 end)) as falling, avg(case when drift < 0e0 then 1e0 else 0e0 end) >= 0.6e0 as down
  from d"""))(
    lambda spark, sf: rounded(book.falling(book.drift(view(spark, sf, "ticks"), ["asset"], "ts_us", "price")))
)
sql_query("switch_check", f"""
with d as (select asset, case when min_by(price, ts_us) > 0e0 then max_by(price, ts_us) / min_by(price, ts_us) - 1e0 end as drift
  from ticks
  group by asset),
r as (select cast(floor(ts_us / 86400000000e0) as bigint) as day, avg(outcome_up) as r, count(*) as n
  from settlements
  group by cast(floor(ts_us / 86400000000e0) as bigint)),
u as (select avg(r) as up_rate, max_by(r, day) as last_rate, count(*) as days from r where n >= 5),
f as (select avg(case when drift < 0e0 then 1e0 else 0e0 end) as falling from d),
b as (select avg((p_cal - outcome_up) * (p_cal - outcome_up)) as model, avg((market_mid - outcome_up) * (market_mid - outcome_up)) as market
  from calib)
select R(up_rate) as up_rate, R(last_rate) as last_rate, days, R(falling) as falling, R(model) as model_brier, R(market) as market_brier,
  case when days is null or days < 3 then 'WAIT' when falling >= 0.6e0 and last_rate < up_rate then 'SWITCH' when model < market then 'KEEP' else 'HOLD' end as verdict
  from u, f, b""")

# running ledgers
query("equity_curve", oracle("select id, round(1000e0 + sum(coalesce(pnl, 0e0)) over (order by ts_us, id rows between unbounded preceding and current row), 4) as equity from settlements where filled = 1"))(
    lambda spark, sf: running_sum(view(spark, sf, "settlements").where("filled = 1").select("id", "ts_us", "pnl"), ["ts_us", "id"], "pnl", DAY, "run").select("id", F.round(F.lit(1000.0) + F.col("run"), 4).alias("equity"))
)
query("equity_curve_calc", oracle("""
select id, asset, round(sum(coalesce(pnl, 0e0)) over w, 4) as cum_pnl, count(*) over w as settled_seq, R(avg(won) over w) as winrate,
    R(avg(cast(filled as double)) over w) as fill_rate
  from settlements
window w as (partition by asset order by ts_us, id rows between unbounded preceding and current row)"""))(
    lambda spark, sf: running_totals(view(spark, sf, "settlements"), ["asset"], ["ts_us", "id"], {"pnls": F.col("pnl"), "settled_seq": F.lit(1), "wins": F.col("won"), "known": F.when(F.col("won").isNotNull(), 1), "fills": F.col("filled")}, DAY)
    .selectExpr("id", "asset", "round(pnls, 4) as cum_pnl", "settled_seq", "round(case when known > 0 then wins / known end, 9) as winrate", "round(fills / settled_seq, 9) as fill_rate")
)
TP = """with t as (select *, case when won = 1 or (id * 31) % 4 = 0 then 1 else 0 end as tp_exited,
  case when filled = 1 and (won = 1 or (id * 31) % 4 = 0) then (0.9e0 - fill_price) * (20e0 / fill_price) when filled = 1 then pnl end as tp_pnl
  from settlements)"""
query("tp_curve", oracle(TP + """ select id, asset, round(100e0 + sum(tp_pnl) over (partition by asset order by ts_us, id rows between unbounded preceding and current row), 4) as tp_cum_pnl
  from t
  where tp_pnl is not null"""))(
    lambda spark, sf: scan(spark.sql(render(TP + " select id, asset, ts_us, tp_pnl from t where tp_pnl is not null", "spark", sf)), ["asset"], ["ts_us", "id"], drawdown("tp_pnl"), DAY)
    .selectExpr("id", "asset", "round(100e0 + cum, 4) as tp_cum_pnl")
)
query("equity_drawdown", oracle("""
with c as (select asset, ts_us, id, sum(coalesce(pnl, 0e0)) over (partition by asset order by ts_us, id rows between unbounded preceding and current row) as cum
  from settlements),
p as (select *, greatest(0e0, max(cum) over (partition by asset order by ts_us, id rows between unbounded preceding and current row)) as peak from c)
select id, asset, round(cum, 4) as cum, round(peak, 4) as peak, round(peak - cum, 4) as drawdown,
    round(max(peak - cum) over (partition by asset order by ts_us, id rows between unbounded preceding and current row), 4) as worst
  from p"""))(
    lambda spark, sf: rounded(scan(view(spark, sf, "settlements").select("id", "asset", "ts_us", "pnl"), ["asset"], ["ts_us", "id"], drawdown("pnl"), DAY).select("id", "asset", "cum", "peak", "drawdown", "worst"), 4)
)
TP_TOTALS = "select cast(sum(tp_exited) as bigint) as exits, count(tp_pnl) as settled, cast(sum(case when tp_pnl > 0e0 then 1 else 0 end) as bigint) as wins, round(max_by(cum, id), 3) as last_cum from {c}"
query("tp_totals", oracle(TP + ", c as (select *, sum(tp_pnl) over (order by ts_us, id rows between unbounded preceding and current row) as cum from t where tp_pnl is not null) " + TP_TOTALS.format(c="c")))(
    lambda spark, sf: spark.sql(TP_TOTALS, c=running_sum(spark.sql(render(TP + " select id, ts_us, tp_exited, tp_pnl from t where tp_pnl is not null", "spark", sf)), ["ts_us", "id"], "tp_pnl", DAY, "cum"))
)
sql_query("tp_ledger", TP + """ select asset, tp_exited, count(*) as n, round(sum(tp_pnl), 4) as tp_pnl, round(sum(pnl), 4) as hold_pnl, round(sum(tp_pnl - pnl), 4) as gain
  from t
  where filled = 1
  group by asset, tp_exited""")
query("maxloss_trip", oracle("""
with r as (select *, ts_us - ts_us % 86400000000 as day, sum(coalesce(pnl,
    0e0)) over (partition by ts_us - ts_us % 86400000000 order by id rows between unbounded preceding and current row) as run
  from settlements),
b as (select *, row_number() over (partition by day order by id) as k from r where run <= -40e0)
select day, id, round(run, 4) as day_pnl, 40e0 as loss_limit from b where k = 1"""))(
    lambda spark, sf: scan(view(spark, sf, "settlements").selectExpr("id", "ts_us - ts_us % 86400000000 as day", "pnl"), ["day"], ["id"], breach("pnl", 40.0), STRETCH)
    .where("first").selectExpr("day", "id", "round(run, 4) as day_pnl", "40e0 as loss_limit")
)
query("error_streak", oracle("""
with e as (select id, filled, sum(filled) over (order by id rows between unbounded preceding and current row) as isle from settlements),
s as (select isle, count(*) as streak, min(id) as first_id, max(id) as last_id from e where filled = 0 group by isle)
select first_id, last_id, streak, streak >= 2 as estop from s"""))(
    lambda spark, sf: running_sum(view(spark, sf, "settlements").select("id", "filled"), ["id"], "filled", STRETCH, "isle").where("filled = 0")
    .groupBy("isle").agg(F.count("*").alias("streak"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).selectExpr("first_id", "last_id", "streak", "streak >= 2 as estop")
)
sql_query("settle_pnl", f"""
with p as (select s.*, 1e0 + id % 7 as agg, 2e0 + id % 5 as pas, case when id % 3 = 0 then 0 else 1 end as pass_filled, least(0.95e0, fill_price + 0.03e0) as agg_price
  from settlements s
  where filled = 1)
select id, won, R(((won - agg_price - {x.venue_fee('venue', 'agg_price')}) * agg) + case when pass_filled = 1 then (won - fill_price) * pas else 0e0 end) as pnl,
  R((agg * agg_price + pass_filled * pas * fill_price) / (agg + pass_filled * pas)) as entry,
  R((0.9e0 - agg_price - {x.venue_fee('venue', 'agg_price')}) * agg + case when pass_filled = 1 then (0.9e0 - fill_price) * pas else 0e0 end) as tp_pnl
  from p""")
sql_query("calib_emit", "select id, market, asset, tf, R(market_mid) as market_mid, R(p_cal) as p_cal, R(alpha_up) as alpha_up, outcome_up, ts_us + 5000000 as due_us from calib")

# attribution
NET = f"won - fill_price - {x.venue_fee('venue', 'fill_price')}"
query("pnl_attribution", oracle(f"""
select count(*) as n, round(sum((won - fill_price) * 20e0 / fill_price), 4) as gross,
    round(sum({x.venue_fee('venue', 'fill_price')} * 20e0 / fill_price), 4) as fees, round(sum(({NET}) * 20e0 / fill_price), 4) as net, R(avg(won)) as winrate
from settlements where filled = 1"""))(
    lambda spark, sf: rounded(book.attribution(_filled(spark, sf), "won", "fill_price", F.expr(FEE)), {"gross": 4, "fees": 4, "net": 4, "winrate": 9})
)
query("settled_by_asset", oracle(f"select asset, count(*) as n, R(avg(won)) as winrate, R(avg(fill_price)) as entry, R(avg({NET})) as net_per_contract, round(sum(pnl), 4) as pnl from settlements where filled = 1 group by asset"))(
    lambda spark, sf: rounded(book.trades(_filled(spark, sf), ["asset"], pnl="pnl", entry=F.col("fill_price"), net_per_contract=book.net("won", "fill_price", F.expr(FEE))).drop("wins"), {"winrate": 9, "entry": 9, "net_per_contract": 9, "pnl": 4})
)
sql_query("net_per_contract", f"select id, R({NET}) as net, R(case when fill_price is null then null else fill_price + 0.02e0 - fill_price - {x.venue_fee('venue', 'fill_price')} end) as stated_edge from settlements")
query("group_stat", oracle(f"select coalesce(side, 'None') as label, count(*) as n, cast(sum(won) as bigint) as wins, R(avg(fill_price)) as price, R(avg({NET})) as net from settlements where filled = 1 group by coalesce(side, 'None')"))(
    lambda spark, sf: rounded(book.trades(_filled(spark, sf).withColumn("label", F.coalesce("side", F.lit("None"))), ["label"], price=F.col("fill_price"), net=book.net("won", "fill_price", F.expr(FEE))).drop("winrate"))
)
sql_query("selectivity_rules", f"""
with t as (select asset, won, ((id * 13) % 100 - 50) / 500e0 as edge, {NET} as net, 20e0 / fill_price as contracts from settlements where filled = 1),
r as (select t.*, k.rule as rule
  from t cross join (values ('all'), ('edge>=1%'), ('edge>=2%'), ('edge>=4%'), ('A0+A1'), ('A0+A1 & edge>=2%'), ('not A6')) as k(rule))
select rule, count(*) as n, R(avg(won)) as winrate, R(avg(net)) as net, round(sum(net * contracts), 4) as pnl
  from r
  where case rule when 'all' then true when 'edge>=1%' then edge >= 0.01e0 when 'edge>=2%' then edge >= 0.02e0
  when 'edge>=4%' then edge >= 0.04e0 when 'A0+A1' then asset in ('A0', 'A1') when 'A0+A1 & edge>=2%' then asset in ('A0', 'A1') and edge >= 0.02e0 else asset <> 'A6' end
  group by rule""")
sql_query("best_per_window", """
with r as (select *, row_number() over (partition by asset, ts_us - ts_us % 604800000000 order by ts_us, id) as k from decisions)
select asset, ts_us - ts_us % 604800000000 as window_us, id, R(p_cal) as p_cal, decision from r where k = 1""")
sql_query("label_agreement", """
with a as (select asset, case when outcome_up = 1 then 'up' else 'down' end as venue,
    case when (id * 17) % 20 = 0 then 'down' when outcome_up = 1 then 'up' else 'down' end as candle, id
  from settlements)
select asset, count(*) as n, R(avg(case when venue = candle then 1e0 else 0e0 end)) as agreement, min(case when venue <> candle then id end) as first_mismatch
  from a
  group by asset""")
sql_query("bucket_edge", """
select regime, tf, count(*) as n, R(avg(case when (p_cal >= 0.5e0) = (id % 2 = 0) then 1e0 else 0e0 end)) as winrate
  from decisions
  group by regime, tf having count(*) >= 3 order by n desc, regime, tf limit 14""")
query("regime_shares", oracle("select regime, count(*) as n, R(count(*) / (sum(count(*)) over () + 0e0)) as share from decisions group by regime"))(
    lambda spark, sf: rounded(book.shares(view(spark, sf, "decisions"), "regime"))
)
sql_query("filled_trade_join", """
with j as (select s.market, s.id as sid, d.id as did, s.pnl, s.won, d.p_cal, d.ev, row_number() over (partition by s.market order by d.ts_us, d.id) as k
  from settlements s join decisions d on s.market = d.market
  where s.filled = 1 and d.decision = 'TRADE')
select market, sid, did, won, R(pnl) as pnl, R(p_cal) as p_cal, R(ev) as ev from j where k = 1""")
sql_query("anchor_replay", f"""
with j as (select s.market, s.pnl, s.won, d.p_cal, d.side, 1e0 / (1e0 + exp(-d.z_dist)) as alpha, row_number() over (partition by s.market order by d.ts_us, d.id) as k
  from settlements s join decisions d on s.market = d.market
  where s.filled = 1 and d.decision = 'TRADE'),
a as (select *, {x.anchor('p_cal', 'alpha')} as anchored from j where k = 1),
g as (select *, case when side = 'up' then anchored >= 0.5e0 else anchored < 0.5e0 end as keep from a)
select count(*) as actual, round(sum(pnl), 4) as pnl, R(avg(won)) as winrate, cast(sum(case when keep then 1 else 0 end) as bigint) as kept,
    round(sum(case when keep then pnl end), 4) as kept_pnl, R(avg(case when keep then won end)) as kept_winrate
  from g""")
sql_query("calib_left_decisions", """
with d as (select market, min(id) as id, count(*) as n from decisions group by market)
select c.id, c.market, R(c.p_cal) as p_cal, d.id as decision_id, d.n from calib c left join d on c.market = d.market and c.market % 3 <> 0""")
sql_query("settled_with_paths", "select distinct s.market, s.asset, R(s.strike) as strike, s.outcome_up from settlements s where s.strike is not null and s.outcome_up is not null and exists (select 1 from lineitem p where p.l_orderkey = s.market)")
sql_query("settled_by_nation", "select n_name, r_name, count(*) as n, round(sum(pnl), 4) as pnl from settlements join orders on id = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where filled = 1 group by n_name, r_name")

# risk and lanes
LANES = """with lanes as (select asset as lane, round(sum(pnl), 6) as day_pnl, 1000e0 + sum(pnl) as equity, (max(id) * 37) % 1200 as age_s
  from settlements
  where filled = 1
  group by asset),
open_positions as (select s.asset as lane, d.asset, count(*) * 1.5e0 as cost
  from settlements s join decisions d on s.market = d.market
  where s.id % 50 = 0
  group by s.asset, d.asset)"""
sql_query("lanes_snapshot", LANES + """ select count(*) as lanes, cast(sum(case when age_s <= 600 then 1 else 0 end) as bigint) as fresh, round(sum(case when age_s <= 600 then day_pnl end), 4) as day_pnl,
    round(sum(case when age_s <= 600 then equity end), 4) as equity,
  round((select sum(o.cost) from open_positions o join lanes l on o.lane = l.lane where l.age_s <= 600), 4) as open_cost from lanes""")
sql_query("exposure_check", LANES + """, e as (select sum(equity) as equity from lanes),
a as (select asset, sum(cost) as cost from open_positions group by asset),
t as (select sum(cost) as total from a)
select asset, R(cost) as cost, R(total) as total, total > 0.10e0 * equity as total_breach, cost > 0.05e0 * equity as asset_breach from a, t, e""")
sql_query("health_rollup", """
select cast(floor(ts_us / 86400000000e0) as bigint) as day, count(*) as cycles, R(avg(price)) as cycle_ms, R(max(price)) as worst_ms,
    count(distinct user_id) as callers, cast(sum(case when k >= 95 then 1 else 0 end) as bigint) as errors, max(ts_us) as last_us
  from ticks
  group by cast(floor(ts_us / 86400000000e0) as bigint)""")
query("feed_staleness", oracle("select asset, max(ts_us) as updated_us, R(((select max(ts_us) from ticks) - max(ts_us)) / 1e6) as stale_s from rounds group by asset"))(
    lambda spark, sf: rounded(book.staleness(view(spark, sf, "rounds"), "asset", "ts_us", view(spark, sf, "ticks"))).selectExpr("asset", "last_us as updated_us", "age_s as stale_s")
)
query("source_activity", oracle("select asset as source, count(*) as events, max(ts_us) as last_us, R(((select max(ts_us) from ticks) - max(ts_us)) / 1e6) as age_s from ticks group by asset"))(
    lambda spark, sf: rounded(book.staleness(view(spark, sf, "ticks"), "asset", "ts_us")).withColumnRenamed("asset", "source")
)
query("latency_percentiles", oracle("""
with r as (select asset, price, row_number() over (partition by asset order by price, seq) as i, count(*) over (partition by asset) as n from ticks)
select asset, max(n) as n, R(max(case when i = cast(floor(n / 2e0) as bigint) + 1 then price end)) as p50,
    R(max(case when i = cast(floor(0.95e0 * (n - 1)) as bigint) + 1 then price end)) as p95
  from r
  group by asset"""))(
    lambda spark, sf: rounded(ranks(view(spark, sf, "ticks").select("asset", "price"), ["asset"], "price", {"p50": F.floor(F.col("n") / 2), "p95": F.floor(0.95 * (F.col("n") - 1))}))
)
sql_query("api_budget", """
with c as (select asset as host, price as ms, k >= 90 as failed, seq, row_number() over (partition by asset order by seq desc) as back from ticks),
l as (select host, ms, row_number() over (partition by host order by ms, seq) as i, count(*) over (partition by host) as n from c where back <= 50),
p as (select host, max(case when i = cast(floor(0.95e0 * (n - 1)) as bigint) + 1 then ms end) as p95 from l group by host)
select c.host, count(*) as calls, cast(sum(case when failed then 1 else 0 end) as bigint) as errors, R(avg(case when failed then 1e0 else 0e0 end)) as err_rate,
    R(avg(ms)) as mean_ms, R(max(p95)) as p95_ms
  from c join p on c.host = p.host
  group by c.host""")
sql_query("open_pnl", "select seq, market, R((coalesce(up_bid, 0e0) - 0.5e0) * up_bid_size) as open_pnl, R(max(coalesce(up_bid, 0e0)) over (partition by market order by ts_us, seq rows between unbounded preceding and current row) - coalesce(up_bid, 0e0)) as drawdown from quotes")
sql_query("open_positions", "select id, market, asset, R(20e0) as cost, R(((select max(ts_us) from settlements) - ts_us) / 6e7) as mins_open from settlements where filled = 1 and id % 20 = 0")
sql_query("tf_order", "select tf, count(*) as n, coalesce(max(case tf when '5m' then 300 when '15m' then 900 when '1h' then 3600 when '4h' then 14400 when '1D' then 86400 end), 1000000000000) as seconds from decisions group by tf order by seconds")
sql_query("cond_skill_summary", """
with l as (select tf, {band} as cell, case when p_cal > market_mid then 1 else 0 end as up_leg, outcome_up from calib),
g as (select tf, cell, avg(case when up_leg = 1 then outcome_up end) - avg(case when up_leg = 0 then outcome_up end) as gap, count(*) as n
  from l
  group by tf, cell)
select tf, cell, n, R(gap) as gap from g order by abs(gap) desc, tf, cell""".replace("{band}", x.band("market_mid")))

# sets
@query("venue_union", oracle("select venue, count(*) as n from (select venue, asset from quotes where venue = 'polymarket' union all select venue, asset from quotes where venue = 'kalshi') u where asset in (select asset from quotes group by asset having count(*) > 10) group by venue"))
def _venues(spark, sf):
    """Rows of both venues, of the assets that are configured: those with more than ten quotes."""
    quotes = view(spark, sf, "quotes").select("venue", "asset")
    configured = quotes.groupBy("asset").agg(F.count("*").alias("n")).where("n > 10").select("asset")
    both = quotes.where("venue = 'polymarket'").unionByName(quotes.where("venue = 'kalshi'"))
    return both.join(configured, "asset", "left_semi").groupBy("venue").agg(F.count("*").alias("n"))


sql_query("token_set_diff", """
with a as (select distinct market from quotes where venue = 'polymarket'), b as (select distinct market from quotes where venue = 'kalshi')
select 'gone' as side, market
  from (select market
  from a except select market
  from b) g union all select 'new' as side, market
  from (select market
  from b except select market
  from a) n""")
sql_query("tf_union", "select tf from (select distinct tf from decisions union select distinct tf from settlements) t order by tf")
sql_query("jump_confusion", """
with truth as (select seq from ticks where k >= 97),
flag as (select seq from ticks where price > (select avg(price) + 2.5e0 * stddev_samp(price) from ticks))
select (select count(*)
  from (select seq
  from truth intersect select seq
  from flag) i) as tp, (select count(*)
  from (select seq
  from flag except select seq
  from truth) f) as fp, (select count(*)
  from (select seq
  from truth except select seq
  from flag) m) as fn""")
sql_query("book_prune", "select q.seq, q.market from quotes q where exists (select 1 from decisions d where d.market = q.seq)")
sql_query("keep_last_n", "select asset, round_id, R(price) as price from (select *, row_number() over (partition by asset order by ts_us desc, round_id desc) as k from rounds) r where k <= 600")
sql_query("schema_evolution_union", "select id, asset, tf, cast(null as bigint) as halted, 'decisions' as origin from decisions where id % 100 = 0 union all select id, asset, tf, cast(filled as bigint) as halted, 'settlements' as origin from settlements where id % 100 = 0")
