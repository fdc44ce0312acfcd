"""Decision path: predicates, gates, sizing and control as expressions over decisions and quotes."""

from pyspark.sql import functions as F

from tidemark.functions import expressions as x
from tidemark.operators import decisions as path
from tidemark.plans.dialect import oracle, rounded, sql_query, view
from tidemark.registry import query

MID = x.mid("up_bid", "up_ask")


def _sides():
    """Columns of UP's bid and ask (made when a query runs, as they need a session)."""
    return F.col("up_bid"), F.col("up_ask")


def _coming(spark, sf):
    """Settlements from ten days after the first one on."""
    s = view(spark, sf, "settlements")
    start = s.agg((F.min("ts_us") + 864_000_000_000).alias("start"))  # one row
    return s.join(start, F.col("ts_us") >= F.col("start")).drop("start")


query("mid_fallback", oracle(f"select seq, R({MID}) as mid from quotes"))(
    lambda spark, sf: rounded(view(spark, sf, "quotes").select("seq", path.mid(*_sides()).alias("mid")))
)
query("spread", oracle("select seq, R(up_ask - up_bid) as spread, R(coalesce(up_ask - up_bid, 0.06e0)) as spread_or_default from quotes"))(
    lambda spark, sf: rounded(view(spark, sf, "quotes").select("seq", F.expr("up_ask - up_bid").alias("spread"), F.expr("coalesce(up_ask - up_bid, 0.06e0)").alias("spread_or_default")))
)
query("orient_up", oracle("select seq, R(case when user_side = 'down' then 1e0 - up_ask else up_bid end) as up_bid, R(case when user_side = 'down' then 1e0 - up_bid else up_ask end) as up_ask from (select *, case when seq % 2 = 0 then 'down' else 'up' end as user_side from quotes) q"))(
    lambda spark, sf: rounded(view(spark, sf, "quotes").select("seq", *[c.alias(n) for c, n in zip(path.oriented(F.when(F.col("seq") % 2 == 0, "down").otherwise("up"), *_sides()), ("up_bid", "up_ask"), strict=True)]))
)
query("ob_imbalance", oracle(f"select seq, R({x.imbalance('up_bid_size', 'up_ask_size')}) as imbalance from quotes"))(
    lambda spark, sf: rounded(view(spark, sf, "quotes").select("seq", path.imbalance(F.col("up_bid_size"), F.col("up_ask_size")).alias("imbalance")))
)
query("liquidity_filter", oracle(f"select seq, venue, R({MID}) as mid from quotes where {MID} is not null and coalesce(up_ask - up_bid, 0e0) <= 0.12e0"))(
    lambda spark, sf: rounded(path.liquid(view(spark, sf, "quotes"), "up_bid", "up_ask").select("seq", "venue", path.mid(*_sides()).alias("mid")))
)
@query("candidate_filter", oracle("""
with c as (select d.*, (id % 200) as mins_left, case tf when '5m' then 5e0 when '15m' then 15e0 when '1h' then 60e0 when '4h' then 240e0 else 1440e0 end as w,
    spot * (1e0 + (id % 21 - 10) / 100e0) as strike
  from decisions d)
select id, market, asset, tf, mins_left
  from c
  where strike is not null and spot is not null and spot > 0e0 and strike > 0e0 and mins_left >= greatest(0.5e0, 0.05e0 * w) and mins_left <= least(0.95e0 * w, 180e0)
  and (kind <> 'threshold' or abs(ln(spot / strike)) <= case when tf = '1h' then 0.08e0 else 0.04e0 end)
  and not exists (select 1 from settlements s where s.market = c.market and s.filled = 0)"""))
def _candidates(spark, sf):
    """Decisions in reach whose market has no settlement without a fill."""
    d = view(spark, sf, "decisions").selectExpr(
        "id", "market", "asset", "tf", "kind", "spot", "id % 200 as mins_left", "case tf when '5m' then 5e0 when '15m' then 15e0 when '1h' then 60e0 when '4h' then 240e0 else 1440e0 end as w", "spot * (1e0 + (id % 21 - 10) / 100e0) as strike"
    )
    lost = view(spark, sf, "settlements").where("filled = 0")
    return path.without(path.in_reach(d, "mins_left", "w", "spot", "strike", "kind", "tf"), lost, ["market"]).select("id", "market", "asset", "tf", "mins_left")


query("undecided", oracle("select d.id, d.market from decisions d where not exists (select 1 from settlements s where s.market = d.market and s.filled = 1)"))(
    lambda spark, sf: path.without(view(spark, sf, "decisions").select("id", "market"), view(spark, sf, "settlements").where("filled = 1"), ["market"])
)
query("trade_gate", oracle("""
with g as (select *, case when p_cal > book_mid_up then 'up' else 'down' end as lean,
    case when p_cal > book_mid_up then book_mid_up else 1e0 - book_mid_up end as price, row_number() over (partition by asset order by ts_us, id) as seen
  from decisions),
e as (select *, abs(p_cal - book_mid_up) as edge, abs(p_cal - book_mid_up) - 0.005e0 - 0.5e0 * (1e0 - confidence) * 0.02e0 as net
  from g
  where price > 0.02e0 and price < 0.98e0)
select id, lean, R(price) as price, R(net) as ev, case when seen > 40 and abs(p_cal - book_mid_up) <= 0.2e0 and book_mid_up between 0.3e0 and 0.65e0 and ((lean = 'up' and z_dist >= 0e0) or (lean = 'down' and z_dist <= 0e0))
  and net > 0.01e0 and confidence > 0.05e0 and move_prob > 0.35e0 then 'TRADE' else 'SKIP' end as gate from e"""))(
    lambda spark, sf: rounded(path.gated(view(spark, sf, "decisions"), ["asset"], ["ts_us", "id"], "floor(ts_us / 86400000000e0)").select("id", "lean", "price", "ev", "gate"))
)
sql_query("side_select", f"""
with cell as (select tf, {x.band('market_mid')} as band, case when avg(case when p_cal > market_mid then outcome_up end) - avg(case when p_cal <= market_mid then outcome_up end) < -0.08e0 then -1 else 1 end as factor
  from calib
  group by tf, {x.band('market_mid')})
select d.id, case when (d.p_cal > d.book_mid_up) = (coalesce(c.factor, 1) = 1) then 'up' else 'down' end as side
  from decisions d left join cell c on d.tf = c.tf and {x.band('d.book_mid_up')} = c.band""")
sql_query("ev_expr", f"select id, R({x.expected_value('abs(p_cal - book_mid_up)', 'confidence')}) as ev from decisions")
sql_query("block_reason", """
select id, case when decision = 'TRADE' and id % 17 = 0 then 'estop' when decision = 'TRADE' and id % 13 = 0 then 'max_loss' when decision = 'TRADE' and id % 11 = 0 then 'halt' end as reason,
  case when decision = 'TRADE' and (id % 17 = 0 or id % 13 = 0 or id % 11 = 0) then 'SKIP' else decision end as decision, side, R(ev) as ev
  from decisions""")
sql_query("reconcile", "select id, case when venue_up is null then 'n/a' when venue_up = outcome_up then 'match' else 'MISMATCH' end as recon from (select id, outcome_up, case when id % 9 = 0 then null when id % 23 = 0 then 1 - outcome_up else outcome_up end as venue_up from settlements) s")
sql_query("ladder_topk", """
with m as (select id, spot, spot * (1e0 + (id % 41 - 20) / 100e0) as strike, tf from decisions where spot > 0e0),
p as (select id, tf, case when tf = '15m' then 0e0 when tf = '1h' then 1e0 + abs(ln(spot / strike)) else 2e0 end as priority
  from m
  where tf <> '1h' or abs(ln(spot / strike)) <= 0.10e0)
select id, tf, R(priority) as priority from p order by priority, id limit 95""")
sql_query("nearest_expiries", "select id, ts_us, asset from settlements where ts_us >= (select min(ts_us) + 864000000000 from settlements) order by ts_us, id limit 12")
query("next_two_expiries", oracle("select asset, id, ts_us from (select *, row_number() over (partition by asset order by ts_us, id) as k from settlements where ts_us >= (select min(ts_us) + 864000000000 from settlements)) s where k <= 2"))(
    lambda spark, sf: path.first_of_each(_coming(spark, sf), ["asset"], ["ts_us", "id"], 2).select("asset", "id", "ts_us")
)
sql_query("entry_filter", "select id, asset, tf from decisions where p_cal is not null and id % 20 > 0 and id % 20 <= 16 and regime not in ('high_vol/chop', 'low_vol/trend')")
sql_query("regime_onehot", "select id, case when regime like '%high_vol%' then 1e0 else 0e0 end as high_vol, case when regime like '%trend%' then 1e0 else 0e0 end as trending from decisions")
# a resting leg at the mid and a crossing leg at the ask, of a flat share of equity or of capped half Kelly; a leg under
# one contract isn't placed, and the crossing one only where the edge clears half the spread and the fee
LEGS = f"""
with l as (select id, venue, p_cal, book_mid_up as mid, case when side = 'up' then p_cal else 1e0 - p_cal end as p,
    case when side = 'up' then book_mid_up else 1e0 - book_mid_up end as price,
  case when side = 'up' then case when id % 5 = 0 then null else book_mid_up + 0.02e0 end else 1e0 - (book_mid_up - 0.02e0) end as cross_price,
    case when id % 5 = 0 then 0.06e0 else 0.04e0 end as spread
  from decisions
  where decision = 'TRADE'),
c as (select *, coalesce(cross_price > 0.02e0 and cross_price < 0.98e0 and abs(p_cal - mid) > spread / 2e0 + {x.venue_fee('venue', 'cross_price')}, false) as clears
  from l)"""
PLACED = """, z as (select id, {passive} as pas, case when clears then {aggressive} else 0e0 end as agg from c),
o as (select id, case when pas >= 1e0 then pas else 0e0 end as pas, case when agg >= 1e0 then agg else 0e0 end as agg from z)
select id, R(pas) as passive, R(agg) as aggressive, case when pas < 1e0 and agg < 1e0 then 'SKIP' else 'TRADE' end as decision from o"""
sql_query("two_leg_sizing", LEGS + PLACED.format(passive="1000e0 * 0.02e0 / price", aggressive="1000e0 * 0.01e0 / cross_price"))
sql_query("two_leg_kelly", LEGS + PLACED.format(passive=f"1000e0 * {x.kelly('p', 'price')} / price", aggressive=f"1000e0 * {x.kelly('p', 'cross_price', '0.01e0')} / cross_price"))
query("earliest_close", oracle("select asset, tf, id, ts_us from (select *, row_number() over (partition by asset, tf order by ts_us, id) as k from settlements where ts_us >= (select min(ts_us) + 864000000000 from settlements)) s where k = 1"))(
    lambda spark, sf: path.first_of_each(_coming(spark, sf).select("asset", "tf", "id", "ts_us"), ["asset", "tf"], ["ts_us", "id"])
)
sql_query("control_state", """
select id, case when id % 101 = 0 then 'ESTOP' when run <= -200e0 then 'MAXLOSS' when id % 37 = 0 then 'HALT' else 'RUN' end as state from
  (select id, sum(coalesce(pnl, 0e0)) over (partition by asset order by id rows between 19 preceding and current row) as run from settlements) s""")
sql_query("config_drift", """
with a as (select tf as k, cast(count(*) as string) as v from decisions where asset = 'A1' group by tf),
b as (select tf as k, cast(count(*) as string) as v from decisions where asset = 'A2' and tf <> '4h' group by tf)
select coalesce(a.k, b.k) as k, a.v as before, b.v as after from a full outer join b on a.k = b.k where a.v is null or b.v is null or a.v <> b.v""".replace("as before", "as was").replace("as after", "as now_is"))
sql_query("control_merge", """
with d as (select k.name as name, k.v as v
  from (values ('estop', 'false'), ('halt_entries', 'false'), ('max_loss', '50'), ('exposure_cap', '0.10')) as k(name, v)),
u as (select k.name as name, k.v as v from (values ('max_loss', '75'), ('unknown', '1')) as k(name, v))
select d.name, coalesce(u.v, d.v) as v from d left join u on d.name = u.name""")

# scalar library on decisions
sql_query("sigmoid_logit", f"select id, R({x.sigmoid('z_dist')}) as s, R({x.logit('p_cal')}) as l from decisions")
sql_query("entropy", f"select id, R({x.entropy('p_cal')}) as h from decisions")
sql_query("normal_cdf", f"select id, R({x.normal_cdf('z_dist')}) as phi, R({x.normal_cdf('(z_dist * 4e0)')}) as phi4 from decisions")
sql_query("digital_prob", f"""with i as (select id, spot, spot * (1e0 + z_dist / 100e0) as strike, 0.0001e0 + confidence / 1e3 as sigma, 60e0 + id % 900 as tau from decisions),
z as (select id, {x.digital_z('spot', 'strike', 'sigma', 'tau')} as z from i)
select id, R({x.digital_of('z')}) as p from z""")
sql_query("bridge_prob", f"select id, R({x.bridge_prob('spot', '(spot * (1e0 + z_dist / 200e0))', '(0.001e0 + confidence / 1e2)', '(id % 15 + 0e0)')}) as p from decisions")
sql_query("venue_fee", f"select id, R({x.venue_fee('venue', 'book_mid_up')}) as fee, R({x.taker_fee('book_mid_up')}) as taker from decisions")
sql_query("kelly", f"select id, R({x.kelly('p_cal', 'book_mid_up')}) as capped, R({x.kelly('p_cal', 'book_mid_up', '0.25e0', '1e0')}) as wide from decisions")
sql_query("structural_anchor", f"select id, R({x.anchor('p_cal', 'alpha_up')}) as anchored from calib")
sql_query("mid_band", f"select id, {x.band('book_mid_up')} as band from decisions")
sql_query("decile", f"select id, {x.decile('p_cal')} as decile from decisions")
sql_query("temperature", f"select id, R({x.temperature('move_prob', 'confidence', '(id % 7 = 0)')}) as t, R({x.confidence('p_cal', 'move_prob', 'confidence')}) as c from decisions")
sql_query("move_prob", f"""
with m as (select id, spot, avg(spot) over w as mu, stddev_pop(spot) over w as sd, count(*) over w as n
  from decisions
  window w as (partition by asset order by ts_us, id rows between unbounded preceding and 1 preceding))
select id, R(case when n > 10 and sd > 1e-9 then {x.sigmoid('(0.9e0 * (spot - mu) / sd)')} else 0.5e0 end) as p from m""".replace("R(case", "round(case").replace(" end) as p", " end, 6) as p"))
sql_query("classify_regime", f"""
with m as (select id, l_v as vol, avg(l_v) over w as mu, stddev_pop(l_v) over w as sd, count(*) over w as n, (id % 97) / 97e0 as eff
  from (select *, round(abs(z_dist) + move_prob, 4) as l_v
  from decisions) d
  window w as (partition by asset order by ts_us, id rows between unbounded preceding and 1 preceding))
select id, {x.classify_regime('n', 'vol', 'round(mu, 6)', 'round(sd, 6)', 'eff')} as regime from m""")
sql_query("ensemble", f"""
with h as (select id, book_mid_up as mid, p_cal as p1, {x.sigmoid('z_dist')} as p2, 0.5e0 + confidence / 4e0 as p3, 0.5e0 + move_prob / 2e0 as w1, 0.6e0 as w2,
    0.4e0 as w3
  from decisions),
e as (select id, mid, (w1 * {x.logit('p1')} + w2 * {x.logit('p2')} + w3 * {x.logit('p3')}) / (w1 + w2 + w3) as l from h),
t as (select id, mid, {x.clamp(f"l - {x.logit('mid', '1e-4')}", '-0.4e0', '0.4e0')} as tilt from e)
select id, R({x.sigmoid(f"{x.logit('mid', '1e-4')} + tilt")}) as p_up from t""")
sql_query("weights_summary", "select concat(k.head, '.', k.feature) as name, R(avg(case k.feature when 'z' then z_dist when 'mid' then book_mid_up else confidence end)) as weight, count(*) as k from decisions cross join (values ('markov', 'z'), ('markov', 'mid'), ('momentum', 'z'), ('micro', 'conf')) as k(head, feature) group by k.head, k.feature")
sql_query("cond_assess", f"""
with l as (select tf, {x.band('market_mid')} as cell, case when p_cal > market_mid then 1 else 0 end as up_leg, outcome_up as y from calib),
g as (select tf, cell, sum(up_leg) as nu, count(*) - sum(up_leg) as nd, sum(up_leg * y) as su, sum((1 - up_leg) * y) as sd from l group by tf, cell),
q as (select *, (su + 0.5e0) / (nu + 1e0) - (sd + 0.5e0) / (nd + 1e0) as gap from g)
select tf, cell, cast(nu as bigint) as nu, cast(nd as bigint) as nd, R(gap) as gap,
    case when tf = '4h' and cell = 'lo' then 'BLACKLIST' when least(nu,
    nd) < 20 then 'WARMUP' when abs(gap) < 0.08e0 then 'NOSKILL' when gap > 0e0 then 'SKILL' else 'INVERTED' end as verdict
  from q""")
