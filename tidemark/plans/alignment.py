"""Alignment: as-of strikes and prices, nearest quotes of two venues, lookbacks, fills and take-profits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import expressions as x
from tidemark.operators import asof_join, interval_parts, interval_totals, nearest_join, range_join
from tidemark.operators.bands import band_distances
from tidemark.operators.scans import with_before
from tidemark.plans.dialect import oracle, render, rounded, sql_query, view
from tidemark.registry import query

#: As-of joins cut an asset's rows to days, so that five assets are more than five tasks.
DAY = 86_400_000_000
GRID = "select distinct asset, g.w as grid_s, ts_us - ts_us % (cast(g.w as bigint) * 1000000) as window_us from ticks cross join (values (3600), (14400)) as g(w)"


def _grid(spark, sf):
    return view(spark, sf, "ticks").select("asset", F.explode(F.array(F.lit(3600), F.lit(14400))).alias("grid_s"), "ts_us").selectExpr("asset", "grid_s", "ts_us - ts_us % (cast(grid_s as bigint) * 1000000) as ts_us").distinct()


query("asof_strike", oracle(f"with g as ({GRID}) select g.asset, grid_s, window_us, r.ts_us as updated_us, round_id, round(price, 9) as strike from g asof left join rounds r on g.asset = r.asset and g.window_us >= r.ts_us"))(
    lambda spark, sf: asof_join(_grid(spark, sf), view(spark, sf, "rounds"), ["asset"], "ts_us", ["round_id", "price"], tie="round_id", bucket=DAY).selectExpr("asset", "grid_s", "ts_us as window_us", "r_ts_us as updated_us", "r_round_id as round_id", "round(r_price, 9) as strike")
)
query("asof_price_at", oracle(f"with g as ({GRID}) select g.asset, grid_s, window_us, case when window_us - r.ts_us <= 1800000000 then round(price, 9) end as price from g asof left join rounds r on g.asset = r.asset and g.window_us >= r.ts_us"))(
    lambda spark, sf: asof_join(_grid(spark, sf), view(spark, sf, "rounds"), ["asset"], "ts_us", ["price"], tolerance=1_800_000_000, bucket=DAY).selectExpr("asset", "grid_s", "ts_us as window_us", "round(r_price, 9) as price")
)
query("resolve_outcome", oracle(f"""
with g as ({GRID}),
b as (select asset, grid_s, window_us, k.e as e, window_us + cast(k.e as bigint) * grid_s * 1000000 as ts_us
  from g cross join (values (0), (1)) as k(e)),
a as (select b.asset, grid_s, window_us, e, r.price from b asof left join rounds r on b.asset = r.asset and b.ts_us >= r.ts_us),
p as (select asset, grid_s, window_us, max(case when e = 0 then price end) as p0, max(case when e = 1 then price end) as p1
  from a
  group by asset, grid_s, window_us)
select asset, grid_s, window_us, case when p1 > p0 then 'up' else 'down' end as outcome, round(p1 / p0 - 1e0, 9) as ret
  from p
  where p0 is not null and p1 is not null"""))(
    lambda spark, sf: asof_join(_grid(spark, sf).selectExpr("asset", "grid_s", "ts_us as window_us", "explode(array(0, 1)) as e").withColumn("ts_us", F.expr("window_us + cast(e as bigint) * grid_s * 1000000")), view(spark, sf, "rounds"), ["asset"], "ts_us", ["price"], bucket=DAY)
    .groupBy("asset", "grid_s", "window_us").agg(F.expr("max(case when e = 0 then r_price end)").alias("p0"), F.expr("max(case when e = 1 then r_price end)").alias("p1")).where("p0 is not null and p1 is not null")
    .selectExpr("asset", "grid_s", "window_us", "case when p1 > p0 then 'up' else 'down' end as outcome", "round(p1 / p0 - 1e0, 9) as ret")
)
TWO = "p as (select seq, asset, ts_us from quotes where venue = 'polymarket'), k as (select seq, asset, ts_us, underlying from quotes where venue = 'kalshi')"
query("asof_nearest", oracle(f"""
with {TWO}, b as (select p.seq, p.asset, p.ts_us, k.seq as bs, k.ts_us as bt from p asof left join k on p.asset = k.asset and p.ts_us >= k.ts_us),
f as (select b.*, k.seq as fs, k.ts_us as ft from b asof left join k on b.asset = k.asset and b.ts_us <= k.ts_us),
d as (select *, case when ts_us - bt <= 600000000 then ts_us - bt end as db, case when ft - ts_us <= 600000000 then ft - ts_us end as df from f)
select seq, asset, case when db is not null and (df is null or db <= df) then bs when df is not null then fs end as match_seq from d"""))(
    lambda spark, sf: nearest_join(view(spark, sf, "quotes").where("venue = 'polymarket'").select("seq", "asset", "ts_us"), view(spark, sf, "quotes").where("venue = 'kalshi'").select("seq", "asset", "ts_us"), ["asset"], "ts_us", ["seq"], 600_000_000, bucket=DAY).selectExpr("seq", "asset", "r_seq as match_seq")
)
query("lead_book_lag", oracle(f"""
with {TWO}, s as (select seq, asset, ts_us + 5000000 as ts_us
  from p) select s.seq, s.asset, k.seq as book_seq, round((s.ts_us - 5000000 - k.ts_us) / 1e6, 6) as lag_s
  from s asof left join k on s.asset = k.asset and s.ts_us >= k.ts_us"""))(
    lambda spark, sf: asof_join(view(spark, sf, "quotes").where("venue = 'polymarket'").selectExpr("seq", "asset", "ts_us + 5000000 as ts_us"), view(spark, sf, "quotes").where("venue = 'kalshi'").select("seq", "asset", "ts_us"), ["asset"], "ts_us", ["seq"], bucket=DAY)
    .selectExpr("seq", "asset", "r_seq as book_seq", "round((ts_us - 5000000 - r_ts_us) / 1e6, 6) as lag_s")
)
query("lookback_join", oracle("select r.round_id, r.asset, count(*) as n, round(avg(t.price), 7) as mean_price, max(t.seq) as last_seq from rounds r join ticks t on r.asset = t.asset and r.ts_us - t.ts_us > 0 and r.ts_us - t.ts_us <= 14400000000 group by r.round_id, r.asset"))(
    lambda spark, sf: interval_totals(view(spark, sf, "rounds").select("round_id", "asset", "ts_us"), view(spark, sf, "ticks").select("asset", "ts_us", "price", "seq"), ["asset"], "ts_us", 14_400_000_000, -1, ["round_id", "asset"], {"total": F.col("r.price")}, {"last_seq": F.col("r.seq")})
    .select("round_id", "asset", "n", F.round(F.col("total") / F.col("n"), 7).alias("mean_price"), "last_seq")
)
CAUSAL = """l as (select round_id, asset, case when price > 0e0 and lag(price) over p > 0e0 then ln(price / lag(price) over p) end as r from {w}
  window p as (partition by round_id, asset order by tick_us, seq))
select round_id, asset, count(r) as n, round(sum(r * r), 6) as rv, round(sum(case when r > 0e0 then r * r else 0e0 end), 6) as up,
    case when count(r) >= 5 then 'own' else 'fallback' end as kind
  from l
  group by round_id, asset having count(r) >= 1"""


@query("causal_var_features", oracle("""
with w as (select round_id, r.asset, t.seq, t.price, t.ts_us as tick_us
  from rounds r join ticks t on r.asset = t.asset and r.ts_us - t.ts_us > 0 and r.ts_us - t.ts_us <= 43200000000),
""" + CAUSAL.format(w="w")))
def _causal(spark, sf):
    """Returns between neighbouring ticks of a round's interval: running sums within each share of it, and the return
    between the last tick of the earlier share and the first of the later one. Rounds that share an id are paired."""
    rounds, ticks = view(spark, sf, "rounds").select("round_id", "asset", "ts_us"), view(spark, sf, "ticks").select("asset", "ts_us", "price", "seq")
    known = rounds.groupBy("round_id", "asset").agg(F.min("ts_us").alias("ts_us"), F.count("*").alias("times"))
    ret = lambda a, b: F.when((a > 0) & (b > 0), F.log(b / a))
    square = lambda r: {"n": F.count(r), "rv": F.sum(r * r), "up": F.sum(F.when(r > 0, r * r).otherwise(F.lit(0.0)))}

    def step(w):
        prev, price = F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))["price"], F.col("r.price")
        return {"x": F.when(F.col("head"), ret(price, prev)).otherwise(ret(prev, price)), "edge": F.first("r", ignorenulls=True).over(w)["price"]}

    run = lambda w: {n: c.over(w) for n, c in square(F.col("x")).items()}
    once = known.where("times = 1").drop("times")
    parts = interval_parts(once, ticks, ["asset"], "ts_us", 43_200_000_000, -1, [step, run], tie="seq")
    whole = parts.groupBy("round_id", "asset").agg(*[F.sum(c).alias(c) for c in ("n", "rv", "up")], F.max(F.when(F.col("head"), F.col("edge"))).alias("a"), F.max(F.when(~F.col("head"), F.col("edge"))).alias("b"))
    whole = whole.withColumn("x", ret(F.col("a"), F.col("b"))).withColumn("n", F.col("n") + F.when(F.col("x").isNull(), 0).otherwise(1)).where("n >= 1")
    plus = lambda c, x: F.coalesce(F.col(c), F.lit(0.0)) + F.coalesce(x, F.lit(0.0))
    x, columns = F.col("x"), ["round_id", "asset", "n", "rv", "up"]
    whole = whole.select("round_id", "asset", "n", plus("rv", x * x).alias("rv"), plus("up", F.when(x > 0, x * x)).alias("up"))
    again = rounds.join(known.where("times > 1").select("round_id", "asset"), ["round_id", "asset"])
    pairs = range_join(again, ticks, ["asset"], "ts_us", 43_200_000_000)
    before = F.lag("r_price").over(Window.partitionBy("round_id", "asset").orderBy("r_ts_us", "r_seq"))
    pairs = pairs.withColumn("x", ret(before, F.col("r_price"))).groupBy("round_id", "asset").agg(*[c.alias(n) for n, c in square(x).items()]).where("n >= 1").select(columns)
    kind = F.when(F.col("n") >= 5, "own").otherwise("fallback").alias("kind")
    return rounded(whole.unionByName(pairs), {"rv": 6, "up": 6}).select(*columns, kind)


sql_query("nearest_in_band", """
with d as (select market, seq, ts_us, abs(ts_us - (window_start_us + 43200000000)) as gap from quotes),
r as (select *, row_number() over (partition by market order by gap, ts_us, seq) as i from d where gap <= 21600000000)
select market, seq, gap from r where i = 1""")
sql_query("cross_venue_windows", """
with v as (select asset, window_start_us, venue, count(*) as n, max_by(up_ask, case when up_ask is not null then ts_us end) as ask
  from quotes
  group by asset, window_start_us, venue)
select p.asset, p.window_start_us, p.n as poly_n, k.n as kalshi_n, R(p.ask - k.ask) as basis
  from v p join v k on p.asset = k.asset and p.window_start_us = k.window_start_us
  where p.venue = 'polymarket' and k.venue = 'kalshi'""")
QUOTED = f"""with w as (select asset, window_start_us, venue, seq, ts_us, up_bid, up_ask, {x.mid('up_bid', 'up_ask')} as mid, cast(floor(ts_us / 1200000000e0) as bigint) as b
  from quotes
  where up_bid is not null and up_ask is not null)"""
PAIRED = """, j as (select p.asset, p.window_start_us, p.mid as pm, k.mid as km, p.up_ask as pa, k.up_ask as ka, p.up_bid as pb, k.up_bid as kb, p.seq as ps, k.seq as ks
  from w p join {k} k
  on p.asset = k.asset and p.window_start_us = k.window_start_us and abs(p.ts_us - k.ts_us) <= 1200000000 {same}
  where p.venue = 'polymarket' and k.venue = 'kalshi')"""
PAIRS = QUOTED + PAIRED.format(k="w", same="")
#: Quotes of two venues are compared within 20 minutes.
BAND = 1_200_000_000


def _quoted(spark, sf):
    """Two-sided quotes of both venues."""
    w = spark.sql(render(QUOTED + " select asset, window_start_us, venue, seq, ts_us, up_bid, up_ask, mid from w", "spark", sf))
    return w.where("venue = 'polymarket'"), w.where("venue = 'kalshi'")


@query("cross_venue_ev", oracle(PAIRS + f""", r as (select *, abs(pm - km) as div, row_number() over (partition by asset, window_start_us order by abs(pm - km) desc, ps, ks) as i from j)
select asset, window_start_us, ps, ks, R(div) as divergence, R(div - {x.taker_fee('ka')}) as ev from r where i = 1 and div >= 0.02e0"""))
def _cross_venue(spark, sf):
    """Widest pair of each market window. A quote is farthest from the highest or lowest quote of the other venue within the
    band; only the first quote of a window that is farthest meets the other venue's rows."""
    p, k = _quoted(spark, sf)
    key = ["asset", "window_start_us"]
    ends = lambda w: {"high": F.max("r.mid").over(w), "low": F.min("r.mid").over(w)}
    parts = interval_parts(p, k, key, "ts_us", BAND, BAND, [ends]).withColumn("div", F.greatest(F.abs(F.col("mid") - F.col("high")), F.abs(F.col("mid") - F.col("low"))))
    top = parts.groupBy(*key).agg(F.max(F.struct("div", (-F.col("seq")).alias("back"), "ts_us", "mid")).alias("p")).where("p.div >= 0.02e0")
    near = k.join(top, key).where((F.abs(F.col("p.ts_us") - F.col("ts_us")) <= BAND) & (F.abs(F.col("p.mid") - F.col("mid")) == F.col("p.div")))
    pair = near.groupBy(*key).agg(F.min(F.struct("seq", "up_ask")).alias("k"), F.first("p").alias("p"))
    return pair.selectExpr(*key, "-p.back as ps", "k.seq as ks", "round(p.div, 9) as divergence", f"round(p.div - {x.taker_fee('k.up_ask')}, 9) as ev")


BASIS = """, b as (select asset, abs(pm - km) as b, row_number() over (partition by asset order by abs(pm - km), ps, ks) as i, count(*) over (partition by asset) as n
  from j)
select asset, max(n) as n, R(avg(b)) as mean, R(max(case when i = cast(floor(n / 2e0) as bigint) + 1 then b end)) as median,
    R(max(case when i = cast(floor(0.9e0 * n) as bigint) + 1 then b end)) as p90
  from b
  group by asset"""


@query("basis_quantiles", oracle(PAIRS + BASIS))
def _basis(spark, sf):
    """Mean, median and 90th percentile of the distance between two venues' prices, from how often each distance occurs."""
    p, k = _quoted(spark, sf)
    b = band_distances(p, k, ["asset", "window_start_us"], "ts_us", "mid", BAND).withColumn("sum", F.col("distance") * F.col("pairs"))
    x = with_before(b.groupBy("asset", "distance").agg(F.sum("pairs").alias("pairs"), F.sum("sum").alias("sum")), ["asset"], "floor(256 * distance)", {"before": F.sum("pairs")}, {"n": F.sum("pairs"), "whole": F.sum("sum")})
    upto = F.col("before") + F.sum("pairs").over(Window.partitionBy("__key").orderBy("distance"))
    x = x.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("pairs"))
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("upto")), F.col("distance")))
    n = F.max("n").alias("n")
    return rounded(x.groupBy("asset").agg(n, F.max(F.col("whole") / F.col("n")).alias("mean"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(0.9 * F.col("n"))).alias("p90")))


@query("arb_lock", oracle(PAIRS + f""", c as (select asset, window_start_us, least(pa + (1e0 - kb) + {x.taker_fee('kb')}, ka + (1e0 - pb) + {x.taker_fee('ka')}) as cost from j)
select asset, window_start_us, R(min(cost)) as cost, R(1e0 - min(cost)) as locked, min(cost) < 1e0 as lockable from c group by asset, window_start_us"""))
def _arb(spark, sf):
    """Cheapest pair of opposite legs. A pair's cost is a sum of a term of each venue, so that a quote meets the other venue's
    cheapest terms within the band, and its cost is taken from their prices."""
    p, k = _quoted(spark, sf)
    k = k.selectExpr("*", f"1e0 - up_bid + {x.taker_fee('up_bid')} as down", f"up_ask + {x.taker_fee('up_ask')} as up")
    least = lambda w: {"kb": F.min(F.when(F.col("r").isNotNull(), F.struct("r.down", "r.up_bid"))).over(w)["up_bid"], "ka": F.min(F.when(F.col("r").isNotNull(), F.struct("r.up", "r.up_ask"))).over(w)["up_ask"]}
    parts = interval_parts(p, k, ["asset", "window_start_us"], "ts_us", BAND, BAND, [least])
    cost = F.expr(f"least(up_ask + (1e0 - kb) + {x.taker_fee('kb')}, ka + (1e0 - up_bid) + {x.taker_fee('ka')})")
    found = parts.groupBy("asset", "window_start_us").agg(F.min(cost).alias("cost"))
    return found.selectExpr("asset", "window_start_us", "round(cost, 9) as cost", "round(1e0 - cost, 9) as locked", "cost < 1e0 as lockable")


BUCKETS = "case when left_h < 1e0 then '0-1' when left_h < 2e0 then '1-2' when left_h < 4e0 then '2-4' when left_h < 8e0 then '4-8' when left_h < 12e0 then '8-12' when left_h < 16e0 then '12-16' end"
LATEST = f"""with q as (select market, asset, seq, ts_us, underlying, {x.mid('up_bid', 'up_ask')} as mid, (window_start_us + 86400000000 - ts_us) / 3.6e9 as left_h
  from quotes),
b as (select *, {BUCKETS} as bucket from q),
l as (select *, row_number() over (partition by market, bucket order by ts_us desc, seq desc) as i from b where bucket is not null),
o as (select market, min_by(underlying, ts_us) as strike, max_by(underlying, ts_us) as fin from quotes group by market)"""
sql_query("latest_in_bucket", LATEST + " select market, bucket, seq, R(mid) as mid from l where i = 1")
sql_query("bridge_edge", LATEST + f""", e as (select l.bucket, l.mid, {x.bridge_prob('underlying', 'strike', '0.02e0', '(left_h * 60e0)')} as p, case when fin > strike then 1 else 0 end as y
  from l join o on l.market = o.market
  where i = 1 and mid is not null)
select bucket, count(*) as n, round(avg(abs(p - mid)), 7) as signal, R(avg(case when (p >= 0.5e0) = (y = 1) then 1e0 else 0e0 end)) as directional,
    cast(sum(case when abs(p - mid) > 0.05e0 then 1 else 0 end) as bigint) as trades,
  R(avg(case when p - mid > 0.05e0 then y - mid - {x.taker_fee('mid')} when mid - p > 0.05e0 then mid - y - {x.taker_fee('mid')} end)) as net
  from e
  group by bucket""")
sql_query("terminal_determinism", LATEST + """, a as (select l.bucket, case when underlying > strike then 1 else 0 end as now_up, case when fin > strike then 1 else 0 end as y, mid
  from l join o on l.market = o.market
  where i = 1)
select bucket, count(*) as n, R(avg(case when now_up = y then 1e0 else 0e0 end)) as determined, R(avg(abs(mid - now_up))) as book_lag
  from a
  group by bucket""")
sql_query("last60_flip", LATEST + """, f as (select l.market, max(case when bucket = '1-2' then case when underlying > strike then 1 else 0 end end) as early,
    max(case when bucket = '0-1' then case when underlying > strike then 1 else 0 end end) as late
  from l join o on l.market = o.market
  where i = 1
  group by l.market)
select count(*) as n, R(avg(case when early <> late then 1e0 else 0e0 end)) as flip_rate from f where early is not null and late is not null""")
sql_query("strike_lookup", "with s as (select asset, ts_us - ts_us % 86400000000 as window_us, min_by(price, ts_us) as strike from rounds group by asset, ts_us - ts_us % 86400000000) select q.seq, q.asset, R(s.strike) as strike from quotes q left join s on q.asset = s.asset and q.window_start_us = s.window_us")
sql_query("strike_merge", """
with a as (select asset, ts_us - ts_us % 86400000000 as w, min_by(price, ts_us) as p from ticks group by asset, ts_us - ts_us % 86400000000),
b as (select asset, ts_us - ts_us % 86400000000 as w, min_by(price, ts_us) as p from rounds group by asset, ts_us - ts_us % 86400000000)
select coalesce(a.asset, b.asset) as asset, coalesce(a.w, b.w) as window_us, R(coalesce(a.p, b.p)) as strike, coalesce(abs(a.p - b.p) > 1e-9, false) as conflict
  from a full outer join b on a.asset = b.asset and a.w = b.w""")
sql_query("round_merge", """
with u as (select asset, ts_us, price, cast(null as bigint) as round_id, seq as arrival
  from ticks
  where k % 10 = 0 union all select asset, ts_us, price, round_id, round_id + 1000000000 as arrival
  from rounds)
select asset, ts_us, R(min_by(price, arrival)) as price, max(round_id) as round_id, count(*) as seen from u group by asset, ts_us""")
sql_query("rounds_in_order", "select asset, round_id, row_number() over (partition by asset order by ts_us, round_id) as position, R(price) as price from rounds")
sql_query("fresh_lookup", """
with l as (select asset, max(ts_us) as ts_us, max_by(price, ts_us) as price from ticks where k % 3 <> 0 group by asset)
select t.seq, t.asset, case when l.ts_us - t.ts_us between 0 and 86400000000 then round(l.price, 9) end as mirror
  from ticks t left join l on t.asset = l.asset
  where t.k = 7""")
sql_query("latest_by_topic", "select concat('tick.', asset) as topic, max(seq) as seq, R(max_by(price, seq)) as price from ticks where seq % 97 <> 0 group by concat('tick.', asset)")
sql_query("first_by_key", "select asset, ts_us - ts_us % 3600000000 as window_us, min(seq) as seq, R(min_by(price, seq)) as price from ticks group by asset, ts_us - ts_us % 3600000000")
PATH = f"""with q as (select market, seq, ts_us, {x.mid('up_bid', 'up_ask')} as mid, up_bid, up_ask, row_number() over (partition by market order by ts_us, seq) as i
  from quotes),
o as (select market, ts_us as placed_us, mid - 0.02e0 as limit_price from q where i = 1),
f as (select q.market, min(q.ts_us) as fill_us
  from q join o on q.market = o.market
  where q.i > 1 and q.up_ask is not null and q.up_ask <= o.limit_price
  group by q.market)"""
sql_query("fill_sim", PATH + " select o.market, R(limit_price) as limit_price, fill_us, f.fill_us is not null as filled from o left join f on o.market = f.market")
sql_query("tp_trigger", PATH + """ select f.market, fill_us, min(case when coalesce(q.up_bid, 1e0 - q.up_ask) >= 0.9e0 - 1e-9 then q.ts_us end) as tp_us
  from f join q on q.market = f.market and q.ts_us >= f.fill_us
  group by f.market, fill_us""")
