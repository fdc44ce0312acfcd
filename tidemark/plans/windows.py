"""Ordered analytics over ticks: returns, rolling and realised variance, jumps, lead-lag, volatility regimes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import expressions as x
from tidemark.operators import decayed, positions, scan, windowed
from tidemark.operators import variance as v
from tidemark.operators.ordered import excursions, seq_gaps
from tidemark.plans.dialect import oracle, rounded, sql_query, view
from tidemark.registry import query

#: Simple return of a price on the one before it; null where either is no positive number.
SIMPLE = "case when price > 0e0 and lag(price) over w > 0e0 then price / lag(price) over w - 1e0 end"
RET = """with r as (select asset, seq, ts_us, ts_s, price, user_id, k, case when price > 0e0 and lag(price) over w > 0e0 then ln(price / lag(price) over w) end as r,
    ts_s - lag(ts_s) over w as dt, row_number() over w as i
  from ticks window w as (partition by asset order by ts_us, seq))"""

BY, ORDER = ["asset"], ["ts_us", "seq"]
#: Rows of a key are numbered day by day, then cut into parts of equal size.
CUT = {"bucket": "floor(ts_us / 86400000000e0)"}


def _returns(spark, sf):
    """Ticks with their log returns."""
    return v.log_returns(view(spark, sf, "ticks"), BY, ORDER, "price", **CUT)


query("log_returns", oracle(RET + " select seq, asset, R(r) as r from r where r is not null"))(lambda spark, sf: rounded(_returns(spark, sf).where("r is not null").select("seq", "asset", "r")))
query("simple_returns", oracle(f"select seq, asset, R({SIMPLE}) as r from ticks window w as (partition by asset order by ts_us, seq)"))(lambda spark, sf: rounded(v.simple_returns(view(spark, sf, "ticks"), BY, ORDER, "price", **CUT).select("seq", "asset", "r")))
query("dedupe_consecutive", oracle("select seq, asset, k from (select seq, asset, k, lag(k) over (partition by asset order by ts_us, seq) as prev from ticks) t where prev is null or k <> prev"))(
    lambda spark, sf: v.changed(view(spark, sf, "ticks").select("seq", "asset", "ts_us", "k"), BY, ORDER, "k", **CUT).select("seq", "asset", "k")
)
query("rolling_rv", oracle(RET + """ select seq, asset, count(r) over w as n, round(sum(r * r) over w, 6) as rv, round(avg(r) over w, 6) as mean
  from r
  window w as (partition by asset order by ts_us, seq rows between 119 preceding and current row)"""))(lambda spark, sf: rounded(v.rolling_moments(_returns(spark, sf), BY, ORDER, "r", 120, **CUT).select("seq", "asset", "n", "rv", "mean"), {"rv": 6, "mean": 6}))
sql_query("running_moments", """
select seq, asset, count(*) over w as n, round(avg(price) over w + 1.234567e-9, 6) as mean, round(var_pop(price) over w + 1.234567e-7, 4) as var
  from ticks
  window w as (partition by asset order by ts_us, seq rows between unbounded preceding and current row)""")
sql_query("zscore_group", """
with m as (select asset, avg(price) as mu, stddev_samp(price) as sd from ticks group by asset)
select seq, t.asset, R(case when sd > 0e0 then (price - mu) / sd else 0e0 end) as z from ticks t join m on t.asset = m.asset""")
sql_query("tercile_hit_rate", RET + """, n as (select asset, r, lead(r) over (partition by asset order by ts_us, seq) as nxt from r where r is not null),
q as (select *, row_number() over (partition by asset order by abs(r), nxt) as i, count(*) over (partition by asset) as c
  from n
  where nxt is not null)
select asset, count(*) as n, R(avg(case when r * nxt > 0e0 then 1e0 else 0e0 end)) as hit_rate
  from q
  where i > cast(floor(c * 2 / 3e0) as bigint)
  group by asset""")
query("bar_rv", oracle(RET + """, b as (select asset, cast(floor((i - 2) / 30e0) as bigint) as bar, r from r where r is not null)
select asset, bar, round(sum(r * r), 9) as rv, round(sum(r), 9) as ret from b group by asset, bar having count(*) = 30"""))(lambda spark, sf: rounded(v.fixed_bars(_returns(spark, sf), BY, ORDER, "r", 30, **CUT)))
HAR = RET + """, b as (select asset, cast(floor((i - 2) / 30e0) as bigint) as bar, r from r where r is not null),
v as (select asset, bar, sum(r * r) as rv, sum(r) as ret from b group by asset, bar having count(*) = 30),
h as (select asset, bar, rv, avg(rv) over (partition by asset order by bar rows between 4 preceding and current row) as rv5,
    avg(rv) over (partition by asset order by bar rows between 21 preceding and current row) as rv22,
  case when ret < 0e0 then ret * ret else 0e0 end as lev, lead(rv) over (partition by asset order by bar) as target,
    row_number() over (partition by asset order by bar) as t
  from v)"""
query("har_design", oracle(HAR + " select asset, bar, round(rv, 7) as rv, round(rv5, 7) as rv5, round(rv22, 7) as rv22, round(lev, 7) as lev, round(target, 7) as target from h where t >= 23 and target is not null"))(
    lambda spark, sf: rounded(v.har_features(v.fixed_bars(_returns(spark, sf), BY, ORDER, "r", 30, **CUT), BY).drop("ret"), 7)
)
sql_query("har_slope", HAR + " select asset, count(*) as n, round(regr_slope(target, rv), 6) as slope, round(regr_intercept(target, rv), 5) as intercept, round(regr_r2(target, rv), 6) as r2 from h where target is not null group by asset")
query("rv_estimators", oracle(RET + """, m as (select asset, avg(r) as mu from r group by asset),
d as (select r.asset, r.r, r.r - mu as e, lag(r.r - mu, 1) over w as e1, lag(r.r - mu, 2) over w as e2, lag(r.r - mu, 3) over w as e3
  from r join m on r.asset = m.asset
  where r.r is not null
  window w as (partition by r.asset order by r.ts_us, r.seq)),
g as (select asset, count(*) as n, sum(r * r) as rv, sum(e * e) as g0, sum(e * e1) as g1, sum(e * e2) as g2, sum(e * e3) as g3 from d group by asset)
select asset, n, round(rv, 6) as naive, round(greatest(rv + 2e0 * g1, 0.25e0 * rv, 1e-18), 6) as ac1,
    round(greatest(g0 + 2e0 * (0.75e0 * g1 + 0.5e0 * g2 + 0.25e0 * g3), 0.25e0 * rv, 1e-18), 6) as kernel
  from g"""))(lambda spark, sf: rounded(v.realized_variance(_returns(spark, sf), BY, ORDER, "r", **CUT), 6))
sql_query("sigma_ratio", RET + """, m as (select asset, avg(r) as mu from r group by asset),
d as (select r.asset, r.r, (r.r - mu) * lag(r.r - mu) over (partition by r.asset order by r.ts_us, r.seq) as c
  from r join m on r.asset = m.asset
  where r.r is not null),
g as (select asset, sum(r * r) as rv, sum(c) as c
  from d
  group by asset) select round(avg(sqrt(greatest(rv + 2e0 * c, 0.25e0 * rv) / rv)), 7) as ratio, count(*) as assets
  from g""")
query("bipower", oracle(RET + """, p as (select asset, r, abs(r) * abs(lag(r) over (partition by asset order by ts_us, seq)) as b from r where r is not null)
select asset, count(*) as n, round(1.5707963267948966e0 * sum(b), 6) as bipower, round(sum(r * r), 6) as rv from p group by asset"""))(lambda spark, sf: rounded(v.bipower(_returns(spark, sf), BY, ORDER, "r", **CUT), 6))
#: Lee-Mykland with a fixed window of 50: flags of returns against the local bipower scale, Gumbel threshold at 1 %.
JUMPS = RET + """, p as (select asset, seq, ts_us, r, abs(r) * abs(lag(r) over (partition by asset order by ts_us, seq)) as b,
    row_number() over (partition by asset order by ts_us, seq) as j, count(*) over (partition by asset) as n
  from r
  where r is not null),
l as (select *, sum(b) over (partition by asset order by ts_us, seq rows between 49 preceding and 1 preceding) as s,
    count(b) over (partition by asset order by ts_us, seq rows between 49 preceding and 1 preceding) as c
  from p),
t as (select *, ln(greatest(n - 50, 2)) as ll, sqrt(0.6366197723675814e0) as q from l where c = 49 and s > 0e0),
f as (select *, case when (abs(r) / sqrt(s / 48e0) - (sqrt(2e0 * ll) / q - (1.1447298858494002e0 + ln(ll)) / (2e0 * q * sqrt(2e0 * ll)))) * (q * sqrt(2e0 * ll)) > 4.600149226776579e0 then 1 else 0 end as jump
  from t)"""
query("lee_mykland", oracle(JUMPS + " select seq, asset, round(abs(r) / sqrt(s / 48e0), 6) as stat, jump from f"))(lambda spark, sf: rounded(v.jumps(_returns(spark, sf), BY, ORDER, "r", **CUT).select("seq", "asset", "stat", "jump"), 6))
query("variance_decompose", oracle(JUMPS + """, g as (select p.asset, count(*) as n, sum(p.r * p.r) as rv, 1.5707963267948966e0 * sum(p.b) as bv,
    coalesce(sum(case when f.jump = 1 then p.r * p.r end), 0e0) as jv, coalesce(sum(f.jump), 0) as jumps,
  sum(case when p.r > 0e0 then p.r * p.r else 0e0 end) as up, sum(case when p.r < 0e0 then p.r * p.r else 0e0 end) as down
  from p left join f on p.asset = f.asset and p.seq = f.seq
  group by p.asset)
select asset, n, round(rv, 6) as rv, round(bv, 6) as bv, round(jv, 6) as jv, cast(jumps as bigint) as jumps, round(up, 6) as up_semivar,
    round(down, 6) as down_semivar, round(jv / rv, 7) as jump_share,
  round(case when bv > 0e0 then least(bv, greatest(rv - jv, 0e0)) else greatest(rv - jv, 0e0) end, 6) as jump_robust, round((up - down) / rv, 7) as skew
  from g"""))(
    lambda spark, sf: rounded(v.decompose(_returns(spark, sf), BY, ORDER, "seq", "r", **CUT), {**dict.fromkeys(["rv", "bv", "jv", "up_semivar", "down_semivar", "jump_robust"], 6), "jump_share": 7, "skew": 7})
)
sql_query("noise_robust_vol", RET + """, w as (select asset, seq, r, dt, count(r) over f as n, sum(r) over f as sr, sum(dt) over f as sdt, sum(r * r) over f as rr
  from r
  where r is not null and dt > 0e0
  window f as (partition by asset order by ts_us, seq rows between 119 preceding and current row))
select seq, asset, n, round(case when n >= 5 then sr / sdt else 0e0 end, 8) as mu, round(greatest(case when n < 3 then 1e-7 else sqrt(rr / sdt) end, 1e-7), 7) as sigma
  from w""")
KAPPA = RET + """, v as (select asset, seq, ts_us, ts_s, price, r, var_samp(r) over (partition by asset order by ts_us, seq rows between 59 preceding and current row) as v60,
    var_samp(r) over (partition by asset order by ts_us, seq rows between 59 preceding and 30 preceding) as old30,
  sum(r * r) over f as rr, sum(dt) over f as sdt, sum(r) over f as sr, count(*) over f as n
  from r
  where r is not null
  window f as (partition by asset order by ts_us, seq rows between 119 preceding and current row)),
q as (select *, case when n >= 120 and old30 > 0e0 then round(v60 / old30 + 1.234567e-9, 5) end as kappa from v)"""
sql_query("kappa_regime", KAPPA + f" select seq, asset, round(kappa + 1.234567e-9, 4) as kappa, {x.kappa_regime('kappa')} as regime, round({x.sigma_multiplier('coalesce(kappa, 1e0)')} + 1.234567e-9, 4) as mult from q")
sql_query("structural_alpha", KAPPA + f""", s as (select seq, asset, price, price * 1.001e0 as strike, 1.25e0 * sqrt(rr / sdt) * {x.sigma_multiplier('coalesce(kappa, 1e0)')} as sigma, 0e0 as mu,
    900e0 - (seq % 900) as tau
  from q
  where n >= 12),
z as (select seq, asset, {x.digital_z('price', 'strike', 'sigma', 'tau')} as z from s)
select seq, asset, round({x.digital_of('z')}, 7) as alpha_up from z""")
sql_query("per_minute_vol", """
with m as (select asset, cast(floor(ts_us / 3600000000e0) as bigint) as minute, max_by(price, ts_us) as close
  from ticks
  group by asset, cast(floor(ts_us / 3600000000e0) as bigint)),
r as (select asset, minute, case when close > 0e0 and lag(close) over w > 0e0 then close / lag(close) over w - 1e0 end as r,
    row_number() over (partition by asset order by minute desc) as back
  from m
  window w as (partition by asset order by minute))
select asset, count(r) as n, round(stddev_samp(r), 7) as vol from r where back <= 720 group by asset""")
VOL15 = f"""with m as (select asset, ts_us, seq, {SIMPLE} as r, row_number() over w as i from ticks window w as (partition by asset order by ts_us, seq)),
v as (select asset, cast(floor((i - 2) / 15e0) as bigint) as bin, stddev_samp(r) * sqrt(15e0) as vol, count(*) as n
  from m
  where r is not null
  group by asset, cast(floor((i - 2) / 15e0) as bigint)),
f as (select asset, bin, vol from v where n = 15)"""
sql_query("realized_vol_15m", VOL15 + " select asset, bin, round(vol, 7) as vol from f")
REG = VOL15 + """, o as (select *, row_number() over (partition by asset order by vol, bin) as i, count(*) over (partition by asset) as c from f),
e as (select asset, max(case when i = cast(floor(c / 3e0) as bigint) + 1 then vol end) as e1, max(case when i = cast(floor(c * 2 / 3e0) as bigint) + 1 then vol end) as e2
  from o
  group by asset),
g as (select f.asset, bin, vol, (case when vol >= e1 then 1 else 0 end) + (case when vol >= e2 then 1 else 0 end) as regime
  from f join e on f.asset = e.asset)"""
sql_query("vol_regimes", REG + " select asset, bin, regime from g")
sql_query("markov_vol_forecast", REG + """, t as (select asset, regime, lead(regime) over (partition by asset order by bin) as nxt from g),
c as (select asset, regime, nxt, count(*) as n from t where nxt is not null group by asset, regime, nxt),
a as (select distinct asset from g),
s as (select a.asset, i.v as regime, j.v as nxt from a cross join (values (0), (1), (2)) as i(v) cross join (values (0), (1), (2)) as j(v)),
p as (select s.asset, s.regime, s.nxt, (coalesce(n, 0) + 1e0) / (sum(coalesce(n, 0)) over (partition by s.asset, s.regime) + 3e0) as p
  from s left join c on s.asset = c.asset and s.regime = c.regime and s.nxt = c.nxt),
mv as (select asset, regime, avg(vol) as vol from g group by asset, regime)
select p.asset, p.regime, round(sum(p * coalesce(vol, 0e0)), 7) as expected_vol, R(-sum(p * ln(p)) / ln(3e0)) as entropy, R(1e0 + sum(p * ln(p)) / ln(3e0)) as confidence
  from p left join mv on p.asset = mv.asset and p.nxt = mv.regime
  group by p.asset, p.regime""")
sql_query("markov_qv", RET + """, s as (select asset, r, case when r >= 0e0 then 1 else 0 end as st, ts_us, seq from r where r is not null),
t as (select asset, r, st, coalesce(lead(st) over (partition by asset order by ts_us, seq), first_value(st) over (partition by asset order by ts_us, seq)) as nxt
  from s),
c as (select asset, sum(case when st = 1 and nxt = 1 then 1 else 0 end) as uu, sum(case when st = 1 and nxt = 0 then 1 else 0 end) as ud,
    sum(case when st = 0 and nxt = 1 then 1 else 0 end) as du, sum(case when st = 0 and nxt = 0 then 1 else 0 end) as dd,
  avg(abs(r)) as step, sum(r * r) as rv, count(*) as n from t group by asset),
p as (select asset, n, step, rv, uu / (uu + ud + 0e0) as a, dd / (dd + du + 0e0) as b from c where uu + ud > 0 and dd + du > 0)
select asset, n, R(a) as p_uu, R(b) as p_dd, round(rv, 6) as rv, round(n * step * step * greatest(0.25e0, (a + b) / greatest(2e0 - a - b, 1e-9)), 5) as markov_qv
  from p""")
sql_query("window_grid", """
select g.w as grid_s, asset, ts_us - ts_us % (cast(g.w as bigint) * 1000000) as window_us, count(*) as n, R(min_by(price, seq)) as open,
    R(max_by(price, seq)) as close, R(max(price)) as high, R(min(price)) as low
from ticks cross join (values (300), (900), (3600)) as g(w) group by g.w, asset, ts_us - ts_us % (cast(g.w as bigint) * 1000000)""")
sql_query("local_strike", """
with w as (select asset, g.w as grid_s, ts_us - ts_us % (cast(g.w as bigint) * 1000000) as window_us, ts_us, seq, price
  from ticks cross join (values (300), (900)) as g(w)),
f as (select *, row_number() over (partition by asset, grid_s, window_us order by ts_us, seq) as i from w where ts_us - window_us <= 25000000)
select asset, grid_s, window_us, seq, R(price) as strike from f where i = 1""")
sql_query("composite_price", """
with o as (select seq, asset, ts_us, price, case when k % 10 = 0 then price end as round_price from ticks),
a as (select *, LAST_SEEN(round_price) over w as anchor, LAST_SEEN(case when round_price is not null then price end) over w as tick_at_round
  from o
  window w as (partition by asset order by ts_us, seq rows between unbounded preceding and current row))
select seq, asset, R(case when anchor is null then price else anchor + (price - tick_at_round) end) as composite from a""")
sql_query("source_priority", """
with s as (select seq, asset, ts_us, price, case when user_id % 2 = 0 then 'coinbase' else 'binance' end as source from ticks),
l as (select *, LAST_SEEN(case when source = 'coinbase' then ts_us end) over (partition by asset order by ts_us,
    seq rows between unbounded preceding and 1 preceding) as last_cb
  from s)
select seq, asset, source from l where source = 'coinbase' or last_cb is null or ts_us - last_cb >= 1800000000""")
sql_query("transport_failover", """
with f as (select seq, asset, ts_us, case when ts_us - lag(ts_us) over (partition by asset order by ts_us, seq) <= 3600000000 then 1 else 0 end as fresh
  from ticks),
t as (select *, lag(fresh) over (partition by asset order by ts_us, seq) as was from f)
select asset, cast(sum(case when was = 1 and fresh = 0 then 1 else 0 end) as bigint) as to_rest,
    cast(sum(case when was = 0 and fresh = 1 then 1 else 0 end) as bigint) as to_md
  from t
  group by asset""")
@query("leadlag_ccf", oracle("""
with p as (select asset, user_id % 20 as m, ts_us, seq, price, k / 100e0 as mid from ticks),
r as (select asset, m, row_number() over w as i, case when price > 0e0 and lag(price) over w > 0e0 then ln(price / lag(price) over w) end as a, mid - lag(mid) over w as b
  from p
  window w as (partition by asset, m order by ts_us, seq)),
s as (select asset, m, avg(a) as ma, stddev_samp(a) as sa, avg(b) as mb, stddev_samp(b) as sb, count(*) as n
  from r
  where a is not null
  group by asset, m having count(*) >= 5),
z as (select r.asset, r.m, i, case when sa > 0e0 then (a - ma) / sa else 0e0 end as za, case when sb > 0e0 then (b - mb) / sb else 0e0 end as zb
  from r join s on r.asset = s.asset and r.m = s.m
  where a is not null),
c as (select l.k as lag_k, x.za, y.zb
  from z x cross join (values (-4), (-3), (-2), (-1), (0), (1), (2), (3), (4)) as l(k) join z y on x.asset = y.asset and x.m = y.m and y.i = x.i + l.k)
select lag_k, count(*) as n, R(corr(za, zb)) as ccf from c group by lag_k"""))
def _leadlag(spark, sf):
    """Correlation of returns with changes of the mid up to four rows away: neighbours come from one window, not from a join."""
    key = Window.partitionBy("asset", "m")
    w, lags = key.orderBy("ts_us", "seq"), range(-4, 5)
    p = view(spark, sf, "ticks").where("asset is not null and user_id is not null").selectExpr("asset", "user_id % 20 as m", "ts_us", "seq", "price", "k / 100e0 as mid")
    before = F.lag("price").over(w)
    r = p.withColumns({"a": F.when((F.col("price") > 0) & (before > 0), F.log(F.col("price") / before)), "b": F.col("mid") - F.lag("mid").over(w)})
    r = r.withColumn("b", F.when(F.col("a").isNotNull(), F.col("b")))
    r = r.withColumns({f"{how.__name__}_{c}": how(c).over(key) for c in ("a", "b") for how in (F.avg, F.stddev_samp)} | {"n": F.count("a").over(key)})
    z = lambda c: F.when(F.col(f"stddev_samp_{c}") > 0, (F.col(c) - F.col(f"avg_{c}")) / F.col(f"stddev_samp_{c}")).otherwise(0.0)
    r = r.withColumn("z", F.when(F.col("a").isNotNull() & (F.col("n") >= 5), F.struct(z("a").alias("a"), z("b").alias("b"))))
    r = r.select(F.col("z.a").alias("x"), *[F.lead("z", k).over(w).alias(f"y{k}") if k >= 0 else F.lag("z", -k).over(w).alias(f"y{k}") for k in lags]).where("x is not null")
    sums = r.agg(*[F.struct(F.count(F.col(f"y{k}")).alias("n"), F.corr("x", F.col(f"y{k}")["b"]).alias("ccf")).alias(f"s{k}") for k in lags])
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag_k"), F.col(f"s{k}.n").alias("n"), F.col(f"s{k}.ccf").alias("ccf")) for k in lags])).alias("s")).select("s.*")
    return rounded(out.where("n > 0"))



sql_query("build_features", f"""
with p as (select seq, asset, ts_us, ts_s, price, k, {SIMPLE} as r, abs(price - lag(price) over w) as step, row_number() over w as i
  from ticks
  window w as (partition by asset order by ts_us, seq)),
f as (select *, stddev_samp(r) over h as sd, count(r) over h as n, first_value(price) over h as p0, first_value(ts_s) over h as t0, sum(step) over h as path,
    price * (1e0 + (k - 50) / 1000e0) as strike, 60e0 + seq % 840 as tau
  from p
  window h as (partition by asset order by ts_us, seq rows between 199 preceding and current row)),
g as (select *, case when sd > 0e0 then sd else 1e-6 end as vol from f where i >= 5 and n >= 4 and price > 0e0 and p0 > 0e0)
select seq, asset, round(ln(price / strike) / (vol * sqrt(greatest(1e0, tau / greatest(1e0, (ts_s - t0) / greatest(1, n))))), 5) as z_dist,
    round(100e0 * (price - p0) / p0, 5) as momentum, round(100e0 * vol, 5) as realized_vol,
  round(case when path > 0e0 then abs(price - p0) / path else 0e0 end, 6) as efficiency, round(ln(tau / 60e0 + 1e-6), 7) as log_tau from g""")
# decayed sums in closed form: weight d ** (rows after this one)
sql_query("calib_decay", """
with b as (select cast(least(9, floor(p_cal * 10e0)) as bigint) as bucket, outcome_up as y,
    row_number() over (partition by least(9, floor(p_cal * 10e0)) order by ts_us desc, id desc, p_cal, outcome_up) - 1 as after
  from calib)
select bucket, count(*) as seen, round(power(0.995e0, count(*)) + sum(power(0.995e0, after)), 6) as n,
    round(0.5e0 * power(0.995e0, count(*)) + sum(y * power(0.995e0, after)), 6) as w
  from b
  group by bucket""")
sql_query("calib_deciles", """
with b as (select cast(least(9, floor(p_cal * 10e0)) as bigint) as bucket, outcome_up as y,
    row_number() over (partition by least(9, floor(p_cal * 10e0)) order by ts_us desc, id desc, p_cal, outcome_up) - 1 as after
  from calib)
select bucket, R(sum(y * power(0.995e0, after)) / sum(power(0.995e0, after))) as rate from b group by bucket""")
sql_query("cond_skill", f"""
with l as (select tf, {x.band('market_mid')} as cell, case when p_cal > market_mid then 'up' else 'dn' end as leg, outcome_up as y, ts_us, id, p_cal
  from calib),
r as (select *, row_number() over (partition by tf, cell, leg order by ts_us desc, id desc, p_cal, y) - 1 as after from l)
select tf, cell, leg, count(*) as seen, round(sum(power(0.99e0, after)), 6) as n, round(sum(y * power(0.99e0, after)), 6) as s
  from r
  group by tf, cell, leg""")
#: Running sums of returns, squares and spans whose weight halves in a day; what a row adds is not aged by its own span.
EWMA = decayed(["r", "rr", "dt"], lambda rows: 0.5 ** (rows["dt"].to_numpy(float) / 86400), ["s_r", "s_rr", "s_dt"])


def _drift_vol(spark, sf):
    """Decayed mean and volatility per second of each asset: the last row of a scan over its returns."""
    ticks = positions(view(spark, sf, "ticks").select("asset", "seq", "ts_us", "ts_s", "price"), BY, ORDER, **CUT)
    both = (F.col("price") > 0) & (F.col("before") > 0) & (F.col("ts_s") > F.col("since"))
    steps = windowed(ticks, BY, ORDER, lambda w: {"before": F.lag("price").over(w), "since": F.lag("ts_s").over(w)}, 1, at="i")
    # a row without a return or a span leaves the sums as they are
    r = F.when(both, F.log(F.col("price") / F.col("before")))
    steps = steps.select("asset", "i", r.alias("r"), (r * r).alias("rr"), F.when(both, F.col("ts_s") - F.col("since")).otherwise(0.0).alias("dt"))
    x = scan(steps, BY, ["i"], EWMA, None, at="i")
    last = x.groupBy("asset").agg(F.count("r").alias("n"), F.max_by(F.struct("s_r", "s_rr", "s_dt"), "i").alias("s")).where("n > 0")
    return last.selectExpr("asset", "n", "round(s.s_r / s.s_dt, 9) as mu", "round(sqrt(s.s_rr / s.s_dt), 7) as sigma")


query("ewma_drift_vol", oracle(RET + """, d as (select asset, r, dt, sum(dt) over (partition by asset order by ts_us desc, seq desc rows between unbounded preceding and current row) - dt as age
  from r
  where r is not null and dt > 0e0)
select asset, count(*) as n, round(sum(r * power(0.5e0, age / 86400e0)) / sum(dt * power(0.5e0, age / 86400e0)), 9) as mu,
    round(sqrt(sum(r * r * power(0.5e0, age / 86400e0)) / sum(dt * power(0.5e0, age / 86400e0))), 7) as sigma
  from d
  group by asset"""))(_drift_vol)
sql_query("alpha_backtest", f"""
with q as (select market, asset, seq, ts_us, underlying as price, {x.mid('up_bid', 'up_ask')} as mid,
    row_number() over (partition by market order by ts_us desc, seq desc) as back, count(*) over (partition by market) as n,
    case when underlying > 0e0 and lag(underlying) over (partition by market order by ts_us,
    seq) > 0e0 then ln(underlying / lag(underlying) over (partition by market order by ts_us, seq)) end as r,
    first_value(underlying) over (partition by market order by ts_us, seq) as strike,
  ts_us - lag(ts_us) over (partition by market order by ts_us, seq) as dt, (window_start_us + 86400000000 - ts_us) / 1e6 as tau from quotes),
v as (select market, sum(r * r) as rv, sum(dt) / 1e6 as span from q where n >= 12 and back > 3 and r is not null group by market),
e as (select q.market, q.price, q.strike, q.tau, q.mid, sqrt(v.rv / v.span) as sigma, o.close as fin
  from q join v on q.market = v.market join (select market, max_by(underlying, ts_us) as close
  from quotes
  group by market) o on q.market = o.market
  where q.back = 4 and v.rv > 0e0),
z as (select mid, case when fin > strike then 1 else 0 end as y, {x.digital_z('price', 'strike', 'sigma', 'greatest(tau, 1e0)')} as z from e),
p as (select mid, y, {x.digital_of('z')} as alpha from z)
select count(*) as n, R(avg((alpha - y) * (alpha - y))) as brier_alpha, R(avg((mid - y) * (mid - y))) as brier_mid,
    R(avg(-(y * ln(alpha) + (1 - y) * ln(1e0 - alpha)))) as logloss_alpha
  from p""")

query("seq_gaps", oracle("with s as (select asset, seq, lag(seq) over (partition by asset order by seq) as prev_seq from (select asset, row_number() over (partition by asset order by seq) * 1 as rn, seq from ticks where seq % 97 <> 0) t) select asset, seq, prev_seq, seq - prev_seq - 1 as missing from s where seq <> prev_seq + 1"))(
    lambda spark, sf: seq_gaps(view(spark, sf, "ticks").where("seq % 97 <> 0").select("asset", "seq"), ["asset"], "seq")
)
sql_query("transport_stats", "with s as (select asset, seq, lag(seq) over (partition by asset order by seq) as p, ts_us - lag(ts_us) over (partition by asset order by seq) as gap from ticks where seq % 97 <> 0) select asset, count(*) as messages, cast(sum(case when seq <> p + 1 then 1 else 0 end) as bigint) as gaps, cast(sum(case when gap > 15000000 then 1 else 0 end) as bigint) as fallbacks from s group by asset")
query("pivot_excursion", oracle("""
with p as (select market, seq, ts_us, coalesce(up_bid, 1e0 - up_ask) as bid, underlying, row_number() over (partition by market order by ts_us, seq) as i
  from quotes
  where coalesce(up_bid, 1e0 - up_ask) is not null),
t as (select market, max(bid) as top from p group by market),
a as (select p.market, min(i) as at_i from p join t on p.market = t.market where bid = top and bid > 0e0 group by p.market)
select p.market, coalesce(max(case when i = at_i then bid end), 0e0) as peak, min(bid) as trough, min(case when i >= at_i then bid end) as post_peak_low,
    max(case when i = at_i then underlying end) as peak_underlying, count(*) as n
  from p left join a on p.market = a.market
  group by p.market"""))(
    lambda spark, sf: excursions(view(spark, sf, "quotes").selectExpr("market", "seq", "ts_us", "coalesce(up_bid, 1e0 - up_ask) as bid", "underlying").where("bid is not null"), ["market"], ["ts_us", "seq"], "bid", ["underlying"])
)
