"""Forecast metrics: Brier, log-loss, AUC, reliability, edge buckets and the calibration scorecard."""

from pyspark.sql import functions as F

from tidemark.functions import expressions as x
from tidemark.operators import scores
from tidemark.plans.dialect import oracle, render, rounded, sql_query, view
from tidemark.registry import query

P = x.clamp("p", "1e-6", "1e0 - 1e-6")
BRIER = "avg((p - y) * (p - y))"
LOGLOSS = f"avg(-(y * ln({P}) + (1 - y) * ln(1e0 - {P})))"
#: Newest rows that count, spread to one row per forecaster.
LONG = """with newest as (select * from calib order by ts_us desc, id desc limit 8000),
f as (select k.who as who, id, outcome_up as y, case k.who when 'market' then market_mid when 'ensemble' then p_cal else alpha_up end as p
  from newest cross join (values ('market'), ('ensemble'), ('structural')) as k(who)),
g as (select * from f where p is not null)"""
#: Midrank AUC from counts per distinct score: exact, and no row order matters.
AUC = """, c as (select who, p, sum(y) as pos, count(*) - sum(y) as neg from g group by who, p),
r as (select who, pos, neg, coalesce(sum(neg) over (partition by who order by p rows between unbounded preceding and 1 preceding), 0) as below
  from c),
a as (select who, case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (below + neg / 2e0)) / (sum(pos) * (sum(neg) + 0e0)) end as auc
  from r
  group by who)"""


def _forecasts(spark, sf):
    """(who, id, y, p) of the newest rows."""
    return spark.sql(render(LONG + " select who, id, y, p from g", "spark", sf))


query("brier", oracle(LONG + f" select who, count(*) as n, R({BRIER}) as brier from g group by who"))(lambda spark, sf: rounded(scores.forecast_scores(_forecasts(spark, sf), ["who"]).select("who", "n", "brier")))
query("logloss", oracle(LONG + f" select who, count(*) as n, R({LOGLOSS}) as logloss from g group by who"))(lambda spark, sf: rounded(scores.forecast_scores(_forecasts(spark, sf), ["who"]).select("who", "n", "logloss")))
query("auc_midrank", oracle(LONG + AUC + " select who, R(auc) as auc from a"))(lambda spark, sf: rounded(scores.auc(_forecasts(spark, sf), ["who"])))
query("auc_ordinal", oracle(LONG + """, r as (select who, y, row_number() over (partition by who order by p, id) as i from g),
s as (select who, sum(case when y = 1 then i else 0 end) as ranks, sum(y) as pos, count(*) - sum(y) as neg from r group by who)
select who, R(case when pos > 0 and neg > 0 then (ranks - pos * (pos + 1) / 2e0) / (pos * (neg + 0e0)) end) as auc from s"""))(lambda spark, sf: rounded(scores.auc_by_rank(_forecasts(spark, sf), ["who"], ["p", "id"])))
query("calibration_scorecard", oracle(LONG + AUC + f""", m as (select who, count(*) as n, {BRIER} as brier, {LOGLOSS} as logloss, avg(p) as mean_p, avg(y) as base_rate from g group by who),
b as (select max(case when who = 'market' then brier end) as market from m)
select m.who, m.n, R(brier) as brier, R(logloss) as logloss, R(auc) as auc, R(mean_p) as mean_p, R(base_rate) as base_rate, m.n >= 30 as ready,
  case when m.n < 30 then 'collecting' when m.who = 'market' then 'benchmark' when brier < market then 'beats market' else 'behind market' end as verdict
from m join a on m.who = a.who cross join b"""))(lambda spark, sf: rounded(scores.scorecard(_forecasts(spark, sf)).select("who", "n", "brier", "logloss", "auc", "mean_p", "base_rate", "ready", "verdict")))
sql_query("directional_skill", """
with l as (select case when p_cal > market_mid then 'up' when p_cal < market_mid then 'down' else 'none' end as lean, outcome_up, abs(p_cal - market_mid) as gap
  from calib)
select lean, count(*) as n, R(avg(outcome_up)) as up_rate, R(avg(gap)) as gap from l group by lean""")
query("reliability_table", oracle(f"""
with b as (select cast(least(floor(p_cal * 10e0), 9) as bigint) as bin, p_cal as p, outcome_up as y from calib),
g as (select bin, count(*) as n, avg(p) as p, avg(y) as y from b group by bin)
select cast(k.bin as bigint) as bin, coalesce(n, 0) as n, R(coalesce(p, 0e0)) as mean_pred, R(coalesce(y, 0e0)) as mean_actual
  from (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) as k(bin) left join g on g.bin = k.bin"""))(lambda spark, sf: rounded(scores.reliability(view(spark, sf, "calib"), "p_cal", "outcome_up")))
EDGES = ["-1e0", "-0.04e0", "-0.02e0", "0e0", "0.02e0", "0.04e0", "1e0"]
CASES = " ".join(f"when edge >= {a} and edge < {b} then '[{float(a):g}, {float(b):g})'" for a, b in zip(EDGES[:-1], EDGES[1:], strict=True))
query("edge_buckets", oracle(f"""
with e as (select p_cal - market_mid as edge, p_cal, market_mid, outcome_up from calib), b as (select case {CASES} end as bucket, * from e)
select bucket, count(*) as n, cast(sum(outcome_up) as bigint) as wins, R(avg(p_cal)) as avg_pred, R(avg(outcome_up)) as win_rate,
    R(avg(outcome_up - market_mid - {x.taker_fee('market_mid')})) as net_taker, R(avg(outcome_up - market_mid)) as net_maker
from b where bucket is not null group by bucket"""))(
    lambda spark, sf: rounded(scores.edge_buckets(view(spark, sf, "calib"), F.col("p_cal") - F.col("market_mid"), [float(e) for e in EDGES], "p_cal", "outcome_up", "market_mid", F.expr(x.taker_fee("market_mid"))))
)
sql_query("pred_side_skill", """
select asset, cast(sum(case when p_cal >= 0.5e0 then 1 else 0 end) as bigint) as up_calls,
    cast(sum(case when p_cal >= 0.5e0 and outcome_up = 1 then 1 else 0 end) as bigint) as up_hits,
  cast(sum(case when p_cal < 0.5e0 then 1 else 0 end) as bigint) as down_calls,
    cast(sum(case when p_cal < 0.5e0 and outcome_up = 0 then 1 else 0 end) as bigint) as down_hits
  from calib
  group by asset""")
sql_query("calib_by_band", """
with b as (select case when abs(market_mid - 0.5e0) < 0.1e0 then '0.0-0.1' when abs(market_mid - 0.5e0) < 0.2e0 then '0.1-0.2' when abs(market_mid - 0.5e0) < 0.3e0 then '0.2-0.3' else '0.3+' end as band, *
  from calib)
select band, count(*) as n, R(avg((p_cal - outcome_up) * (p_cal - outcome_up))) as model, R(avg((market_mid - outcome_up) * (market_mid - outcome_up))) as market
  from b
  group by band""")
K = x.kelly("greatest(p_cal, 1e0 - p_cal)", "price", "0.25e0", "1e0")
sql_query("kelly_roi", f"""
with t as (select p_cal, case when p_cal > market_mid then market_mid else 1e0 - market_mid end as price,
    case when p_cal > market_mid then outcome_up else 1 - outcome_up end as won
  from calib
  where abs(p_cal - market_mid) > 0.01e0),
f as (select *, {K} as f from t)
select count(*) as n, R(avg(f)) as fraction, R(sum(f * (won - price)) / nullif(sum(f * price), 0e0)) as roi from f""")
sql_query("transition_entropy", """
with s as (select asset, regime, lead(regime) over (partition by asset order by ts_us, id) as nxt from decisions),
c as (select regime, nxt, count(*) as n from s where nxt is not null group by regime, nxt),
p as (select regime, n / (sum(n) over (partition by regime) + 0e0) as p, count(*) over (partition by regime) as k from c)
select regime, R(-sum(p * ln(p)) / ln(greatest(2e0, max(k)))) as entropy, max(k) as states from p group by regime""")
sql_query("regime_transitions", """
with s as (select asset, regime, lead(regime) over (partition by asset order by ts_us, id) as nxt from decisions),
c as (select regime, nxt, count(*) as n from s where nxt is not null group by regime, nxt)
select regime, nxt, n, R((n + 1e0) / (sum(n) over (partition by regime) + count(*) over (partition by regime))) as p from c""")
sql_query("label_quality", "select quality, toxic, count(*) as n from labels group by quality, toxic")
