"""Sources and payload parsing: candles, quotes, books, ladders, hex rounds, topics; also sampling of files."""

from pyspark.sql import functions as F

from tidemark.operators.ordered import systematic_sample
from tidemark.plans.dialect import oracle, sql_query, view
from tidemark.registry import query

sql_query("candles_scan", "select asset, cast(floor(ts_us / 3600000000e0) as bigint) * 3600 as epoch, R(min_by(price, seq)) as open, R(max_by(price, seq)) as close, count(*) as volume from ticks where ts_us >= (select min(ts_us) + 86400000000 from ticks) group by asset, cast(floor(ts_us / 3600000000e0) as bigint) * 3600")
sql_query("quote_scan", "select seq, venue, asset, R(up_bid) as bid, R(up_ask) as ask, seq % 5 as kind from quotes where abs((case when seq % 5 = 0 then 900 else 3600 end) - 900) <= 1")
sql_query("settled_projection", "select id, concat('run', cast(id % 3 as string)) as run, asset, venue, side, R(coalesce(case when id % 4 = 0 then null else fill_price end, 0.5e0)) as entry_price, R(coalesce(pnl, 0e0)) as realized_pnl from settlements where filled = 1")
query("systematic_sample", oracle("select asset, seq from (select asset, seq, row_number() over (partition by asset order by seq) as i from ticks) t where i % 7 = 0 and i <= 7 * 100"))(
    lambda spark, sf: systematic_sample(view(spark, sf, "ticks").select("asset", "seq"), ["asset"], ["seq"], 7, 100)
)
sql_query("tick_fallback", """
with s as (select seq, asset, ts_us - ts_us % 60000000 as minute, price, case when user_id % 2 = 0 then 'coinbase' else 'binance' end as source
  from ticks),
g as (select asset, minute, max_by(price, case when source = 'coinbase' then seq end) as cb, max_by(price, case when source = 'binance' then seq end) as bn,
  cast(sum(case when source = 'coinbase' then 1 else 0 end) as bigint) as ncb, cast(sum(case when source = 'binance' then 1 else 0 end) as bigint) as nbn
  from s
  group by asset, minute)
select asset, minute, R(coalesce(case when ncb > 0 then cb end, case when nbn > 0 then bn end)) as price, case when ncb > 0 then 'coinbase' else 'binance' end as source
  from g""")
sql_query("topic_prefix_filter", "select seq, concat('tick.', asset, '.', cast(user_id as string)) as topic from ticks where concat('tick.', asset) like 'tick.p%'")
sql_query("topic_parse", "select seq, split_part(t, '.', 1) as kind, split_part(t, '.', 2) as venue, substr(t, length(split_part(t, '.', 1)) + length(split_part(t, '.', 2)) + 3) as market from (select seq, concat('book.', case when user_id % 2 = 0 then 'poly' else 'kalshi' end, '.', asset, '.', cast(user_id as string)) as t from ticks) x")
sql_query("lane_config", "select name, data_dir, flags from (values ('lane_a', 'forward_live_a', '--mode conditional'), ('lane_b', 'forward_live_b', '--kelly')) as c(name, data_dir, flags)")
sql_query("lanes_scan", "select asset as lane, max(ts_us) as updated_us, round(1000e0 + sum(coalesce(pnl, 0e0)), 4) as equity, count(*) as open_positions from settlements group by asset")
sql_query("calib_clamp", """
with c as (select cast(least(9, floor(p_cal * 10e0)) as bigint) as b, count(*) + 0e0 as n, sum(outcome_up) + 0e0 as w
  from calib
  group by cast(least(9, floor(p_cal * 10e0)) as bigint))
select b, R(least(n, 200e0)) as n, R(w * least(n, 200e0) / n) as w from c""")
BOOK = """with o as (select o_orderkey as id, 0.30e0 + o_custkey % 40 / 100e0 as y0, 0.28e0 + o_custkey % 37 / 100e0 as y1, 0.25e0 + o_orderkey % 30 / 100e0 as n0,
    0.20e0 + o_orderkey % 45 / 100e0 as n1, o_orderkey % 50 + 1e0 as s0, o_custkey % 60 + 1e0 as s1
  from orders)"""
sql_query("book_top_kalshi", BOOK + " select id, R(greatest(y0, y1)) as up_bid, R(1e0 - greatest(n0, n1)) as up_ask, R(case when y0 >= y1 then s0 else s1 end) as up_bid_size, R(case when n0 >= n1 then s1 else s0 end) as up_ask_size from o")
sql_query("book_top_poly", BOOK + " select id, R(greatest(y0, y1)) as bid, R(least(1e0 - n0, 1e0 - n1)) as ask, R(case when y0 = greatest(y0, y1) then s0 when y1 = greatest(y0, y1) then s1 else 0e0 end) as bid_size from o")
sql_query("strike_regex", "select c_custkey, cast(nullif(regexp_extract(concat('KXBTC-25-T', cast(c_custkey * 25 as string), '.5'), '-T([0-9.]+)$', 1), '') as double) as strike, cast(nullif(regexp_extract(concat('bitcoin-above-', cast(c_custkey as string), '-on-may'), 'above-([0-9.]+)-on', 1), '') as double) as ladder from customer")
sql_query("ladder_parse", "select c_custkey, regexp_extract(s, '^([a-z]+)-above', 1) as asset, cast(nullif(regexp_extract(s, 'above-([0-9]+)k-on', 1), '') as bigint) * 1000 as strike from (select c_custkey, concat(lower(c_mktsegment), '-above-', cast(c_custkey as string), 'k-on-june') as s from customer) c")
sql_query("slug_build", "select n_nationkey, concat(lower(n_name), '-updown-15m-', cast(1700000000 + n_nationkey * 900 as string)) as slug from nation")
sql_query("json_first", "select event_id, JSON_INT(props, 'k') as k from events")
sql_query("topic_counts", "select asset, count(distinct user_id) as users, count(*) as n from ticks group by asset")
query("iso_parse", "select o_orderkey, case when o_orderkey % 10 = 0 then 0e0 else epoch_us(o_orderdate) / 1e6 end as epoch from orders")(
    lambda spark, sf: spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit("not a time")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("iso"))
    .select("o_orderkey", F.coalesce(F.expr("unix_micros(try_to_timestamp(iso, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")) / 1e6"), F.lit(0.0)).alias("epoch"))
)

def hex_low(word: str):
    """The low 64 bits of a hex word as a decimal."""
    return F.conv(F.substring(word, -16, 16), 16, 10).cast("decimal(38,0)")


#: 32-byte words in hex: the low 16 digits hold the value, the first digit tells the sign.
query("hex_decode", "select o_orderkey, o_custkey / 1e8 * case when o_orderkey % 5 = 0 and o_custkey > 0 then -1 else 1 end as price, o_orderkey as updated_at from orders")(
    lambda spark, sf: spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when((F.col("o_orderkey") % 5 == 0) & (F.col("o_custkey") > 0), F.concat(F.lit("f" * 48), F.lpad(F.hex(-F.col("o_custkey")), 16, "f"))).otherwise(F.lpad(F.hex("o_custkey"), 64, "0")).alias("answer"), F.lpad(F.hex("o_orderkey"), 64, "0").alias("updated"))
    .select("o_orderkey", (F.when(F.substring("answer", 1, 1) == "f", hex_low("answer") - F.lit(2).cast("decimal(38,0)") * F.lit(2**62) * 2).otherwise(hex_low("answer")).cast("double") / 1e8).alias("price"), hex_low("updated").cast("long").alias("updated_at"))
)

