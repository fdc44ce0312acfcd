"""Preference formatting: one prompt from the longest common turn prefix, two masked completions; DataFrame functions only.

A turn is rendered as `<|role|>`, a newline, its text, `<|end|>` and a newline. Offsets of turns come from a running sum
over each conversation, so no step is quadratic in a conversation's turns; one shuffle on the pair serves the running
sum and the pairing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _render(t: Column) -> Column:
    return F.concat(_head(t["role"]), t["text"], F.lit("<|end|>\n"))


def preference(turns: DataFrame, train_on: str = "assistant") -> DataFrame:
    """turns(pair_id, side, conv_id, turn, role, text), side 'chosen' or 'rejected' -> one row per pair.

    pair_id, chosen_conv, rejected_conv, n_common (turns of the common prefix: same role and text), prompt (those turns,
    rendered once), chosen and rejected (the other turns, rendered), chosen_mask and rejected_mask (character spans
    [start, end) of the completion on which a model is trained: text and end mark of `train_on` turns).

    Turns are ordered by turn, then role and text. A null role is 'unknown', a null text empty. Repeated rows are turns
    of their own. A side that is missing is an empty conversation with a null conv_id: nothing is common then. If both
    sides are alike, both completions are empty. Rows with a null pair_id or another side belong to no pair. Extra columns are not read. A
    pair's turns come together in one row, as its texts do: a pair has to fit into a row of Spark (2 GB), else it fails.
    """
    t = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    t = t.select("pair_id", "side", "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    length = F.length(_head(F.col("role"))) + F.length("text") + F.length(F.lit("<|end|>\n"))
    before = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = t.repartition("pair_id").withColumn("at", F.coalesce(F.sum(length.cast("long")).over(before), F.lit(0)))
    item = F.struct("at", "role", "text")
    sides = [F.array_sort(F.collect_list(F.when(F.col("side") == s, item))).alias(s) for s in ("chosen", "rejected")]
    ids = [F.min(F.when(F.col("side") == s, F.col("conv_id"))).alias(f"{s}_conv") for s in ("chosen", "rejected")]
    x = t.groupBy("pair_id").agg(*ids, *sides)
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differ = F.array_position(same, False)
    x = x.withColumn("n_common", F.when(differ > 0, differ - 1).otherwise(F.size("chosen")).cast("long"))
    joined = lambda a: F.array_join(F.transform(a, _render), "")
    rest = lambda s: F.slice(s, (F.col("n_common") + 1).cast("int"), F.greatest(F.size(s) - F.col("n_common"), F.lit(0)).cast("int"))
    x = x.withColumns({"head": F.slice("chosen", F.lit(1), F.col("n_common").cast("int")), "chosen": rest("chosen"), "rejected": rest("rejected")})

    def mask(side: str) -> Column:
        base = F.get(side, F.lit(0))["at"]
        start = lambda t: t["at"] - base + F.length(_head(t["role"]))
        spans = F.filter(side, lambda t: t["role"] == train_on)
        return F.transform(spans, lambda t: F.struct(start(t).alias("start"), (start(t) + F.length(t["text"]) + 7).alias("end")))

    x = x.withColumns({"chosen_mask": mask("chosen"), "rejected_mask": mask("rejected"), "prompt": joined("head")})
    x = x.withColumns({"chosen": joined("chosen"), "rejected": joined("rejected")})
    return x.select("pair_id", "chosen_conv", "rejected_conv", "n_common", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


def alternatives(conversations: DataFrame, train_on: str = "assistant") -> DataFrame:
    """Pairs out of one table: a conversation is chosen; rejected is the same with its last `train_on` turn replaced by
    that of the conversation whose id is one higher, or without that turn where there is none.

    pair_id is the conversation's id; rows without one belong to no pair. A conversation without such a turn is paired
    with itself. Of turns with one number the greatest text is the last; repeated rows of it are all replaced.
    """
    t = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = t.where(F.col("role") == train_on).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    r = t.join(last, "conv_id", "left").join(other, "conv_id", "left")
    is_last = (F.col("role") == train_on) & F.col("turn").eqNullSafe(F.col("last.turn")) & (F.col("text") == F.col("last.text"))
    r = r.where(~is_last | F.col("other").isNotNull()).withColumn("text", F.when(is_last, F.col("other")).otherwise(F.col("text")))
    side = lambda df, name: df.select(F.col("conv_id").alias("pair_id"), F.lit(name).alias("side"), "conv_id", "turn", "role", "text")
    return side(t, "chosen").unionByName(side(r, "rejected"))


def report(conversations: DataFrame) -> DataFrame:
    """`preference` over each conversation and its alternative, spans as text `start-end,...`."""
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    x = preference(alternatives(conversations))
    return x.select("pair_id", "chosen_conv", "rejected_conv", "n_common", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


ORACLE = """
with t as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null),
last as (select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn desc nulls last, text desc) as k from t where role = 'assistant') where k = 1),
r as (select t.conv_id, t.turn, t.role, t.text, t.role = 'assistant' and t.turn is not distinct from l.turn and t.text = l.text as ends, o.text as other
  from t left join last l on t.conv_id = l.conv_id left join last o on o.conv_id = t.conv_id + 1),
e as (select conv_id as pair_id, 'c' as side, turn, role, text from t
  union all select conv_id, 'r', turn, role, case when coalesce(ends, false) then other else text end from r where not coalesce(ends, false) or other is not null),
w as (select *, '<|' || role || '|>' || chr(10) as head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as line from e),
o as (select *, coalesce(sum(length(line)) over (partition by pair_id, side order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as pos,
  row_number() over (partition by pair_id, side order by turn nulls first, role, text) as i from w),
d as (select c.pair_id, coalesce(min(case when r.i is null or r.role <> c.role or r.text <> c.text then c.i end) - 1, max(c.i)) as n
  from o c left join o r on r.pair_id = c.pair_id and r.side = 'r' and r.i = c.i where c.side = 'c' group by c.pair_id),
s as (select d.pair_id, n, o.side, o.i, o.role, o.text, o.head, o.line, pos - min(pos) over (partition by d.pair_id, o.side, i > n) as rel from d join o on o.pair_id = d.pair_id),
g as (select pair_id, n, max(case when side = 'r' then pair_id end) as rejected_conv, string_agg(line, '' order by i) filter (i <= n and side = 'c') as prompt, string_agg(line, '' order by i) filter (i > n and side = 'c') as chosen,
  string_agg(line, '' order by i) filter (i > n and side = 'r') as rejected,
  string_agg((rel + length(head))::bigint || '-' || (rel + length(head) + length(text) + 7)::bigint, ',' order by i) filter (i > n and side = 'c' and role = 'assistant') as chosen_mask,
  string_agg((rel + length(head))::bigint || '-' || (rel + length(head) + length(text) + 7)::bigint, ',' order by i) filter (i > n and side = 'r' and role = 'assistant') as rejected_mask
  from s group by pair_id, n)
select pair_id, pair_id as chosen_conv, rejected_conv, n::bigint as n_common, coalesce(prompt, '') as prompt, coalesce(chosen, '') as chosen, coalesce(rejected, '') as rejected,
  coalesce(chosen_mask, '') as chosen_mask, coalesce(rejected_mask, '') as rejected_mask from g
"""
