"""Scores of probability forecasts as functions of a DataFrame: any columns, any grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brier(p: str, y: str) -> Column:
    """Mean squared error, as an aggregate."""
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def logloss(p: str, y: str, eps: float = 1e-6) -> Column:
    """Mean negative log-likelihood of probabilities kept `eps` from 0 and 1, as an aggregate."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1.0) - F.lit(eps))
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def forecast_scores(df: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """n, brier, logloss, mean_p and base_rate of each group; rows without a forecast or an outcome don't count."""
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), brier(p, y).alias("brier"), logloss(p, y).alias("logloss"), F.avg(p).alias("mean_p"), F.avg(y).alias("base_rate"))


def auc(df: DataFrame, by: list[str], p: str = "p", y: str = "y", buckets: int = 4096) -> DataFrame:
    """Area under the ROC curve of each group, ties as one half; null where a class is missing.

    Rows are counted per distinct score first. Scores are cut to `buckets` ranges of [0, 1], whose counts are summed up
    one row a range, and each range runs on its own from there: no task sees all scores of a group.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    c = rows.groupBy(*by, F.col(p).alias("__p")).agg(F.sum(y).alias("__pos"), (F.count("*") - F.sum(y)).alias("__neg"))
    c = c.withColumn("__b", F.least(F.greatest(F.floor(F.col("__p") * buckets), F.lit(0)), F.lit(buckets)))
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = c.groupBy(*by, "__b").agg(F.sum("__neg").alias("__s")).select(*[F.col(k).alias(f"__k_{k}") for k in by], F.col("__b").alias("__kb"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by], F.col("__b") == F.col("__kb"))
    inside = Window.partitionBy(*by, "__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__before") + F.coalesce(F.sum("__neg").over(inside), F.lit(0))
    wins = c.join(sums, same).withColumn("__w", F.col("__pos") * (below + F.col("__neg") / 2))
    pos, neg = F.sum("__pos"), F.sum("__neg")
    return wins.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), F.sum("__w") / (pos * (neg + F.lit(0.0)))).alias("auc"))


def auc_by_rank(df: DataFrame, by: list[str], order: list[str], y: str = "y") -> DataFrame:
    """Area under the ROC curve from ranks in `order`, without regard to ties."""
    ranked = df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    pos, neg = F.sum(y), F.count("*") - F.sum(y)
    ranks = F.sum(F.when(F.col(y) == 1, F.col("__i")).otherwise(0))
    return ranked.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), (ranks - pos * (pos + 1) / 2) / (pos * (neg + F.lit(0.0)))).alias("auc"))


def reliability(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """(bin, n, mean_pred, mean_actual) of equal bins, the last closed; empty bins have zeros."""
    rows = df.where(F.col(p).isNotNull())
    g = rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(g, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(0.0)).alias("mean_pred"), F.coalesce("y", F.lit(0.0)).alias("mean_actual"))


def edge_buckets(df: DataFrame, edge: Column, edges: list[float], p: str, y: str, price: str, fee: Column) -> DataFrame:
    """Results by buckets [e_i, e_i+1) of `edge`: n, wins, avg_pred, win_rate, net_taker (after `fee`) and net_maker."""
    names = [f"[{a:g}, {b:g})" for a, b in zip(edges[:-1], edges[1:], strict=True)]
    case = reduce(lambda c, k: c.when((edge >= edges[k]) & (edge < edges[k + 1]), names[k]), range(1, len(names)), F.when((edge >= edges[0]) & (edge < edges[1]), names[0]))
    won = F.col(y) - F.col(price)
    return df.withColumn("bucket", case).where("bucket is not null").groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum(y).cast("long").alias("wins"), F.avg(p).alias("avg_pred"), F.avg(y).alias("win_rate"), F.avg(won - fee).alias("net_taker"), F.avg(won).alias("net_maker")
    )


def scorecard(df: DataFrame, who: str = "who", p: str = "p", y: str = "y", benchmark: str = "market", least: int = 30) -> DataFrame:
    """All scores of each forecaster and a verdict against the benchmark's Brier score, from `least` rows on."""
    m = forecast_scores(df, [who], p, y).join(auc(df, [who], p, y), who)
    market = m.where(F.col(who) == benchmark).agg(F.max("brier").alias("__market"))  # one row
    verdict = F.when(F.col("n") < least, "collecting").when(F.col(who) == benchmark, "benchmark").when(F.col("brier") < F.col("__market"), "beats market").otherwise("behind market")
    return m.join(F.broadcast(market)).withColumn("ready", F.col("n") >= least).withColumn("verdict", verdict).drop("__market")
