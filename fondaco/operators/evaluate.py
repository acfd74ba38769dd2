"""Ranking quality and calibration, as aggregations over (query_id, id, rank) and (query_id, id) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ranking_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, precision, mrr, ndcg, noise) at k of every query with a truth; a query without results scores 0."""
    wanted = truth.groupBy("query_id").agg(F.count("*").alias("_wanted"))
    hits = ranked.where(F.col("rank") <= k).join(truth.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    gain = F.sum(F.when(F.col("_hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    told = hits.groupBy("query_id").agg(F.count("_hit").alias("_hits"), F.count("*").alias("_seen"), F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("_first"), gain.alias("_gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    j = wanted.join(told, "query_id", "left").na.fill(0, ["_hits", "_seen"]).na.fill(0.0, ["_gain"])
    r6 = lambda c: F.round(c, 6)
    return j.select(
        "query_id", r6(F.col("_hits") / F.col("_wanted")).alias("recall"), r6(F.col("_hits") / k).alias("precision"), r6(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        r6(F.col("_gain") / ideal).alias("ndcg"), r6(F.when(F.col("_seen") > 0, 1 - F.col("_hits") / F.col("_seen")).otherwise(0.0)).alias("noise"),
    )


def calibration_error(rows: DataFrame, confidence: Column, right: Column, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over bins (low, high]."""
    at = F.greatest(F.ceil(confidence * bins), F.lit(1))
    told = rows.where(confidence.isNotNull()).groupBy(at.alias("_b")).agg(F.count("*").alias("_n"), F.avg(confidence).alias("_c"), F.avg(right.cast("double")).alias("_a"))
    return told.agg(F.round(F.sum(F.abs(F.col("_a") - F.col("_c")) * F.col("_n")) / F.sum("_n"), 6).alias("ece"))


def gates(measures: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row of measures with ``failed``, the names of the gates it misses."""
    return measures.withColumn("failed", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])))
