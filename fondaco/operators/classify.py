"""Classifiers: keyword rules, centroids, merged label votes, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fondaco.functions import similarity as sim

#: Labels that centroids are made for; more are refused, as every row meets every centroid.
LABELS = 1_000


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): mean vector by label, averaged position by position with partial sums."""
    parts = rows.select(label, F.posexplode(vector).alias("_i", "_x")).groupBy(label, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s._m).alias("centroid"))


def nearest_centroid(rows: DataFrame, key: str, vector: str, centers: DataFrame, label: str) -> DataFrame:
    """(key, label, score, delta): the best centroid by cosine and its lead over the second.

    There are as many centroids as labels, a configured set of LABELS at most; each row meets all of them.
    """
    if centers.limit(LABELS + 1).count() > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    scored = rows.select(key, vector).join(F.broadcast(centers)).select(key, label, F.round(sim.cosine(F.col(vector), F.col("centroid")), 6).alias("score"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), label)
    top = scored.withColumn("_n", F.row_number().over(best)).where("_n <= 2")
    first, second = F.max(F.when(F.col("_n") == 1, F.col("score"))), F.max(F.when(F.col("_n") == 2, F.col("score")))
    return top.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col(label))).alias(label), first.alias("score"), (first - F.coalesce(second, F.lit(0.0))).alias("delta"))


def keyword_scores(words: Column, lists: dict[str, list[str]]) -> Column:
    """Map of list name to the number of a text's distinct words that are on it."""
    return F.map_from_arrays(F.array(*map(F.lit, lists)), F.array(*[F.size(F.array_intersect(words, F.array(*map(F.lit, w)))) for w in lists.values()]))


def best_label(scores: Column, order: list[str]) -> Column:
    """The label of the highest score above zero; ties to the label listed first."""
    best = F.array_max(F.map_values(scores))
    first = F.filter(F.array(*map(F.lit, order)), lambda k: F.element_at(scores, k) == best)[0]
    return F.when(best > 0, first)


def merge_votes(a: Column, pa: Column, b: Column, pb: Column, judge: Column) -> Column:
    """Label, confidence and acceptance from two voters and a judge: agreement raises, a judge's word lowers confidence."""
    agree = a == b
    strongest = F.greatest(F.coalesce(pa, F.lit(0.0)), F.coalesce(pb, F.lit(0.0)))
    confidence = F.when(agree, F.least(strongest * 1.1, F.lit(0.98))).when(judge.isNotNull(), strongest * 0.9).otherwise(strongest * 0.5)
    label = F.when(agree, a).otherwise(F.coalesce(judge, F.when(F.coalesce(pa, F.lit(0.0)) >= F.coalesce(pb, F.lit(0.0)), a).otherwise(b)))
    return F.struct(label.alias("label"), F.round(confidence, 4).alias("confidence"), (F.round(confidence, 4) >= 0.7).alias("accepted"))


def calibrate(score: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear interpolation between thresholds, flat beyond both ends."""
    out = F.when(score <= xs[0], ys[0])
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(score <= x1, F.lit(y0) + (score - x0) * (F.lit(y1 - y0) / F.lit(x1 - x0 or 1.0)))
    return out.when(score > xs[-1], ys[-1])


def isotonic_fit(rows: DataFrame, score: str, outcome: str) -> tuple[list[float], list[float]]:
    """Thresholds of an isotonic calibration by pooled adjacent violators; their number is that of distinct pooled steps."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    at = VectorAssembler(inputCols=[score], outputCol="_f").transform(rows.select(score, F.col(outcome).cast("double").alias("_y")))
    model = IsotonicRegression(featuresCol="_f", labelCol="_y").fit(at)
    return model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()
