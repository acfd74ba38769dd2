"""Queries of this subpackage, with the SQL they are held against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fondaco.llm import consensus, linkage, nearest, neardup, packing, residue, scans, tokens
from fondaco.session import table

_FIELDS = [("model_a", "model_a_label"), ("model_b", "model_b_label"), ("judge_model", "judge_label")]


def _consensus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return consensus.consensus(table(spark, sf, "llm_resolver_result"), "massima_id", "id", "created_at", _FIELDS)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus(spark, sf)[0].where("n_labels > 1").select(F.col("item").alias("massima_id"), "label")


def p1_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus(spark, sf)[0].select(F.col("item").alias("massima_id"), "label", F.round("confidence", 6).alias("confidence"), F.round("agreement", 6).alias("agreement"))


def p1_models(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus(spark, sf)[1].select(F.col("annotator").alias("model"), F.round("competence", 6).alias("competence"), "votes")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_pairs(table(spark, sf, "massime"), "id", "testo_normalizzato", threshold=0.6, width=3)


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf, "massime"), "id", "testo_normalizzato", threshold=0.6, width=3)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.findings(table(spark, sf, "massime"), "id", "testo")


def p4_texts(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repair(table(spark, sf, "massime"), "id", "testo").select("id", "text")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.link(*(table(spark, sf, t) for t in ("normativa_altalex", "normativa", "work")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select(F.col("left_id").alias("altalex_id"), F.col("right_id").alias("normativa_id"))


def p5_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select(F.col("left_id").alias("altalex_id"), F.col("right_id").alias("brocardi_match_id"), F.round("confidence", 4).alias("brocardi_similarity"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.nearest_pairs(table(spark, sf, "normativa_chunk_embeddings"), "id", "model", "dims", "embedding").select("id_a", "id_b")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and the share of their room that is filled."""
    filled = packing.containers(table(spark, sf, "documents"), "doc_id", "text").where("container is not null")
    return filled.agg(F.countDistinct("container").alias("containers"), F.round(F.sum("n_tokens") / (4096 * F.countDistinct("container")), 4).alias("filled"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents"), "doc_id", "text", "source").select(F.col("id").alias("doc_id"))


def p10_kinds(spark: SparkSession, sf: str) -> DataFrame:
    found = residue.residue(table(spark, sf, "documents"), "doc_id", "text", "source")
    return found.select(F.col("id").alias("doc_id"), F.concat_ws(",", "kinds").alias("kinds"))


QUERIES = {"p1_found": p1_found, "p1_consensus": p1_consensus, "p1_models": p1_models, "p2_found": p2_found, "p2_groups": p2_groups, "p4_found": p4_found, "p4_texts": p4_texts, "p5_found": p5_found, "p5_confidence": p5_confidence, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_kinds": p10_kinds}
SQL: dict[str, str] = {
    "p2_found": r"""
        WITH w AS (SELECT id, regexp_extract_all(lower(testo_normalizzato), '[\p{L}\p{N}]+') AS w FROM massime WHERE testo_normalizzato IS NOT NULL),
        s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS s FROM w WHERE len(w) > 2),
        p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS n FROM s a JOIN s b ON a.id < b.id AND least(len(a.s), len(b.s)) >= 0.6 * greatest(len(a.s), len(b.s)))
        SELECT id_a, id_b FROM p WHERE c >= 0.6 * (n - c)""",
    "p7_found": """
        WITH v AS (SELECT id, model, embedding::DOUBLE[] AS x, sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS n
            FROM normativa_chunk_embeddings WHERE embedding IS NOT NULL AND len(embedding) = dims),
        g AS (SELECT * FROM v WHERE n > 0 AND NOT isnan(n) AND NOT isinf(n)),
        c AS (SELECT a.id AS a, b.id AS b, round(list_inner_product(a.x, b.x) / (a.n * b.n), 6) AS cos FROM g a JOIN g b ON a.model = b.model AND a.id <> b.id),
        r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS k FROM c WHERE cos >= 0.85)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= 5""",
}
