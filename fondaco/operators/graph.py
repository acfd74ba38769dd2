"""Graph operators over edge tables (source, target, weight): bounded expansion, boosts, hierarchies.

Expansion is a loop of equi-joins whose depth is a parameter; after each step a node keeps its best path only, so the frontier
never holds more than one row a start and node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fondaco.functions import similarity as sim
from fondaco.operators.relational import sharing_pairs
from fondaco.session import materialise


def neighbors(seeds: DataFrame, edges: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """(start, node, depth, weight): nodes within ``depth`` directed steps, at their least depth with the best last edge."""
    strong = edges.where(F.col("weight") >= least).select(F.col("source").alias("node"), F.col("target").alias("next"), "weight")
    frontier = seeds.select(F.col("id").alias("start"), F.col("id").alias("node"))
    found = None
    for step in range(1, depth + 1):
        reached = frontier.join(strong, "node").groupBy("start", F.col("next").alias("node")).agg(F.max("weight").alias("weight")).where("node <> start")
        if found is not None:
            reached = reached.join(found.select("start", "node"), ["start", "node"], "left_anti")
        reached = reached.withColumn("depth", F.lit(step))
        found = reached if found is None else found.unionByName(reached)
        frontier = reached.select("start", "node")
    return found.select("start", "node", "depth", "weight")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))


def expand(seeds: DataFrame, edges: DataFrame, depth: int, least: float, decay: float = 0.3) -> DataFrame:
    """(start, node, length, total, score): undirected expansion; a path's total is the sum of its weights, its score total / (1 + decay * length)."""
    strong = both_ways(edges).where(F.col("weight") >= least).select(F.col("source").alias("node"), F.col("target").alias("next"), "weight")
    paths = seeds.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("total"))
    out = None
    for step in range(1, depth + 1):
        paths = paths.join(strong, "node").groupBy("start", F.col("next").alias("node")).agg(F.max(F.col("total") + F.col("weight")).alias("total")).where("node <> start")
        here = paths.withColumn("length", F.lit(step))
        out = here if out is None else out.unionByName(here)
    scored = out.withColumn("score", F.col("total") / (1 + decay * F.col("length")))
    return scored.groupBy("start", "node").agg(F.max_by(F.struct("length", "total", "score"), F.struct("score", -F.col("length"))).alias("b")).select("start", "node", "b.*")


def boost(seeds: Column, mean_type_weight: Column, total: Column, depth: Column, factor: float = 0.15, decay: float = 0.7) -> Column:
    """factor * (0.4 min(0.3 seeds, 1) + 0.3 min(type weight, 1.5) + 0.3 min(total / 2, 1)) * decay^(depth - 1)."""
    cap = lambda c, most: F.least(c, F.lit(most))
    return factor * (0.4 * cap(seeds * 0.3, 1.0) + 0.3 * cap(mean_type_weight, 1.5) + 0.3 * cap(total / 2.0, 1.0)) * F.pow(F.lit(decay), depth - 1)


def expand_from(seeds: DataFrame, edges: DataFrame, least: float, most: int = 50, decay: float = 0.7) -> DataFrame:
    """(node, seeds, total, depth): what lies one or two undirected steps from the seeds taken together.

    Seeds and their weights add up over the edges of the first step; the ``most`` nodes of greatest weight are expanded once
    more, each passing on its seeds, with weights times ``decay``. Seeds are no answers.
    """
    strong = both_ways(edges).where(F.col("weight") >= least)
    is_seed = seeds.select(F.col("id").alias("target"))
    one = strong.join(seeds.select(F.col("id").alias("source")), "source", "left_semi").join(is_seed, "target", "left_anti").select(F.col("target").alias("node"), F.col("source").alias("seed"), "weight")
    kept = one.groupBy("node").agg(F.round(F.sum("weight"), 6).alias("w")).orderBy(F.desc("w"), "node").limit(most).select(F.col("node").alias("source"))
    two = strong.join(kept, "source", "left_semi").join(is_seed, "target", "left_anti").join(kept.withColumnRenamed("source", "target"), "target", "left_anti")
    two = two.select(F.col("target").alias("node"), F.col("source").alias("via"), (F.col("weight") * decay).alias("weight"))
    passed = two.select("node", "via").join(one.select(F.col("node").alias("via"), "seed"), "via").select("node", "seed")
    reached = one.select("node", "weight", F.lit(1).alias("depth")).unionByName(two.select("node", "weight", F.lit(2).alias("depth")))
    weights = reached.groupBy("node").agg(F.round(F.sum("weight"), 6).alias("total"), F.min("depth").alias("depth"))
    of = one.select("node", "seed").unionByName(passed).distinct().groupBy("node").agg(F.count("*").alias("seeds"))
    return weights.join(of, "node").select("node", "seeds", "total", "depth")


def same_principle(norms: DataFrame, vectors: DataFrame, years: DataFrame, shared: int = 2, cosine: float = 0.85) -> DataFrame:
    """(a, b, overlap, cosine, weight): rows that share two norms or more and whose vectors are alike.

    norms: (id, norm_id), vectors: (id, vec), years: (id, year).
    """
    pairs = sharing_pairs(norms, "id", "norm_id", shared)
    side = lambda c: vectors.join(years, "id").select(F.col("id").alias(c), F.col("vec").alias(f"v{c}"), F.col("year").alias(f"y{c}"))
    told = pairs.withColumnRenamed("shared", "overlap").join(side("a"), "a").join(side("b"), "b").withColumn("cosine", F.round(sim.cosine(F.col("va"), F.col("vb")), 6))
    told = told.where(F.col("cosine") >= cosine)
    return told.select("a", "b", "overlap", "cosine", F.round(edge_weight(F.col("overlap"), F.col("cosine"), F.coalesce(F.col("ya") - F.col("yb"), F.lit(0))), 4).alias("weight"))


def ancestors(nodes: DataFrame, parents: DataFrame, depth: int = 6) -> DataFrame:
    """(start, ancestor, level): the chain above each node, by at most ``depth`` joins."""
    chain = nodes.select(F.col("id").alias("start"), F.col("id").alias("node"))
    out = None
    for level in range(1, depth + 1):
        chain = chain.join(parents.select(F.col("id").alias("node"), "parent"), "node").where("parent is not null").select("start", F.col("parent").alias("node"))
        here = chain.select("start", F.col("node").alias("ancestor"), F.lit(level).alias("level"))
        out = here if out is None else out.unionByName(here)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(source, target): every pair joined by a path, each once. A round extends the pairs that were new in the round before; it ends with a round that finds none."""
    steps = edges.select("source", "target").distinct()
    known = fresh = materialise(steps, "closure")
    while not fresh.isEmpty():
        further = fresh.join(steps.select(F.col("source").alias("target"), F.col("target").alias("next")), "target").select("source", F.col("next").alias("target")).distinct()
        fresh = materialise(further.join(known, ["source", "target"], "left_anti"), "closure")
        known = known.unionByName(fresh)
    return known


def siblings(nodes: DataFrame, paths: DataFrame, most: int = 5) -> DataFrame:
    """(start, sibling): up to ``most`` nodes of the same path prefix, by id; a node without prefix has none."""
    prefixed = paths.where(F.size("path") > 1).select("id", F.slice("path", F.lit(1), F.size("path") - 1).alias("prefix"))
    # The few smallest ids stand for a prefix, one more for the node itself.
    first = Window.partitionBy("prefix").orderBy("id")
    few = prefixed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most + 1).groupBy("prefix").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    asked = nodes.select(F.col("id").alias("start")).join(prefixed.withColumnRenamed("id", "start"), "start").join(few, "prefix")
    return asked.select("start", F.explode(F.slice(F.filter("_ids", lambda i: i != F.col("start")), 1, most)).alias("sibling"))


def edge_weight(overlap: Column, similarity: Column, years: Column, scale: float = 5.0, decay: float = 0.1) -> Column:
    """Mean of shared norms (over ``scale``, at most 1), similarity, and nearness in time 1 / (1 + decay * years)."""
    return (F.least(overlap / scale, F.lit(1.0)) + similarity + 1 / (1 + decay * F.abs(years))) / 3


def cascade(flags: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, flagged): a node is flagged if it or a node of the same path prefix is."""
    prefixed = paths.select("id", F.slice("path", F.lit(1), F.size("path") - 1).alias("prefix"))
    hot = prefixed.join(flags.where("flag").select("id"), "id").select("prefix").distinct()
    return prefixed.join(hot.withColumn("_h", F.lit(True)), "prefix", "left").select("id", F.coalesce("_h", F.lit(False)).alias("flagged"))
