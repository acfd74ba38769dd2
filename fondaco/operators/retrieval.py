"""Ranked retrieval for sets of queries: dense, BM25 and trigram search, rank fusion, boosts and re-ranking.

Every function takes a table of queries (``query_id`` first) and gives (query_id, id, score, rank). Scores are rounded to six
decimals before they are ranked and ties go to the smaller id, so rankings do not depend on the order of additions.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fondaco.functions import similarity as sim, text as tx
from fondaco.session import materialise, tasks_of

#: Queries in a block of dense search; vectors of a row block.
QUERY_BLOCK, ROW_BLOCK = 5_000, 20_000
#: Texts that ask in a block of trigram search.
TEXT_BLOCK = 1_000
#: Documents and queries in a block of BM25.
TEXT_ROWS, TEXT_QUERIES = 100_000, 50_000

# Common Italian words that BM25 leaves out.
STOP = tx.ITALIAN + "i ai agli alle dai dal dalla dallo dello degli dell l d all dall nell sull se si ne ci ad ed od come anche".split()


def top(rows: DataFrame, limit: int, least: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): the best of each query. Spark cuts each partition to ``limit`` before the shuffle."""
    rows = rows.withColumn("score", F.round("score", 6))
    rows = rows if least is None else rows.where(F.col("score") >= least)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def _block_scorer(limit: int, least: float):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        def matrix(t):
            x = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
            return x / np.linalg.norm(x, axis=1, keepdims=True)

        out: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            x, ids, qids = matrix(rows), rows.column("id").to_numpy(), queries.column("query_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids, q = x[order], ids[order], matrix(queries)
            for at in range(0, len(q), 256):
                scores = np.round(q[at : at + 256] @ x.T, 6)
                for i, s in enumerate(scores):
                    keep = np.flatnonzero(s >= least)
                    if len(keep) > limit:
                        edge = np.partition(s[keep], len(keep) - limit)[len(keep) - limit]
                        keep = keep[s[keep] >= edge]
                    keep = keep[np.lexsort((keep, -s[keep]))][:limit]
                    out[0].append(np.full(len(keep), qids[at + i])), out[1].append(ids[keep]), out[2].append(s[keep])
        cat = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
        return pa.table([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.float64())], names=["query_id", "id", "score"])

    return run


def usable(rows: DataFrame, vector: str, dims: str | None = None) -> DataFrame:
    """Rows whose vector can be compared: right size, some length, all numbers."""
    n = sim.norm(F.col(vector))
    rows = rows.where(F.col(vector).isNotNull())
    return (rows if dims is None else rows.where(F.size(vector) == F.col(dims))).where((n > 0) & ~F.isnan(n) & (n < float("inf")))


def dense_search(queries: DataFrame, rows: DataFrame, limit: int = 50, least: float = 0.5) -> DataFrame:
    """Exact cosine top-k of (query_id, part, vec) over (id, part, vec) of the same part (model, tenant).

    Query blocks meet row blocks in a grid of tasks, each a matrix product that keeps its best; the numbers of blocks follow
    the numbers of rows, so no task and no broadcast grows with the data. Vectors travel in the type they are stored in and are
    doubles where they are compared.
    """
    nq, nr = queries.count(), rows.count()
    qb, rb = max(1, math.ceil(nq / QUERY_BLOCK)), max(1, math.ceil(nr / ROW_BLOCK))
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    r = rows.select("id", "part", F.col("vec").alias("vec")).withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(rb))).withColumn("qb", cells(qb))
    q = queries.select("query_id", F.col("part").alias("part"), F.col("vec").alias("vec")).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb))).withColumn("rb", cells(rb))
    found = r.groupBy("part", "rb", "qb").cogroup(q.groupBy("part", "rb", "qb")).applyInArrow(_block_scorer(limit, least), "query_id long, id long, score double")
    return top(found, limit)


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, dl) of (id, text): terms without stop words; dl is the number of such words in the text."""
    words = F.filter(tx.words(F.col("text")), lambda w: ~w.isin(STOP))
    told = docs.select("id", words.alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return told.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def _weight_scorer(limit: int, all_terms: bool):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            terms = pa.concat_arrays([queries.column("term").combine_chunks(), rows.column("term").combine_chunks()]).dictionary_encode()
            code, many = terms.indices.to_numpy(), len(terms.dictionary)
            asks, holds = code[: queries.num_rows], code[queries.num_rows :]
            ids, row = np.unique(rows.column("id").to_numpy(), return_inverse=True)
            order = np.argsort(holds, kind="stable")
            row, part = row[order], rows.column("part").to_numpy()[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(holds, minlength=many))])
            qids = queries.column("query_id").to_numpy()
            order = np.argsort(qids, kind="stable")
            qids, asks = qids[order], asks[order]
            bounds = np.flatnonzero(np.concatenate([[True], qids[1:] != qids[:-1], [True]]))
            for a, b in zip(bounds[:-1], bounds[1:]):
                mine = [slice(ends[t], ends[t + 1]) for t in asks[a:b]]
                met = np.concatenate([row[m] for m in mine])
                if not len(met):
                    continue
                score, times = np.bincount(met, np.concatenate([part[m] for m in mine]), len(ids)), np.bincount(met, minlength=len(ids))
                keep = np.flatnonzero(times == b - a if all_terms else times > 0)
                told = np.round(score[keep], 6)
                if len(keep) > limit:
                    best = told >= np.partition(told, len(keep) - limit)[len(keep) - limit]
                    keep, told = keep[best], told[best]
                keep = keep[np.lexsort((keep, -told))][:limit]
                out[0].append(np.full(len(keep), qids[a])), out[1].append(ids[keep]), out[2].append(score[keep])
        cat = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
        return pa.table([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.float64())], names=["query_id", "id", "score"])

    return run


def bm25_search(queries: DataFrame, docs: DataFrame, limit: int = 50, k1: float = 1.2, b: float = 0.75, all_terms: bool = False) -> DataFrame:
    """BM25 of (query_id, text) over (id, text). ``all_terms`` keeps only documents with every query term.

    The weight of each term that is asked is told once for each document; blocks of documents meet the queries in a grid of tasks that
    add the weights and keep the best, so what is written follows documents and queries and not the rows that they share.
    """
    post = postings(docs)
    stats = docs.select(F.size(F.filter(tx.words(F.col("text")), lambda w: ~w.isin(STOP))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", F.explode(F.array_distinct(F.filter(tx.words(F.col("text")), lambda w: ~w.isin(STOP)))).alias("term"))
    n, avg = F.lit(stats["n"]), F.lit(stats["avg"]).cast("double")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    weights = asked.select("term").distinct().join(df, "term").join(post, "term").select("id", "term", part.alias("part"))
    rb = max(math.ceil(stats["n"] / TEXT_ROWS), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    qb = max(1, math.ceil(queries.count() / TEXT_QUERIES))
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    x = weights.select("id", F.col("term").alias("term"), "part", F.pmod(F.xxhash64("id"), F.lit(rb)).cast("long").alias("rb"), cells(qb).alias("qb"))
    y = asked.select("query_id", F.col("term").alias("term"), F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("long").alias("qb"), cells(rb).alias("rb"))
    found = x.groupBy("rb", "qb").cogroup(y.groupBy("rb", "qb")).applyInArrow(_weight_scorer(limit, all_terms), "query_id long, id long, score double")
    return top(found, limit)


def term_rank_search(queries: DataFrame, docs: DataFrame, limit: int = 20, weight: float = 0.1) -> DataFrame:
    """Documents with every term of a query, by the mean of weight * (1 + 1/4 + ... + 1/tf²) / (π²/6) over its terms, as full-text ranks of databases have it."""
    post = postings(docs)
    asked = queries.select("query_id", F.array_distinct(F.filter(tx.words(F.col("text")), lambda w: ~w.isin(STOP))).alias("t")).select("query_id", F.size("t").alias("terms"), F.explode("t").alias("term"))
    mass = F.aggregate(F.sequence(F.lit(1), F.col("tf").cast("int")), F.lit(0.0), lambda a, i: a + 1 / (i * i)) / 1.64493406685
    found = asked.join(post, "term").groupBy("query_id", "id", "terms").agg(F.sum(weight * mass).alias("s"), F.count("*").alias("matched")).where("matched = terms")
    return top(found.select("query_id", "id", (F.col("s") / F.col("terms")).alias("score")), limit)


def _trigram_scorer(limit: int, least: float):
    bits = sim.trigram_bits

    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            ids, qids = rows.column("id").to_numpy(), queries.column("query_id").to_numpy()
            both = bits(queries.column("text").to_pylist() + rows.column("text").to_pylist())
            sizes = np.bitwise_count(both).sum(1, dtype=np.int64)
            q, nq, x, nx = both[: len(qids)], sizes[: len(qids)], np.ascontiguousarray(both[len(qids) :].T), sizes[len(qids) :]
            for i, mine in enumerate(q):
                shared = np.zeros(len(ids), np.int64)
                for w in np.flatnonzero(mine):
                    shared += np.bitwise_count(x[w] & mine[w])
                union = nq[i] + nx - shared
                score = (2_000_000 * shared + union) // (2 * union)  # half up at six decimals, as Spark rounds
                keep = np.flatnonzero((shared > 0) & (score / 1e6 >= least))
                if len(keep) > limit:
                    edge = np.partition(score[keep], len(keep) - limit)[len(keep) - limit]
                    keep = keep[score[keep] >= edge]
                keep = keep[np.lexsort((ids[keep], -score[keep]))][:limit]
                out[0].append(np.full(len(keep), qids[i])), out[1].append(ids[keep]), out[2].append(score[keep] / 1e6)
        cat = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
        return pa.table([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.float64())], names=["query_id", "id", "score"])

    return run


def trgm_search(queries: DataFrame, docs: DataFrame, limit: int = 20, least: float = 0.3) -> DataFrame:
    """Trigram similarity (Jaccard) of (query_id, text) over (id, text), of ``least`` or more.

    Texts of equal words are one class, named by its smallest id. Blocks of classes that ask meet blocks of classes that are held in a
    grid of tasks, as in ``dense_search``; each compares its trigrams as bits and keeps its best, so what is written follows the
    queries and not the pairs. The best classes of a query hold its best rows, and of a class no more than ``limit`` can matter.
    """
    told = lambda t, key: t.select(key, sim.spaced(F.col("text")).alias("text")).where("text <> ''")
    asked, held = materialise(told(queries, "query_id"), "asked"), materialise(told(docs, "id"), "held")
    classes = lambda t, key: t.groupBy("text").agg(F.min(key).alias(key))
    q, r = materialise(classes(asked, "query_id"), "classes"), materialise(classes(held, "id"), "classes")
    rb = max(1, math.ceil(r.count() / ROW_BLOCK))
    qb = max(1, math.ceil(q.count() / TEXT_BLOCK), math.ceil(tasks_of(q.sparkSession) / rb))
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    x = r.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(rb)).alias("rb"), cells(qb).alias("qb"))
    y = q.select("query_id", "text", F.pmod(F.xxhash64("query_id"), F.lit(qb)).alias("qb"), cells(rb).alias("rb"))
    found = x.groupBy("rb", "qb").cogroup(y.groupBy("rb", "qb")).applyInArrow(_trigram_scorer(limit, least), "query_id long, id long, score double")
    best = top(found, limit).select(F.col("query_id").alias("q"), F.col("id").alias("c"), "score")
    within = Window.partitionBy("c").orderBy("id")
    members = held.select("id", "text").join(r.select(F.col("id").alias("c"), "text").hint("merge"), "text").select("c", "id")
    members = members.withColumn("n", F.row_number().over(within)).where(F.col("n") <= limit).select("c", "id")
    rows = top(best.join(members.hint("merge"), "c").select(F.col("q").alias("query_id"), "id", "score"), limit).drop("rank").withColumnRenamed("query_id", "q")
    asking = asked.join(q.select(F.col("query_id").alias("q"), "text").hint("merge"), "text").select("query_id", "q")
    return top(asking.join(rows.hint("merge"), "q").select("query_id", "id", "score"), limit)


def keyword_boost(ranked: DataFrame, keywords: DataFrame, wanted: Column, limit: int, factor: float = 1.5) -> DataFrame:
    """Scores times factor per keyword of (id, keywords) that is wanted."""
    overlap = F.size(F.array_intersect(F.transform("keywords", F.lower), wanted))
    scored = ranked.join(keywords.select("id", "keywords"), "id", "left")
    return top(scored.select("query_id", "id", (F.col("score") * F.pow(F.lit(factor), F.greatest(F.coalesce(overlap, F.lit(0)), F.lit(0)))).alias("score")), limit)


def rrf(lists: list[DataFrame], limit: int, k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of weight / (k + rank) over the lists that hold a row."""
    weights = weights or [1.0] * len(lists)
    each = [x.select("query_id", "id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s")) for x, w in zip(lists, weights)]
    return top(reduce(DataFrame.unionByName, each).groupBy("query_id", "id").agg(F.sum("s").alias("score")), limit)


def recency(day: Column, year: Column, reference: Column) -> Column:
    """1 / (1 + days / 3650), by year where the day is unknown, 0.5 where both are; within 0 and 1."""
    by_day = 1 / (1 + F.datediff(reference, day) / 3650)
    by_year = 1 / (1 + (F.year(reference) - year) * 0.1)
    return F.least(F.greatest(F.coalesce(by_day, by_year, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def temporal_boost(ranked: DataFrame, dates: DataFrame, reference: Column, limit: int, year: Column | None = None, day: Column | None = None, weight: float = 0.1) -> DataFrame:
    """Score + weight * recency, doubled for the exact day asked for, times 1.5 for the exact year. dates: (id, day, year)."""
    j = ranked.join(dates, "id", "left")
    factor = F.lit(1.0)
    if year is not None:
        factor = F.when(F.col("year") == year, 1.5).otherwise(factor)
    if day is not None:
        factor = F.when(F.col("day") == day, 2.0).otherwise(factor)
    return top(j.select("query_id", "id", (F.col("score") + weight * recency(F.col("day"), F.col("year"), reference) * factor).alias("score")), limit)


def norm_boost(ranked: DataFrame, cites: DataFrame, limit: int, base: float = 0.10, per_hundred: float = 0.02, most: float = 0.20) -> DataFrame:
    """Rows that cite the norm asked for gain base plus popularity. cites: (query_id, id, citation_count)."""
    j = ranked.join(cites, ["query_id", "id"], "left")
    gain = F.least(base + F.least(F.col("citation_count") / 100, F.lit(1.0)) * per_hundred, F.lit(most))
    return top(j.select("query_id", "id", (F.col("score") + F.coalesce(gain, F.lit(0.0))).alias("score")), limit)


def minmax_blend(ranked: DataFrame, rerank: DataFrame, limit: int, weight: float = 0.4) -> DataFrame:
    """(1 - weight) * minmax(rerank score) + weight * score / best score, per query. rerank: (query_id, id, rerank)."""
    by = Window.partitionBy("query_id")
    j = ranked.join(rerank, ["query_id", "id"])
    low, high = F.min("rerank").over(by), F.max("rerank").over(by)
    scaled = F.when(high > low, (F.col("rerank") - low) / (high - low)).otherwise(F.lit(0.5))
    return top(j.select("query_id", "id", ((1 - weight) * scaled + weight * F.col("score") / F.max("score").over(by)).alias("score")), limit)
