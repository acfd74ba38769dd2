"""Queries of ranked retrieval: every row whose id is divisible by 50 asks, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fondaco.functions import text as tx
from fondaco.operators import relational as rel, retrieval as ret
from fondaco.plans.texts import sql_trigrams, sql_words
from fondaco.session import materialise, table

QUERIES, SQL = {}, {}


def op(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


# Rows of the index: the newest delivery of each chunk, its vector of the first model, and its article's heading.


def vectors(spark: SparkSession, sf: str, model: str | None = "lex-64") -> DataFrame:
    e = table(spark, sf, "normativa_chunk_embeddings")
    e = e if model is None else e.where(F.col("model") == model)
    best = ret.usable(e, "embedding", "dims").groupBy("chunk_id", "model").agg(F.max_by("embedding", "id").alias("vec"))
    return best.select(F.col("chunk_id").alias("id"), F.col("model").alias("part"), "vec")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return rel.latest(table(spark, sf, "normativa_chunk").select("id", "normativa_id", "work_id", "text", "created_at"), ["id"], [F.desc("created_at"), F.col("text")])


def headings(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "normativa").where("rubrica is not null").select(F.col("id").alias("normativa_id"), F.col("rubrica").alias("text"))
    return chunks(spark, sf).select("id", "normativa_id").join(n.hint("merge"), "normativa_id").select("id", "text")


def asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")


def question(spark: SparkSession, sf: str) -> DataFrame:
    """Questions: the whole heading of the article of every fiftieth chunk."""
    return asked(headings(spark, sf))


_V = """vecs AS (SELECT chunk_id AS id, model AS part, arg_max(embedding, id) AS vec FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n
    FROM normativa_chunk_embeddings WHERE embedding IS NOT NULL AND len(embedding) = dims) WHERE n > 0 AND NOT isnan(n) {0} GROUP BY 1, 2)"""
_C = "chunks AS (SELECT id, normativa_id, work_id, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, text) AS r FROM normativa_chunk) WHERE r = 1)"
_H = "heads AS (SELECT c.id, n.rubrica AS text FROM chunks c JOIN normativa n ON c.normativa_id = n.id WHERE n.rubrica IS NOT NULL)"
_Q = f"{_H}, asked AS (SELECT id AS query_id, text FROM heads WHERE id % 50 = 0)"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(ret.STOP))


def sql_top(source: str, limit: int, least: float | None = None) -> str:
    keep = "" if least is None else f"WHERE score >= {least}"
    return f"SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(score, 6) AS score FROM ({source})) {keep}) WHERE rank <= {limit}"


def sql_dense(limit: int = 50, least: float = 0.5) -> str:
    return sql_top("SELECT q.id AS query_id, r.id, list_cosine_similarity(q.vec::DOUBLE[], r.vec::DOUBLE[]) AS score FROM vecs q JOIN vecs r ON q.part = r.part WHERE q.id % 50 = 0", limit, least)


def sql_bm25(docs: str, limit: int = 50, all_terms: bool = False) -> str:
    terms = f"list_filter({sql_words('text')}, lambda w: w NOT IN ({_STOP}))"
    having = "HAVING count(*) = max(terms)" if all_terms else ""
    return sql_top(f"""
        WITH d AS (SELECT id, {terms} AS w FROM {docs}), p AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d),
        a AS (SELECT query_id, unnest(list_distinct(t)) AS term, len(list_distinct(t)) AS terms FROM (SELECT query_id, {terms} AS t FROM asked))
        SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM a JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2 {having}""", limit)


def sql_trgm(queries: str, docs: str, limit: int = 20, least: float = 0.3) -> str:
    return sql_top(f"""
        WITH q AS (SELECT query_id, {sql_trigrams('text')} AS g FROM {queries}), d AS (SELECT id, {sql_trigrams('text')} AS g FROM {docs}),
        x AS (SELECT query_id, len(g) AS nq, unnest(g) AS gram FROM q), y AS (SELECT id, len(g) AS nd, unnest(g) AS gram FROM d)
        SELECT query_id, id, count(*)::DOUBLE / (max(nq) + max(nd) - count(*)) AS score FROM x JOIN y USING (gram) GROUP BY 1, 2""", limit, least)


@op(f"WITH {_V.format(chr(65) + 'ND model = ' + chr(39) + 'lex-64' + chr(39))} {sql_dense()}")
def dense_search(spark, sf):
    v = vectors(spark, sf)
    return ret.dense_search(asked(v), v)


@op(f"WITH {_V.format('')} {sql_dense(10, 0.6)}")
def dense_multi_model(spark, sf):
    v = vectors(spark, sf, None)
    return ret.dense_search(asked(v).groupBy("query_id", "part").agg(F.first("vec").alias("vec")), v, 10, 0.6)


@op(f"WITH {_C}, {_Q} {sql_bm25('chunks')}")
def sparse_bm25(spark, sf):
    c = chunks(spark, sf)
    return ret.bm25_search(question(spark, sf), c)


def sql_term_rank(docs: str, limit: int = 20) -> str:
    return sql_top(f"""
        WITH d AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_filter({sql_words('text')}, lambda w: w NOT IN ({_STOP}))) AS term FROM {docs}) GROUP BY ALL),
        a AS (SELECT query_id, unnest(list_distinct(t)) AS term, len(list_distinct(t)) AS terms FROM (SELECT query_id, list_filter({sql_words('text')}, lambda w: w NOT IN ({_STOP})) AS t FROM asked))
        SELECT query_id, id, sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda i: 1.0::DOUBLE / (i * i))) / 1.64493406685) / max(terms) AS score FROM a JOIN d USING (term) GROUP BY 1, 2 HAVING count(*) = max(terms)""", limit)


@op(f"WITH {_C}, {_Q} {sql_term_rank('chunks')}")
def sparse_tsrank_and(spark, sf):
    c = chunks(spark, sf)
    return ret.term_rank_search(question(spark, sf), c, 20)


@op(f"WITH {_C}, {_Q} {sql_trgm('asked', 'heads')}")
def trgm_search(spark, sf):
    h = headings(spark, sf)
    return ret.trgm_search(asked(h), h)


@op("SELECT id, list_sort(list_filter(list_distinct(%s), lambda w: w NOT IN (%s))) AS terms FROM massime WHERE testo IS NOT NULL" % (sql_words("translate(lower(substring(testo, 1, 256)), '%s', '%s')" % tx.ACCENTS), _STOP))
def fts_query_build(spark, sf):
    """Terms of a question: the first 256 characters without accents and stop words."""
    words = tx.words(tx.unaccent(F.substring("testo", 1, 256)))
    return table(spark, sf, "massime").where("testo is not null").select("id", F.array_sort(F.filter(F.array_distinct(words), lambda w: ~w.isin(ret.STOP))).alias("terms"))


@op(f"SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM (SELECT id, list_filter({sql_words('testo')}, lambda w: w NOT IN ({_STOP})) AS w FROM normativa)) GROUP BY ALL")
def fts_doc_build(spark, sf):
    return ret.postings(table(spark, sf, "normativa").select("id", F.col("testo").alias("text"))).select("id", "term", "dl", "tf")


@op(f"""WITH {_C}, {_Q}, ranked AS ({sql_bm25('chunks', 40)}), k AS (SELECT c.id, string_split(lower(n.rubrica), ' ') AS keywords FROM chunks c JOIN normativa n ON c.normativa_id = n.id)
    {sql_top("SELECT query_id, r.id, score * power(1.5, coalesce(len(list_intersect(keywords, ['contratto', 'danno', 'finale', 'generale', 'totale'])), 0)) AS score FROM ranked r LEFT JOIN k ON r.id = k.id", 20)}""")
def keyword_boost(spark, sf):
    c, n = chunks(spark, sf), table(spark, sf, "normativa")
    words = c.select("id", "normativa_id").join(n.select(F.col("id").alias("normativa_id"), F.split(F.lower("rubrica"), " ").alias("keywords")), "normativa_id")
    wanted = F.array(*map(F.lit, ["contratto", "danno", "finale", "generale", "totale"]))
    return ret.keyword_boost(ret.bm25_search(question(spark, sf), c, 40), words.select("id", F.array_distinct("keywords").alias("keywords")), wanted, 20)


def lists(spark, sf, dense=50, sparse=50, trgm=20):
    v, c, h = vectors(spark, sf), chunks(spark, sf).select("id", "text"), headings(spark, sf)
    return [ret.dense_search(asked(v), v, dense), ret.bm25_search(question(spark, sf), c, sparse), ret.trgm_search(asked(h), h, trgm)]


_LISTS = f"{_V.format('AND model = ' + chr(39) + 'lex-64' + chr(39))}, {_C}, {_Q}, dense AS ({sql_dense()}), sparse AS ({sql_bm25('chunks')}), trgm AS ({sql_trgm('asked', 'heads')})"


def sql_rrf(parts: dict[str, float], limit: int, k: int = 60) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, id, {w}::DOUBLE / ({k} + rank) AS s FROM {p}" for p, w in parts.items())
    return sql_top(f"SELECT query_id, id, sum(s) AS score FROM ({union}) GROUP BY 1, 2", limit)


_HYBRID = f"hybrid AS ({sql_rrf({'dense': 1.0, 'sparse': 1.0, 'trgm': 1.0}, 20)})"


@op(f"WITH {_LISTS} {sql_rrf({'dense': 1.0, 'sparse': 1.0}, 50)}")
def rrf_fusion(spark, sf):
    return ret.rrf(lists(spark, sf)[:2], 50)


@op(f"WITH {_LISTS} {sql_rrf({'dense': 0.7, 'sparse': 0.5, 'trgm': 0.3}, 20)}")
def rrf_weighted(spark, sf):
    return ret.rrf(lists(spark, sf), 20, weights=[0.7, 0.5, 0.3])


def hybrid(spark, sf) -> DataFrame:
    return ret.rrf(lists(spark, sf), 20)


@op(f"""WITH {_LISTS}, {_HYBRID} SELECT h.query_id, h.id, h.score, h.rank, d.rank AS dense_rank, s.rank AS sparse_rank, t.rank AS trgm_rank FROM hybrid h
    LEFT JOIN dense d ON h.query_id = d.query_id AND h.id = d.id LEFT JOIN sparse s ON h.query_id = s.query_id AND h.id = s.id LEFT JOIN trgm t ON h.query_id = t.query_id AND h.id = t.id""")
def hybrid_search(spark, sf):
    """The flagship: three searches, fused by rank, with the rank of each."""
    parts = [materialise(x, "ranked") for x in lists(spark, sf)]  # each is read twice
    out = ret.rrf(parts, 20)
    for name, part in zip(("dense_rank", "sparse_rank", "trgm_rank"), parts):
        out = out.join(part.select("query_id", "id", F.col("rank").alias(name)), ["query_id", "id"], "left")
    return out


@op(f"WITH {_LISTS} SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id, round(1.0::DOUBLE / (60 + coalesce(d.rank, 999999)) + 1.0::DOUBLE / (60 + coalesce(s.rank, 999999)), 6) AS score FROM dense d FULL OUTER JOIN sparse s ON d.query_id = s.query_id AND d.id = s.id")
def hybrid_benchmark_fn(spark, sf):
    d, s, _ = lists(spark, sf)
    j = d.select("query_id", "id", F.col("rank").alias("a")).join(s.select("query_id", "id", F.col("rank").alias("b")), ["query_id", "id"], "full_outer")
    part = lambda c: F.lit(1.0) / (60 + F.coalesce(c, F.lit(999999)))
    return j.select("query_id", "id", F.round(part("a") + part("b"), 6).alias("score"))


@op(f"WITH {_LISTS} {sql_rrf({'dense': 1.0, 'sparse': 1.0}, 20)}", name="hybrid_sql_fn")
def hybrid_sql_fn(spark, sf):
    return ret.rrf(lists(spark, sf)[:2], 20)


@op(f"WITH {_LISTS}, {_HYBRID} SELECT h.query_id, h.id, round(h.score, 4) AS score, w.code, substring(c.text, 1, 200) AS preview FROM hybrid h JOIN chunks c ON h.id = c.id JOIN work w ON c.work_id = w.id")
def hybrid_normativa(spark, sf):
    c = chunks(spark, sf).join(table(spark, sf, "work").select(F.col("id").alias("work_id"), "code"), "work_id")
    return hybrid(spark, sf).join(c.select("id", "code", F.substring("text", 1, 200).alias("preview")).hint("merge"), "id").select("query_id", "id", F.round("score", 4).alias("score"), "code", "preview")


@op(f"WITH {_LISTS}, {_HYBRID} SELECT query_id, id, score FROM hybrid WHERE score >= 0.02")
def min_score_filter(spark, sf):
    return hybrid(spark, sf).where("score >= 0.02").select("query_id", "id", "score")


_TENANT = "tenant AS (SELECT id, text FROM chunks WHERE work_id = 1), tenant_vecs AS (SELECT v.* FROM vecs v JOIN tenant USING (id))"
_TENANT_DENSE = sql_top("SELECT q.id AS query_id, r.id, list_cosine_similarity(q.vec::DOUBLE[], r.vec::DOUBLE[]) AS score FROM vecs q JOIN tenant_vecs r ON q.part = r.part WHERE q.id % 50 = 0", 20, -1.0)
_TENANT_LISTS = f"{_V.format('AND model = ' + chr(39) + 'lex-64' + chr(39))}, {_C}, {_Q}, {_TENANT}, tenant_dense AS ({_TENANT_DENSE}), tenant_sparse AS ({sql_bm25('tenant', 20)})"


@op(f"WITH {_TENANT_LISTS} {sql_rrf({'tenant_dense': 1.0, 'tenant_sparse': 1.0}, 5)}")
def hybrid_library(spark, sf):
    """Dense and sparse lists of one tenant's rows, filtered before anything is ranked, fused; a question without a vector has its sparse list alone."""
    c, v = chunks(spark, sf), vectors(spark, sf)
    tenant = c.where("work_id = 1").select("id", "text")
    dense = ret.dense_search(asked(v), v.join(tenant.select("id"), "id", "left_semi"), 20, -1.0)
    return ret.rrf([dense, ret.bm25_search(question(spark, sf), tenant, 20)], 5)


_DATES = "SELECT id, data_decisione AS day, anno AS year FROM massime"
_MQ = "asked AS (SELECT id AS query_id, concat_ws(' ', materia, array_to_string(keywords, ' ')) AS text FROM massime WHERE id % 50 = 0), docs AS (SELECT id, testo_normalizzato AS text FROM massime WHERE testo_normalizzato IS NOT NULL)"
_RECENCY = "least(greatest(coalesce(1.0::DOUBLE / (1 + date_diff('day', day, DATE '2026-01-01') / 3650.0::DOUBLE), 1.0::DOUBLE / (1 + (2026 - year) * 0.1::DOUBLE), 0.5), 0.0), 1.0)"


def _massime(spark, sf):
    """Questions of subject and keywords, and the texts they are asked of."""
    m = table(spark, sf, "massime")
    questions = asked(m).select("query_id", F.concat_ws(" ", "materia", F.array_join("keywords", " ")).alias("text"))
    return questions, m.where("testo_normalizzato is not null").select("id", F.col("testo_normalizzato").alias("text"))


@op(f"SELECT id, round({_RECENCY}, 6) AS recency FROM ({_DATES})")
def temporal_recency(spark, sf):
    return table(spark, sf, "massime").select("id", F.round(ret.recency(F.col("data_decisione"), F.col("anno"), F.lit("2026-01-01").cast("date")), 6).alias("recency"))


@op(f"WITH {_MQ}, ranked AS ({sql_bm25('docs', 30)}) {sql_top(f'SELECT query_id, r.id, score + 0.1 * {_RECENCY} * CASE WHEN year = 2015 THEN 1.5 ELSE 1.0 END AS score FROM ranked r LEFT JOIN ({_DATES}) d ON r.id = d.id', 20)}")
def temporal_boost(spark, sf):
    dates = table(spark, sf, "massime").select("id", F.col("data_decisione").alias("day"), F.col("anno").alias("year"))
    return ret.temporal_boost(ret.bm25_search(*_massime(spark, sf), 30), dates, F.lit("2026-01-01").cast("date"), 20, year=F.lit(2015))


@op(f"WITH {_MQ}, ranked AS ({sql_bm25('docs', 30)}), b AS (SELECT r.*, m.importance_score AS rr FROM ranked r JOIN massime m ON r.id = m.id WHERE m.importance_score IS NOT NULL), w AS (SELECT *, min(rr) OVER (PARTITION BY query_id) AS lo, max(rr) OVER (PARTITION BY query_id) AS hi, max(score) OVER (PARTITION BY query_id) AS best FROM b) "
    + sql_top("SELECT query_id, id, 0.6 * CASE WHEN hi > lo THEN (rr - lo) / (hi - lo) ELSE 0.5 END + 0.4 * score / best AS score FROM w", 10))
def rerank_minmax_blend(spark, sf):
    ranked = ret.bm25_search(*_massime(spark, sf), 30)
    scores = table(spark, sf, "massime").where("importance_score is not null").select("id", F.col("importance_score").alias("rerank"))
    return ret.minmax_blend(ranked, ranked.join(scores, "id").select("query_id", "id", "rerank"), 10)


_FACETS = "SELECT count(*) AS chunks, count(DISTINCT normativa_id) AS articles, (SELECT count(DISTINCT chunk_id) FROM normativa_chunk_embeddings WHERE embedding IS NOT NULL) AS embedded, count(DISTINCT work_id) AS works FROM chunks"


@op(f"WITH {_C} {_FACETS}")
def corpus_stats(spark, sf):
    e = table(spark, sf, "normativa_chunk_embeddings").where("embedding is not null").agg(F.countDistinct("chunk_id").alias("embedded"))
    c = chunks(spark, sf).agg(F.count("*").alias("chunks"), F.countDistinct("normativa_id").alias("articles"), F.countDistinct("work_id").alias("works"))
    return c.join(F.broadcast(e)).select("chunks", "articles", "embedded", "works")


@op(f"WITH {_C}, {_Q}, ranked AS ({sql_bm25('chunks', 5)}) SELECT query_id, count(*) FILTER (WHERE contains(lower(c.text), 'contratto') OR contains(lower(c.text), 'danno')) AS hits FROM ranked r JOIN chunks c ON r.id = c.id GROUP BY 1")
def keyword_hits_at_k(spark, sf):
    c = chunks(spark, sf)
    hit = F.lower("text").contains("contratto") | F.lower("text").contains("danno")
    return ret.bm25_search(question(spark, sf), c, 5).join(c.select("id", "text"), "id").groupBy("query_id").agg(F.count_if(hit).alias("hits"))


@op(f"WITH {_C}, {_Q}, {_V.format('')}, found AS ({sql_dense(10, 0.6)}) SELECT n.codice, count(*) AS hits FROM found f JOIN chunks c ON f.id = c.id JOIN normativa n ON c.normativa_id = n.id GROUP BY 1")
def search_annotation(spark, sf):
    c = chunks(spark, sf).select("id", "normativa_id")
    n = table(spark, sf, "normativa").select(F.col("id").alias("normativa_id"), "codice")
    return dense_multi_model(spark, sf).join(c, "id").join(n, "normativa_id").groupBy("codice").agg(F.count("*").alias("hits"))
