"""Further queries: norm questions, similarity joins, derived columns, splits, caches, multilingual articles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fondaco.functions import legal, similarity as sim, text as tx
from fondaco.operators import dedup as dd, extract as ex, retrieval as ret
from fondaco.plans import extraction as xp, quality as qu, retrieval as rt
from fondaco.plans.texts import sql_article_number, sql_article_suffix, sql_hash_form, sql_jaccard, sql_shingles, sql_sort_key, sql_words
from fondaco.session import table
from fondaco.sources import articles as src

QUERIES, SQL = {}, {}


def op(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


_ASKED = "lower(trim(concat_ws(' ', articolo, codice, rubrica)))"
_found = lambda p, i: f"nullif(regexp_extract(q, {xp.q(p)}, {i}), '')"
_codes = ", ".join(f"CASE WHEN {_found(p, 1)} IS NOT NULL THEN concat_ws(':', '{c}', {_found(p, 1)}, {_found(p, 2)}) END" for c, p in ex.QUESTION_CODE.items())
_acts = ", ".join(f"CASE WHEN {_found(p, 1)} IS NOT NULL THEN concat_ws(':', '{c}', {_found(p, 1)}, {_found(p, 2)}) END" for c, p in ex.QUESTION_ACT.items())


@op(f"SELECT id, coalesce({_codes}, {_acts}) AS norm_id FROM (SELECT id, {_ASKED} AS q FROM normativa_altalex)")
def parse_norm_query(spark, sf):
    """The norm that a question names: number, act and heading as a user types them, here those of a dirty source."""
    asked = F.concat_ws(" ", "articolo", "codice", "rubrica")
    return table(spark, sf, "normativa_altalex").select("id", ex.norm_question(asked).alias("norm_id"))


_SETS = f"s AS (SELECT t, min(id) AS k FROM (SELECT id, list_sort({sql_shingles('w', 3)}) AS t FROM (SELECT id, {sql_words('testo_normalizzato')} AS w FROM massime WHERE testo_normalizzato IS NOT NULL)) WHERE len(t) > 0 GROUP BY t)"


@op(f"WITH {_SETS}, p AS (SELECT a.k AS a, b.k AS b, {sql_jaccard('a.t', 'b.t')} AS j FROM s a JOIN s b ON a.k < b.k AND least(len(a.t), len(b.t)) >= greatest(len(a.t), len(b.t)) * 0.85) SELECT a, b, round(j, 6) AS similarity FROM p WHERE j >= 0.85")
def dedup_jaccard_pairs(spark, sf):
    rows = table(spark, sf, "massime").where("testo_normalizzato is not null")
    words = rows.select("id", tx.words(F.col("testo_normalizzato")).alias("w"))
    return dd.jaccard_pairs(words, "id", sim.shingles(F.col("w"), 3), 0.85)



@op(f"WITH a AS (SELECT id AS query_id, codice AS text FROM normativa_altalex WHERE codice <> ''), w AS (SELECT id, nome_completo AS text FROM work) {rt.sql_trgm('a', 'w', 3, 0.3)}")
def join_nested_loop_sim(spark, sf):
    """The acts whose names are most like the act that a dirty source names: a join on similarity, not on equality."""
    named = table(spark, sf, "normativa_altalex").where("codice <> ''").select(F.col("id").alias("query_id"), F.col("codice").alias("text"))
    return ret.trgm_search(named, table(spark, sf, "work").select("id", F.col("nome_completo").alias("text")), 3, 0.3)


_ACTUAL = "work_id || '~art' || {0} || coalesce({1}, '')".format(f"{sql_article_number('articolo')}::VARCHAR", sql_article_suffix("articolo"))


@op(f"SELECT id, {sql_sort_key('articolo')} AS sort_key, 'urn:nir:stato:act:' || {_ACTUAL} AS urn, substring(sha256({sql_hash_form('testo')}), 1, 16) AS digest FROM normativa")
def derive_columns(spark, sf):
    """The columns that a writer derives: sort key, name of the article, digest of its text."""
    n, a = table(spark, sf, "normativa"), F.col("articolo")
    base = F.concat(F.lit("urn:nir:stato:act:"), F.col("work_id").cast("string"))
    return n.select("id", legal.article_sort_key(a).alias("sort_key"), legal.article_urn(base, a).alias("urn"), tx.content_hash(tx.normalize_for_hash(F.col("testo")), 16).alias("digest"))


_SPLIT = """WITH p AS (SELECT document_id, pagina_inizio AS page, count(*) AS n FROM massime WHERE pagina_inizio IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, max(page) OVER (PARTITION BY document_id) AS last FROM p)
    SELECT document_id, arg_max(page, (round(n - abs(page - last / 2.0) / last * 10, 6), -page)) AS split FROM m WHERE last > 0 GROUP BY 1"""


@op(_SPLIT)
def pdf_smart_split(spark, sf):
    """The page near the middle of each document where the most units begin."""
    p = table(spark, sf, "massime").where("pagina_inizio is not null").groupBy("document_id", F.col("pagina_inizio").alias("page")).agg(F.count("*").alias("n"))
    m = p.withColumn("last", F.max("page").over(Window.partitionBy("document_id"))).where("last > 0")
    score = F.round(F.col("n") - F.abs(F.col("page") - F.col("last") / 2) / F.col("last") * 10, 6)
    return m.groupBy("document_id").agg(F.max_by("page", F.struct(score, -F.col("page"))).alias("split"))


_EU = r"(?:^|[^\p{L}])(Artikel|[Aa]rticle|Articolo)\s+(\d+)"


@op(f"SELECT doc_id, lower(k) AS word, n::INT AS number FROM (SELECT doc_id, unnest(regexp_extract_all(text, {xp.q(_EU)}, 1)) AS k, unnest(regexp_extract_all(text, {xp.q(_EU)}, 2)) AS n FROM documents WHERE text IS NOT NULL)")
def eurlex_articles(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return ex._rows(docs, _EU, ["word", "number"]).select(F.col("id").alias("doc_id"), F.lower("word").alias("word"), F.col("number").cast("int").alias("number"))


_V = r"coalesce(try_strptime(regexp_replace(regexp_extract(opendata_version, '(\d{4}[-.]?\d{2}[-.]?\d{2})$', 1), '[-.]', '', 'g'), '%Y%m%d'))::DATE"


@op(f"SELECT id, {_V} AS day, CASE WHEN fine_vigore <> DATE '9999-12-31' THEN fine_vigore END AS until FROM normativa_vigenza")
def vigenza_date_parse(spark, sf):
    raw = F.regexp_replace(F.regexp_extract("opendata_version", r"(\d{4}[-.]?\d{2}[-.]?\d{2})$", 1), "[-.]", "")
    return table(spark, sf, "normativa_vigenza").select("id", legal.compact_date(raw).alias("day"), F.when(F.col("fine_vigore") != F.lit("9999-12-31").cast("date"), F.col("fine_vigore")).alias("until"))


@op(f"SELECT g.id, g.materia, m.rv, m.anno, d.n FROM ({qu.SQL['golden_sample']}) g JOIN massime m ON g.id = m.id LEFT JOIN (SELECT document_id, count(*) AS n FROM massime GROUP BY 1) d ON m.document_id = d.document_id")
def view_golden_with_info(spark, sf):
    m = table(spark, sf, "massime")
    per = m.groupBy("document_id").agg(F.count("*").alias("n"))
    return qu.golden_sample(spark, sf).join(m.select("id", "rv", "anno", "document_id"), "id").join(per, "document_id", "left").select("id", "materia", "rv", "anno", "n")


@op("""WITH c AS (SELECT sha256(text) AS digest, max(embedding) AS vec FROM normativa_chunk c JOIN normativa_chunk_embeddings e ON c.id = e.chunk_id AND e.model = 'lex-64' AND len(embedding) = 64 GROUP BY 1),
    h AS (SELECT DISTINCT text, list_transform(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: ('0x' || substr(md5(w), 1, 2))::INT % 64) AS h FROM normativa_chunk),
    v AS (SELECT text, list_transform(range(64), lambda i: len(list_filter(h, lambda x: x = i))::FLOAT) AS v FROM h)
    SELECT id, c.vec IS NOT NULL AS cached, round(list_sum(coalesce(c.vec, v.v)::DOUBLE[]), 3) AS total FROM (SELECT DISTINCT id, text FROM normativa_chunk) t JOIN v ON v.text = t.text LEFT JOIN c ON c.digest = sha256(t.text)""")
def embed_generate(spark, sf):
    """A vector for every chunk text: the cached one by the hash of the text, else that of a plugged-in function, here counts of hashed words."""
    from pyspark.sql.types import ArrayType, FloatType

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(text):
        import re
        from hashlib import md5

        def vector(t):
            counts = [0.0] * 64
            for w in re.split(r"[\W_]+", t.lower()):
                counts[int(md5(w.encode()).hexdigest()[:2], 16) % 64] += 1.0
            return counts

        return text.map(vector)

    c = table(spark, sf, "normativa_chunk").select("id", "text").distinct()
    e = table(spark, sf, "normativa_chunk_embeddings").where("model = 'lex-64' and size(embedding) = 64").select(F.col("chunk_id").alias("id"), "embedding")
    cache = table(spark, sf, "normativa_chunk").join(e, "id").groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("embedding").alias("vec"))
    told = src.with_cached_vectors(c.select(F.col("id").alias("key"), "text"), cache, embed, 64)
    known = told.join(cache.select("digest"), "digest", "left_semi").select("key", "digest").distinct().withColumn("cached", F.lit(True))
    total = F.round(F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 3)
    return told.join(known, ["key", "digest"], "left").select(F.col("key").alias("id"), F.coalesce("cached", F.lit(False)).alias("cached"), total.alias("total"))
