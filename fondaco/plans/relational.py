"""Queries of scans, filters, joins, aggregations, windows, sorts, set operations and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fondaco.operators import relational as rel
from fondaco.session import table

QUERIES, SQL = {}, {}


def op(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, *names: str):
    found = [table(spark, sf, n) for n in names]
    return found if len(found) > 1 else found[0]


# Scans and filters


@op("SELECT id, rv, anno FROM massime WHERE is_active AND rv IS NOT NULL")
def scan_table(spark, sf):
    return _t(spark, sf, "massime").where("is_active and rv is not null").select("id", "rv", "anno")


@op("SELECT (i // 200)::BIGINT AS page, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM massime) GROUP BY 1")
def scan_batch_paged(spark, sf):
    """All pages of 200 rows in the order of the key, each by its first and last key."""
    paged = rel.paged(_t(spark, sf, "massime").select("id", "rv"), "id", 200)
    return paged.groupBy("page").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


@op("SELECT id, data_decisione, anno FROM massime WHERE id IN (SELECT massima_id FROM llm_resolver_result WHERE accepted)")
def scan_in_list(spark, sf):
    m, r = _t(spark, sf, "massime", "llm_resolver_result")
    return m.join(r.where("accepted").select(F.col("massima_id").alias("id")), "id", "left_semi").select("id", "data_decisione", "anno")


def filter_meta_of(rows: DataFrame, anno_min=None, anno_max=None, tipo=None, sezione=None) -> DataFrame:
    """Each filter that is given, as a predicate before anything is ranked."""
    for value, test in ((anno_min, lambda v: F.col("anno") >= v), (anno_max, lambda v: F.col("anno") <= v), (tipo, lambda v: F.col("tipo") == v), (sezione, lambda v: F.col("sezione") == v)):
        rows = rows.where(test(value)) if value else rows
    return rows


@op("SELECT id, anno, tipo FROM massime WHERE anno >= 2005 AND anno <= 2015 AND tipo = 'civile'")
def filter_meta(spark, sf):
    return filter_meta_of(_t(spark, sf, "massime"), 2005, 2015, "civile").select("id", "anno", "tipo")


@op("SELECT n.id, w.code FROM normativa n JOIN work w ON n.work_id = w.id WHERE w.code IN ('CACQINT', 'CMERRIO', 'TUMIN')")
def filter_codes(spark, sf):
    n, w = _t(spark, sf, "normativa", "work")
    return n.join(w.where(F.col("code").isin("CACQINT", "CMERRIO", "TUMIN")).select(F.col("id").alias("work_id"), "code"), "work_id").select("id", "code")


@op("SELECT doc_id, source, n_chars FROM documents WHERE source = 'rassegna_00' AND tipo IN ('massima', 'nota')")
def filter_tenant(spark, sf):
    return _t(spark, sf, "documents").where(F.col("source") == "rassegna_00").where(F.col("tipo").isin("massima", "nota")).select("doc_id", "source", "n_chars")


@op("SELECT i.chunk_id, i.run_id FROM sync_item i WHERE i.run_id = (SELECT max(run_id) FROM sync_run WHERE status = 'success')")
def filter_active_run(spark, sf):
    items, runs = _t(spark, sf, "sync_item", "sync_run")
    active = rel.active_run(runs.withColumn("is_active", F.col("status") == "success"))
    return items.join(F.broadcast(active), "run_id").select("chunk_id", "run_id")


@op("SELECT id FROM massime WHERE testo IS NOT NULL AND (rv IS NOT NULL OR regexp_matches(testo, '(?i)rv\\.?\\s*\\d{5}')) AND (try_cast(numero AS INT) > 0 OR numero IS NULL)")
def filter_plausible(spark, sf):
    rows = _t(spark, sf, "massime")
    return rows.where("testo is not null").where(F.col("rv").isNotNull() | F.col("testo").rlike(r"(?i)rv\.?\s*\d{5}")).where((F.col("numero").try_cast("int") > 0) | F.col("numero").isNull()).select("id")


@op("SELECT id FROM normativa n WHERE NOT EXISTS (SELECT 1 FROM normativa_vigenza v WHERE v.normativa_id = n.id)")
def filter_not_exists(spark, sf):
    n, v = _t(spark, sf, "normativa", "normativa_vigenza")
    return n.join(v.select(F.col("normativa_id").alias("id")), "id", "left_anti").select("id")


@op("SELECT id FROM normativa WHERE id NOT IN (SELECT DISTINCT brocardi_match_id FROM normativa_altalex WHERE brocardi_match_id IS NOT NULL)")
def filter_not_in_subq(spark, sf):
    n, a = _t(spark, sf, "normativa", "normativa_altalex")
    return n.join(a.select(F.col("brocardi_match_id").alias("id")), "id", "left_anti").select("id")


@op("SELECT id, rubrica FROM normativa WHERE rubrica ILIKE '%contratt%' OR testo ILIKE '%rescindibil%'")
def filter_ilike(spark, sf):
    return _t(spark, sf, "normativa").where(F.col("rubrica").ilike("%contratt%") | F.col("testo").ilike("%rescindibil%")).select("id", "rubrica")


GATES = """CASE WHEN regexp_matches(lower(trim(testo)), '^(\\d+$|pagina\\s+\\d+|massimario\\s+(civile|penale))') THEN 'header_footer' WHEN length(testo) < 150 THEN 'too_short'
    WHEN len(regexp_extract_all(testo, '(?i)\\b(?:sez\\.|rv\\.|n\\.\\s*\\d+)')) * 1.0 / length(testo) > 0.03 THEN 'too_citation_dense'
    WHEN regexp_matches(testo, '^[\\s]*[a-z,;)]') THEN 'bad_start' ELSE 'accepted' END"""


@op(f"SELECT id, {GATES} AS decision FROM massime WHERE testo IS NOT NULL")
def gate_policy(spark, sf):
    """The first rule that a text fails, or acceptance."""
    t = F.col("testo")
    decision = (
        F.when(F.lower(F.trim(t)).rlike(r"^(\d+$|pagina\s+\d+|massimario\s+(civile|penale))"), "header_footer").when(F.length(t) < 150, "too_short")
        .when(F.regexp_count(t, F.lit(r"(?i)\b(?:sez\.|rv\.|n\.\s*\d+)")) / F.length(t) > 0.03, "too_citation_dense").when(t.rlike(r"^[\s]*[a-z,;)]"), "bad_start").otherwise("accepted")
    )
    return _t(spark, sf, "massime").where("testo is not null").select("id", decision.alias("decision"))


@op(f"SELECT decision, count(*) AS n, round(avg(chars), 4) AS chars FROM (SELECT {GATES} AS decision, length(testo) AS chars FROM massime WHERE testo IS NOT NULL) GROUP BY decision")
def gate_pipeline(spark, sf):
    rows = gate_policy(spark, sf).join(_t(spark, sf, "massime").select("id", F.length("testo").alias("chars")), "id")
    return rows.groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg("chars"), 4).alias("chars"))


PROFILES = [("p_massima_it", "massima", "it"), ("p_massima", "massima", None), ("p_it", None, "it"), ("p_default", None, None)]


@op(f"""WITH p(profile, tipo, lang) AS (VALUES {', '.join('(' + ', '.join('NULL' if v is None else f"'{v}'" for v in r) + ')' for r in PROFILES)})
    SELECT doc_id, arg_min(p.profile, (CASE WHEN p.tipo IS NULL THEN 1 ELSE 0 END + CASE WHEN p.lang IS NULL THEN 1 ELSE 0 END)::VARCHAR || p.profile) AS profile
    FROM documents d JOIN p ON (p.tipo IS NULL OR p.tipo = d.tipo) AND (p.lang IS NULL OR p.lang = d.lang) GROUP BY doc_id""")
def profile_match(spark, sf):
    profiles = spark.createDataFrame(PROFILES, "profile string, tipo string, lang string")
    return rel.specificity_match(_t(spark, sf, "documents"), profiles, {"tipo": "tipo", "lang": "lang"}, "doc_id", "profile")


@op("SELECT id, CASE WHEN is_active THEN 'attiva' WHEN NOT is_active THEN 'superata' ELSE 'ignota' END AS stato, coalesce(testo_normalizzato, testo, '') AS corpo, rv IS NOT NULL AS con_rv FROM massime")
def project_case_flags(spark, sf):
    return _t(spark, sf, "massime").select(
        "id", F.when(F.col("is_active"), "attiva").when(~F.col("is_active"), "superata").otherwise("ignota").alias("stato"),
        F.coalesce("testo_normalizzato", "testo", F.lit("")).alias("corpo"), F.col("rv").isNotNull().alias("con_rv"),
    )


@op("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_path_get(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@op("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_each_text(spark, sf):
    pairs = _t(spark, sf, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count("*").alias("n"))


# Joins


@op("SELECT c.id, c.created_at, w.code, n.articolo FROM normativa_chunk c JOIN normativa n ON c.normativa_id = n.id JOIN work w ON c.work_id = w.id")
def join_inner_equi(spark, sf):
    c, n, w = _t(spark, sf, "normativa_chunk", "normativa", "work")
    return c.select("id", "created_at", "normativa_id", "work_id").join(n.select(F.col("id").alias("normativa_id"), "articolo"), "normativa_id").join(
        w.select(F.col("id").alias("work_id"), "code"), "work_id").select("id", "created_at", "code", "articolo")


@op("SELECT w.code, count(n.id) AS articles FROM work w LEFT JOIN normativa n ON n.work_id = w.id GROUP BY w.code")
def join_left(spark, sf):
    n, w = _t(spark, sf, "normativa", "work")
    per = n.groupBy("work_id").agg(F.count("id").alias("articles"))
    return w.join(per, w.id == per.work_id, "left").select("code", F.coalesce("articles", F.lit(0)).alias("articles"))


@op("""WITH a AS (SELECT materia, count(*) AS active FROM massime WHERE is_active GROUP BY materia), b AS (SELECT materia, count(*) AS old FROM massime WHERE NOT is_active GROUP BY materia)
    SELECT coalesce(a.materia, b.materia) AS materia, active, old FROM a FULL OUTER JOIN b ON a.materia = b.materia""")
def join_full_outer(spark, sf):
    m = _t(spark, sf, "massime")
    a, b = m.where("is_active").groupBy("materia").agg(F.count("*").alias("active")), m.where("not is_active").groupBy("materia").agg(F.count("*").alias("old"))
    return a.join(b, "materia", "full_outer")


@op("WITH p AS (SELECT avg(n_chars) AS mean FROM documents) SELECT doc_id, n_chars > mean AS long FROM documents CROSS JOIN p")
def join_cross_params(spark, sf):
    d = _t(spark, sf, "documents")
    return d.join(F.broadcast(d.agg(F.avg("n_chars").alias("mean")))).select("doc_id", (F.col("n_chars") > F.col("mean")).alias("long"))  # one row of parameters


@op("SELECT id, unnest(list_distinct(keywords)) AS keyword FROM massime")
def join_lateral_fn(spark, sf):
    return _t(spark, sf, "massime").select("id", F.explode(F.array_distinct("keywords")).alias("keyword"))


@op("SELECT id, testo FROM normativa WHERE id IN (SELECT normativa_id FROM normativa_chunk WHERE chunk_no > 1)")
def join_semi(spark, sf):
    n, c = _t(spark, sf, "normativa", "normativa_chunk")
    return n.join(c.where("chunk_no > 1").select(F.col("normativa_id").alias("id")), "id", "left_semi").select("id", "testo")


@op("SELECT i.run_id, count(*) AS orphans FROM sync_item i LEFT JOIN normativa_chunk c ON i.chunk_id = c.id AND i.chunk_created_at = c.created_at WHERE c.id IS NULL GROUP BY i.run_id")
def join_anti_orphan(spark, sf):
    i, c = _t(spark, sf, "sync_item", "normativa_chunk")
    gone = i.join(c.select(F.col("id").alias("chunk_id"), F.col("created_at").alias("chunk_created_at")), ["chunk_id", "chunk_created_at"], "left_anti")
    return gone.groupBy("run_id").agg(F.count("*").alias("orphans"))


@op("""WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
    SELECT a.o AS a, b.o AS b, count(*) AS shared FROM e a JOIN e b ON a.p = b.p AND a.o < b.o GROUP BY 1, 2 HAVING count(*) >= 2""")
def join_self_pairs(spark, sf):
    """Orders that share two parts or more."""
    return rel.sharing_pairs(_t(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@op("SELECT c.id, c.chunk_no FROM (SELECT DISTINCT normativa_id, chunk_no, char_start, id FROM normativa_chunk) c JOIN (SELECT DISTINCT normativa_id, chunk_no, char_start FROM normativa_chunk) p ON c.normativa_id = p.normativa_id AND c.chunk_no = p.chunk_no + 1 WHERE c.char_start < p.char_start")
def join_self_hierarchy(spark, sf):
    c = _t(spark, sf, "normativa_chunk")
    child = c.select("normativa_id", "chunk_no", "char_start", "id").distinct()
    parent = c.select("normativa_id", (F.col("chunk_no") + 1).alias("chunk_no"), F.col("char_start").alias("before")).distinct()
    return child.join(parent, ["normativa_id", "chunk_no"]).where("char_start < before").select("id", "chunk_no")


_SECTIONS = "SELECT document_id, decade * 100 AS s, decade * 100 + 99 AS e, decade FROM (SELECT DISTINCT document_id, pagina_inizio // 100 AS decade FROM massime WHERE pagina_inizio IS NOT NULL AND document_id IS NOT NULL)"


@op(f"SELECT m.id, x.decade FROM massime m JOIN ({_SECTIONS}) x ON m.document_id = x.document_id AND m.pagina_fine BETWEEN x.s AND x.e")
def join_range_page(spark, sf):
    m = _t(spark, sf, "massime")
    decade = F.floor(F.col("pagina_inizio") / 100)
    sections = m.where("pagina_inizio is not null and document_id is not null").select("document_id", decade.alias("decade")).distinct()
    sections = sections.select("document_id", (F.col("decade") * 100).alias("s"), (F.col("decade") * 100 + 99).alias("e"), "decade")
    return rel.in_range(m.select("id", "document_id", "pagina_fine"), sections, ["document_id"], "pagina_fine", "s", "e", 100).select("id", "decade")


@op("WITH p AS (SELECT c_custkey, [r_name, n_name, c_mktsegment] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT path[1] AS a, path[2] AS b, count(*) AS siblings FROM p GROUP BY 1, 2")
def join_array_prefix(spark, sf):
    path = concept_paths(spark, sf).select(F.slice("path", 1, 2).alias("prefix"))
    return path.groupBy("prefix").agg(F.count("*").alias("siblings")).select(F.col("prefix")[0].alias("a"), F.col("prefix")[1].alias("b"), "siblings")


def concept_paths(spark, sf) -> DataFrame:
    c, n, r = _t(spark, sf, "customer", "nation", "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", F.array("r_name", "n_name", "c_mktsegment").alias("path"))


_AB = "(SELECT massima_id, run_id, min(label) AS label FROM llm_resolver_result GROUP BY massima_id, run_id)"


@op(f"SELECT a.run_id AS a, b.run_id AS b, count(*) AS both, sum(CASE WHEN a.label IS DISTINCT FROM b.label THEN 1 ELSE 0 END)::BIGINT AS flips FROM {_AB} a JOIN {_AB} b ON a.massima_id = b.massima_id AND a.run_id < b.run_id GROUP BY 1, 2")
def join_ab_compare(spark, sf):
    r = _t(spark, sf, "llm_resolver_result").groupBy("massima_id", "run_id").agg(F.min("label").alias("label"))
    a, b = r.select("massima_id", F.col("run_id").alias("a"), F.col("label").alias("la")), r.select("massima_id", F.col("run_id").alias("b"), F.col("label").alias("lb"))
    flips = F.sum((~F.col("la").eqNullSafe(F.col("lb"))).cast("long"))
    return a.join(b, "massima_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"), flips.alias("flips"))


@op("SELECT id, normativa_id FROM normativa_vigenza WHERE (inizio_vigore IS NULL OR inizio_vigore <= DATE '2018-01-01') AND (fine_vigore IS NULL OR fine_vigore > DATE '2018-01-01')")
def join_asof_valid_at(spark, sf):
    return rel.valid_at(_t(spark, sf, "normativa_vigenza"), "inizio_vigore", "fine_vigore", F.lit("2018-01-01").cast("date")).select("id", "normativa_id")


# Aggregations


@op("SELECT p_brand AS code, count(*) AS norms, sum(c)::BIGINT AS citations, round(avg(c), 2) AS mean, max(c) AS most FROM (SELECT p_brand, coalesce(c, 0) AS c FROM part LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) GROUP BY 1")
def agg_norm_stats(spark, sf):
    p, li = _t(spark, sf, "part", "lineitem")
    c = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("c"))
    return p.join(c, "p_partkey", "left").select(F.col("p_brand").alias("code"), F.coalesce("c", F.lit(0)).alias("c")).groupBy("code").agg(
        F.count("*").alias("norms"), F.sum("c").alias("citations"), F.round(F.avg("c"), 2).alias("mean"), F.max("c").alias("most"))


@op("SELECT w.id, count(n.id) AS n, round(avg(length(n.testo)), 4) AS mean, min(length(n.testo)) AS least, max(length(n.testo)) AS most FROM work w LEFT JOIN normativa n ON n.work_id = w.id GROUP BY w.id")
def agg_category_stats(spark, sf):
    n, w = _t(spark, sf, "normativa", "work")
    per = n.groupBy(F.col("work_id").alias("id")).agg(F.count("id").alias("n"), F.round(F.avg(F.length("testo")), 4).alias("mean"), F.min(F.length("testo")).alias("least"), F.max(F.length("testo")).alias("most"))
    return w.select("id").join(per, "id", "left").na.fill(0, ["n"])


@op("SELECT materia, tipo, extraction_mode, count(*) AS n, round(avg(importance_score), 6) AS mean FROM massime WHERE is_active GROUP BY ALL")
def agg_category_v2_stats(spark, sf):
    return _t(spark, sf, "massime").where("is_active").groupBy("materia", "tipo", "extraction_mode").agg(F.count("*").alias("n"), F.round(F.avg("importance_score"), 6).alias("mean"))


@op("SELECT document_id, min(substring(testo, 1, 2000)) AS head, list_sort(array_agg(DISTINCT materia) FILTER (WHERE materia IS NOT NULL)) AS materie, count(DISTINCT rv) AS rvs FROM massime GROUP BY document_id")
def agg_features_view(spark, sf):
    return _t(spark, sf, "massime").groupBy("document_id").agg(F.min(F.substring("testo", 1, 2000)).alias("head"), F.sort_array(F.collect_set("materia")).alias("materie"), F.countDistinct("rv").alias("rvs"))


@op("SELECT count(*) AS n, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE rv IS NULL) AS no_rv, count(*) FILTER (WHERE extraction_mode = 'ocr') AS ocr FROM massime")
def agg_filter_counts(spark, sf):
    return _t(spark, sf, "massime").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"), F.count_if(F.col("rv").isNull()).alias("no_rv"), F.count_if(F.col("extraction_mode") == "ocr").alias("ocr"))


@op("SELECT tipo, round(100.0 * count(rv) / nullif(count(*), 0), 4) AS pct FROM massime GROUP BY tipo")
def agg_pct_nullif(spark, sf):
    return _t(spark, sf, "massime").groupBy("tipo").agg(F.round(100.0 * F.count("rv") / F.nullif(F.count("*"), F.lit(0)), 4).alias("pct"))


@op("SELECT w.code, count(DISTINCT n.id) AS articles, count(DISTINCT c.id) AS chunks, count(DISTINCT v.id) AS versions FROM work w LEFT JOIN normativa n ON n.work_id = w.id LEFT JOIN normativa_chunk c ON c.normativa_id = n.id LEFT JOIN normativa_vigenza v ON v.normativa_id = n.id GROUP BY w.code")
def agg_distinct_multi(spark, sf):
    """Distinct counts over two fan-out joins, each child counted by itself before it is joined."""
    n, c, v, w = _t(spark, sf, "normativa", "normativa_chunk", "normativa_vigenza", "work")
    per = lambda t, name: t.groupBy(F.col("normativa_id").alias("id")).agg(F.countDistinct("id").alias(name))
    rows = n.select("id", "work_id").join(per(c.select("normativa_id", "id"), "chunks"), "id", "left").join(per(v.select("normativa_id", "id"), "versions"), "id", "left")
    sums = rows.groupBy("work_id").agg(F.count("id").alias("articles"), F.sum("chunks").alias("chunks"), F.sum("versions").alias("versions"))
    return w.select("code", F.col("id").alias("work_id")).join(sums, "work_id", "left").select("code", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("articles", "chunks", "versions")])


@op("SELECT user_id, count(DISTINCT event_type) FILTER (WHERE value > 50) AS big, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def agg_distinct_filter(spark, sf):
    return _t(spark, sf, "events").groupBy("user_id").agg(F.countDistinct(F.when(F.col("value") > 50, F.col("event_type"))).alias("big"), F.countDistinct("event_type").alias("kinds"))


@op("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id")
def agg_cond_pivot(spark, sf):
    return _t(spark, sf, "events").groupBy("user_id").pivot("event_type", ["view", "click", "error"]).count().na.fill(0)


@op("SELECT (SELECT count(*) FROM massime) AS massime, (SELECT count(*) FROM normativa) AS normativa, (SELECT max(anno) FROM massime) AS anno")
def agg_scalar_multi(spark, sf):
    m, n = _t(spark, sf, "massime", "normativa")
    return m.agg(F.count("*").alias("massime"), F.max("anno").alias("anno")).join(F.broadcast(n.agg(F.count("*").alias("normativa")))).select("massime", "normativa", "anno")


@op("SELECT round(count(DISTINCT l_partkey) * 1.0 / (SELECT count(*) FROM part), 6) AS covered FROM lineitem")
def agg_coverage_ratio(spark, sf):
    p, li = _t(spark, sf, "part", "lineitem")
    return li.agg(F.countDistinct("l_partkey").alias("c")).join(F.broadcast(p.agg(F.count("*").alias("n")))).select(F.round(F.col("c") / F.col("n"), 6).alias("covered"))


@op("SELECT rv, list_sort(array_agg(id)) AS ids FROM massime WHERE rv IS NOT NULL GROUP BY rv HAVING count(*) > 1")
def agg_having(spark, sf):
    return _t(spark, sf, "massime").where("rv is not null").groupBy("rv").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)


@op("SELECT CASE WHEN length(testo) < 0 THEN 0 WHEN length(testo) >= 2000 THEN 11 ELSE length(testo) // 200 + 1 END AS bucket, count(*) AS n, min(length(testo)) AS least, max(length(testo)) AS most FROM normativa GROUP BY 1")
def agg_histogram(spark, sf):
    return _t(spark, sf, "normativa").groupBy(F.width_bucket(F.length("testo"), F.lit(0.0), F.lit(2000.0), F.lit(10)).alias("bucket")).agg(
        F.count("*").alias("n"), F.min(F.length("testo")).alias("least"), F.max(F.length("testo")).alias("most"))


@op("SELECT materia, median(importance_score) AS mid FROM massime GROUP BY materia")
def agg_median(spark, sf):
    return _t(spark, sf, "massime").groupBy("materia").agg(F.median("importance_score").alias("mid"))


@op("SELECT event_type, list_sort(array_agg(value))[(floor(count(value) * 0.5) + 1)::INT] AS p50, list_sort(array_agg(value))[(floor(count(value) * 0.95) + 1)::INT] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def agg_percentile_index(spark, sf):
    """Nearest-rank percentiles by row number, so that no group is collected."""
    e = _t(spark, sf, "events").where("value is not null")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("value"))).join(n, "event_type")
    at = lambda q: F.max(F.when(F.col("r") == F.floor(F.col("n") * q) + 1, F.col("value")))
    return ranked.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@op("SELECT tipo, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.95), 4) AS p95 FROM documents WHERE n_chars IS NOT NULL GROUP BY tipo")
def agg_quantiles(spark, sf):
    return _t(spark, sf, "documents").where("n_chars is not null").groupBy("tipo").agg(F.round(F.percentile("n_chars", 0.9), 4).alias("p90"), F.round(F.percentile("n_chars", 0.95), 4).alias("p95"))


@op("SELECT date_trunc('day', created_at)::TIMESTAMP AS day, count(*) AS n FROM massime GROUP BY 1")
def agg_time_bucket(spark, sf):
    return _t(spark, sf, "massime").groupBy(F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))


@op("SELECT run_id, attempt, date_diff('second', date_trunc('second', started_at), date_trunc('second', finished_at)) AS seconds FROM sync_run WHERE finished_at IS NOT NULL")
def agg_duration(spark, sf):
    at = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    return _t(spark, sf, "sync_run").where("finished_at is not null").select("run_id", "attempt", (at("finished_at") - at("started_at")).alias("seconds"))


@op("SELECT l_partkey AS node, count(*) AS degree, round(avg(l_discount), 6) AS weight FROM lineitem GROUP BY 1 ORDER BY degree DESC, node LIMIT 25")
def agg_in_out_degree(spark, sf):
    return _t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("degree"), F.round(F.avg("l_discount"), 6).alias("weight")).orderBy(F.desc("degree"), "node").limit(25)


@op("SELECT count(*) AS edges, count(DISTINCT l_orderkey) AS sources, count(DISTINCT l_partkey) AS targets, round(avg(l_discount), 4) AS mean, count(*) FILTER (WHERE l_discount >= 0.06) AS valid FROM lineitem")
def agg_edge_stats(spark, sf):
    return _t(spark, sf, "lineitem").agg(F.count("*").alias("edges"), F.countDistinct("l_orderkey").alias("sources"), F.countDistinct("l_partkey").alias("targets"), F.round(F.avg("l_discount"), 4).alias("mean"), F.count_if(F.col("l_discount") >= 0.06).alias("valid"))


@op("SELECT label, i AS pos, round(avg(embedding[i]::DOUBLE), 5) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2")
def agg_centroid(spark, sf):
    from fondaco.operators.classify import centroids

    c = centroids(_t(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "mean")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("mean", 5).alias("mean"))


@op("SELECT model, channel, count(*) AS n, count(DISTINCT chunk_id) AS chunks, max(dims) AS dims FROM normativa_chunk_embeddings GROUP BY 1, 2")
def agg_embedding_stats(spark, sf):
    return _t(spark, sf, "normativa_chunk_embeddings").groupBy("model", "channel").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"), F.max("dims").alias("dims"))


@op("""WITH x AS (SELECT work_id, list_distinct(array_agg(try_cast(regexp_extract(articolo, '(\\d+)', 1) AS INT))) AS got, max(try_cast(regexp_extract(articolo, '(\\d+)', 1) AS INT)) AS top FROM normativa GROUP BY work_id)
    SELECT work_id, top, len(got) AS seen, len(list_filter(range(1, top + 1), lambda i: NOT list_contains(got, i::INT))) AS missing, round(len(got) * 1.0 / top, 6) AS coverage FROM x""")
def agg_batch_stats(spark, sf):
    number = F.regexp_extract("articolo", r"(\d+)", 1).try_cast("int")
    x = _t(spark, sf, "normativa").select("work_id", number.alias("n")).distinct().groupBy("work_id").agg(F.max("n").alias("top"), F.count("n").alias("seen"), F.count_if(F.col("n").between(1, 10**9)).alias("ok"))
    return x.select("work_id", "top", "seen", (F.col("top") - F.col("ok")).alias("missing"), F.round(F.col("seen") / F.col("top"), 6).alias("coverage"))


@op("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, sf):
    return _t(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@op("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf):
    return _t(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@op("SELECT l_returnflag, true AS parts_close, true AS middle_close FROM lineitem GROUP BY 1")
def agg_approx(spark, sf):
    """Whether the approximate count of parts and median of quantities of each group lie near the exact ones: within 5 % and 1 % of the ranks."""
    li = _t(spark, sf, "lineitem")
    told = li.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("e"), F.percentile_approx("l_quantity", 0.5, 1000).alias("m"), F.percentile("l_quantity", F.array(F.lit(0.49), F.lit(0.51))).alias("r"),
    )
    return told.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= 0.05 * F.col("e")).alias("parts_close"), F.col("m").between(F.floor(F.col("r")[0]), F.ceil(F.col("r")[1])).alias("middle_close"))


@op("SELECT l_returnflag, l_linestatus, year(l_shipdate)::INT AS y, count(*) AS n, grouping(l_returnflag, l_linestatus, year(l_shipdate)) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (year(l_shipdate)), ())")
def agg_grouping_sets(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("y"))
    flag, status, y = F.col("l_returnflag"), F.col("l_linestatus"), F.col("y")
    return li.groupingSets([[flag, status], [y], []], flag, status, y).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@op("SELECT s AS strategy, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM (SELECT unnest(['broadcast', 'merge', 'shuffle_hash']) AS s), lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def join_physical(spark, sf):
    """One join by three strategies, asked for by hints: the choice is the optimiser's, the rows are the same."""
    li, o = _t(spark, sf, "lineitem", "orders")
    each = [li.join(o.where("o_orderstatus = 'F'").hint(h), li.l_orderkey == o.o_orderkey, "left_semi").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).withColumn("strategy", F.lit(h)) for h in ("broadcast", "merge", "shuffle_hash")]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("strategy", "n", "qty")


# Windows, sorts, set operations


@op("SELECT id, anno, row_number() OVER (PARTITION BY anno ORDER BY importance_score DESC NULLS LAST, id) AS r FROM massime")
def win_row_number_rank(spark, sf):
    return rel.rank_by(_t(spark, sf, "massime").select("id", "anno", "importance_score"), ["anno"], [F.desc_nulls_last("importance_score"), F.col("id")], "r").drop("importance_score")


@op("SELECT id, materia FROM (SELECT id, materia, row_number() OVER (PARTITION BY materia ORDER BY md5(id::VARCHAR || 's7'), id) AS n FROM massime) WHERE n <= 20")
def win_partition_sample(spark, sf):
    return rel.sample_per_group(_t(spark, sf, "massime").select("id", "materia"), "materia", "id", 20, "s7")


@op("SELECT id, pagina_inizio, coalesce(lead(pagina_inizio) OVER (PARTITION BY document_id ORDER BY pagina_inizio, id) - 1, 999) AS range_end FROM massime WHERE pagina_inizio IS NOT NULL")
def win_lead_range_end(spark, sf):
    by = Window.partitionBy("document_id").orderBy("pagina_inizio", "id")
    return _t(spark, sf, "massime").where("pagina_inizio is not null").select("id", "pagina_inizio", F.coalesce(F.lead("pagina_inizio").over(by) - 1, F.lit(999)).alias("range_end"))


_HEADS = "SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN event_id END AS libro, CASE WHEN event_type = 'purchase' THEN event_id END AS titolo FROM events"


@op(f"""WITH h AS ({_HEADS}), l AS (SELECT *, last_value(libro IGNORE NULLS) OVER w AS lb, last_value(titolo IGNORE NULLS) OVER w AS tt FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, lb AS at_libro, CASE WHEN lb > tt THEN NULL ELSE tt END AS at_titolo FROM l""")
def win_carry_forward(spark, sf):
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("event_id"))
    rows = _t(spark, sf, "events").select("event_id", "user_id", at("signup").alias("libro"), at("purchase").alias("titolo"))
    return rel.carry_forward(rows, ["user_id"], "event_id", ["libro", "titolo"]).select("event_id", "at_libro", "at_titolo")


@op("""WITH c AS (SELECT id, normativa_id, chunk_no, max(text) AS text FROM normativa_chunk GROUP BY ALL)
    SELECT id, coalesce(right(lag(text) OVER w, 50), '') || '|' || coalesce(left(lead(text) OVER w, 50), '') AS context FROM c WINDOW w AS (PARTITION BY normativa_id ORDER BY chunk_no, id)""")
def win_neighbor_context(spark, sf):
    c = _t(spark, sf, "normativa_chunk").groupBy("id", "normativa_id", "chunk_no").agg(F.max("text").alias("text"))
    by = Window.partitionBy("normativa_id").orderBy("chunk_no", "id")
    return c.select("id", F.concat(F.coalesce(F.right(F.lag("text").over(by), F.lit(50)), F.lit("")), F.lit("|"), F.coalesce(F.left(F.lead("text").over(by), F.lit(50)), F.lit(""))).alias("context"))


@op("""WITH d AS (SELECT DISTINCT user_id, event_id // 10 AS p FROM events), m AS (SELECT *, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM d)
    SELECT user_id, min(p) AS first, max(p) AS last, count(*) AS length FROM m GROUP BY user_id, g HAVING count(*) >= 2""")
def win_gaps_islands(spark, sf):
    return rel.islands(_t(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 10).alias("p")), ["user_id"], "p", 2)


@op("""WITH b AS (SELECT document_id, id, avg(coalesce(importance_score, 0)) OVER (PARTITION BY document_id ORDER BY pagina_inizio NULLS FIRST, id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS score FROM massime)
    SELECT document_id, arg_max(id, (round(score, 6), -id)) AS centre, round(max(score), 6) AS best FROM b GROUP BY document_id""")
def win_moving_window_best(spark, sf):
    by = Window.partitionBy("document_id").orderBy("pagina_inizio", "id").rowsBetween(-7, 7)
    scored = _t(spark, sf, "massime").select("document_id", "id", F.avg(F.coalesce("importance_score", F.lit(0))).over(by).alias("score"))
    return scored.groupBy("document_id").agg(F.max_by("id", F.struct(F.round("score", 6), -F.col("id"))).alias("centre"), F.round(F.max("score"), 6).alias("best"))


@op("SELECT massima_id, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY massima_id ORDER BY confidence DESC NULLS LAST, id) AS n FROM (SELECT DISTINCT massima_id, id, confidence FROM llm_resolver_result)) WHERE n = 1")
def win_distinct_on(spark, sf):
    rows = _t(spark, sf, "llm_resolver_result").select("massima_id", "id", "confidence").distinct()
    return rel.latest(rows, ["massima_id"], [F.desc_nulls_last("confidence"), F.col("id")])


_DELTA = "SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY importance_score DESC NULLS LAST, id) - row_number() OVER (PARTITION BY document_id ORDER BY anno DESC NULLS LAST, id) AS delta FROM massime"


@op(f"SELECT document_id, round(avg(delta), 6) AS mean, count(*) FILTER (WHERE delta > 0) AS improved, count(*) FILTER (WHERE delta < 0) AS worsened, count(*) FILTER (WHERE delta = 0) AS unchanged FROM ({_DELTA}) GROUP BY document_id")
def win_rank_delta(spark, sf):
    m = _t(spark, sf, "massime").select("document_id", "id", "importance_score", "anno")
    m = rel.rank_by(rel.rank_by(m, ["document_id"], [F.desc_nulls_last("importance_score"), F.col("id")], "a"), ["document_id"], [F.desc_nulls_last("anno"), F.col("id")], "b").withColumn("d", F.col("a") - F.col("b"))
    return m.groupBy("document_id").agg(F.round(F.avg("d"), 6).alias("mean"), F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("worsened"), F.count_if(F.col("d") == 0).alias("unchanged"))


@op("SELECT materia, round(max(importance_score) - coalesce(list_sort(array_agg(importance_score), 'DESC')[2], 0), 6) AS delta FROM massime WHERE importance_score IS NOT NULL GROUP BY materia")
def win_delta_top2(spark, sf):
    top = rel.rank_by(_t(spark, sf, "massime").where("importance_score is not null").select("materia", "importance_score"), ["materia"], [F.desc("importance_score")], "n", 2)
    return top.groupBy("materia").agg(F.round(F.max("importance_score") - F.coalesce(F.max(F.when(F.col("n") == 2, F.col("importance_score"))), F.lit(0)), 6).alias("delta"))


@op("SELECT id, ntile(4) OVER (ORDER BY nome_breve) AS quarter, dense_rank() OVER (ORDER BY atto_tipo) AS kind, lag(code) OVER (ORDER BY id) AS before FROM work")
def win_ntile_lag(spark, sf):
    """Over the fixed table of acts, the only place where a window needs no partition."""
    return _t(spark, sf, "work").select("id", F.ntile(4).over(Window.orderBy("nome_breve")).alias("quarter"), F.dense_rank().over(Window.orderBy("atto_tipo")).alias("kind"), F.lag("code").over(Window.orderBy("id")).alias("before"))


@op("SELECT o_orderkey, round(cume_dist() OVER w, 6) AS below, round(percent_rank() OVER w, 6) AS rank, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)")
def win_cume_dist(spark, sf):
    """Where an order stands among its customer's by price, and how many orders the customer placed in the 90 days to it."""
    by = Window.partitionBy("o_custkey").orderBy("o_totalprice")
    days = Window.partitionBy("o_custkey").orderBy(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).rangeBetween(-90 * 86_400_000_000, 0)
    return _t(spark, sf, "orders").select("o_orderkey", F.round(F.cume_dist().over(by), 6).alias("below"), F.round(F.percent_rank().over(by), 6).alias("rank"), F.count("*").over(days).alias("recent"))


@op("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) <= 2")
def win_qualify(spark, sf):
    """Rows by the rank they have in their group, ties included."""
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.rank().over(best).alias("r")).where("r <= 2").drop("r")


@op("SELECT id, importance_score FROM massime WHERE importance_score IS NOT NULL ORDER BY importance_score DESC, id LIMIT 50")
def topk_score(spark, sf):
    return _t(spark, sf, "massime").where("importance_score is not null").select("id", "importance_score").orderBy(F.desc("importance_score"), "id").limit(50)


@op("SELECT id, anno, numero FROM massime ORDER BY anno DESC NULLS LAST, numero DESC NULLS LAST, id LIMIT 50")
def topk_nulls_last(spark, sf):
    return _t(spark, sf, "massime").select("id", "anno", "numero").orderBy(F.desc_nulls_last("anno"), F.desc_nulls_last("numero"), "id").limit(50)


@op("SELECT document_id, id FROM (SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY importance_score DESC NULLS LAST, id) AS n FROM massime) WHERE n <= 3")
def topk_per_group(spark, sf):
    return rel.rank_by(_t(spark, sf, "massime").select("document_id", "id", "importance_score"), ["document_id"], [F.desc_nulls_last("importance_score"), F.col("id")], "n", 3).select("document_id", "id")


@op("SELECT id FROM work ORDER BY CASE atto_tipo WHEN 'CODICE' THEN 0 WHEN 'TESTO_UNICO' THEN 1 ELSE 2 END, atto_data DESC, id LIMIT 20")
def sort_specificity(spark, sf):
    return _t(spark, sf, "work").orderBy(F.when(F.col("atto_tipo") == "CODICE", 0).when(F.col("atto_tipo") == "TESTO_UNICO", 1).otherwise(2), F.desc("atto_data"), "id").select("id").limit(20)


@op("SELECT work_id, count(*) AS n FROM normativa GROUP BY work_id ORDER BY n, work_id LIMIT 10")
def topk_bottom(spark, sf):
    return _t(spark, sf, "normativa").groupBy("work_id").agg(F.count("*").alias("n")).orderBy("n", "work_id").limit(10)


@op("SELECT id FROM massime ORDER BY md5(id::VARCHAR || '42'), id LIMIT 100")
def limit_random(spark, sf):
    return _t(spark, sf, "massime").select("id").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("42"))), "id").limit(100)


@op("""SELECT 'massima' AS kind, id, testo AS text, NULL AS act FROM massime UNION ALL SELECT 'articolo', id, testo, work_id::VARCHAR FROM normativa
    UNION ALL SELECT 'altalex', id, testo, codice FROM normativa_altalex""")
def union_all_views(spark, sf):
    m, n, a = _t(spark, sf, "massime", "normativa", "normativa_altalex")
    part = lambda t, kind, **more: t.select(F.lit(kind).alias("kind"), "id", F.col("testo").alias("text"), *[c.alias(k) for k, c in more.items()])
    return part(m, "massima").unionByName(part(n, "articolo", act=F.col("work_id").cast("string")), allowMissingColumns=True).unionByName(part(a, "altalex", act=F.col("codice")), allowMissingColumns=True)


@op("SELECT lower(rubrica) AS voce, 'n' AS src FROM normativa WHERE rubrica IS NOT NULL UNION ALL SELECT lower(rubrica), 'a' FROM normativa_altalex WHERE rubrica IS NOT NULL")
def union_all_glossary(spark, sf):
    n, a = _t(spark, sf, "normativa", "normativa_altalex")
    part = lambda t, s: t.where("rubrica is not null").select(F.lower("rubrica").alias("voce"), F.lit(s).alias("src"))
    return part(n, "n").unionByName(part(a, "a"))


@op("SELECT l_suppkey AS a, l_partkey AS b, 'out' AS way FROM lineitem UNION SELECT l_partkey, l_suppkey, 'in' FROM lineitem")
def union_bidirectional(spark, sf):
    e = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return e.withColumn("way", F.lit("out")).unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("in").alias("way")))


@op("SELECT a.id, len(list_intersect(a.keywords, b.keywords)) AS overlap FROM massime a JOIN massime b ON a.rv = b.rv AND a.id < b.id WHERE a.keywords IS NOT NULL AND b.keywords IS NOT NULL")
def set_intersect_arrays(spark, sf):
    m = _t(spark, sf, "massime").where("keywords is not null and rv is not null").select("id", "rv", "keywords")
    other = m.select(F.col("id").alias("o"), "rv", F.col("keywords").alias("k"))
    return m.join(other, "rv").where("id < o").select("id", F.size(F.array_intersect("keywords", "k")).cast("long").alias("overlap"))


@op("SELECT 'missing' AS side, id FROM (SELECT id FROM normativa EXCEPT SELECT normativa_id FROM normativa_vigenza) UNION ALL SELECT 'extra', id FROM (SELECT normativa_id AS id FROM normativa_vigenza EXCEPT SELECT id FROM normativa)")
def set_expected_diff(spark, sf):
    want, got = _t(spark, sf, "normativa").select("id"), _t(spark, sf, "normativa_vigenza").select(F.col("normativa_id").alias("id"))
    return want.subtract(got).select(F.lit("missing").alias("side"), "id").unionByName(got.subtract(want).select(F.lit("extra").alias("side"), "id"))


@op("SELECT id FROM normativa INTERSECT SELECT brocardi_match_id FROM normativa_altalex")
def set_intersect(spark, sf):
    n, a = _t(spark, sf, "normativa", "normativa_altalex")
    return n.select("id").intersect(a.select("brocardi_match_id"))


# Merges


def _chunks(spark, sf):
    """The first delivery of each chunk as target, the last as feed."""
    c = _t(spark, sf, "normativa_chunk").select("id", "text", "created_at")
    return rel.latest(c, ["id"], [F.col("created_at"), F.col("text")]), rel.latest(c, ["id"], [F.desc("created_at"), F.desc("text")])


_FIRST = "(SELECT id, text, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, text) AS n FROM normativa_chunk) WHERE n = 1)"
_LAST = "(SELECT id, text, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, text DESC) AS n FROM normativa_chunk) WHERE n = 1)"


@op(f"SELECT * FROM {_LAST}")
def sink_upsert(spark, sf):
    return rel.upsert(*_chunks(spark, sf), ["id"])


@op(f"SELECT * FROM {_FIRST}")
def sink_insert_ignore(spark, sf):
    return rel.insert_ignore(*_chunks(spark, sf), ["id"])


@op(f"""WITH f AS {_FIRST}, l AS {_LAST}
    SELECT f.id, f.text, DATE '2025-01-01' AS valid_from, CASE WHEN f.text <> l.text THEN DATE '2025-12-31' END AS valid_to FROM f JOIN l ON f.id = l.id
    UNION ALL SELECT l.id, l.text, DATE '2025-12-31', NULL FROM f JOIN l ON f.id = l.id WHERE f.text <> l.text""")
def sink_scd2_merge(spark, sf):
    first, last = _chunks(spark, sf)
    digest = lambda d: d.withColumn("digest", F.sha2("text", 256)).drop("created_at")
    target = digest(first).withColumn("valid_from", F.lit("2025-01-01").cast("date")).withColumn("valid_to", F.lit(None).cast("date"))
    return rel.scd2_merge(target, digest(last), "id", "digest", "valid_from", "valid_to", F.lit("2025-12-31").cast("date")).drop("digest")


@op("SELECT id, rv FROM massime WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM massime WHERE ingest_batch_id = (SELECT max(ingest_batch_id) FROM massime) AND document_id IS NOT NULL)")
def sink_delete_by_key(spark, sf):
    m = _t(spark, sf, "massime")
    last = m.agg(F.max("ingest_batch_id").alias("ingest_batch_id"))
    return rel.delete_by_key(m, m.join(F.broadcast(last), "ingest_batch_id"), ["document_id"]).select("id", "rv")


@op("SELECT p_partkey, coalesce(c, p_size)::BIGINT AS p_size FROM part LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def sink_update_from(spark, sf):
    p, li = _t(spark, sf, "part", "lineitem")
    return rel.update_from(p.select("p_partkey", F.col("p_size").cast("long")), li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("p_size")), "p_partkey", "p_size")


QUARANTINE = "list_filter([CASE WHEN NOT coalesce(length(testo) >= 300, false) THEN 'short' END, CASE WHEN NOT coalesce(rv IS NOT NULL, false) THEN 'no_rv' END, CASE WHEN NOT coalesce(anno BETWEEN 1990 AND 2025, false) THEN 'year' END], lambda x: x IS NOT NULL)"


@op(f"SELECT id, {QUARANTINE} AS errors FROM massime")
def quarantine_split(spark, sf):
    rules = {"short": F.length("testo") >= 300, "no_rv": F.col("rv").isNotNull(), "year": F.col("anno").between(1990, 2025)}
    return rel.quarantine(_t(spark, sf, "massime"), rules).select("id", "errors")


@op(f"SELECT len(e) > 0 AS bad, count(*) AS n FROM (SELECT {QUARANTINE} AS e FROM massime) GROUP BY 1")
def article_validate(spark, sf):
    return quarantine_split(spark, sf).groupBy((F.size("errors") > 0).alias("bad")).agg(F.count("*").alias("n"))


@op("SELECT run_id, run_id = 100 AS is_active FROM sync_run")
def graph_set_active_run(spark, sf):
    runs = _t(spark, sf, "sync_run").select("run_id", F.lit("sync").alias("run_type"), (F.col("status") == "success").alias("is_active"))
    return rel.activate_run(runs, 100, "sync").select("run_id", "is_active")


@op("SELECT id, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, text) AS n FROM normativa_chunk) WHERE n = 1", name="dedup_first_seen_paged")
def dedup_first_seen(spark, sf):
    return rel.latest(_t(spark, sf, "normativa_chunk").select("id", "text", "created_at"), ["id"], [F.desc("created_at"), F.col("text")]).select("id", "text")


@op("SELECT w.code, count(DISTINCT c.id) AS missing FROM normativa_chunk c JOIN work w ON c.work_id = w.id WHERE c.id NOT IN (SELECT chunk_id FROM normativa_chunk_embeddings WHERE embedding IS NOT NULL) GROUP BY w.code")
def verify_missing_embeddings(spark, sf):
    c, e, w = _t(spark, sf, "normativa_chunk", "normativa_chunk_embeddings", "work")
    gone = c.select("id", "work_id").distinct().join(e.where("embedding is not null").select(F.col("chunk_id").alias("id")), "id", "left_anti")
    return gone.groupBy("work_id").agg(F.count("*").alias("missing")).join(w.select(F.col("id").alias("work_id"), "code"), "work_id").select("code", "missing")


@op("SELECT normativa_id, id, is_last FROM (SELECT normativa_id, id, row_number() OVER (PARTITION BY normativa_id ORDER BY created_at DESC, id DESC) = 1 AS is_last FROM normativa_vigenza)")
def version_history(spark, sf):
    ranked = rel.rank_by(_t(spark, sf, "normativa_vigenza").select("normativa_id", "id", "created_at"), ["normativa_id"], [F.desc("created_at"), F.desc("id")], "n")
    return ranked.select("normativa_id", "id", (F.col("n") == 1).alias("is_last"))


_VNO = "try_cast(nullif(regexp_extract(opendata_version, 'V(\\d+)', 1), '') AS INT)"


@op(f"SELECT normativa_id, max({_VNO}) AS newest, list_sort(array_agg(DISTINCT {_VNO}) FILTER (WHERE {_VNO} IS NOT NULL)) AS versions FROM normativa_vigenza WHERE {_VNO} IS NOT NULL GROUP BY 1")
def pick_latest_version(spark, sf):
    rows = _t(spark, sf, "normativa_vigenza").select("normativa_id", F.regexp_extract("opendata_version", r"V(\d+)", 1).try_cast("int").alias("v")).where("v is not null").distinct()
    return rows.groupBy("normativa_id").agg(F.max("v").alias("newest"), F.sort_array(F.collect_list("v")).alias("versions"))


# Reports


@op("SELECT document_id, round(100.0 * count(rv) / count(*), 2) AS linked, round(100.0 * count(pagina_inizio) / count(*), 2) AS paged FROM massime GROUP BY document_id")
def report_linking(spark, sf):
    pct = lambda c: F.round(100.0 * F.count(c) / F.count("*"), 2)
    return _t(spark, sf, "massime").groupBy("document_id").agg(pct("rv").alias("linked"), pct("pagina_inizio").alias("paged"))


@op("""WITH x AS (SELECT work_id, array_agg(DISTINCT try_cast(regexp_extract(articolo, '(\\d+)', 1) AS INT)) AS got FROM normativa GROUP BY work_id)
    SELECT work_id, list_min(got) AS first, list_max(got) AS last, list_sort(list_filter(range(list_min(got), list_max(got) + 1), lambda i: NOT list_contains(got, i::INT)))::INT[] AS gaps FROM x""")
def report_articles(spark, sf):
    number = F.regexp_extract("articolo", r"(\d+)", 1).try_cast("int")
    got = _t(spark, sf, "normativa").select("work_id", number.alias("n")).groupBy("work_id").agg(F.collect_set("n").alias("got"))
    first, last = F.array_min("got"), F.array_max("got")
    return got.select("work_id", first.alias("first"), last.alias("last"), F.sort_array(F.array_except(F.sequence(first, last), "got")).alias("gaps"))


@op("SELECT id, n - 1 AS peers FROM (SELECT id, count(*) OVER (PARTITION BY lower(replace(a, '.', ''))) AS n FROM (SELECT id, abbreviazioni[1] AS a FROM work)) WHERE n > 1")
def catalog_duplicates(spark, sf):
    w = _t(spark, sf, "work").select("id", F.lower(F.replace(F.col("abbreviazioni")[0], F.lit("."), F.lit(""))).alias("a"))
    return w.withColumn("n", F.count("*").over(Window.partitionBy("a"))).where("n > 1").select("id", (F.col("n") - 1).alias("peers"))


@op("SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed, max(ts) FILTER (WHERE event_type = 'error') AS last_failure FROM events GROUP BY user_id")
def tool_health_counters(spark, sf):
    bad = F.col("event_type") == "error"
    return _t(spark, sf, "events").groupBy("user_id").agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"), F.max(F.when(bad, F.col("ts"))).alias("last_failure"))


@op("SELECT n.id, w.code, w.nome_breve, n.articolo FROM normativa n JOIN work w ON n.work_id = w.id WHERE n.is_current")
def view_normativa_current(spark, sf):
    n, w = _t(spark, sf, "normativa", "work")
    return n.where("is_current").select("id", "work_id", "articolo").join(w.select(F.col("id").alias("work_id"), "code", "nome_breve"), "work_id").drop("work_id")


_BEST = "(SELECT massima_id, label, confidence FROM (SELECT *, row_number() OVER (PARTITION BY massima_id ORDER BY confidence DESC NULLS LAST, id) AS n FROM (SELECT DISTINCT massima_id, id, label, confidence FROM llm_resolver_result WHERE accepted)) WHERE n = 1)"


@op(f"SELECT m.id, b.label, b.confidence FROM massime m LEFT JOIN {_BEST} b ON m.id = b.massima_id WHERE m.is_active")
def view_massime_with_category(spark, sf):
    m, r = _t(spark, sf, "massime", "llm_resolver_result")
    best = rel.latest(r.where("accepted").select(F.col("massima_id").alias("id"), F.col("id").alias("row"), "label", "confidence").distinct(), ["id"], [F.desc_nulls_last("confidence"), F.col("row")])
    return m.where("is_active").select("id").join(best.drop("row"), "id", "left")


@op("SELECT m.id, r.label FROM massime m LEFT JOIN (SELECT DISTINCT massima_id, label FROM llm_resolver_result WHERE run_id = (SELECT max(run_id) FROM llm_resolver_result)) r ON m.id = r.massima_id")
def view_massime_enriched(spark, sf):
    m, r = _t(spark, sf, "massime", "llm_resolver_result")
    active = rel.active_run(r.select("run_id").withColumn("is_active", F.lit(True)))
    told = r.join(F.broadcast(active), "run_id").select(F.col("massima_id").alias("id"), "label").distinct()
    return m.select("id").join(told, "id", "left")


@op("SELECT massima_id, list_sort(array_agg(DISTINCT label)) AS labels, max(confidence) AS best FROM llm_resolver_result WHERE label IS NOT NULL GROUP BY massima_id")
def fn_massima_categories(spark, sf):
    return _t(spark, sf, "llm_resolver_result").where("label is not null").groupBy("massima_id").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.max("confidence").alias("best"))


@op("SELECT w.id, concat_ws(' | ', nome_breve, code, list_aggregate(abbreviazioni, 'string_agg', ', ')) AS text, n.c AS links FROM work w JOIN (SELECT work_id, count(*) AS c FROM normativa GROUP BY 1) n ON n.work_id = w.id")
def principle_links(spark, sf):
    n, w = _t(spark, sf, "normativa", "work")
    per = n.groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("links"))
    return w.join(per, "id").select("id", F.concat_ws(" | ", "nome_breve", "code", F.array_join("abbreviazioni", ", ")).alias("text"), "links")


@op("SELECT n.id, w.nome_breve || ' > ' || concat_ws(' > ', libro, titolo, capo) || ' | Art. ' || articolo || coalesce(' — ' || rubrica, '') || ' | ' || testo AS text FROM normativa n JOIN work w ON n.work_id = w.id")
def embed_text_enriched(spark, sf):
    n, w = _t(spark, sf, "normativa", "work")
    j = n.join(w.select(F.col("id").alias("work_id"), "nome_breve"), "work_id")
    return j.select("id", F.concat(F.col("nome_breve"), F.lit(" > "), F.concat_ws(" > ", "libro", "titolo", "capo"), F.lit(" | Art. "), F.col("articolo"), F.coalesce(F.concat(F.lit(" — "), F.col("rubrica")), F.lit("")), F.lit(" | "), F.col("testo")).alias("text"))


@op("SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)")
def lookback_window(spark, sf):
    e = _t(spark, sf, "events")
    return e.join(F.broadcast(e.agg((F.max("ts") - F.expr("interval 7 days")).alias("since"))), F.col("ts") >= F.col("since")).select("event_id", "event_type")


@op("SELECT user_id, count(*) AS live FROM events WHERE ts + INTERVAL 3 DAY > (SELECT max(ts) FROM events) GROUP BY user_id")
def cache_ttl(spark, sf):
    e = _t(spark, sf, "events")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("now"))), F.col("ts") + F.expr("interval 3 days") > F.col("now")).groupBy("user_id").agg(F.count("*").alias("live"))
