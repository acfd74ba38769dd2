"""Queries of extraction, routing and graph operators over whole tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from fondaco.functions import legal, text as tx
from fondaco.operators import extract as ex, graph as gr, relational as rel, retrieval as ret
from fondaco.plans.relational import concept_paths
from fondaco.plans.texts import sql_article_number, sql_words
from fondaco.session import materialise, shared_dir, table

QUERIES, SQL = {}, {}


def op(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


def texts(spark: SparkSession, sf: str):
    return table(spark, sf, "massime").where("testo is not null").select("id", F.col("testo").alias("text"))


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def all_of(pattern: str, groups: int, where: str = "massime WHERE testo IS NOT NULL") -> str:
    parts = ", ".join(f"unnest(regexp_extract_all(testo, {q(pattern)}, {i})) AS g{i}" for i in range(1, groups + 1))
    return f"SELECT id, {parts} FROM {where}"


NUMERO = "CASE WHEN {0} <> '' AND regexp_replace({0}, '^0+', '') = '' THEN '0' ELSE regexp_replace({0}, '^0+', '') END"
SEZIONE = "CASE WHEN lower(trim({0})) IN ('un', 'unite', 'u') THEN 'U' WHEN lower(trim({0})) IN ('lav', 'l') THEN 'L' ELSE trim({0}) END"
RVN = r"CASE WHEN regexp_extract({0}, '^0*(\d{{5,7}})', 1) <> '' THEN regexp_extract({0}, '^0*(\d{{5,7}})', 1) ELSE {0} END"


def placed(pattern: str, groups: int, before: int, after: int = 0, where: str = "massime WHERE testo IS NOT NULL") -> str:
    """SQL of matches with their place and what stands around them: (id, position, raw_span, around, g1, ...)."""
    found = ", ".join(f"regexp_extract_all(testo, {q(pattern)}, {i}) AS g{i}" for i in range(1, groups + 1))
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)::INT"
    rest = f" + length(spans[i]) + {after}" if after else ""
    lists = ", ".join(f"unnest({c}) AS {n}" for c, n in [("places", "position"), ("spans", "raw_span"), ("beside", "around"), *[(f"g{i}", f"g{i}") for i in range(1, groups + 1)]])
    return f"""SELECT id, {lists} FROM (
        SELECT *, list_transform(range(1, len(spans) + 1), lambda i: substr(testo, greatest(places[i] - {before}, 0) + 1, places[i] - greatest(places[i] - {before}, 0){rest})) AS beside FROM (
        SELECT *, list_transform(range(1, len(spans) + 1), lambda i: {size.format('pieces[1:i]')} + {size.format('spans[1:i - 1]')}) AS places FROM (
        SELECT id, testo, regexp_extract_all(testo, {q(pattern)}, 0) AS spans, string_split_regex(testo, {q(pattern)}) AS pieces, {found} FROM {where})))"""


INDICATOR = "CASE " + " ".join(f"WHEN regexp_matches(lower(around), {q(p)}) THEN '{n}'" for n, p in ex.ATTITUDES) + " END"
MENTIONS = f"""SELECT id, 'rv' AS kind, g1 AS rv_raw, {RVN.format('g1')} AS rv, NULL AS sezione, NULL AS numero, NULL::INT AS anno, position, raw_span, {INDICATOR} AS indicator FROM ({placed(ex.RV, 1, 50)})
    UNION ALL SELECT id, 'sez_num_anno', NULL, NULL, {SEZIONE.format('g1')}, {NUMERO.format('g2')}, g3::INT, position, raw_span, {INDICATOR} FROM ({placed(ex.SEZ, 3, 50)})
    UNION ALL SELECT id, 'num_anno', NULL, NULL, NULL, {NUMERO.format('g1')}, g2::INT, position, raw_span, {INDICATOR} FROM ({placed(ex.NUM, 2, 50)})
    UNION ALL SELECT id, 'sentenza', NULL, NULL, NULL, {NUMERO.format('g1')}, g2::INT, position, raw_span, {INDICATOR} FROM ({placed(ex.SENTENCE, 2, 50)})"""


@op(f"SELECT id, kind, rv, sezione, numero, anno, position, raw_span FROM ({MENTIONS})")
def extract_mentions(spark, sf):
    return ex.mentions(texts(spark, sf)).select("id", "kind", "rv", "sezione", "numero", "anno", "position", "raw_span")


@op(f"SELECT id, kind, position, raw_span, indicator FROM ({MENTIONS})")
def detect_indicator(spark, sf):
    return ex.mention_places(texts(spark, sf))


KEYS = "k AS (SELECT id, rv, sezione, numero, anno FROM massime WHERE is_active)"
RESOLVED = f"""{KEYS}, m AS ({MENTIONS}), h AS (
    SELECT m.*, 0 AS level, (SELECT min(id) FROM k WHERE k.rv = m.rv) AS target FROM m WHERE m.rv IS NOT NULL UNION ALL
    SELECT m.*, 1, (SELECT min(id) FROM k WHERE {SEZIONE.format('k.sezione')} = m.sezione AND k.numero = m.numero AND k.anno = m.anno) FROM m UNION ALL
    SELECT m.*, 2, (SELECT min(id) FROM k WHERE k.numero = m.numero AND k.anno = m.anno) FROM m),
    b AS (SELECT id, kind, rv_raw, rv, sezione, numero, anno, position, raw_span, indicator, arg_min(target, level) AS target, min(level) AS level FROM h WHERE target IS NOT NULL GROUP BY ALL)
    SELECT *, ['rv_exact', 'sez_num_anno', 'num_anno'][level + 1] AS resolver FROM b WHERE target <> id"""


def resolved(spark, sf):
    keys = table(spark, sf, "massime").where("is_active").select("id", "rv", "sezione", "numero", "anno")
    return ex.resolve(ex.mentions(texts(spark, sf)).drop("numero_raw"), keys)


@op(f"SELECT id, kind, rv, sezione, numero, anno, position, target, level, resolver FROM (WITH {RESOLVED})")
def resolve_mention(spark, sf):
    level = F.when(F.col("resolver") == "rv_exact", 0).when(F.col("resolver") == "sez_num_anno", 1).otherwise(2)
    return resolved(spark, sf).select("id", "kind", "rv", "sezione", "numero", "anno", "position", "target", level.alias("level"), "resolver")


WEIGHT = "round(CASE WHEN indicator IN ('OVERRULES', 'DISTINGUISHES') THEN least(1.1 * w, 1.0) ELSE w END, 2)::DOUBLE"
WEIGHED = f"(SELECT *, {WEIGHT} AS weight FROM (SELECT *, CASE resolver WHEN 'rv_exact' THEN 1.0 WHEN 'sez_num_anno' THEN 0.9 ELSE 0.7 END::DOUBLE AS w FROM (WITH {RESOLVED})))"


@op(f"SELECT id, kind, position, target, weight FROM {WEIGHED}")
def mention_weight(spark, sf):
    return resolved(spark, sf).select("id", "kind", "position", "target", ex.mention_weight(F.col("resolver"), F.col("indicator")).alias("weight"))


_JSON = lambda c: f"""coalesce('"' || replace(replace(replace({c}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"', 'null')"""
_PATTERN = "coalesce('Rv.' || rv || CASE WHEN rv_raw <> rv THEN ' (raw: ' || rv_raw || ')' ELSE '' END, 'Sez.' || sezione || '/n.' || numero || '/' || anno, 'n.' || numero || '/' || anno)"
EVIDENCE = f"""'{{"pattern":' || {_JSON(_PATTERN)} || ',"indicator":' || {_JSON('indicator')} || ',"resolver":' || {_JSON('resolver')} || ',"raw_span":' || {_JSON('substr(raw_span, 1, 100)')} || '}}'"""


@op(f"SELECT id, position, target, {EVIDENCE} AS evidence FROM {WEIGHED}")
def evidence_json(spark, sf):
    told = ex.evidence(*map(F.col, ("rv", "rv_raw", "sezione", "numero", "anno", "raw_span", "resolver", "indicator")))
    return resolved(spark, sf).select("id", "position", "target", told.alias("evidence"))


EDGES = f"""SELECT source, target, indicator, confidence, weight, evidence FROM (SELECT id AS source, target, indicator, CASE WHEN contains(resolver, 'rv') THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence, weight, {EVIDENCE} AS evidence,
    row_number() OVER (PARTITION BY id, target, indicator ORDER BY contains(resolver, 'rv') DESC, list_position({ex.FORMS!r}, kind), position) AS n FROM {WEIGHED}) WHERE n = 1"""


@op(EDGES)
def dedupe_mentions(spark, sf):
    return ex.dedupe(resolved(spark, sf))


@op(f"SELECT coalesce(indicator, 'NONE') AS subtype, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, round(avg(weight), 4) AS weight, count(*) FILTER (weight < 0.6) AS weak FROM ({EDGES}) GROUP BY 1")
def graph_build_citations(spark, sf):
    """The metrics of a run that builds the citation graph, by the subtype of its edges."""
    subtype = F.coalesce("indicator", F.lit("NONE")).alias("subtype")
    return dedupe_mentions(spark, sf).groupBy(subtype).agg(
        F.count("*").alias("edges"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"), F.round(F.avg("weight"), 4).alias("weight"), F.count_if(F.col("weight") < 0.6).alias("weak"),
    )


@op(f"SELECT 'edge' AS kind, source, target, weight, 7 AS run_id FROM ({EDGES}) UNION ALL SELECT DISTINCT 'node', n, NULL::BIGINT, NULL::DOUBLE, 7 FROM (SELECT source AS n FROM ({EDGES}) UNION ALL SELECT target FROM ({EDGES}))")
def sink_dual_write(spark, sf):
    """Edges and the nodes they touch, written by run and read back; a second write of the run replaces the first."""
    edges = materialise(dedupe_mentions(spark, sf).select("source", "target", "weight"), "edges")
    nodes = edges.select(F.col("source").alias("source")).unionByName(edges.select(F.col("target").alias("source"))).distinct()
    both = edges.withColumn("kind", F.lit("edge")).unionByName(nodes.withColumn("kind", F.lit("node")), allowMissingColumns=True)
    path = f"{shared_dir(spark)}/fondaco-graph-{uuid.uuid4().hex}"
    for _ in range(2):
        rel.write_run(both, path, 7)
    return rel.read_run(spark, path, 7, both).select("kind", "source", "target", "weight", "run_id")


_codes = ", ".join(f"WHEN g{i + 3} <> '' THEN '{c}'" for i, c in enumerate(ex.CODES)).replace(", WHEN", " WHEN")


def norms_sql(where: str = "massime WHERE testo IS NOT NULL") -> str:
    codes = f"SELECT DISTINCT id, concat_ws(':', CASE {_codes} END, g1, nullif(lower(g2), '')) AS norm_id FROM ({all_of(ex.CODE_REF, 2 + len(ex.CODES), where)})"
    acts = "".join(f" UNION SELECT id, '{c}:' || g1 || ':' || g2 FROM ({all_of(p, 2, where)})" for c, p in ex.ACT_REF.items())
    return codes + acts + "".join(f" UNION SELECT id, '{c}:' || g2 || ':' || g1 FROM ({all_of(p, 2, where)})" for c, p in ex.DATED_REF.items())


NORMS = norms_sql()
_short = lambda c: f"coalesce(map {ex.ABBREVIATIONS!r}[{c}], {c})"
_acts = "".join(
    f" UNION ALL SELECT id, position, around, {form}, '{c}:' || g{a} || ':' || g{b}, '{ex.ABBREVIATIONS[c]} n. ' || g{a} || '/' || g{b} FROM ({placed(p, 2, 80, 80)})"
    for form, refs, a, b in ((1, ex.ACT_REF, 1, 2), (2, ex.DATED_REF, 2, 1)) for c, p in refs.items()
)
NORM_REFS = f"""WITH r AS (SELECT id, position, around, 0 AS form, concat_ws(':', c, g1, nullif(lower(g2), '')) AS norm_id, concat_ws(' ', 'art.', g1, nullif(lower(g2), ''), {_short('c')}) AS full_ref
        FROM (SELECT *, CASE {_codes} END AS c FROM ({placed(ex.CODE_REF, 2 + len(ex.CODES), 80, 80)})){_acts})
    SELECT id, norm_id, full_ref, trim(regexp_replace(around, '\\s+', ' ', 'g')) AS context FROM (SELECT *, row_number() OVER (PARTITION BY id, norm_id ORDER BY form DESC, position DESC) AS n FROM r) WHERE n = 1"""


@op(NORM_REFS)
def extract_norms(spark, sf):
    return ex.norm_refs(texts(spark, sf)).select("id", "norm_id", "full_ref", "context")


def cited(spark, sf):
    return ex.norms(texts(spark, sf)).select("id", "norm_id")


@op(f"SELECT norm_id, count(*) AS citations, min(id) AS first_id FROM ({NORMS}) GROUP BY 1")
def graph_build_norms(spark, sf):
    return cited(spark, sf).groupBy("norm_id").agg(F.count("*").alias("citations"), F.min("id").alias("first_id"))


DOCS = "(SELECT doc_id AS id, text AS testo FROM documents WHERE text IS NOT NULL)"


def citations_sql(where: str) -> str:
    """SQL of ex.citations: (id, tipo, raw_text, articolo, comma, lettera, codice, legge, atto_ue, autorita, sezione, numero, anno)."""
    span = lambda p: p.replace("(?i)", "(?i)(", 1) + ")"
    none = lambda c: f"nullif({c}, '')"
    code = "CASE " + " ".join(f"WHEN g{i + 5} <> '' THEN '{c}'" for i, c in enumerate(ex.CITED_CODES)) + " END"
    head = f"{none('g2')} AS articolo, {none('g3')} AS comma, {none('g4')} AS lettera"
    parts = [f"SELECT id, 'norma' AS tipo, g1 AS raw_text, {head}, {code} AS codice, NULL AS legge, NULL AS atto_ue, NULL AS autorita, NULL AS sezione, NULL AS numero, NULL::INT AS anno FROM ({all_of(span(ex.CITED_CODE), 4 + len(ex.CITED_CODES), where)})"]
    parts += [f"SELECT id, 'norma', g1, {head}, NULL, g5, NULL, NULL, NULL, NULL, NULL FROM ({all_of(span(ex.CITED_LAW), 5, where)})"]
    parts += [f"SELECT id, '{k}', g1, NULL, NULL, NULL, NULL, NULL, g2 || '/' || g3, NULL, NULL, NULL, NULL FROM ({all_of(span(p), 3, where)})" for k, p in ex.UNION_ACT.items()]
    parts += [
        f"SELECT id, 'pronuncia', g1, NULL, NULL, NULL, NULL, NULL, NULL, '{c}', {none('g2')}, {none('g3')}, {none('g6')}::INT FROM ({all_of(span(p), 6, where)}) WHERE g3 <> '' OR g6 <> ''" for c, p in ex.COURTS.items()
    ]
    return " UNION ".join(parts)


CITATIONS = citations_sql(DOCS)


def documents(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")


@op(CITATIONS)
def extract_all_citations(spark, sf):
    return ex.citations(documents(spark, sf))


@op(f"""SELECT id, list_sort(list_distinct(array_agg(lower('art. ' || articolo || ' ' || coalesce(codice, legge) || coalesce(', co. ' || comma, '') || coalesce(', lett. ' || lettera, ''))))) AS norms FROM ({CITATIONS}) WHERE tipo = 'norma' GROUP BY id""")
def cited_norm_ids(spark, sf):
    norm = ex.cited_norm(*map(F.col, ("articolo", "comma", "lettera", "codice", "legge")))
    return extract_all_citations(spark, sf).where("tipo = 'norma'").groupBy("id").agg(F.sort_array(F.collect_set(norm)).alias("norms"))


@op(f"""SELECT id, list_sort(list_distinct(array_agg(lower(autorita || coalesce(' sez. ' || sezione, '') || ' n. ' || numero || coalesce('/' || anno, ''))))) AS decisions FROM ({CITATIONS}) WHERE tipo = 'pronuncia' AND numero IS NOT NULL GROUP BY id""")
def cited_pronounce(spark, sf):
    decision = ex.cited_decision(*map(F.col, ("autorita", "sezione", "numero", "anno")))
    return extract_all_citations(spark, sf).where("tipo = 'pronuncia' and numero is not null").groupBy("id").agg(F.sort_array(F.collect_set(decision)).alias("decisions"))


NUMBERS = r"(?i)\b(art|comma|n|rv|sez)\.?\s*(\d+)"


@op(f"SELECT lower(g1) AS kind, count(*) AS n, count(DISTINCT g2) AS numbers FROM ({all_of(NUMBERS, 2)}) GROUP BY 1")
def extract_legal_numbers(spark, sf):
    return ex._rows(texts(spark, sf), NUMBERS, ["kind", "number"]).groupBy(F.lower("kind").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("number").alias("numbers"))


@op(f"""SELECT id, {SEZIONE.format(f"nullif(regexp_extract(testo, {q(ex.SEZ)}, 1), '')")} AS sezione, {NUMERO.format(f"nullif(regexp_extract(testo, {q(ex.SEZ)}, 2), '')")} AS numero,
    nullif(regexp_extract(testo, {q(ex.SEZ)}, 3), '')::INT AS anno, {RVN.format(f"nullif(regexp_extract(testo, {q(ex.RV)}, 1), '')")} AS rv FROM massime WHERE testo IS NOT NULL""")
def extract_citation_fields(spark, sf):
    return texts(spark, sf).select("id", ex.citation_fields(F.col("text")).alias("c")).select("id", "c.sezione", "c.numero", "c.anno", "c.rv")


@op(f"SELECT id, (length(trim(testo)) >= 100 AND (regexp_matches(lower(ltrim(testo)), '^(?:{ex.OPENINGS.replace(chr(39), chr(39) * 2)})') OR regexp_matches(testo, {q(ex.SEZ)}))) AS ok FROM massime WHERE testo IS NOT NULL")
def is_massima_text(spark, sf):
    return texts(spark, sf).select("id", ex.is_massima(F.col("text")).alias("ok"))


@op(f"SELECT id, coalesce(rv, {RVN.format(f'nullif(regexp_extract(testo, {q(ex.RV)}, 1), {chr(39) * 2})')}) AS rv FROM massime")
def backfill_rv(spark, sf):
    found = legal.norm_rv(F.nullif(F.regexp_extract("testo", ex.RV, 1), F.lit("")))
    return table(spark, sf, "massime").select("id", F.coalesce("rv", found).alias("rv"))


_ACT = "|".join(f"(?:{p[4:]})" for p in [*ex.ACT_REF.values(), *ex.DATED_REF.values()])


@op(f"""SELECT doc_id, CASE WHEN regexp_matches(text, {q(ex.RV)}) THEN 'citation_rv' WHEN regexp_matches(text, {q(ex.SEZ)}) THEN 'citation_sez_num_anno'
    WHEN regexp_matches(text, {q(ex.CODE_REF)}) OR regexp_matches(text, {q('(?i)(?:' + _ACT + ')')}) THEN 'norm' WHEN regexp_matches(text, '(?i)\\bn\\.?\\s*\\d+\\s*(?:/|del\\s+)\\d{{4}}') THEN 'citation_num_anno' ELSE 'semantic' END AS route
    FROM documents WHERE text IS NOT NULL""")
def route_classify(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", ex.route(F.col("text")).alias("route"))


SCORE = "CASE resolver WHEN 'rv_exact' THEN 1.0 WHEN 'sez_num_anno' THEN 0.95 ELSE 0.90 END"


@op(f"SELECT id AS query_id, target AS id, max({SCORE})::DOUBLE AS score FROM (WITH {RESOLVED}) GROUP BY 1, 2")
def route_citation_lookup(spark, sf):
    score = F.when(F.col("resolver") == "rv_exact", 1.0).when(F.col("resolver") == "sez_num_anno", 0.95).otherwise(0.90)
    return resolved(spark, sf).groupBy(F.col("id").alias("query_id"), F.col("target").alias("id")).agg(F.max(score).alias("score"))


LOOKUP = f"""WITH n AS ({NORMS}), s AS (SELECT n.norm_id, n.id, round(0.85 + least(0.10, greatest(0, coalesce(anno, 2000) - 2000) * 0.005), 6)::DOUBLE AS score FROM n JOIN massime m ON n.id = m.id)
    SELECT norm_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY norm_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10"""


@op(LOOKUP)
def route_norm_lookup(spark, sf):
    years = table(spark, sf, "massime").select("id", "anno")
    score = F.round(0.85 + F.least(F.lit(0.10), F.greatest(F.lit(0), F.coalesce("anno", F.lit(2000)) - 2000) * 0.005), 6)
    return rel.rank_by(cited(spark, sf).join(years, "id").select("norm_id", "id", score.alias("score")), ["norm_id"], [F.desc("score"), F.col("id")], "r", 10).drop("r")


@op(f"SELECT x.norm_id, x.id, round(x.score + least(0.10 + least(c.citations / 100.0, 1.0) * 0.02, 0.20), 6)::DOUBLE AS score FROM ({LOOKUP}) x JOIN ({SQL['graph_build_norms']}) c ON x.norm_id = c.norm_id")
def norm_boost(spark, sf):
    ranked = route_norm_lookup(spark, sf).withColumnRenamed("norm_id", "query_id")
    cites = cited(spark, sf).withColumnRenamed("norm_id", "query_id").join(graph_build_norms(spark, sf).select(F.col("norm_id").alias("query_id"), F.col("citations").alias("citation_count")), "query_id")
    return ret.norm_boost(ranked, cites, 10).select(F.col("query_id").alias("norm_id"), "id", "score")


@op(f"SELECT query_id, id, score, 'lookup' AS source FROM ({SQL['route_citation_lookup']})")
def routed_search(spark, sf):
    """Citations that a text resolves are its answer; ranked search answers texts without any (see hybrid_search)."""
    return route_citation_lookup(spark, sf).withColumn("source", F.lit("lookup"))


_TRIMMED = "regexp_replace(line, '^ +| +$', '', 'g')"


@op(f"""WITH l AS (SELECT id, unnest(string_split(testo, chr(10))) AS line, generate_subscripts(string_split(testo, chr(10)), 1) - 1 AS n FROM massime WHERE testo IS NOT NULL),
    t AS (SELECT id, n, {_TRIMMED} AS t FROM l WHERE length({_TRIMMED}) > 0),
    m AS (SELECT *, coalesce(lag(t LIKE '%-' OR (NOT regexp_matches(t, '[.!?:;)]$') AND length(t) > 10)) OVER (PARTITION BY id ORDER BY n), false) AS open FROM t),
    r AS (SELECT *, sum(CASE WHEN open THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS run FROM m), e AS (SELECT *, n = max(n) OVER (PARTITION BY id, run) AS last FROM r)
    SELECT id, min(n)::INT AS first, string_agg(CASE WHEN last THEN t WHEN t LIKE '%-' THEN left(t, length(t) - 1) ELSE t || ' ' END, '' ORDER BY n) AS text FROM e GROUP BY id, run""")
def merge_split_paragraphs(spark, sf):
    lines = table(spark, sf, "massime").where("testo is not null").select("id", F.posexplode(F.split("testo", "\n")).alias("n", "line"))
    return ex.merge_paragraphs(lines, "id", "n", "line")


@op(r"SELECT id, list_distinct(regexp_extract_all(testo, '\[(\d+(?:-?[a-z]+)?)\]', 1)) AS refs, coalesce(regexp_matches(lower(testo), '\babrogat[oaie]\b'), false) AS gone FROM normativa_altalex WHERE testo IS NOT NULL AND len(list_distinct(regexp_extract_all(testo, '\[(\d+(?:-?[a-z]+)?)\]', 1))) < 2")
def extract_cross_refs(spark, sf):
    rows = table(spark, sf, "normativa_altalex").where("testo is not null").select("id", ex.cross_references(F.col("testo")).alias("refs"), ex.is_abrogated(F.col("testo")).alias("gone"))
    return rows.where(F.size("refs") < 2)


@op(f"SELECT id, 'Libro ' || coalesce(libro, '-') AS a, {sql_article_number('articolo')} AS n, count(*) OVER (PARTITION BY work_id, libro) AS in_book FROM normativa")
def section_parse(spark, sf):
    from pyspark.sql import Window

    n = table(spark, sf, "normativa")
    return n.select("id", F.concat(F.lit("Libro "), F.coalesce("libro", F.lit("-"))).alias("a"), legal.article_number(F.col("articolo")).alias("n"), F.count("*").over(Window.partitionBy("work_id", "libro")).alias("in_book"))


# Graphs over suppliers (negative ids) and parts


def edges(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy((-1 - F.col("l_suppkey")).alias("source"), F.col("l_partkey").alias("target")).agg(F.round(F.max("l_discount") * 10, 4).alias("weight"))


def seeds(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey % 50 = 0").select((-1 - F.col("s_suppkey")).alias("id"))


E = "e AS (SELECT -1 - l_suppkey AS source, l_partkey AS target, round(max(l_discount) * 10, 4) AS weight FROM lineitem GROUP BY 1, 2)"
S = "s AS (SELECT -1 - s_suppkey AS id FROM supplier WHERE s_suppkey % 50 = 0)"
B = "b AS (SELECT source, target, weight FROM e UNION ALL SELECT target, source, weight FROM e)"


@op(f"""WITH {E}, {S}, {B}, one AS (SELECT s.id AS start, target AS node, 1 AS depth, max(weight) AS weight FROM s JOIN b ON b.source = s.id WHERE weight >= 0.9 AND target <> s.id GROUP BY 1, 2),
    two AS (SELECT start, b.target AS node, 2 AS depth, max(b.weight) AS weight FROM one JOIN b ON b.source = one.node WHERE b.weight >= 0.9 AND b.target <> start AND NOT EXISTS (SELECT 1 FROM one o WHERE o.start = one.start AND o.node = b.target) GROUP BY 1, 2)
    SELECT * FROM one UNION ALL SELECT * FROM two""")
def graph_neighbors(spark, sf):
    return gr.neighbors(seeds(spark, sf), gr.both_ways(edges(spark, sf)), 2, 0.9)




@op(f"""WITH {E}, {S}, {B}, one AS (SELECT s.id AS start, target AS node, max(weight) AS total FROM s JOIN b ON b.source = s.id WHERE weight >= 0.9 AND target <> s.id GROUP BY 1, 2),
    two AS (SELECT start, b.target AS node, max(total + b.weight) AS total FROM one JOIN b ON b.source = one.node WHERE b.weight >= 0.9 AND b.target <> start GROUP BY 1, 2),
    u AS (SELECT *, 1 AS length, total / 1.3::DOUBLE AS score FROM one UNION ALL SELECT *, 2, total / 1.6::DOUBLE FROM two)
    SELECT start, node, arg_max(length, (score, -length)) AS length, round(arg_max(total, (score, -length)), 6) AS total, round(max(score), 6) AS score FROM u GROUP BY 1, 2""")
def graph_expand_cypher(spark, sf):
    return gr.expand(seeds(spark, sf), edges(spark, sf), 2, 0.9).select("start", "node", "length", F.round("total", 6).alias("total"), F.round("score", 6).alias("score"))


EXPANDED = f"""WITH {E}, {S}, {B}, one AS (SELECT target AS node, source AS seed, weight FROM b JOIN s ON b.source = s.id WHERE weight >= 0.5 AND target NOT IN (SELECT id FROM s)),
    kept AS (SELECT node FROM one GROUP BY node ORDER BY round(sum(weight), 6) DESC, node LIMIT 50),
    two AS (SELECT target AS node, source AS via, weight * 0.7 AS weight FROM b JOIN kept ON b.source = kept.node WHERE weight >= 0.5 AND target NOT IN (SELECT id FROM s) AND target NOT IN (SELECT node FROM kept)),
    sd AS (SELECT node, seed FROM one UNION SELECT two.node, one.seed FROM two JOIN one ON two.via = one.node), w AS (SELECT node, weight, 1 AS depth FROM one UNION ALL SELECT node, weight, 2 FROM two),
    t AS (SELECT node, round(sum(weight), 6)::DOUBLE AS total, min(depth) AS depth FROM w GROUP BY node) SELECT t.node, count(*) AS seeds, total, depth FROM t JOIN sd ON t.node = sd.node GROUP BY ALL"""
BOOSTED = f"SELECT node, round(0.15 * (0.4 * least(seeds * 0.3, 1.0) + 0.3 * 1.0 + 0.3 * least(total / 2.0, 1.0)) * power(0.7, depth - 1), 6)::DOUBLE AS boost FROM ({EXPANDED})"


@op(EXPANDED)
def graph_expand_sql(spark, sf):
    return gr.expand_from(seeds(spark, sf), edges(spark, sf), 0.5)


@op(BOOSTED)
def graph_boost(spark, sf):
    near = graph_expand_sql(spark, sf)
    return near.select("node", F.round(gr.boost(F.col("seeds"), F.lit(1.0), F.col("total"), F.col("depth")), 6).alias("boost"))


@op(f"SELECT p_partkey AS id, round(1.0::DOUBLE / (60 + p_size) + coalesce(boost, 0), 6) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY round(1.0::DOUBLE / (60 + p_size) + coalesce(boost, 0), 6) DESC, p_partkey) AS rank FROM part LEFT JOIN ({BOOSTED}) b ON p_partkey = b.node")
def graph_rerank(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_brand", "p_size").join(graph_boost(spark, sf), "node", "left")
    scored = p.select(F.col("node").alias("id"), "p_brand", F.round(F.lit(1.0) / (60 + F.col("p_size")) + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))
    return rel.rank_by(scored, ["p_brand"], [F.desc("score"), F.col("id")]).drop("p_brand")


@op(f"SELECT round(count(b.node) * 1.0 / count(*), 6)::DOUBLE AS hit_rate FROM part LEFT JOIN ({BOOSTED}) b ON p_partkey = b.node")
def graph_hit_rate(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node")).join(graph_boost(spark, sf), "node", "left")
    return p.agg(F.round(F.count("boost") / F.count("*"), 6).alias("hit_rate"))


PARENTS = "p AS (SELECT c_custkey AS id, 1000000000 + c_nationkey AS parent FROM customer UNION ALL SELECT 1000000000 + n_nationkey, 2000000000 + n_regionkey FROM nation UNION ALL SELECT 2000000000 + r_regionkey, NULL FROM region)"


def parents(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.select(F.col("c_custkey").alias("id"), (1_000_000_000 + F.col("c_nationkey").cast("long")).alias("parent")).unionByName(
        n.select((1_000_000_000 + F.col("n_nationkey").cast("long")).alias("id"), (2_000_000_000 + F.col("n_regionkey").cast("long")).alias("parent"))).unionByName(
        r.select((2_000_000_000 + F.col("r_regionkey").cast("long")).alias("id"), F.lit(None).cast("long").alias("parent")))


@op(f"WITH RECURSIVE {PARENTS}, up AS (SELECT id AS start, parent AS ancestor, 1 AS level FROM p WHERE parent IS NOT NULL AND id < 1000000000 UNION ALL SELECT start, p.parent, level + 1 FROM up JOIN p ON up.ancestor = p.id WHERE p.parent IS NOT NULL) SELECT * FROM up")
def graph_parents(spark, sf):
    return gr.ancestors(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), parents(spark, sf), 4)


@op(f"WITH RECURSIVE {PARENTS}, up(node, above) AS (SELECT id, parent FROM p WHERE parent IS NOT NULL UNION SELECT node, p.parent FROM up JOIN p ON up.above = p.id WHERE p.parent IS NOT NULL) SELECT node, above FROM up")
def union_distinct_recursive(spark, sf):
    """All (node, ancestor) pairs of the hierarchy, each once, by rounds that stop when nothing new comes."""
    return gr.closure(parents(spark, sf).where("parent is not null").select(F.col("id").alias("source"), F.col("parent").alias("target"))).select(F.col("source").alias("node"), F.col("target").alias("above"))


PATHS = "paths AS (SELECT c_custkey AS id, r_name AS a, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SIBLINGS = f"WITH {PATHS} SELECT start, sibling FROM (SELECT x.id AS start, y.id AS sibling, row_number() OVER (PARTITION BY x.id ORDER BY y.id) AS n FROM paths x JOIN paths y ON x.a = y.a AND x.b = y.b AND x.id <> y.id WHERE x.id % 50 = 0) WHERE n <= 5"


@op(SIBLINGS)
def graph_siblings(spark, sf):
    paths = concept_paths(spark, sf).withColumnRenamed("c_custkey", "id")
    return gr.siblings(paths.where("id % 50 = 0"), paths)


@op(f"SELECT start AS query_id, sibling AS id, round(c_acctbal / 10000 * 0.8 + 0.05, 6) AS score FROM ({SIBLINGS}) JOIN customer ON start = c_custkey")
def graph_hier_search(spark, sf):
    parent = table(spark, sf, "customer").select(F.col("c_custkey").alias("start"), "c_acctbal")
    return graph_siblings(spark, sf).join(parent, "start").select(F.col("start").alias("query_id"), F.col("sibling").alias("id"), F.round(F.col("c_acctbal") / 10000 * 0.8 + 0.05, 6).alias("score"))


_SHARED = f"""n AS ({NORMS}), p AS (SELECT a.id AS a, b.id AS b, count(*) AS overlap FROM n a JOIN n b ON a.norm_id = b.norm_id AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2),
    h AS (SELECT id, anno, list_transform({sql_words('testo')}, lambda w: ('0x' || substr(md5(w), 1, 2))::INT % 64) AS h FROM massime WHERE testo IS NOT NULL),
    v AS (SELECT id, anno, list_transform(range(64), lambda i: len(list_filter(h, lambda x: x = i))::DOUBLE) AS v FROM h WHERE len(h) > 0)"""


@op(f"""WITH {_SHARED}, c AS (SELECT a, b, overlap, round(list_cosine_similarity(x.v, y.v), 6) AS cosine, coalesce(x.anno - y.anno, 0) AS years FROM p JOIN v x ON a = x.id JOIN v y ON b = y.id)
    SELECT a, b, overlap, cosine, round((least(overlap / 5.0, 1.0) + cosine + 1 / (1 + 0.1 * abs(years))) / 3, 4)::DOUBLE AS weight FROM c WHERE cosine >= 0.85""")
def graph_same_principle(spark, sf):
    """Massime that share norms and whose texts, as counts of hashed words, are alike."""
    norms = materialise(cited(spark, sf), "norms")
    several = norms.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    m = table(spark, sf, "massime").where("testo is not null").join(several, "id", "left_semi")
    word = m.select("id", F.explode(tx.words(F.col("testo"))).alias("w"))
    counted = word.groupBy("id", (F.conv(F.substring(F.md5("w"), 1, 2), 16, 10).cast("int") % 64).alias("b")).agg(F.count("*").alias("n"))
    counted = counted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    vectors = counted.select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double")).alias("vec"))
    return gr.same_principle(norms, vectors, m.select("id", F.col("anno").alias("year")))


@op("SELECT l_orderkey, l_linenumber, round((least(l_quantity / 10.0, 1.0) + l_discount + 1 / (1 + 1.0 * l_linenumber)) / 3, 6)::DOUBLE AS weight FROM lineitem")
def graph_edge_weight_fn(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(gr.edge_weight(F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber"), 10.0, 1.0), 6).alias("weight"))


@op(f"WITH {E}, {S}, {B} SELECT id, other, weight FROM (SELECT s.id, b.target AS other, b.weight, row_number() OVER (PARTITION BY s.id ORDER BY weight DESC, b.target) AS n FROM s JOIN b ON b.source = s.id) WHERE n <= 20")
def graph_related(spark, sf):
    both = gr.both_ways(edges(spark, sf)).join(seeds(spark, sf), F.col("source") == F.col("id"))
    return rel.rank_by(both.select("id", F.col("target").alias("other"), "weight"), ["id"], [F.desc("weight"), F.col("other")], "n", 20).drop("n")


@op(f"WITH {PATHS} SELECT id, bool_or(c_acctbal < -990) OVER (PARTITION BY a, b) AS flagged FROM paths JOIN customer ON id = c_custkey")
def cascade_flag(spark, sf):
    flags = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < -990).alias("flag"))
    return gr.cascade(flags, concept_paths(spark, sf).withColumnRenamed("c_custkey", "id"))


_AMENDING = " UNION ".join(f"SELECT id, '{c}:' || g1 || ':' || g2 AS act FROM ({all_of(p, 2, 'normativa WHERE testo IS NOT NULL')})" for c, p in ex.ACT_REF.items()) + "".join(
    f" UNION SELECT id, '{c}:' || g2 || ':' || g1 FROM ({all_of(p, 2, 'normativa WHERE testo IS NOT NULL')})" for c, p in ex.DATED_REF.items())


@op(f"SELECT id, act, 'UNKNOWN' AS kind, concat_ws('->', act, id::VARCHAR) AS edge FROM ({_AMENDING})")
def modification_edges(spark, sf):
    """An edge from every act that an article's text names to the article; how the act changed it is not said."""
    named = ex.norms(table(spark, sf, "normativa").where("testo is not null").select("id", F.col("testo").alias("text"))).where("number is not null")
    return named.select("id", F.col("norm_id").alias("act"), F.lit("UNKNOWN").alias("kind"), F.concat_ws("->", "norm_id", F.col("id").cast("string")).alias("edge"))


@op(f"""SELECT target AS id, count(*) AS overruled_by, min(m.anno) AS year, arg_min(source, (coalesce(m.anno, 9999), source)) AS turning FROM ({EDGES}) e JOIN massime m ON e.source = m.id WHERE indicator = 'OVERRULES' GROUP BY 1""")
def turning_points(spark, sf):
    """Decisions that others overrule, with the first that did."""
    edges = dedupe_mentions(spark, sf).where("indicator = 'OVERRULES'").join(table(spark, sf, "massime").select(F.col("id").alias("source"), "anno"), "source")
    first = F.min_by("source", F.struct(F.coalesce("anno", F.lit(9999)), "source")).alias("turning")
    return edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("overruled_by"), F.min("anno").alias("year"), first)
