"""Queries of sources and streams, with their SQL. Sources are fed with renderings of whole tables and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fondaco.operators import relational as rel
from fondaco.sources import articles as src
from fondaco.streaming import events as st
from fondaco.session import materialise, shared_dir, table

QUERIES, SQL = {}, {}


def op(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


def files(spark, sf, content):
    return table(spark, sf, "normativa").select(F.col("id").cast("string").alias("name"), content.alias("content"))


def number():
    return F.regexp_extract("articolo", r"(\d+(?:[-\s]?(?:bis|ter|quater|quinquies))?)", 1)


_READ = "SELECT id::VARCHAR AS name, regexp_extract(articolo, '(\\d+(?:[-\\s]?(?:bis|ter|quater|quinquies))?)', 1) AS articolo, rubrica, regexp_replace(testo, '^\\s+|\\s+$', '', 'g') AS testo, regexp_extract(libro, '([IVXLC]+)$', 1) AS libro FROM normativa WHERE libro IS NOT NULL"


@op(_READ)
def source_markdown(spark, sf):
    text = F.concat(F.lit("# "), F.col("libro"), F.lit("\n\n**Art. "), number(), F.lit(".** "), F.coalesce("rubrica", F.lit("")), F.lit("\n"), F.col("testo"))
    return src.markdown_articles(files(spark, sf, text)).where("libro is not null").select("name", "articolo", "rubrica", "testo", "libro")


_PLAIN = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t\\x{{a0}}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))"
_HTML = f"""SELECT id::VARCHAR AS name, regexp_extract(articolo, '(\\d+(?:[-\\s]?(?:bis|ter|quater|quinquies))?)', 1) AS articolo, rubrica, regexp_replace({_PLAIN.format('testo')}, '^\\s+|\\s+$', '', 'g') AS testo,
    nullif(regexp_extract(libro, '([IVXLC]+)$', 1), '') AS libro FROM normativa WHERE testo IS NOT NULL"""


@op(_HTML)
def source_html_codes(spark, sf):
    text = F.concat(F.lit("<html><nav>Menu</nav><article><h1>"), F.coalesce("libro", F.lit("")), F.lit("</h1><h2>Art. "), number(), F.lit(". "), F.coalesce("rubrica", F.lit("")), F.lit("</h2><p>"), F.col("testo"), F.lit("</p></article><script>x()</script></html>"))
    return src.html_articles(files(spark, sf, text)).select("name", "articolo", "rubrica", "testo", "libro")


@op(f"SELECT id::VARCHAR AS name, {_PLAIN.format('testo')} AS text FROM normativa WHERE testo IS NOT NULL")
def html_clean(spark, sf):
    text = F.concat(F.lit("<nav>Menu</nav><div>"), F.col("testo"), F.lit("</div>"))
    return files(spark, sf, text).where("content is not null").select("name", src.html_clean("content").alias("text"))


@op("SELECT id::VARCHAR AS name, 0 AS n, 'SectionHeader' AS kind, 'Art. ' || articolo AS text, 1 AS page FROM normativa UNION ALL SELECT id::VARCHAR, 1, 'Text', testo, 2 FROM normativa")
def source_marker_json(spark, sf):
    block = lambda kind, text, page, kids=None: F.struct(F.lit(kind).alias("block_type"), text.alias("text"), F.lit(page).alias("page"), *([kids.alias("children")] if kids is not None else []))
    tree = F.struct(F.array(block("SectionHeader", F.concat(F.lit("Art. "), F.col("articolo")), 1, F.array(block("Text", F.col("testo"), 2)))).alias("children"))
    return src.json_blocks(files(spark, sf, F.to_json(tree)))


@op("SELECT id::VARCHAR AS name, libro, articolo, testo FROM normativa WHERE libro IS NOT NULL")
def tree_walk_articles(spark, sf):
    leaf = F.struct(F.col("articolo").alias("articolo"), F.col("testo").alias("testo"))
    tree = F.struct(F.col("libro").alias("label"), F.array(leaf).alias("children"))
    return src.tree_articles(files(spark, sf, F.to_json(tree)), 3).where(F.size("path") > 0).select("name", F.get("path", F.lit(0)).alias("libro"), "articolo", "testo")


@op("""SELECT id::VARCHAR AS name, regexp_extract(articolo, '(\\d+(?:[-\\s]?(?:bis|ter|quater|quinquies))?)', 1) AS articolo, NULL::VARCHAR AS rubrica, regexp_replace(testo, '^\\s+|\\s+$', '', 'g') AS testo,
    nullif(regexp_extract(libro, '([IVXLC]+)$', 1), '') AS libro, NULL::VARCHAR AS titolo, NULL::VARCHAR AS capo, NULL::VARCHAR AS sezione FROM normativa""")
def structure_extract(spark, sf):
    """Articles with their place in the hierarchy, from the JSON rendering of the table."""
    tree = F.struct(F.array(F.struct(F.lit("Title").alias("block_type"), F.col("libro").alias("text")), F.struct(F.lit("SectionHeader").alias("block_type"), F.concat(F.lit("Art. "), number()).alias("text")), F.struct(F.lit("Text").alias("block_type"), F.col("testo").alias("text"))).alias("blocks"))
    return src.json_articles(files(spark, sf, F.to_json(tree)))


_FORM = r"'^\s*(\S.*?)\s*(?:\.{2,}|\s{2,}|\|)\s*(\d{1,4})\s*$'"
_TOC = f"SELECT id, n::INT AS n, regexp_extract(line, {_FORM}, 1) AS title, regexp_extract(line, {_FORM}, 2)::INT AS page FROM (SELECT id, unnest(string_split(testo, chr(10))) AS line, generate_subscripts(string_split(testo, chr(10)), 1) - 1 AS n FROM massime WHERE testo IS NOT NULL) WHERE regexp_matches(line, {_FORM})"


@op(_TOC)
def toc_extract(spark, sf):
    return src.toc_lines(table(spark, sf, "massime").where("testo is not null"), "id", "testo")


@op(f"SELECT id, n, title, page, last_value(CASE WHEN regexp_matches(title, '(?i)^\\S*\\s*(?:cap|volume|parte|titolo)') THEN title END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS at_capo FROM ({_TOC})")
def toc_index_tree(spark, sf):
    """Lines of contents under the last chapter line above them."""
    toc = toc_extract(spark, sf).withColumn("capo", F.when(F.col("title").rlike(r"(?i)^\S*\s*(?:cap|volume|parte|titolo)"), F.col("title")))
    return rel.carry_forward(toc, ["id"], "n", ["capo"]).select("id", "n", "title", "page", "at_capo")


@op("SELECT event_id, user_id, event_type, value FROM events")
def sink_jsonl_csv(spark, sf):
    """Events written as lines of JSON and as CSV, read back and held against each other."""
    from fondaco.session import shared_dir
    import uuid

    base = f"{shared_dir(spark)}/fondaco-sink-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    src.write_jsonl(rows, f"{base}/jsonl"), src.write_csv(rows, f"{base}/csv")
    a, b = spark.read.schema(rows.schema).json(f"{base}/jsonl"), spark.read.schema(rows.schema).option("header", True).csv(f"{base}/csv")
    return a.join(b.select("event_id"), "event_id", "left_semi")


@op("SELECT id::VARCHAR AS name, n::INT AS n, kind, text, page::INT AS page FROM (SELECT id, 0 AS n, 'heading' AS kind, upper('pagina ' || coalesce(libro, 'prima')) AS text, 1 AS page FROM normativa UNION ALL SELECT id, 1, CASE WHEN rubrica = upper(rubrica) AND regexp_matches(rubrica, '\\p{L}') THEN 'heading' ELSE 'text' END, trim(rubrica), 1 FROM normativa WHERE trim(rubrica) <> '' UNION ALL SELECT id, CASE WHEN trim(rubrica) <> '' THEN 2 ELSE 1 END, 'text', regexp_replace(testo, '^\\s+|\\s+$', '', 'g'), 2 FROM normativa WHERE testo NOT LIKE '%' || chr(10) || chr(10) || '%')")
def source_pdf(spark, sf):
    """Elements of binary files by a parser that is handed in; here pages of text, one file an article."""
    n = table(spark, sf, "normativa").where(~F.col("testo").contains("\n\n"))
    text = F.concat(F.upper(F.concat(F.lit("pagina "), F.coalesce("libro", F.lit("prima")))), F.lit("\n\n"), F.coalesce("rubrica", F.lit("")), F.lit("\f"), F.col("testo"))
    return src.parsed_elements(n.select(F.col("id").cast("string").alias("name"), F.encode(text, "UTF-8").alias("content")), src.paged_text)


@op("SELECT id, normativa_id, opendata_version, inizio_vigore, testo FROM normativa_vigenza")
def source_opendata(spark, sf):
    """Rows that a fetcher left as lines of JSON, read with a given schema."""
    rows = table(spark, sf, "normativa_vigenza").select("id", "normativa_id", "opendata_version", "inizio_vigore", "testo")
    path = f"{shared_dir(spark)}/fondaco-landing-{uuid.uuid4().hex}"
    src.write_jsonl(rows, path)
    return src.landing_json(spark, path, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


@op("SELECT doc_id::VARCHAR AS name, '3' || coalesce(anno, 2000) || 'R' || lpad((doc_id % 10000)::VARCHAR, 4, '0') AS celex, lang FROM documents WHERE tipo = 'atto_ue'")
def source_sparql_eurlex(spark, sf):
    """Acts of the Union from the answers of an endpoint, one answer a document; a document without language binds none."""
    d = table(spark, sf, "documents").where("tipo = 'atto_ue'")
    celex = F.concat(F.lit("3"), F.coalesce("anno", F.lit(2000)).cast("string"), F.lit("R"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"))
    value = lambda c: F.struct(F.lit("literal").alias("type"), c.alias("value"))
    binding = F.struct(value(celex).alias("celex"), F.when(F.col("lang").isNotNull(), value(F.col("lang"))).alias("lang"))
    answer = F.to_json(F.struct(F.struct(F.array(F.lit("celex"), F.lit("lang")).alias("vars")).alias("head"), F.struct(F.array(binding).alias("bindings")).alias("results")))
    return src.sparql_bindings(d.select(F.col("doc_id").cast("string").alias("name"), answer.alias("content")), ["celex", "lang"])


# Streams


def stream(spark, sf):
    return st.read_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


_HOUR = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@op(_HOUR)
def stream_tumbling(spark, sf):
    return st.run_once(st.tumbling(stream(spark, sf), "1 hour"))


@op(_HOUR)
def batch_tumbling(spark, sf):
    return st.tumbling(table(spark, sf, "events"), "1 hour")


@op("SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts)]) AS s FROM events) GROUP BY 1")
def stream_sliding(spark, sf):
    return st.run_once(st.sliding(stream(spark, sf), "1 hour", "30 minutes"))


_SESSIONS = """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, g"""


@op(_SESSIONS)
def stream_sessions(spark, sf):
    return st.run_once(st.sessions(stream(spark, sf), "6 hours"))


@op("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    return st.run_once(st.first_seen(stream(spark, sf), ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), "append")


@op("SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit_60s(spark, sf):
    return st.over_limit(table(spark, sf, "events"), 1)


_STEP = "CASE WHEN moment < until THEN 'open' WHEN until IS NOT NULL THEN 'half_open' ELSE 'closed' END AS state, CASE WHEN moment < until THEN failures WHEN NOT bad THEN 0 WHEN until IS NOT NULL THEN 3 ELSE failures + 1 END AS f"


@op(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS moment, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, n, event_id, 'closed' AS state, CASE WHEN bad THEN 1 ELSE 0 END AS failures, NULL::DOUBLE AS until FROM e WHERE n = 1 UNION ALL
        SELECT user_id, n, event_id, state, f, CASE WHEN state = 'open' THEN until WHEN f >= 3 THEN moment + 300 END FROM (SELECT e.*, s.until, {_STEP} FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
    SELECT event_id, state FROM s""")
def circuit_breaker(spark, sf):
    return st.circuit_breaker(table(spark, sf, "events"))


_PAIRS = "SELECT v.event_id AS view_id, p.event_id AS purchase_id, v.user_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 6 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'"


@op(_PAIRS)
def stream_join(spark, sf):
    """Views of a stream with the purchases of another that follow within six hours."""
    views, purchases = (stream(spark, sf).where(F.col("event_type") == k) for k in ("view", "purchase"))
    return st.run_once(st.followed_by(views, purchases, "6 hours").select(F.col("event_id").alias("view_id"), F.col("other_id").alias("purchase_id"), "user_id"), "append")


@op("""WITH b AS (SELECT max(ts) FILTER (event_id % 4 <> 0) - INTERVAL 30 DAY AS mark FROM events), e AS (SELECT ts, time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, value FROM events, b WHERE event_id % 4 <> 0 OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > mark)
    SELECT start, event_type, count(*) AS n FROM e GROUP BY 1, 2""")
def stream_late_data(spark, sf):
    """Hourly counts over two rounds of one stream: every fourth event comes late, and counts only if its hour ends after the mark, 30 days behind the newest event."""
    rows = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    rounds = [rows.where("event_id % 4 <> 0"), rows.where("event_id % 4 = 0")]
    out = st.run_rounds(rounds, lambda r: st.tumbling(r, "1 hour", "30 days").select("start", "event_type", "n"))
    return out.groupBy("start", "event_type").agg(F.max_by("n", "round").alias("n"))


@op("SELECT event_id, user_id, event_type, value FROM events")
def workflow_sync(spark, sf):
    """Events merged batch by batch into a table that starts without half of them."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    state = {"t": materialise(rows.where("event_id % 2 = 0"), "sync")}
    from fondaco.session import shared_dir
    import uuid

    feed = stream(spark, sf).select("event_id", "user_id", "event_type", "value")
    st.merge_incrementally(feed, lambda: state["t"], lambda t, n: state.update(t=materialise(t, f"sync{n}")), ["event_id"], f"{shared_dir(spark)}/fondaco-sync-{uuid.uuid4().hex}")
    return state["t"]
