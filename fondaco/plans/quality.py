"""Queries of chunking, duplicates, classification, quality and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fondaco.functions import similarity as sim, text as tx
from fondaco.operators import chunk as ch, classify as cl, dedup as dd, evaluate as ev, extract as ex, relational as rel, retrieval as ret
from fondaco.plans import extraction as xp, relational as rp, retrieval as rt
from fondaco.plans.texts import sql_chain, sql_clean, sql_hash_form, sql_jaccard, sql_share, sql_trigrams, sql_words
from fondaco.session import table

QUERIES, SQL = {}, {}


def op(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


def articles(spark, sf):
    return table(spark, sf, "normativa").select("id", F.col("testo").alias("text"))


# Chunking


@op("SELECT id, k::INT AS chunk_no, (k * 850)::INT AS char_start, least(k * 850 + 1000, length(testo))::INT AS char_end, substring(testo, (k * 850 + 1)::INT, 1000) AS text FROM normativa, range(0, 100) r(k) WHERE length(testo) > 0 AND k <= greatest(0, ceil((length(testo) - 1000) / 850.0))")
def chunk_fixed(spark, sf):
    return ch.chunk_fixed(articles(spark, sf), 1000, 150)


for _name, _spans in {"chunk_generic": ch.generic, "chunk_legal": ch.legal, "chunk_sql": ch.backward, "chunk_para_sentence": ch.paragraphs}.items():
    QUERIES[_name] = lambda spark, sf, s=_spans: ch.chunk(articles(spark, sf), s)


def best_cuts(rows, soft, hard):
    """(id, cut, score, kind): the best cut of each text of (id, text) over the soft limit."""

    def best(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, *c[0]) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) if t and (c := ch.cut_scores(t, soft, hard))]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.string())], names=["id", "cut", "score", "kind"])

    return rows.select("id", "text").mapInArrow(best, "id long, cut int, score double, kind string")


@op()
def cut_propose(spark, sf):
    return best_cuts(articles(spark, sf), 300, 500)


@op(f"SELECT c.id FROM ({rp._FIRST[1:-1]}) c WHERE c.id NOT IN (SELECT n.id FROM normativa_chunk n JOIN ({rp._LAST[1:-1]}) l ON n.id = l.id WHERE n.text <> l.text)")
def chunk_rechunk(spark, sf):
    """Chunks that keep their text: those of changed ids are deleted before they are written again."""
    first, last = rp._chunks(spark, sf)
    changed = table(spark, sf, "normativa_chunk").join(last.select("id", F.col("text").alias("t")), "id").where("text <> t")
    return rel.delete_by_key(first, changed, ["id"]).select("id")


@op("SELECT w.code, count(DISTINCT c.id) AS chunks, round(avg(length(c.text)), 4) AS mean, max(c.token_est) AS most FROM normativa_chunk c JOIN work w ON c.work_id = w.id GROUP BY w.code")
def chunk_stats(spark, sf):
    c, w = table(spark, sf, "normativa_chunk"), table(spark, sf, "work").select(F.col("id").alias("work_id"), "code")
    per = c.groupBy("work_id").agg(F.countDistinct("id").alias("chunks"), F.round(F.avg(F.length("text")), 4).alias("mean"), F.max("token_est").alias("most"))
    return per.join(w, "work_id").select("code", "chunks", "mean", "most")


# Duplicates and alignment

HASHED = f"SELECT id, sha256({sql_hash_form('testo')}) AS h FROM massime WHERE testo IS NOT NULL"


@op(f"SELECT id, min(id) OVER (PARTITION BY h) AS kept FROM ({HASHED})")
def dedup_exact(spark, sf):
    rows = table(spark, sf, "massime").where("testo is not null")
    return dd.exact(rows, "id", F.sha2(tx.normalize_for_hash(F.col("testo")), 256))


@op("WITH c AS (SELECT text_fingerprint AS f, min(id) AS k FROM massime WHERE text_fingerprint IS NOT NULL GROUP BY 1) SELECT x.k AS a, y.k AS b, bit_count(xor(x.f, y.f))::INT AS distance FROM c x JOIN c y ON x.k < y.k WHERE bit_count(xor(x.f, y.f)) <= 9")
def dedup_near_simhash(spark, sf):
    """Stored fingerprints that differ in 9 bits at most (similarity 0.85)."""
    return dd.fingerprint_pairs(table(spark, sf, "massime"), "id", "text_fingerprint", 9)


_W = lambda c: f"list_distinct({sql_words(c)})"
ALIGN = f"""WITH a AS (SELECT id, testo, sha256({sql_hash_form('testo')}) AS h FROM normativa_altalex WHERE trim(testo) <> ''), n AS (SELECT id, testo, sha256({sql_hash_form('testo')}) AS h FROM normativa WHERE trim(testo) <> ''),
    ca AS (SELECT h, min(id) AS id, arg_min(testo, id) AS testo FROM a GROUP BY h), cn AS (SELECT h, min(id) AS id, arg_min(testo, id) AS testo FROM n GROUP BY h),
    t AS (SELECT 0 AS side, id, {_W('testo')} AS w FROM ca WHERE h NOT IN (SELECT h FROM cn) UNION ALL SELECT 1, id, {_W('testo')} FROM cn),
    x AS (SELECT side, id, len(w) AS n, unnest(w) AS k FROM t), c AS (SELECT k, count(*) AS c FROM x GROUP BY k),
    p AS (SELECT side, id, n, k FROM (SELECT x.*, row_number() OVER (PARTITION BY side, id ORDER BY c, k) AS r FROM x JOIN c USING (k)) WHERE r <= n - ceil(n * 0.65 - 1e-9) + 4),
    near AS (SELECT y.id, z.id AS target FROM p y JOIN p z ON y.k = z.k AND y.side = 0 AND z.side = 1 WHERE least(y.n, z.n) >= greatest(y.n, z.n) * 0.65 - 1e-9 GROUP BY y.id, z.id, y.n, z.n HAVING count(*) >= least(4, ceil(least(y.n, z.n) * 0.65 - 1e-9))),
    j AS (SELECT near.id, target, round({sql_jaccard('y.w', 'z.w')}, 6) AS score FROM near JOIN t y ON y.side = 0 AND y.id = near.id JOIN t z ON z.side = 1 AND z.id = target),
    w AS (SELECT id, max(score) AS score, arg_max(target, (score, -target)) AS target FROM j GROUP BY id),
    g AS (SELECT near.id, target, round({sql_jaccard(sql_trigrams('ca.testo'), sql_trigrams('cn.testo'))}, 6) AS score FROM near JOIN ca ON ca.id = near.id JOIN cn ON cn.id = target WHERE near.id IN (SELECT id FROM w WHERE score < 0.65)),
    b AS (SELECT id, max(score) AS score, arg_max(target, (score, -target)) AS target FROM g WHERE score >= 0.70 GROUP BY id),
    m AS (SELECT h, cn.id AS target, 'exact' AS stage, 1.0::DOUBLE AS score FROM ca JOIN cn USING (h) UNION ALL
        SELECT ca.h, CASE WHEN w.score >= 0.65 THEN w.target ELSE coalesce(b.target, w.target) END, CASE WHEN w.score >= 0.65 THEN 'tokens' WHEN b.id IS NOT NULL THEN 'grams' ELSE 'weak' END, CASE WHEN w.score >= 0.65 THEN w.score ELSE coalesce(b.score, w.score) END
        FROM w JOIN ca ON ca.id = w.id LEFT JOIN b ON b.id = w.id WHERE w.score > 0.3 OR b.id IS NOT NULL)
    SELECT l.id, m.target, coalesce(m.stage, 'unmatched') AS stage, coalesce(m.score, 0.0)::DOUBLE AS score FROM normativa_altalex l LEFT JOIN a ON a.id = l.id LEFT JOIN m ON m.h = a.h"""


@op(ALIGN)
def align_reference(spark, sf):
    """The best match of every altalex row among the articles, whatever an earlier load stored."""
    return dd.align(*(table(spark, sf, t).select("id", F.col("testo").alias("text")) for t in ("normativa_altalex", "normativa")))


ALIGNED = f"""SELECT r.id, r.target, a.testo = n.testo AS same, round({sql_jaccard(_W('a.testo'), _W('n.testo'))}, 6) AS sim
    FROM ({ALIGN}) r JOIN normativa_altalex a ON r.id = a.id JOIN normativa n ON r.target = n.id"""
KIND = "CASE WHEN same THEN 'exact' WHEN sim > 0.95 THEN 'format_diff' WHEN sim > 0.80 THEN 'content_diff' ELSE 'mismatch' END"


def aligned(spark, sf):
    a = table(spark, sf, "normativa_altalex").select("id", F.col("testo").alias("ta"))
    n = table(spark, sf, "normativa").select(F.col("id").alias("target"), F.col("testo").alias("tb"))
    words = lambda c: F.array_distinct(tx.words(F.col(c)))
    pairs = align_reference(spark, sf).where("target is not null").select("id", "target").join(a.hint("merge"), "id").join(n.hint("merge"), "target")  # texts are not broadcast, however small their files
    return pairs.select("id", "target", (F.col("ta") == F.col("tb")).alias("same"), F.round(sim.jaccard(words("ta"), words("tb")), 6).alias("sim"))


@op(f"SELECT id, target, sim, {KIND} AS kind FROM ({ALIGNED})")
def cross_validate(spark, sf):
    return aligned(spark, sf).select("id", "target", "sim", dd.overlap_kind(F.col("same"), F.col("sim")).alias("kind"))


@op(f"""WITH r AS ({ALIGN}), u AS (SELECT target FROM r WHERE target IS NOT NULL GROUP BY target HAVING count(*) > 1)
    SELECT stage, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM r), 6)::DOUBLE AS share, round(avg(score), 5) AS trust, count(*) FILTER (target IN (SELECT target FROM u)) AS collisions FROM r GROUP BY stage""")
def align_summary(spark, sf):
    """Rows by stage with their share of all rows, mean score, and how many share their target with another row."""
    r = align_reference(spark, sf)
    shared = r.where("target is not null").groupBy("target").agg((F.count("*") > 1).alias("shared"))
    per = r.join(shared, "target", "left").groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("trust"), F.count_if(F.coalesce("shared", F.lit(False))).alias("collisions"))
    return per.select("stage", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"), "trust", "collisions")  # at most a row a stage


@op(f"SELECT sum(share) FILTER (stage <> 'unmatched') >= 0.5 AS covered, coalesce(max(collisions) FILTER (stage = 'exact'), 0) <= 0.2 * sum(n) AS few_collisions, bool_and(trust > 0 OR stage = 'unmatched') AS all_positive, sum(n) >= 1 AS enough FROM ({SQL['align_summary']})")
def alignment_guardrails(spark, sf):
    stage = F.col("stage")
    return align_summary(spark, sf).agg(
        (F.sum(F.when(stage != "unmatched", F.col("share"))) >= 0.5).alias("covered"), (F.coalesce(F.max(F.when(stage == "exact", F.col("collisions"))), F.lit(0)) <= 0.2 * F.sum("n")).alias("few_collisions"),
        F.bool_and((F.col("trust") > 0) | (stage == "unmatched")).alias("all_positive"), (F.sum("n") >= 1).alias("enough"),
    )


@op(f"SELECT id, CASE WHEN sim >= 0.70 THEN 'confirm' WHEN sim >= 0.40 THEN 'partial' ELSE 'conflict' END AS status, greatest(sim, 0.5) AS best FROM ({ALIGNED})")
def enrich_choose_source(spark, sf):
    status = F.when(F.col("sim") >= 0.70, "confirm").when(F.col("sim") >= 0.40, "partial").otherwise("conflict")
    return aligned(spark, sf).select("id", status.alias("status"), F.greatest("sim", F.lit(0.5)).alias("best"))


_BEST = f"""SELECT l.id, CASE WHEN r.sim >= 0.70 OR r.sim IS NULL AND length(trim(l.testo)) > 0 THEN 'altalex' WHEN length(n.testo) >= length(l.testo) THEN 'normativa' WHEN length(trim(l.testo)) > 0 THEN 'altalex' ELSE 'none' END AS source,
    greatest(length(l.testo), coalesce(length(n.testo), 0)) AS longest FROM normativa_altalex l LEFT JOIN ({ALIGNED}) r ON r.id = l.id LEFT JOIN normativa n ON n.id = r.target"""


@op(_BEST)
def choose_best_source(spark, sf):
    """Which source's text stands for each altalex row: its own where the match confirms it or where none was found, else the longer of the two."""
    l = table(spark, sf, "normativa_altalex").select("id", "testo")  # noqa: E741
    n = table(spark, sf, "normativa").select(F.col("id").alias("target"), F.length("testo").alias("_n"))
    j = l.join(aligned(spark, sf).select("id", "target", "sim"), "id", "left").join(n, "target", "left")
    some = F.length(F.trim("testo")) > 0
    source = F.when((F.col("sim") >= 0.70) | (F.col("sim").isNull() & some), "altalex").when(F.col("_n") >= F.length("testo"), "normativa").when(some, "altalex").otherwise("none")
    return j.select("id", source.alias("source"), F.greatest(F.length("testo"), F.coalesce("_n", F.lit(0))).alias("longest"))


@op("SELECT id, CASE WHEN testo IS NULL OR length(testo) < 80 THEN 'short' WHEN rubrica IS NULL THEN 'no_heading' WHEN articolo = '' THEN 'no_number' WHEN codice = '' THEN 'no_act' ELSE 'none' END AS reason FROM normativa_altalex")
def enrich_trigger(spark, sf):
    reason = F.when(F.col("testo").isNull() | (F.length("testo") < 80), "short").when(F.col("rubrica").isNull(), "no_heading").when(F.col("articolo") == "", "no_number").when(F.col("codice") == "", "no_act").otherwise("none")
    return table(spark, sf, "normativa_altalex").select("id", reason.alias("reason"))


def run_ratios(pairs):
    """(id, ratio) of (id, ta, tb)."""

    def ratio(batches):
        from difflib import SequenceMatcher

        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([round(SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio(), 6) for x, y in zip(a, b)], pa.float64())], names=["id", "ratio"])

    return pairs.select("id", "ta", "tb").mapInArrow(ratio, "id long, ratio double")


@op()
def sequence_ratio(spark, sf):
    """Ratio of matching runs between the altalex and the matched text, by the standard library's matcher."""
    a = table(spark, sf, "normativa_altalex").where("testo is not null").select("id", F.col("testo").alias("ta"))
    n = table(spark, sf, "normativa").where("testo is not null").select(F.col("id").alias("t"), F.col("testo").alias("tb"))
    a = a.hint("merge").join(align_reference(spark, sf).select("id", F.col("target").alias("t")), "id")
    return run_ratios(a.join(n.hint("merge"), "t"))


# Classification

LISTS = {"CIVILE": ["contratto", "danno", "locazione", "servitù", "comodato"], "PENALE": ["reato", "pena", "imputato", "indagato", "querela"], "LAVORO": ["licenziamento", "lavoratore", "mansione", "retribuzione"], "TRIBUTARIO": ["tributo", "imposta", "sanzione", "sgravio"]}
_SCORED = "SELECT id, " + ", ".join(f"len(list_intersect(w, [{', '.join(chr(39) + x + chr(39) for x in words)}])) AS {k}" for k, words in LISTS.items()) + f" FROM (SELECT id, list_distinct({sql_words('testo')}) AS w FROM massime WHERE testo IS NOT NULL)"


def scores(spark, sf):
    return table(spark, sf, "massime").where("testo is not null").select("id", cl.keyword_scores(tx.words(F.col("testo")), LISTS).alias("s"))


@op(f"SELECT id, greatest(CIVILE, PENALE, LAVORO, TRIBUTARIO) AS hits, CASE WHEN greatest(CIVILE, PENALE, LAVORO, TRIBUTARIO) = 0 THEN NULL WHEN CIVILE = greatest(CIVILE, PENALE, LAVORO, TRIBUTARIO) THEN 'CIVILE' WHEN PENALE = greatest(CIVILE, PENALE, LAVORO, TRIBUTARIO) THEN 'PENALE' WHEN LAVORO = greatest(CIVILE, PENALE, LAVORO, TRIBUTARIO) THEN 'LAVORO' ELSE 'TRIBUTARIO' END AS label FROM ({_SCORED})")
def classify_keywords_v1(spark, sf):
    return scores(spark, sf).select("id", F.array_max(F.map_values("s")).cast("long").alias("hits"), cl.best_label(F.col("s"), list(LISTS)).alias("label"))


@op("""SELECT id, CASE WHEN tipo = 'penale' THEN ['PENALE'] WHEN regexp_matches(testo, '(?i)\\blicenziament[oi]\\b') THEN ['LAVORO', 'CIVILE'] WHEN regexp_matches(testo, '(?i)\\btribut[oi]\\b') THEN ['TRIBUTARIO'] ELSE ['CIVILE', 'LAVORO', 'TRIBUTARIO', 'AMMINISTRATIVO', 'CRISI'] END AS candidates FROM massime WHERE testo IS NOT NULL""")
def classify_materia_rules(spark, sf):
    """Candidate labels by the first rule that applies."""
    t, arr = F.col("testo"), lambda *x: F.array(*map(F.lit, x))
    rule = F.when(F.col("tipo") == "penale", arr("PENALE")).when(t.rlike(r"(?i)\blicenziament[oi]\b"), arr("LAVORO", "CIVILE")).when(t.rlike(r"(?i)\btribut[oi]\b"), arr("TRIBUTARIO")).otherwise(
        arr("CIVILE", "LAVORO", "TRIBUTARIO", "AMMINISTRATIVO", "CRISI"))
    return table(spark, sf, "massime").where("testo is not null").select("id", rule.alias("candidates"))


AMBITI = [("MISURE", r"(?i)(?:^|[^\p{L}\p{N}])(cautelar[ei]|sequestro|sospension[ei])(?:$|[^\p{L}\p{N}])"), ("ESECUZIONE", r"(?i)(?:^|[^\p{L}\p{N}])(precett[oi]|espropriazion[ei]|titolo esecutivo|pignoramento)(?:$|[^\p{L}\p{N}])"), ("IMPUGNAZIONI", r"(?i)(?:^|[^\p{L}\p{N}])(impugnazion[ei]|appello|cassazione)(?:$|[^\p{L}\p{N}])"), ("GIUDIZIO", r"(?i)(?:^|[^\p{L}\p{N}])(competenza|nullit[aà]|decadenz[ae]|preclusione)(?:$|[^\p{L}\p{N}])")]


@op("SELECT id, CASE " + " ".join(f"WHEN regexp_matches(testo, '{p}') THEN '{a}'" for a, p in AMBITI) + " ELSE 'UNKNOWN' END AS ambito FROM massime WHERE testo IS NOT NULL")
def classify_ambito_rules(spark, sf):
    rule = F.lit("UNKNOWN")
    for name, p in reversed(AMBITI):
        rule = F.when(F.col("testo").rlike(p), name).otherwise(rule)
    return table(spark, sf, "massime").where("testo is not null").select("id", rule.alias("ambito"))


_CENTER = "c AS (SELECT label, array_agg(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)"
CENTROID = f"WITH {_CENTER}, s AS (SELECT vec_id, e.label AS own, c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 6) AS score FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n FROM s)"


def by_centroid(spark, sf):
    e = table(spark, sf, "embeddings")
    return cl.nearest_centroid(e, "vec_id", "embedding", cl.centroids(e, "label", "embedding"), "label")


@op(f"{CENTROID} SELECT vec_id, max(label) FILTER (WHERE n = 1) AS label, round(max(score) FILTER (WHERE n = 1), 3) AS score, round(max(score) FILTER (WHERE n = 1) - max(score) FILTER (WHERE n = 2), 3) AS delta FROM r WHERE n <= 2 GROUP BY vec_id")
def classify_centroid(spark, sf):
    return by_centroid(spark, sf).select("vec_id", "label", F.round("score", 3).alias("score"), F.round("delta", 3).alias("delta"))


NATURA = {"PROCESSUALE": ["competenza", "termine", "decadenza", "notifica", "impugnazione", "ricorso", "appello", "cassazione", "nullità", "procedimento"], "SOSTANZIALE": ["responsabilità", "danno", "inadempimento", "contratto", "diritto", "obbligo", "colpa", "dolo", "proprietà", "risarcimento"]}
_NAT = "SELECT id, len(list_intersect(w, [{0}])) / 10.0 AS p, len(list_intersect(w, [{1}])) / 10.0 AS s FROM (SELECT id, list_distinct({2}) AS w FROM massime WHERE testo IS NOT NULL)".format(*[", ".join(f"'{x}'" for x in v) for v in NATURA.values()], sql_words("testo"))


@op(f"SELECT id, CASE WHEN p > s + 0.1 THEN 'PROCESSUALE' ELSE 'SOSTANZIALE' END AS natura, round(CASE WHEN p > s + 0.1 THEN 0.75 + p * 0.2 WHEN s > p + 0.1 THEN 0.75 + s * 0.2 ELSE 0.55 END, 4)::DOUBLE AS confidence FROM ({_NAT})")
def classify_natura(spark, sf):
    s = table(spark, sf, "massime").where("testo is not null").select("id", cl.keyword_scores(tx.words(F.col("testo")), NATURA).alias("s"))
    share = lambda k: F.round(F.element_at("s", F.lit(k)) / 10, 4)
    s = s.select("id", share("PROCESSUALE").alias("p"), share("SOSTANZIALE").alias("q"))
    proc, sost = F.round(F.col("p") - F.col("q"), 4) > 0.1, F.round(F.col("q") - F.col("p"), 4) > 0.1
    return s.select("id", F.when(proc, "PROCESSUALE").otherwise("SOSTANZIALE").alias("natura"), F.round(F.when(proc, 0.75 + F.col("p") * 0.2).when(sost, 0.75 + F.col("q") * 0.2).otherwise(0.55), 4).alias("confidence"))


_DISTINCT = "(SELECT DISTINCT id, massima_id, model_a_label, model_a_confidence, model_b_label, model_b_confidence, judge_label, label, confidence FROM llm_resolver_result)"
COMPOSITE = "round(least(greatest(0.6 * coalesce(model_a_confidence, 0) + 0.4 * coalesce(model_b_confidence, 0) + CASE WHEN judge_label IS NULL THEN 0.05 ELSE -0.03 END, 0.0), 1.0), 4)::DOUBLE"


def votes(spark, sf):
    return table(spark, sf, "llm_resolver_result").select("id", "massima_id", "model_a_label", "model_a_confidence", "model_b_label", "model_b_confidence", "judge_label", "label", "confidence").distinct()


@op(f"SELECT id, {COMPOSITE} AS composite FROM {_DISTINCT}")
def classify_composite(spark, sf):
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = 0.6 * zero("model_a_confidence") + 0.4 * zero("model_b_confidence") + F.when(F.col("judge_label").isNull(), 0.05).otherwise(-0.03)
    return votes(spark, sf).select("id", F.round(F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0)), 4).alias("composite"))


@op(f"SELECT id, CASE WHEN c >= 0.85 THEN 'TOP1' WHEN c >= 0.65 THEN 'TOP2' WHEN c >= 0.45 THEN 'LLM' ELSE 'NEEDS_REVIEW' END AS route FROM (SELECT id, {COMPOSITE} AS c FROM {_DISTINCT})")
def classify_route_v25(spark, sf):
    c = F.col("composite")
    return classify_composite(spark, sf).select("id", F.when(c >= 0.85, "TOP1").when(c >= 0.65, "TOP2").when(c >= 0.45, "LLM").otherwise("NEEDS_REVIEW").alias("route"))


@op(f"""WITH v AS (SELECT *, greatest(coalesce(model_a_confidence, 0), coalesce(model_b_confidence, 0)) AS top FROM {_DISTINCT})
    SELECT id, CASE WHEN model_a_label = model_b_label THEN model_a_label ELSE coalesce(judge_label, CASE WHEN coalesce(model_a_confidence, 0) >= coalesce(model_b_confidence, 0) THEN model_a_label ELSE model_b_label END) END AS label,
    round(CASE WHEN model_a_label = model_b_label THEN least(top * 1.1, 0.98) WHEN judge_label IS NOT NULL THEN top * 0.9 ELSE top * 0.5 END, 4) AS confidence,
    round(CASE WHEN model_a_label = model_b_label THEN least(top * 1.1, 0.98) WHEN judge_label IS NOT NULL THEN top * 0.9 ELSE top * 0.5 END, 4) >= 0.7 AS accepted FROM v""")
def llm_ensemble_merge(spark, sf):
    m = cl.merge_votes(*[F.col(c) for c in ("model_a_label", "model_a_confidence", "model_b_label", "model_b_confidence", "judge_label")])
    return votes(spark, sf).select("id", m.alias("m")).select("id", "m.*")


@op(f"SELECT id, round(CASE WHEN confidence <= 0.5714 THEN 0.7573 WHEN confidence <= 0.9 THEN 0.7573 WHEN confidence <= 0.92 THEN 0.7573 + (confidence - 0.9) * (0.2427 / 0.02) ELSE 1.0 END, 4)::DOUBLE AS calibrated FROM {_DISTINCT} WHERE confidence IS NOT NULL")
def isotonic_calibrate(spark, sf):
    """Stored thresholds applied; fondaco.operators.classify.isotonic_fit makes new ones."""
    return votes(spark, sf).where("confidence is not null").select("id", F.round(cl.calibrate(F.col("confidence"), [0.5714, 0.9, 0.92], [0.7573, 0.7573, 1.0]), 4).alias("calibrated"))


@op(f"WITH b AS (SELECT greatest(ceil(model_a_confidence * 10), 1) AS b, count(*) AS n, avg(model_a_confidence) AS c, avg(CASE WHEN model_a_label = label THEN 1.0 ELSE 0.0 END) AS a FROM {_DISTINCT} WHERE model_a_confidence IS NOT NULL GROUP BY 1) SELECT round(sum(abs(a - c) * n) / sum(n), 6) AS ece FROM b")
def ece(spark, sf):
    right = F.coalesce(F.col("model_a_label") == F.col("label"), F.lit(False))
    return ev.calibration_error(votes(spark, sf), F.col("model_a_confidence"), right)


@op(f"SELECT round(count(label) * 1.0 / count(*), 6) AS coverage, round(avg(confidence), 4) AS mean, list_filter([CASE WHEN NOT coalesce(count(label) * 1.0 / count(*) >= 0.99, false) THEN 'coverage' END, CASE WHEN NOT coalesce(avg(confidence) >= 0.5, false) THEN 'confidence' END], lambda x: x IS NOT NULL) AS failed FROM {_DISTINCT}")
def quality_gates(spark, sf):
    m = votes(spark, sf).agg(F.round(F.count("label") / F.count("*"), 6).alias("coverage"), F.round(F.avg("confidence"), 4).alias("mean"))
    return ev.gates(m, {"coverage": F.col("coverage") >= 0.99, "confidence": F.col("mean") >= 0.5})


# Quality

ARTICLE_QUALITY = "CASE WHEN testo IS NULL OR length(trim(testo)) = 0 THEN 'EMPTY' WHEN length(testo) < 20 THEN 'INVALID' WHEN regexp_matches(lower(testo), '^\\[?abrogato') THEN 'VALID_ABROGATED' WHEN length(testo) < 150 THEN 'VALID_SHORT' WHEN regexp_matches(testo, '[.;:]\\s*$') THEN 'VALID_STRONG' ELSE 'WEAK' END"


@op(f"SELECT id, {ARTICLE_QUALITY} AS quality FROM normativa_altalex")
def classify_article_quality(spark, sf):
    t, n = F.col("testo"), F.length("testo")
    q = F.when(t.isNull() | (F.length(F.trim(t)) == 0), "EMPTY").when(n < 20, "INVALID").when(F.lower(t).rlike(r"^\[?abrogato"), "VALID_ABROGATED").when(n < 150, "VALID_SHORT").when(t.rlike(r"[.;:]\s*$"), "VALID_STRONG").otherwise("WEAK")
    return table(spark, sf, "normativa_altalex").select("id", q.alias("quality"))


_VALID = "[\\p{L}\\p{N}\\s.,;:()''\"-]"
_IT = "(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ({0})))::DOUBLE / len(w) ELSE 0.0 END)".format(", ".join(f"'{w}'" for w in tx.ITALIAN))
OCR = f"SELECT id, round(0.4 * ({sql_share('testo', _VALID.replace(chr(39) * 2, chr(39)))}) + 0.4 * least({_IT} * 3, 1.0) + 0.2 * CASE WHEN regexp_matches(testo, {xp.q(ex.RV)}) THEN 1 ELSE 0 END, 5)::DOUBLE AS score FROM (SELECT id, testo, {sql_words('testo')} AS w FROM massime WHERE testo IS NOT NULL)"


@op(OCR)
def ocr_metrics(spark, sf):
    t = F.col("testo")
    score = 0.4 * tx.share_of(t, r"[\p{L}\p{N}\s.,;:()'\"-]") + 0.4 * F.least(tx.italian_share(t) * 3, F.lit(1.0)) + 0.2 * t.rlike(ex.RV).cast("int")
    return table(spark, sf, "massime").where("testo is not null").select("id", F.round(score, 5).alias("score"))


_PAGE = "SELECT document_id, pagina_inizio AS page, count(*) AS n, sum(length(testo))::BIGINT AS chars, sum(len(string_split(testo, chr(10))))::BIGINT AS lines FROM massime WHERE pagina_inizio IS NOT NULL AND testo IS NOT NULL GROUP BY 1, 2"


@op(_PAGE)
def page_stats(spark, sf):
    rows = table(spark, sf, "massime").where("pagina_inizio is not null and testo is not null")
    return rows.groupBy("document_id", F.col("pagina_inizio").alias("page")).agg(F.count("*").alias("n"), F.sum(F.length("testo")).alias("chars"), F.sum(F.size(F.split("testo", "\n"))).alias("lines"))


@op(f"""WITH p AS ({_PAGE}), f AS (SELECT document_id, max(n) AS most, sum(chars) * 1.0 / count(*) AS mean FROM p GROUP BY 1)
    SELECT document_id, 'crowded' AS flag FROM f WHERE most > 5 UNION ALL SELECT document_id, 'thin' FROM f WHERE mean < 400""")
def health_flags(spark, sf):
    f = page_stats(spark, sf).groupBy("document_id").agg(F.max("n").alias("most"), (F.sum("chars") / F.count("*")).alias("mean"))
    return f.where("most > 5").select("document_id", F.lit("crowded").alias("flag")).unionByName(f.where("mean < 400").select("document_id", F.lit("thin").alias("flag")))


GRADED = "SELECT document_id, round(avg(CASE WHEN rv IS NOT NULL AND numero IS NOT NULL THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS complete, count(*) AS n FROM massime GROUP BY 1"
GRADE = "CASE WHEN complete >= 0.9 THEN 'A' WHEN complete >= 0.75 THEN 'B' WHEN complete >= 0.5 THEN 'C' ELSE 'D' END"


@op(f"SELECT document_id, n, complete, {GRADE} AS grade FROM ({GRADED})")
def extraction_quality(spark, sf):
    done = F.coalesce((F.col("rv").isNotNull() & F.col("numero").isNotNull()).cast("double"), F.lit(0.0))
    g = table(spark, sf, "massime").groupBy("document_id").agg(F.round(F.avg(done), 6).alias("complete"), F.count("*").alias("n"))
    c = F.col("complete")
    return g.withColumn("grade", F.when(c >= 0.9, "A").when(c >= 0.75, "B").when(c >= 0.5, "C").otherwise("D"))


_NOISE = {"broken": r"[a-z]-\n", "digits": r"[a-z][0-9][a-z]", "marks": r"[!@]", "pages": r"\n\s*-?\s*\d{1,4}\s*-?\s*\n", "spaces": r"  +"}


@op("SELECT " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(testo, '{p}')) AS {n}" for n, p in _NOISE.items()) + " FROM massime")
def noise_counts(spark, sf):
    return table(spark, sf, "massime").agg(*[F.count_if(F.col("testo").rlike(p)).alias(n) for n, p in _NOISE.items()])


CHUNKF = "SELECT id, created_at, round(len(regexp_extract_all(text, '\\.{3,}|\\d+\\s*$')) * 1.0 / greatest(length(text), 1) * 100, 4)::DOUBLE AS toc, len(regexp_extract_all(text, '[.!?](\\s|$)')) AS sentences, length(text) < 150 AS short, regexp_matches(text, '(?i)\\bart\\.') AS cites FROM normativa_chunk"


@op(CHUNKF)
def chunk_features(spark, sf):
    n = F.regexp_count("text", F.lit(r"\.{3,}|\d+\s*$"))
    return table(spark, sf, "normativa_chunk").select("id", "created_at", F.round(n / F.greatest(F.length("text"), F.lit(1)) * 100, 4).alias("toc"), F.regexp_count("text", F.lit(r"[.!?](\s|$)")).cast("long").alias("sentences"),
        (F.length("text") < 150).alias("short"), F.col("text").rlike(r"(?i)\bart\.").alias("cites"))


LABEL = "CASE WHEN toc > 0.6 THEN 'toc' WHEN short AND NOT cites THEN 'noise' WHEN sentences > 2 THEN 'massima' WHEN cites THEN 'citation_list' ELSE 'uncertain' END"


@op(f"SELECT id, created_at, {LABEL} AS label FROM ({CHUNKF})")
def silver_label(spark, sf):
    label = F.when(F.col("toc") > 0.6, "toc").when(F.col("short") & ~F.col("cites"), "noise").when(F.col("sentences") > 2, "massima").when(F.col("cites"), "citation_list").otherwise("uncertain")
    return chunk_features(spark, sf).select("id", "created_at", label.alias("label"))


@op(f"SELECT document_id, CASE {GRADE} WHEN 'A' THEN 'strict' WHEN 'B' THEN 'normal' ELSE 'lenient' END AS profile FROM ({GRADED})")
def assign_profile(spark, sf):
    g = F.col("grade")
    return extraction_quality(spark, sf).select("document_id", F.when(g == "A", "strict").when(g == "B", "normal").otherwise("lenient").alias("profile"))


@op(f"SELECT document_id, round(0.7 * (1 - complete) + 0.3 * CASE WHEN n < 20 THEN 1 ELSE 0 END, 5)::DOUBLE AS risk FROM ({GRADED})")
def risk_report(spark, sf):
    return extraction_quality(spark, sf).select("document_id", F.round(0.7 * (1 - F.col("complete")) + 0.3 * (F.col("n") < 20).cast("int"), 5).alias("risk"))


@op("SELECT id, round(least(0.5 + CASE WHEN upper(trim(sezione)) IN ('U', 'UN', 'UNITE') THEN 0.2 ELSE 0 END + CASE WHEN rv IS NOT NULL AND numero IS NOT NULL AND anno IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN anno >= 2020 THEN 0.1 ELSE 0 END, 1.0), 4)::DOUBLE AS importance FROM massime")
def importance_score(spark, sf):
    one = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    full = F.col("rv").isNotNull() & F.col("numero").isNotNull() & F.col("anno").isNotNull()
    score = 0.5 + one(F.upper(F.trim("sezione")).isin("U", "UN", "UNITE"), 0.2) + one(full, 0.1) + one(F.col("anno") >= 2020, 0.1)
    return table(spark, sf, "massime").select("id", F.round(F.least(score, F.lit(1.0)), 4).alias("importance"))


@op("SELECT materia, id FROM (SELECT materia, id, row_number() OVER (PARTITION BY materia ORDER BY md5(id::VARCHAR || 'golden'), id) AS n FROM massime WHERE rv IS NOT NULL) WHERE n <= 30")
def golden_sample(spark, sf):
    return rel.sample_per_group(table(spark, sf, "massime").where("rv is not null").select("materia", "id"), "materia", "id", 30, "golden")


# Evaluation: a chunk's question should find the chunks of its own article.

_RANKED = rt.sql_bm25("chunks", 10)
_METRICS = f"""WITH {rt._C}, {rt._Q}, ranked AS ({_RANKED}), truth AS (SELECT q.id AS query_id, c.id FROM chunks q JOIN chunks c ON q.normativa_id = c.normativa_id WHERE q.id % 50 = 0),
    w AS (SELECT query_id, count(*) AS wanted FROM truth GROUP BY 1), h AS (SELECT r.query_id, r.rank, t.id IS NOT NULL AS hit FROM ranked r LEFT JOIN truth t ON r.query_id = t.query_id AND r.id = t.id),
    g AS (SELECT query_id, count(*) FILTER (WHERE hit) AS hits, count(*) AS seen, min(rank) FILTER (WHERE hit) AS first, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM h GROUP BY 1)
    SELECT w.query_id, round(coalesce(hits, 0) * 1.0 / wanted, 6)::DOUBLE AS recall, round(coalesce(hits, 0) / 10.0, 6)::DOUBLE AS precision, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr,
    round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(wanted, 10) + 1), lambda i: 1 / log2(i + 1))), 6)::DOUBLE AS ndcg, round(CASE WHEN seen > 0 THEN 1 - hits * 1.0 / seen ELSE 0 END, 6)::DOUBLE AS noise FROM w LEFT JOIN g ON w.query_id = g.query_id"""


@op(_METRICS)
def eval_ranking(spark, sf):
    c = rt.chunks(spark, sf)
    ranked = ret.bm25_search(rt.question(spark, sf), c, 10)
    own = c.where("id % 50 = 0").select(F.col("id").alias("query_id"), "normativa_id")
    return ev.ranking_metrics(ranked, own.join(c.select("id", "normativa_id"), "normativa_id").select("query_id", "id"), 10)


for _m in ("recall", "precision", "mrr", "ndcg", "noise"):
    QUERIES[f"eval_{_m}"] = lambda spark, sf, m=_m: eval_ranking(spark, sf).agg(F.round(F.avg(m), 4).alias(m), F.count("*").alias("queries"))
    SQL[f"eval_{_m}"] = f"SELECT round(avg({_m}), 4) AS {_m}, count(*) AS queries FROM ({_METRICS})"


@op(f"SELECT count(*) AS queries, round(avg(CASE WHEN mrr > 0 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS hit_rate, avg(mrr) >= 0.5 AS passed FROM ({_METRICS})", name="eval_norm")
def eval_norm(spark, sf):
    return eval_ranking(spark, sf).agg(F.count("*").alias("queries"), F.round(F.avg((F.col("mrr") > 0).cast("double")), 4).alias("hit_rate"), (F.avg("mrr") >= 0.5).alias("passed"))


@op(f"{CENTROID} SELECT own AS label, count(*) AS n, round(avg(CASE WHEN own = label THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM r WHERE n = 1 GROUP BY own")
def eval_category(spark, sf):
    own = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("own"))
    j = by_centroid(spark, sf).join(own, "vec_id")
    return j.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("own") == F.col("label")).cast("double")), 6).alias("accuracy"))


@op(f"WITH {rt._C}, {rt._Q}, a AS ({_RANKED}), t AS (SELECT q.id AS query_id, c.id FROM chunks q JOIN chunks c ON q.normativa_id = c.normativa_id WHERE q.id % 50 = 0), h AS (SELECT a.query_id, min(rank) FILTER (WHERE t.id IS NOT NULL) AS f FROM a LEFT JOIN t ON a.query_id = t.query_id AND a.id = t.id GROUP BY 1) SELECT round(avg(CASE WHEN f = 1 THEN 1.0 ELSE 0.0 END) - avg(coalesce(1.0 / f, 0)), 5)::DOUBLE AS lift FROM h")
def rerank_lift(spark, sf):
    m = eval_ranking(spark, sf)
    c = rt.chunks(spark, sf)
    seen = ret.bm25_search(rt.question(spark, sf), c, 10).select("query_id").distinct()
    return m.join(seen, "query_id").agg(F.round(F.avg((F.col("mrr") == 1).cast("double")) - F.avg("mrr"), 5).alias("lift"))


@op("SELECT 'massime' AS name, count(*) = count(DISTINCT id) AS ok FROM massime UNION ALL SELECT 'normativa', count(*) = count(DISTINCT id) FROM normativa UNION ALL SELECT 'orphans', count(*) = 0 FROM normativa_vigenza v WHERE NOT EXISTS (SELECT 1 FROM normativa n WHERE n.id = v.normativa_id)")
def sanity_checks(spark, sf):
    unique = lambda t: table(spark, sf, t).agg(F.lit(t).alias("name"), (F.count("*") == F.countDistinct("id")).alias("ok"))
    gone = table(spark, sf, "normativa_vigenza").select(F.col("normativa_id").alias("id")).join(table(spark, sf, "normativa").select("id"), "id", "left_anti")
    return unique("massime").unionByName(unique("normativa")).unionByName(gone.agg(F.lit("orphans").alias("name"), (F.count("*") == 0).alias("ok")))


@op("SELECT extraction_mode, round(avg(CASE WHEN rv IS NOT NULL THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate, avg(CASE WHEN rv IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.3 AS go FROM massime GROUP BY 1")
def run_go_nogo(spark, sf):
    rate = F.avg(F.col("rv").isNotNull().cast("double"))
    return table(spark, sf, "massime").groupBy("extraction_mode").agg(F.round(rate, 6).alias("rate"), (rate >= 0.3).alias("go"))


@op("SELECT document_id, round(0.4 * avg(CASE WHEN rv IS NOT NULL THEN 1.0 ELSE 0 END) + 0.4 * avg(CASE WHEN numero IS NOT NULL THEN 1.0 ELSE 0 END) + 0.2 * avg(CASE WHEN is_active THEN 1.0 ELSE 0 END), 5)::DOUBLE AS final FROM massime GROUP BY 1")
def benchmark_final_score(spark, sf):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return table(spark, sf, "massime").groupBy("document_id").agg(F.round(0.4 * share(F.col("rv").isNotNull()) + 0.4 * share(F.col("numero").isNotNull()) + 0.2 * share(F.col("is_active")), 5).alias("final"))


@op("SELECT document_id, CASE WHEN count(pagina_inizio) * 1.0 / count(*) >= 0.9 THEN 150 WHEN count(*) < 50 THEN 80 ELSE 100 END AS min_chars FROM massime GROUP BY 1")
def gate_config_by_coverage(spark, sf):
    rows = table(spark, sf, "massime").groupBy("document_id").agg((F.count("pagina_inizio") / F.count("*")).alias("c"), F.count("*").alias("n"))
    return rows.select("document_id", F.when(F.col("c") >= 0.9, 150).when(F.col("n") < 50, 80).otherwise(100).alias("min_chars"))


@op("SELECT id, len(regexp_extract_all(testo, '\\d+')) * 1.0 / greatest(len(string_split(testo, ' ')), 1) > 0.2 AS toc_like, len(regexp_extract_all(testo, '(?i)\\brv\\.')) >= 3 AS citation_list FROM massime WHERE testo IS NOT NULL")
def toc_like(spark, sf):
    t = F.col("testo")
    return table(spark, sf, "massime").where("testo is not null").select("id", (F.regexp_count(t, F.lit(r"\d+")) / F.greatest(F.size(F.split(t, " ")), F.lit(1)) > 0.2).alias("toc_like"), (F.regexp_count(t, F.lit(r"(?i)\brv\.")) >= 3).alias("citation_list"))


@op("SELECT document_id, round(quantile_cont(n, 0.95), 4) AS p95, quantile_cont(n, 0.95) <= 5 AS ok FROM (SELECT document_id, pagina_inizio, count(*) AS n FROM massime WHERE pagina_inizio IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def massime_per_page_p95(spark, sf):
    per = table(spark, sf, "massime").where("pagina_inizio is not null").groupBy("document_id", "pagina_inizio").agg(F.count("*").alias("n"))
    return per.groupBy("document_id").agg(F.round(F.percentile("n", 0.95), 4).alias("p95"), (F.percentile("n", 0.95) <= 5).alias("ok"))


@op("SELECT document_id, anno, count(*) AS n, round(avg(length(testo)), 4) AS mean FROM massime GROUP BY 1, 2")
def doc_diagnose_profile(spark, sf):
    return table(spark, sf, "massime").groupBy("document_id", "anno").agg(F.count("*").alias("n"), F.round(F.avg(F.length("testo")), 4).alias("mean"))


ABBREVIATIONS = "art|artt|n|sez|cod|proc|civ|pen|rv|c|p|s|l|lav|un|disp|att|nav|fall|cfr"


def sentences(rows):
    """(id, n, sentence) of (id, text): cut after a mark that ends a sentence and no abbreviation."""
    cut = F.split(F.regexp_replace("text", r"\s+", " "), rf"(?<!\b(?i:{ABBREVIATIONS})\.)(?<=[.!?])\s+(?=[A-ZÀ-Ý(])")
    return rows.where("text is not null").select("id", F.posexplode(cut).alias("n", "sentence"))


def windows(cut):
    """(id, n, window): two sentences before and one after each sentence that cites a register number."""
    by = Window.partitionBy("id").orderBy("n").rowsBetween(-2, 1)
    return cut.withColumn("window", F.array_join(F.collect_list("sentence").over(by), " ")).where(F.col("sentence").rlike(ex.RV)).select("id", "n", "window")


#: A split sentence begins anew after a mark, a blank and a capital, where no abbreviation ends: cut at a sign that no text holds.
_CUT = rf"regexp_replace(regexp_replace(regexp_replace(testo, '\s+', ' ', 'g'), '([.!?]) +([A-ZÀ-Ý(])', '\1' || chr(1) || '\2', 'g'), '(^|[^\w])((?i:{ABBREVIATIONS}))\.' || chr(1), '\1\2. ', 'g')"
_SENTENCES = f"SELECT id, generate_subscripts(string_split({_CUT}, chr(1)), 1)::INT - 1 AS n, unnest(string_split({_CUT}, chr(1))) AS sentence FROM massime WHERE testo IS NOT NULL"


@op(_SENTENCES)
def sentence_split(spark, sf):
    """Sentences of massime with their numbers."""
    return sentences(xp.texts(spark, sf))


@op(f"SELECT id, n, w AS window FROM (SELECT id, n, sentence, string_agg(sentence, ' ') OVER (PARTITION BY id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS w FROM ({_SENTENCES})) WHERE regexp_matches(sentence, {xp.q(ex.RV)})")
def anchored_windows(spark, sf):
    return windows(sentence_split(spark, sf))


_VALID = r"[\p{L}\p{N}\s.,;:!?()\"'-]"
_FIELDS = xp.SQL["extract_citation_fields"]


@op(f"""SELECT m.id, {sql_clean('m.testo')} AS testo, sha256({sql_hash_form('m.testo')}) AS content_hash, f.sezione, f.numero, f.anno, f.rv, round({sql_share(sql_clean('m.testo'), _VALID)}, 6) AS quality
    FROM massime m JOIN ({xp.SQL['is_massima_text']}) o ON m.id = o.id AND o.ok JOIN ({_FIELDS}) f ON f.id = m.id""")
def extract_massime_elements(spark, sf):
    """Texts that are case-law summaries, cleaned, hashed, with the citation they hold and the share of valid characters."""
    clean = tx.clean_legal_text(F.col("text"))
    told = xp.texts(spark, sf).where(ex.is_massima(F.col("text"))).select("id", clean.alias("testo"), tx.content_hash(tx.normalize_for_hash(F.col("text"))).alias("content_hash"),
        ex.citation_fields(F.col("text")).alias("c"), F.round(tx.share_of(clean, _VALID), 6).alias("quality"))
    return told.select("id", "testo", "content_hash", "c.sezione", "c.numero", "c.anno", "c.rv", "quality")
