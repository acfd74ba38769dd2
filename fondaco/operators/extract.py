"""Citations, norms and sections extracted from legal text.

Everything runs in the JVM over all matches of a text at once; the places of matches and what stands around them come from the
lengths of the pieces between them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fondaco.functions import legal

# Forms of citations, and the words before one that tell its attitude.
RV = r"(?i)\brv\.?\s*(\d{5,7})(?:-\d+)?"
SEZ = r"(?i)\bsez\.?\s*([a-z0-9\-]+)\.?[,\s]+n\.?\s*(\d+)[/\s]+(\d{4})"
NUM = r"(?i)\bn\.?\s*(\d+)\s+(?:del\s+)?(\d{4})\b"
SENTENCE = r"(?i)\b(?:sent(?:enza)?|ord(?:inanza)?)\.?\s*n\.?\s*(\d+)\s+(?:del\s+)?(\d{4})\b"
ATTITUDES = [
    ("OVERRULES", r"contra|in senso contrario|superando|muta(?:ndo)? (?:il )?(?:proprio )?orientamento|in senso difforme|abbandona(?:ndo)?"),
    ("DISTINGUISHES", r"diversamente|va distint[ao]|non si applica|fattispecie diversa|caso diverso"),
    ("CONFIRMS", r"conforme|nello stesso senso|v\. anche|cfr\.|in senso analogo|in termini"),
]
RESOLVER_WEIGHTS = {"rv_exact": 1.0, "rv_raw": 0.95, "rv_text_fallback": 0.85, "sez_num_anno": 0.9, "sez_num_anno_raw": 0.85, "num_anno": 0.7}

# How the codes are written after an article's number, and the acts before their number; abbreviations in full references.
CODES = {
    "CPC": r"c\.?\s*p\.?\s*c\b|cod\.?\s*proc\.?\s*civ\b|codice\s+di\s+procedura\s+civile\b", "CPP": r"c\.?\s*p\.?\s*p\b|cod\.?\s*proc\.?\s*pen\b|codice\s+di\s+procedura\s+penale\b",
    "CC": r"c\.?\s*c\b|cod\.?\s*civ\b|codice\s+civile\b", "CP": r"c\.?\s*p\b|cod\.?\s*pen\b|codice\s+penale\b", "COST": r"cost\b|della\s+costituzione\b|costituzione\b",
    "TUB": r"t\.?\s*u\.?\s*b\b|testo\s+unico\s+bancario\b", "TUF": r"t\.?\s*u\.?\s*f\b|testo\s+unico\s+finanza\b", "CAD": r"c\.?\s*a\.?\s*d\b|codice\s+amministrazione\s+digitale\b",
}
ACTS = {"LEGGE": r"l\.|legge", "DLGS": r"d\.?\s*lgs\.?|decreto\s+legislativo", "DPR": r"d\.?\s*p\.?\s*r\.?|decreto\s+del\s+presidente\s+della\s+repubblica", "DL": r"d\.?\s*l\.?|decreto\s+legge"}
DATED = {"LEGGE": "legge", "DLGS": ACTS["DLGS"]}
ABBREVIATIONS = {"CC": "c.c.", "CPC": "c.p.c.", "CP": "c.p.", "CPP": "c.p.p.", "COST": "Cost.", "LEGGE": "L.", "DLGS": "D.Lgs.", "DPR": "D.P.R.", "DL": "D.L."}

# The grammar of a reference: an article, or a range of them, with a suffix and a code; an act with number and year, or date and number.
ANY_CODE = "|".join(f"({p})" for p in CODES.values())
CODE_REF = rf"(?i)\bartt?\.?\s*(\d+)(?:\s*[-–]\s*\d+)?\s*(?:[-–]\s*)?({legal.SUFFIX})?\s*(?:{ANY_CODE})"
ACT_REF = {code: rf"(?i)\b(?:{p})\s*(?:n\.?\s*)?(\d+)\s*(?:/|del\s*)(\d{{4}})\b" for code, p in ACTS.items()}
DATED_REF = {code: rf"(?i)\b(?:{p})\s+\d+\s+\w+\s+(\d{{4}})\s*,?\s*n\.?\s*(\d+)\b" for code, p in DATED.items()}
#: How questions name norms, in the order in which they are tried: loosely, without "art." and with blanks for points and strokes.
QUESTION_CODES = {"CC": r"c\.?\s*c|codice\s*civile", "CPC": r"c\.?\s*p\.?\s*c", "CPP": r"c\.?\s*p\.?\s*p", "CP": r"c\.?\s*p", "COST": "cost|costituzione", "TUB": r"t\.?\s*u\.?\s*b", "TUF": r"t\.?\s*u\.?\s*f", "CAD": r"c\.?\s*a\.?\s*d"}
QUESTION_ACTS = {"DLGS": r"d\.?\s*lgs\.?|decreto\s+legislativo", "DPR": r"d\.?\s*p\.?\s*r\.?", "DL": r"d\.?\s*l\.?|decreto\s+legge", "LEGGE": r"l\.?|legge"}
QUESTION_CODE = {code: rf"(\d+)\s*(?:-\s*)?({legal.SUFFIX})?\s*(?:{p})\b" for code, p in QUESTION_CODES.items()}
QUESTION_ACT = {code: rf"(?:^|[^a-z.])(?:{p})\s*(?:n\.?\s*)?(\d+)\s*(?:/|del\s*|\s)\s*(\d{{4}})\b" for code, p in QUESTION_ACTS.items()}

# How decisions and acts of the Union are cited, with articles, paragraphs and letters.
ARTICLES = r"(?i)artt?\.?\s*(\d+(?:\s*[-–]\s*\d+)?(?:\s*,\s*\d+)*)\s*(?:,?\s*(?:co\.?|comma)\s*(\d+(?:\s*[-–]\s*\d+)?))?\s*(?:,?\s*(?:lett\.?|lettera)\s*([a-z]))?\s*"
CITED_CODES = {
    "disp. att. c.p.c.": r"disp\.?\s*att\.?\s*c\.?\s*p\.?\s*c\.?", "c.p.c.": r"c\.?\s*p\.?\s*c\.?|cod\.?\s*proc\.?\s*civ\.?|codice\s+di\s+procedura\s+civile",
    "c.p.p.": r"c\.?\s*p\.?\s*p\.?|cod\.?\s*proc\.?\s*pen\.?|codice\s+di\s+procedura\s+penale", "c.c.": r"c\.?\s*c\.?|cod\.?\s*civ\.?|codice\s+civile",
    "c.p.": r"c\.?\s*p\.?|cod\.?\s*pen\.?|codice\s+penale", "cost.": r"cost\.?|costituzione",
}
CITED_CODE = ARTICLES + "(?:" + "|".join(f"({p})" for p in CITED_CODES.values()) + ")"
CITED_LAW = ARTICLES + r"(?:della?\s+|,\s*)?((?:l\.?|legge|d\.?\s*l(?:gs)?\.?|decreto\s*legislativo|d\.?\s*p\.?\s*r\.?)\s*(?:n\.?\s*)?\d+\s*/\s*\d{4})"
UNION_ACTS = {"regolamento_ue": "reg(?:olamento)?", "direttiva_ue": "dir(?:ettiva)?"}
UNION_ACT = {kind: rf"(?i)\b{p}\.?\s*(?:\(?\s*(?:UE|CEE|CE)\s*\)?\s*)?(?:n\.?\s*)?(\d+)\s*/\s*(\d+)" for kind, p in UNION_ACTS.items()}
_DECIDED = r"\s*(?:,?\s*(?:sent\.?|sentenza|ord\.?|ordinanza))?\s*(?:,?\s*n\.?\s*(\d+))?(?:[/\s]+(?:del\s+)?)?(?:(\d{1,2})[/.-](\d{1,2})[/.-])?(\d{4})?"
#: Authority: pattern with groups section, number, day, month, year.
COURTS = {
    "Cassazione": r"(?i)\bcass(?:azione|\.)?\s*(?:civ\.?|pen\.?)?\s*(?:,?\s*(?:sez\.?|sezione|sezioni)\s*(u(?:nite|n)?|l(?:av)?|\d+(?:\s*-\s*\d+)?)\.?)?" + _DECIDED,
    "Corte Costituzionale": r"(?i)\b(?:corte\s+cost(?:ituzionale|\.)?|c\.?\s*cost\.?)()" + _DECIDED,
    "Consiglio di Stato": r"(?i)\b(?:cons\.?\s*(?:di\s+)?stato|c\.?\s*d\.?\s*s\.)\s*(?:,?\s*sez\.?\s*([ivx0-9]+))?" + _DECIDED,
    "CGUE": r"(?i)\b(?:cgue|corte\s+(?:di\s+)?giustizia\s*(?:ue|eu)?|c\.?\s*giust\.?)()\s*(?:,?\s*causa\s*(?:c-)?(\d+/\d+))?\s*(?:,?\s*(?:sent\.?|sentenza))?\s*(?:,?\s*del\s+)?(?:(\d{1,2})[/.-](\d{1,2})[/.-])?(\d{4})?",
}


def _rows(texts: DataFrame, pattern: str, groups: list[str]) -> DataFrame:
    """(id, *groups) for all matches; groups that match nothing are empty."""
    parts = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i + 1)).alias(g) for i, g in enumerate(groups)]
    return texts.select("id", F.explode(F.arrays_zip(*parts)).alias("m")).select("id", *[F.col(f"m.{g}").alias(g) for g in groups])


def _placed(texts: DataFrame, pattern: str, groups: list[str], before: int, after: int = 0) -> DataFrame:
    """(id, position, raw_span, around, *groups): matches with their place, and the text from ``before`` characters before to ``after`` behind.

    The pieces between matches give the places, so all of it runs in the JVM; texts without a match end at the first look.
    """
    spans = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    parts = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i + 1)).alias(g) for i, g in enumerate(groups)]
    told = texts.where(F.col("text").rlike(pattern)).select("id", "text", spans.alias("raw_span"), F.split("text", pattern, -1).alias("_pieces"), *parts)
    size = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    told = told.withColumn("position", F.transform("raw_span", lambda x, i: size("_pieces", i + 1) + size("raw_span", i)))
    start = lambda p: F.greatest(p - before, F.lit(0))
    around = F.transform(F.arrays_zip("position", "raw_span"), lambda m: F.substring(F.col("text"), start(m.position) + 1, m.position - start(m.position) + (F.length(m.raw_span) + after if after else 0)))
    told = told.withColumn("around", around)
    names = ["position", "raw_span", "around", *groups]
    return told.select("id", F.explode(F.arrays_zip(*names)).alias("m")).select("id", *[F.col(f"m.{g}").alias(g) for g in names])


def indicator(before: Column) -> Column:
    """The attitude of the words before a citation, the strongest first; null if none."""
    return F.coalesce(*[F.when(F.lower(before).rlike(p), name) for name, p in ATTITUDES])


def mentions(texts: DataFrame) -> DataFrame:
    """Citations in (id, text) by four forms, with their place, span and the attitude in the 50 characters before.

    (id, kind, rv_raw, sezione, numero_raw, anno, rv, numero, position, raw_span, indicator)
    """
    forms = [("rv", RV, ["rv_raw"]), ("sez_num_anno", SEZ, ["sezione", "numero_raw", "anno"]), ("num_anno", NUM, ["numero_raw", "anno"]), ("sentenza", SENTENCE, ["numero_raw", "anno"])]
    parts = [_placed(texts, pattern, groups, 50).withColumn("kind", F.lit(kind)) for kind, pattern, groups in forms]
    told = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return told.select(
        "id", "kind", "rv_raw", legal.norm_sezione(F.col("sezione")).alias("sezione"), "numero_raw", F.col("anno").cast("int").alias("anno"), legal.norm_rv(F.col("rv_raw")).alias("rv"),
        legal.norm_numero(F.col("numero_raw")).alias("numero"), "position", "raw_span", indicator(F.col("around")).alias("indicator"),
    )


def mention_places(texts: DataFrame) -> DataFrame:
    """(id, kind, position, raw_span, indicator): where each citation stands and the attitude in the 50 characters before it."""
    return mentions(texts).select("id", "kind", "position", "raw_span", "indicator")


def resolve(found: DataFrame, keys: DataFrame) -> DataFrame:
    """Mentions with the row they mean: (…, target, resolver), by the first level of the cascade that has an answer.

    keys: (id, rv, sezione, numero, anno) of active rows; of several answers on a level the smallest id holds. A mention that
    resolves to its own text is a self-reference and is left out; repeated mentions count once.
    """
    sezione = keys.withColumn("sezione", legal.norm_sezione(F.col("sezione")))
    levels = [("rv_exact", ["rv"], keys), ("sez_num_anno", ["sezione", "numero", "anno"], sezione), ("num_anno", ["numero", "anno"], keys)]
    hits = []
    for i, (name, cols, source) in enumerate(levels):
        known = source.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])).groupBy(*cols).agg(F.min("id").alias("target"))
        hits.append(found.join(known, cols).select(*found.columns, F.struct(F.lit(i).alias("level"), F.col("target"), F.lit(name).alias("resolver")).alias("hit")))
    best = reduce(DataFrame.unionByName, hits).groupBy(*found.columns).agg(F.min("hit").alias("hit"))
    return best.select(*found.columns, "hit.target", "hit.resolver").where("target <> id")


def mention_weight(resolver: Column, indicator: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in RESOLVER_WEIGHTS.items() for x in kv])
    base = F.coalesce(F.element_at(known, resolver), F.lit(1.0))
    return F.round(F.when(indicator.isin("OVERRULES", "DISTINGUISHES"), F.least(base * 1.1, F.lit(1.0))).otherwise(base), 2)


def evidence(rv: Column, rv_raw: Column, sezione: Column, numero: Column, anno: Column, span: Column, resolver: Column, attitude: Column) -> Column:
    """What was matched and how it was resolved, as JSON; what is unknown is null, and the span is cut to 100 characters."""
    number = F.concat(numero, F.lit("/"), anno.cast("string"))
    raw = F.when(rv_raw != rv, F.concat(F.lit(" (raw: "), rv_raw, F.lit(")"))).otherwise("")
    pattern = F.coalesce(F.concat(F.lit("Rv."), rv, F.coalesce(raw, F.lit(""))), F.concat(F.lit("Sez."), sezione, F.lit("/n."), number), F.concat(F.lit("n."), number))
    fields = F.struct(pattern.alias("pattern"), attitude.alias("indicator"), resolver.alias("resolver"), F.substring(span, 1, 100).alias("raw_span"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


#: Mentions in the order in which a text is read for them.
FORMS = ["rv", "sez_num_anno", "num_anno", "sentenza"]


def dedupe(found: DataFrame) -> DataFrame:
    """(source, target, indicator, confidence, weight, evidence): one edge for each source, target and attitude of resolved mentions.

    The mention of greatest confidence holds (1.0 by register number, else 0.9), the first one read of several.
    """
    confidence = F.when(F.col("resolver").contains("rv"), 1.0).otherwise(0.9)
    place = F.struct((-confidence).alias("c"), (F.array_position(F.array(*map(F.lit, FORMS)), F.col("kind"))).alias("k"), "position")
    row = F.struct("rv", "rv_raw", "sezione", "numero", "anno", "raw_span", "resolver", confidence.alias("confidence"))
    best = found.groupBy(F.col("id").alias("source"), "target", "indicator").agg(F.min_by(row, place).alias("m"))
    m = lambda c: F.col(f"m.{c}")
    told = evidence(m("rv"), m("rv_raw"), m("sezione"), m("numero"), m("anno"), m("raw_span"), m("resolver"), F.col("indicator"))
    return best.select("source", "target", "indicator", m("confidence").alias("confidence"), mention_weight(m("resolver"), F.col("indicator")).alias("weight"), told.alias("evidence"))


def norm_refs(texts: DataFrame) -> DataFrame:
    """(id, code, article, suffix, number, year, norm_id, full_ref, context): the norms of (id, text), each once a text, with 80 characters around its last mention."""
    codes = _placed(texts, CODE_REF, ["article", "suffix", *CODES], 80, 80)
    code = F.coalesce(*[F.when(F.col(c) != "", c) for c in CODES])
    parts = [codes.select("id", "position", "around", F.lit(0).alias("_form"), code.alias("code"), "article", F.nullif(F.lower("suffix"), F.lit("")).alias("suffix"))]
    for form, (refs, groups) in enumerate([(ACT_REF, ["number", "year"]), (DATED_REF, ["year", "number"])], 1):
        parts += [_placed(texts, p, groups, 80, 80).select("id", "position", "around", F.lit(form).alias("_form"), F.lit(c).alias("code"), "number", "year") for c, p in refs.items()]
    told = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("year", F.col("year").cast("int"))
    told = told.withColumn("norm_id", legal.canonical_id(F.col("code"), F.col("article"), F.col("suffix"), F.col("number"), F.col("year")))
    last = told.groupBy("id", "norm_id").agg(F.max_by(F.struct("code", "article", "suffix", "number", "year", "around"), F.struct("_form", "position")).alias("m")).select("id", "norm_id", "m.*")
    short = F.coalesce(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])[F.col("code")], F.col("code"))
    full = F.when(F.col("article").isNotNull(), F.concat_ws(" ", F.lit("art."), "article", "suffix", short)).otherwise(F.concat(short, F.lit(" n. "), "number", F.lit("/"), "year"))
    context = F.trim(F.regexp_replace("around", r"\s+", " "))
    return last.select("id", "code", "article", "suffix", "number", "year", "norm_id", full.alias("full_ref"), context.alias("context"))


def norms(texts: DataFrame) -> DataFrame:
    """(id, code, article, suffix, number, year, norm_id): references to norms in (id, text), each once a text."""
    codes = _rows(texts, CODE_REF, ["article", "suffix", *CODES])
    code = F.coalesce(*[F.when(F.col(c) != "", c) for c in CODES])
    parts = [codes.select("id", code.alias("code"), "article", F.nullif(F.lower("suffix"), F.lit("")).alias("suffix"))]
    parts += [_rows(texts, p, ["number", "year"]).withColumn("code", F.lit(c)) for c, p in ACT_REF.items()]
    parts += [_rows(texts, p, ["year", "number"]).withColumn("code", F.lit(c)) for c, p in DATED_REF.items()]
    told = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    told = told.select("id", "code", "article", "suffix", "number", F.col("year").cast("int").alias("year"))
    return told.withColumn("norm_id", legal.canonical_id(F.col("code"), F.col("article"), F.col("suffix"), F.col("number"), F.col("year"))).distinct()


def norm_question(question: Column) -> Column:
    """The canonical id of the norm that a question names, however loosely; null if it names none."""
    text = F.lower(F.trim(question))
    part = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    none = F.lit(None).cast("string")
    codes = [F.when(part(p, 1).isNotNull(), legal.canonical_id(F.lit(c), part(p, 1), part(p, 2), none, none.cast("int"))) for c, p in QUESTION_CODE.items()]
    acts = [F.when(part(p, 1).isNotNull(), F.concat_ws(":", F.lit(c), part(p, 1), part(p, 2))) for c, p in QUESTION_ACT.items()]
    return F.coalesce(*codes, *acts)


CITATION = ["id", "tipo", "raw_text", "articolo", "comma", "lettera", "codice", "legge", "atto_ue", "autorita", "sezione", "numero", "anno"]


def citations(texts: DataFrame) -> DataFrame:
    """Citations of codes, laws, acts of the Union and decisions in (id, text), each span once a text; see CITATION for the columns."""
    spans = lambda pattern, groups: _rows(texts.select("id", "text"), f"({pattern})".replace("((?i)", "(?i)(", 1), ["raw_text", *groups])
    codes = spans(CITED_CODE, ["articolo", "comma", "lettera", *[f"c{i}" for i in range(len(CITED_CODES))]])
    code = F.coalesce(*[F.when(F.col(f"c{i}") != "", c) for i, c in enumerate(CITED_CODES)])
    parts = [codes.withColumn("codice", code).withColumn("tipo", F.lit("norma")), spans(CITED_LAW, ["articolo", "comma", "lettera", "legge"]).withColumn("tipo", F.lit("norma"))]
    parts += [spans(p, ["a", "b"]).withColumn("atto_ue", F.concat("a", F.lit("/"), "b")).withColumn("tipo", F.lit(kind)) for kind, p in UNION_ACT.items()]
    parts += [spans(p, ["sezione", "numero", "_d", "_m", "anno"]).where("numero <> '' or anno <> ''").withColumn("autorita", F.lit(c)).withColumn("tipo", F.lit("pronuncia")) for c, p in COURTS.items()]
    told = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return told.select("id", "tipo", "raw_text", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in CITATION[3:-1]], F.nullif("anno", F.lit("")).cast("int").alias("anno")).distinct()


def cited_norm(articolo: Column, comma: Column, lettera: Column, codice: Column, legge: Column) -> Column:
    """'art. 5 c.c., co. 2, lett. a' of a citation of a code or law, in lower case."""
    part = lambda word, c: F.coalesce(F.concat(F.lit(word), c), F.lit(""))
    return F.lower(F.concat(F.lit("art. "), articolo, F.lit(" "), F.coalesce(codice, legge), part(", co. ", comma), part(", lett. ", lettera)))


def cited_decision(autorita: Column, sezione: Column, numero: Column, anno: Column) -> Column:
    """'cassazione sez. u n. 5/2020' of a citation of a numbered decision, in lower case."""
    part = lambda word, c: F.coalesce(F.concat(F.lit(word), c.cast("string")), F.lit(""))
    return F.lower(F.concat(autorita, part(" sez. ", sezione), F.lit(" n. "), numero, part("/", anno)))


def citation_fields(text: Column) -> Column:
    """First full citation of a text, else its isolated parts."""
    part = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    return F.struct(
        legal.norm_sezione(part(SEZ, 1)).alias("sezione"), legal.norm_numero(part(SEZ, 2)).alias("numero"), part(SEZ, 3).cast("int").alias("anno"), legal.norm_rv(part(RV, 1)).alias("rv"), legal.italian_date(text).alias("data")
    )


# Openings that mark a case-law summary.
OPENINGS = "in tema di|in materia di|la sentenza|l'ordinanza|il principio|ai fini|nel caso|qualora|ove|allorch[eé]"


def is_massima(text: Column) -> Column:
    return (F.length(F.trim(text)) >= 100) & (F.lower(F.ltrim(text)).rlike(f"^(?:{OPENINGS})") | text.rlike(SEZ))


def route(query: Column) -> Column:
    """How a query is answered: by register number, section and number, norm, number and year, or meaning."""
    act = "|".join(f"(?:{p[4:]})" for p in [*ACT_REF.values(), *DATED_REF.values()])
    return (
        F.when(query.rlike(RV), "citation_rv").when(query.rlike(SEZ), "citation_sez_num_anno").when(query.rlike(CODE_REF) | query.rlike(f"(?i)(?:{act})"), "norm")
        .when(query.rlike(r"(?i)\bn\.?\s*\d+\s*(?:/|del\s+)\d{4}"), "citation_num_anno").otherwise("semantic")
    )


def merge_paragraphs(blocks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, first, text): blocks joined to the next while they end unfinished: a broken word, or no closing mark."""
    by = Window.partitionBy(key).orderBy(order)
    t = F.trim(text)
    open_end = t.endswith("-") | (~t.rlike(r"[.!?:;)]$") & (F.length(t) > 10))
    marked = blocks.where(F.length(t) > 0).withColumn("_t", t).withColumn("_open", F.lag(open_end).over(by))
    marked = marked.withColumn("_run", F.sum(F.when(F.coalesce("_open", F.lit(False)), 0).otherwise(1)).over(by))
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct(order, "_t"))), F.lit(""),
        lambda a, b: F.when(a == "", b._t).when(a.endswith("-"), F.concat(F.regexp_replace(a, "-$", ""), b._t)).otherwise(F.concat(a, F.lit(" "), b._t)),
    )
    return marked.groupBy(key, "_run").agg(F.min(order).alias("first"), joined.alias("text")).drop("_run")


def cross_references(text: Column) -> Column:
    """Bracketed references in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d+(?:-?[a-z]+)?)\]"), F.lit(1)))


def is_abrogated(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(r"\babrogat[oaie]\b"), F.lit(False))
