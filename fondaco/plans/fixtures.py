"""Small inputs written out with the rows that must come out; the SQL states these rows and no pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from fondaco.functions import legal, text as tx
from fondaco.operators import chunk, extract as ex
from fondaco.plans import quality

QUERIES, SQL = {}, {}


def literal(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def expected(columns: str, rows: list[tuple]):
    """Register a query with the rows that it must give: columns as 'name TYPE, ...'."""
    names, types = zip(*(c.split() for c in columns.split(", ")))
    values = ", ".join("(" + ", ".join(f"{literal(v)}::{t}" for v, t in zip(r, types)) + ")" for r in rows)

    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"SELECT * FROM (VALUES {values}) AS t({', '.join(names)})"
        return f

    return register


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


KEYS = [("09337", "9337", "639966-01", "639966", "Un", "U"), ("0000", "0", "0639966", "639966", "Unite", "U"), ("12", "12", "654321", "654321", "Lav", "L"), ("", "", "12", "12", "6-1", "6-1"), (None, None, None, None, None, None)]


@expected("i BIGINT, numero VARCHAR, rv VARCHAR, sezione VARCHAR", [(i, n, r, s) for i, (_, n, _, r, _, s) in enumerate(KEYS)])
def fixture_citation_keys(spark, sf):
    rows = spark.createDataFrame([(i, n, r, s) for i, (n, _, r, _, s, _) in enumerate(KEYS)], "i long, n string, r string, s string")
    return rows.select("i", legal.norm_numero(F.col("n")).alias("numero"), legal.norm_rv(F.col("r")).alias("rv"), legal.norm_sezione(F.col("s")).alias("sezione"))


MENTIONS = [
    ("cfr. Cass. Sez. Un., Rv. 639966", [("rv", "639966", None, None, None, "CONFIRMS", 21)]), ("Rv. 639966-01", [("rv", "639966", None, None, None, None, 0)]), ("vedi Rv 654321", [("rv", "654321", None, None, None, None, 5)]),
    ("Cass. Sez. Un., n. 12345/2020", [("sez_num_anno", None, "U", "12345", 2020, None, 6)]), ("Sez. 1, n. 09337/2020", [("sez_num_anno", None, "1", "9337", 2020, None, 0)]),
    ("sentenza n. 9876 del 2019", [("num_anno", None, None, "9876", 2019, None, 9), ("sentenza", None, None, "9876", 2019, None, 0)]),
    ("Rv. 123456 cfr. anche Rv. 654321", [("rv", "123456", None, None, None, None, 0), ("rv", "654321", None, None, None, "CONFIRMS", 22)]),
    ("conforme a quanto stabilito in Rv. 123456", [("rv", "123456", None, None, None, "CONFIRMS", 31)]), ("diversamente da Rv. 123456", [("rv", "123456", None, None, None, "DISTINGUISHES", 16)]),
    ("in senso contrario Rv. 123456", [("rv", "123456", None, None, None, "OVERRULES", 19)]), ("contra: Rv. 654321", [("rv", "654321", None, None, None, "OVERRULES", 8)]), ("nessuna citazione", []), (None, []),
]


@expected("id BIGINT, kind VARCHAR, rv VARCHAR, sezione VARCHAR, numero VARCHAR, anno INTEGER, indicator VARCHAR, position INTEGER", [(i, *m) for i, (_, ms) in enumerate(MENTIONS) for m in ms])
def fixture_mentions(spark, sf):
    return ex.mentions(texts(spark, [t for t, _ in MENTIONS])).select("id", "kind", "rv", "sezione", "numero", "anno", "indicator", "position")


NORMS = [
    ("l'art. 2043 c.c. e l'art 2043 cc", ["CC:2043"]), ("artt. 2043-2045 c.c.", ["CC:2043"]), ("art. 2043 del codice; art. 1176 codice civile", ["CC:1176"]), ("art 360 cpc", ["CPC:360"]), ("art. 360 bis c.p.c.", ["CPC:360:bis"]),
    ("art. 640-ter c.p.", ["CP:640:ter"]), ("art. 384 c.p.p.", ["CPP:384"]), ("art. 5 cod. proc. pen.", ["CPP:5"]), ("art. 111 Cost. e art. 3 della Costituzione", ["COST:111", "COST:3"]), ("art. 10 testo unico bancario", ["TUB:10"]), ("art. 21 t.u.f.", ["TUF:21"]),
    ("art. 5 CAD", ["CAD:5"]), ("L. n. 241/1990", ["LEGGE:241:1990"]), ("l. 241/1990", ["LEGGE:241:1990"]), ("legge n. 241 del 1990", ["LEGGE:241:1990"]), ("legge 7 agosto 1990, n. 241", ["LEGGE:241:1990"]), ("d.lgs. n. 50/2016", ["DLGS:50:2016"]),
    ("d.lgs. 10 settembre 2003, n. 276", ["DLGS:276:2003"]), ("decreto legislativo 165/2001", ["DLGS:165:2001"]), ("decreto del presidente della repubblica 445/2000", ["DPR:445:2000"]), ("d.p.r. n. 445/2000", ["DPR:445:2000"]), ("dl 18/2020", ["DL:18:2020"]),
    ("nessuna norma, articolo senza numero", []), ("", []), (None, []),
]


@expected("id BIGINT, norm_id VARCHAR", [(i, n) for i, (_, ns) in enumerate(NORMS) for n in ns])
def fixture_norms(spark, sf):
    return ex.norms(texts(spark, [t for t, _ in NORMS])).select("id", "norm_id")


LONG = "parola " * 30
CONTEXTS = [
    ("Vedi art. 2043  c.c.,\ncomma 1", "CC:2043", "art. 2043 c.c.", "Vedi art. 2043 c.c., comma 1"), ("l. 241/1990", "LEGGE:241:1990", "L. n. 241/1990", "l. 241/1990"),
    (f"art. 360 bis c.p.c. {LONG}art. 360-bis cod. proc. civ. fine", "CPC:360:bis", "art. 360 bis c.p.c.", ("parola " * 30)[-80:].strip() + " art. 360-bis cod. proc. civ. fine"),
]


@expected("id BIGINT, norm_id VARCHAR, full_ref VARCHAR, context VARCHAR", [(i, *r[1:]) for i, r in enumerate(CONTEXTS)])
def fixture_norm_contexts(spark, sf):
    return ex.norm_refs(texts(spark, [r[0] for r in CONTEXTS])).select("id", "norm_id", "full_ref", "context")


QUESTIONS = [
    ("art. 2043 c.c.", "CC:2043"), ("art 2043 cc", "CC:2043"), ("2043cc", "CC:2043"), ("2043 codice civile", "CC:2043"), ("360 bis cpc", "CPC:360:bis"), ("384 c.p.p.", "CPP:384"), ("640 cp", "CP:640"), ("111 cost", "COST:111"),
    ("art 10 tub", "TUB:10"), ("legge 241 1990", "LEGGE:241:1990"), ("l. n. 241 del 1990", "LEGGE:241:1990"), ("d lgs 165 2001", "DLGS:165:2001"), ("dlgs 50 2016", "DLGS:50:2016"), ("d.p.r. 445/2000", "DPR:445:2000"), ("d.l. 18/2020", "DL:18:2020"),
    ("responsabilità del produttore", None), ("", None), (None, None),
]


@expected("id BIGINT, norm_id VARCHAR", [(i, n) for i, (_, n) in enumerate(QUESTIONS)])
def fixture_norm_questions(spark, sf):
    return texts(spark, [t for t, _ in QUESTIONS]).select("id", ex.norm_question(F.col("text")).alias("norm_id"))


ROUTES = [
    ("Rv. 639966", "citation_rv"), ("Sez. Un., n. 12345/2020", "citation_sez_num_anno"), ("L. n. 206/2005", "norm"), ("legge n. 206/2005", "norm"), ("art. 2043 c.c.", "norm"), ("n. 12345/2020", "citation_num_anno"),
    ("responsabilità del medico per omessa diagnosi", "semantic"),
]


@expected("id BIGINT, route VARCHAR", [(i, r) for i, (_, r) in enumerate(ROUTES)])
def fixture_routes(spark, sf):
    return texts(spark, [t for t, _ in ROUTES]).select("id", ex.route(F.col("text")).alias("route"))


RESOLVED = "id long, target long, kind string, rv string, rv_raw string, sezione string, numero string, anno int, position int, raw_span string, resolver string, indicator string"
EDGES = [
    *[(1, 9, "rv", "123456", "123456", None, None, None, i, f"Rv. 123456 ({i})", "rv_exact", None) for i in range(4)],
    (2, 9, "rv", "123456", "123456", None, None, None, 5, "Rv. 123456", "rv_exact", "CONFIRMS"), (2, 9, "rv", "123456", "123456", None, None, None, 50, "Rv. 123456", "rv_exact", "OVERRULES"),
    (3, 9, "num_anno", None, None, None, "123", 2020, 0, "n. 123 del 2020", "num_anno", None), (3, 9, "rv", "123456", "0123456", None, None, None, 30, "Rv. 0123456", "rv_exact", None),
    (4, 9, "sez_num_anno", None, None, "U", "12345", 2020, 3, "x" * 200, "sez_num_anno", "OVERRULES"), (5, 8, "num_anno", None, None, None, "123", 2020, 0, "n. 123 del 2020", "num_anno", "DISTINGUISHES"),
]


def _json(pattern, indicator, resolver, span):
    return f'{{"pattern":"{pattern}","indicator":{chr(34) + indicator + chr(34) if indicator else "null"},"resolver":"{resolver}","raw_span":"{span}"}}'


@expected("source BIGINT, target BIGINT, indicator VARCHAR, confidence DOUBLE, weight DOUBLE, evidence VARCHAR", [
    (1, 9, None, 1.0, 1.0, _json("Rv.123456", None, "rv_exact", "Rv. 123456 (0)")), (2, 9, "CONFIRMS", 1.0, 1.0, _json("Rv.123456", "CONFIRMS", "rv_exact", "Rv. 123456")),
    (2, 9, "OVERRULES", 1.0, 1.0, _json("Rv.123456", "OVERRULES", "rv_exact", "Rv. 123456")), (3, 9, None, 1.0, 1.0, _json("Rv.123456 (raw: 0123456)", None, "rv_exact", "Rv. 0123456")),
    (4, 9, "OVERRULES", 0.9, 0.99, _json("Sez.U/n.12345/2020", "OVERRULES", "sez_num_anno", "x" * 100)), (5, 8, "DISTINGUISHES", 0.9, 0.77, _json("n.123/2020", "DISTINGUISHES", "num_anno", "n. 123 del 2020")),
])
def fixture_edges(spark, sf):
    return ex.dedupe(spark.createDataFrame(EDGES, RESOLVED))


WEIGHTS = [("rv_exact", None, 1.0), ("rv_raw", None, 0.95), ("rv_text_fallback", None, 0.85), ("sez_num_anno", None, 0.9), ("sez_num_anno", "OVERRULES", 0.99), ("sez_num_anno_raw", "CONFIRMS", 0.85), ("num_anno", "DISTINGUISHES", 0.77), ("num_anno", None, 0.7), ("rv_exact", "OVERRULES", 1.0)]


@expected("i BIGINT, weight DOUBLE", [(i, w) for i, (_, _, w) in enumerate(WEIGHTS)])
def fixture_weights(spark, sf):
    rows = spark.createDataFrame([(i, r, a) for i, (r, a, _) in enumerate(WEIGHTS)], "i long, r string, a string")
    return rows.select("i", ex.mention_weight(F.col("r"), F.col("a")).alias("weight"))


_C = "tipo VARCHAR, raw_text VARCHAR, articolo VARCHAR, comma VARCHAR, lettera VARCHAR, codice VARCHAR, legge VARCHAR, atto_ue VARCHAR, autorita VARCHAR, sezione VARCHAR, numero VARCHAR, anno INTEGER"
CITED = [
    ("artt. 2043, 2059 c.c.", ("norma", "artt. 2043, 2059 c.c.", "2043, 2059", None, None, "c.c.", None, None, None, None, None, None)),
    ("l'art. 1 comma 2 lett. b cod. proc. civ.", ("norma", "art. 1 comma 2 lett. b cod. proc. civ.", "1", "2", "b", "c.p.c.", None, None, None, None, None, None)),
    ("art. 5 disp. att. c.p.c.", ("norma", "art. 5 disp. att. c.p.c.", "5", None, None, "disp. att. c.p.c.", None, None, None, None, None, None)),
    ("art. 3 della l. 241/1990", ("norma", "art. 3 della l. 241/1990", "3", None, None, None, "l. 241/1990", None, None, None, None, None)),
    ("Reg. (UE) n. 2016/679", ("regolamento_ue", "Reg. (UE) n. 2016/679", None, None, None, None, None, "2016/679", None, None, None, None)),
    ("la direttiva 93/13", ("direttiva_ue", "direttiva 93/13", None, None, None, None, None, "93/13", None, None, None, None)),
    ("Cass. civ., Sez. 3, n. 12345/2020", ("pronuncia", "Cass. civ., Sez. 3, n. 12345/2020", None, None, None, None, None, None, "Cassazione", "3", "12345", 2020)),
    ("Cassazione Sezioni Unite n. 500 del 22/07/1999", ("pronuncia", "Cassazione Sezioni Unite n. 500 del 22/07/1999", None, None, None, None, None, None, "Cassazione", "Unite", "500", 1999)),
    ("Corte Cost. sent. n. 10 del 2015", ("pronuncia", "Corte Cost. sent. n. 10 del 2015", None, None, None, None, None, None, "Corte Costituzionale", None, "10", 2015)),
    ("Cons. Stato, Sez. IV, n. 123/2019", ("pronuncia", "Cons. Stato, Sez. IV, n. 123/2019", None, None, None, None, None, None, "Consiglio di Stato", "IV", "123", 2019)), ("Cons. Stato Sez. IV, n. 123/2019", ("pronuncia", "Cons. Stato Sez. IV, n. 123/2019", None, None, None, None, None, None, "Consiglio di Stato", "IV", "123", 2019)),
    ("CGUE causa C-26/62 1963", ("pronuncia", "CGUE causa C-26/62 1963", None, None, None, None, None, None, "CGUE", None, "26/62", 1963)), ("la Cassazione ha detto", None), (None, None),
]


@expected(f"id BIGINT, {_C}", [(i, *c) for i, (_, c) in enumerate(CITED) if c])
def fixture_citations(spark, sf):
    return ex.citations(texts(spark, [t for t, _ in CITED]))


FORMS = [
    ("L’Avv. “Rossi”  ＡＢＣ ﬁne", 'l\'avv. "rossi" abc fine'), ("C o n t r a t t o  d i  v e n d i t a", "contratto di vendita"), ("Il contratto\tdi\nvendita immobiliare", "il contratto di vendita immobiliare"), ("A B", "a b"), ("", ""), (None, None),
]


@expected("id BIGINT, normal VARCHAR", [(i, n) for i, (_, n) in enumerate(FORMS)])
def fixture_normalize_v2(spark, sf):
    return texts(spark, [t for t, _ in FORMS]).select("id", tx.normalize_v2(F.col("text")).alias("normal"))


SCANS = [("Testo buono\n12\n-----\naaaaaa bbb ...... fine", "Testo buono\naa bbb .. fine"), ("....\n  7  \n_ _\nsolo", "_ _\nsolo"), ("1234\n12345", "12345"), ("", ""), (None, None)]


@expected("id BIGINT, clean VARCHAR", [(i, n) for i, (_, n) in enumerate(SCANS)])
def fixture_clean_ocr(spark, sf):
    return texts(spark, [t for t, _ in SCANS]).select("id", tx.clean_ocr(F.col("text")).alias("clean"))


#: A text of words only, 7 characters each; one of two paragraphs and sentences of 27; one of two articles.
RUNS = ["breve", "parola " * 300, ("Frase di prova numero uno. " * 30 + "\n\n") * 4, "Art. 1. " + "testo dell'articolo primo " * 40 + "\nArt. 2. " + "testo del secondo " * 60]
SPANS = {
    "generic": [[(0, 5)], [(0, 2000), (1850, 2100)], [(0, 810), (660, 1622), (1472, 2434), (2284, 3246)], [(0, 7), (0, 1053), (903, 1056), (906, 2137)]],
    "legal": [[(0, 5)], [(0, 1000), (850, 1850), (1700, 2100)], [(0, 920), (770, 1678), (1528, 2434), (2284, 3248)], [(0, 1049), (899, 1899), (1749, 2137)]],
    "backward": [[(0, 5)], [(0, 1099), (949, 2044), (1894, 2100)], [(0, 1082), (932, 2029), (1879, 2976), (2826, 3248)], [(0, 1057), (907, 2003), (1853, 2137)]],
    "paragraphs": [[(0, 5)], [(0, 2000), (1800, 2100)], [(0, 1624), (1424, 3248)], [(0, 1057), (857, 2137)]],
}


def _chunk_case(name: str, chunker: str):
    def query(spark, sf):
        return chunk.chunk(texts(spark, [*RUNS, "", " \n", None]), getattr(chunk, chunker)).select("id", "chunk_no", "char_start", "char_end", "text")

    query.__name__ = name
    rows = [(i, n, s, e, RUNS[i][s:e]) for i, spans in enumerate(SPANS[chunker]) for n, (s, e) in enumerate(spans)]
    expected("id BIGINT, chunk_no INTEGER, char_start INTEGER, char_end INTEGER, text VARCHAR", rows)(query)


for _name, _chunker in {"fixture_chunk_generic": "generic", "fixture_chunk_legal": "legal", "fixture_chunk_sql": "backward", "fixture_chunk_para_sentence": "paragraphs"}.items():
    _chunk_case(_name, _chunker)

CUTS = [("x" * 400, None), ("Una frase lunga. " * 40, (306, 0.791, "sentence")), ("a, b; " * 120, (306, 0.491, "clause")), (("parola " * 45).strip() + "\n\n" + "coda " * 40, (316, 0.976, "paragraph")), ("breve", None)]


@expected("id BIGINT, cut INTEGER, score DOUBLE, kind VARCHAR", [(i, *c) for i, (_, c) in enumerate(CUTS) if c])
def fixture_cut_propose(spark, sf):
    return quality.best_cuts(texts(spark, [t for t, _ in CUTS]), 300, 500)


@expected("id BIGINT, ratio DOUBLE", [(1, 0.75), (2, 0.0), (3, 1.0), (4, 0.8)])
def fixture_sequence_ratio(spark, sf):
    return quality.run_ratios(spark.createDataFrame([(1, "a b c d", "a b x d"), (2, "uno due", "tre"), (3, "x y", "x y"), (4, "a b", "a b c")], "id long, ta string, tb string"))


SAID = "Il danno va provato. Cfr. art. 5 c.c. e Sez. Un. n. 3. Così anche Rv. 639966. La prova è libera! Segue altro. Fine."


@expected("id BIGINT, n INTEGER, sentence VARCHAR", [(0, i, s) for i, s in enumerate(["Il danno va provato.", "Cfr. art. 5 c.c. e Sez. Un. n. 3.", "Così anche Rv. 639966.", "La prova è libera!", "Segue altro.", "Fine."])])
def fixture_sentences(spark, sf):
    return quality.sentences(texts(spark, [SAID, None]))


@expected("id BIGINT, n INTEGER, w VARCHAR", [(0, 2, "Il danno va provato. Cfr. art. 5 c.c. e Sez. Un. n. 3. Così anche Rv. 639966. La prova è libera!")])
def fixture_windows(spark, sf):
    return quality.windows(quality.sentences(texts(spark, [SAID, None]))).withColumnRenamed("window", "w")
