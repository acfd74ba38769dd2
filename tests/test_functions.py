"""Examples and properties of functions and operators on small fixtures."""

from datetime import date

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fondaco.functions import legal, similarity as sim, text as tx
from fondaco.operators import chunk, classify, dedup, evaluate, extract, graph, relational as rel, retrieval as ret
from fondaco.sources import articles
from fondaco.streaming import events


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


@pytest.mark.parametrize("raw, want", [("09337", "9337"), ("0000", "0"), ("", ""), (None, None)])
def test_numero(spark, raw, want):
    assert one(spark, legal.norm_numero(F.col("x").cast("string")), x=raw) == want


@pytest.mark.parametrize("raw, want", [("639966-01", "639966"), ("0639966", "639966"), ("12", "12"), (None, None)])
def test_rv(spark, raw, want):
    assert one(spark, legal.norm_rv(F.col("x").cast("string")), x=raw) == want


@pytest.mark.parametrize("raw, want", [("Un", "U"), ("Unite", "U"), ("U", "U"), ("Lav", "L"), ("6-1", "6-1")])
def test_sezione(spark, raw, want):
    assert one(spark, legal.norm_sezione(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [("2043", "002043.00"), ("Art. 2635-ter", "002635.03"), ("131 BIS", "000131.02"), ("Preleggi", "999999.99")])
def test_sort_key(spark, raw, want):
    assert one(spark, legal.article_sort_key(F.col("x")), x=raw) == want


def test_dates(spark):
    assert one(spark, legal.compact_date(F.col("x")), x="20200229") == date(2020, 2, 29)
    assert one(spark, legal.compact_date(F.col("x")), x="99999999") is None
    assert one(spark, legal.italian_date(F.col("x")), x="il 3/2/2019.") == date(2019, 2, 3)
    assert one(spark, legal.italian_date(F.col("x")), x="il 31/2/2019.") is None


def test_cleaning(spark):
    assert one(spark, tx.clean_legal_text(F.col("x")), x="compe-\ntenza  «x» .Segue") == 'competenza "x". Segue'
    assert one(spark, tx.clean_legal_text(F.col("x").cast("string")), x=None) == ""
    assert one(spark, tx.safe_despace(F.col("x")), x="c o r t e s u p r e m a d i c a s s a") == "cortesupremadicassa"
    assert one(spark, tx.clean_ocr(F.col("x")), x="aaaaa\n12\n----\nfine......") == "aa\nfine.."


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("abcàé ,.-", max_size=30), min_size=1, max_size=8))
def test_hash_form_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.normalize_for_hash(F.col("t")).alias("a"))
    assert df.where(F.col("a") != tx.normalize_for_hash(F.col("a"))).count() == 0


def test_similarities_are_symmetric_and_reflexive(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], 5, 6), ([], [], 0, None)], "x array<string>, y array<string>, f long, g long")
    got = df.select(sim.jaccard(F.col("x"), F.col("y")), sim.jaccard(F.col("y"), F.col("x")), sim.jaccard(F.col("x"), F.col("x")), sim.hamming(F.col("f"), F.col("g")), sim.hamming(F.col("f"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(1 / 3, 1 / 3, 1.0, 2, 0), (0.0, 0.0, 0.0, 64, 0)]


def test_mentions_and_attitudes(spark):
    text = "Conforme, Cass. Sez. Un., n. 01234/2020, Rv. 639966-01; in senso contrario Sez. 3, n. 55 del 2011 e art. 2043 c.c., d.lgs. 165/2001."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = {(r["kind"], r["rv"], r["sezione"], r["numero"], r["anno"]) for r in extract.mentions(df).collect()}
    assert ("rv", "639966", None, None, None) in got and ("sez_num_anno", None, "U", "1234", 2020) in got
    signs = {(r["kind"], r["indicator"]) for r in extract.mention_places(df).collect()}
    assert ("sez_num_anno", "CONFIRMS") in signs and ("num_anno", "OVERRULES") in signs
    assert {r["norm_id"] for r in extract.norms(df).collect()} == {"CC:2043", "DLGS:165:2001"}


def test_resolution_takes_the_first_level_and_no_self_reference(spark):
    keys = spark.createDataFrame([(10, "639966", "1", "7", 2020), (11, "111111", "2", "7", 2020)], "id long, rv string, sezione string, numero string, anno int")
    found = spark.createDataFrame([(1, "639966", "2", "7", 2020), (2, "999999", "2", "7", 2020), (10, "639966", None, None, None)], "id long, rv string, sezione string, numero string, anno int")
    got = {(r["id"], r["target"], r["resolver"]) for r in extract.resolve(found, keys).collect()}
    assert got == {(1, 10, "rv_exact"), (2, 11, "sez_num_anno")}


@pytest.mark.parametrize("text, want", [("Rv. 639966", "citation_rv"), ("Sez. Un., n. 12345/2020", "citation_sez_num_anno"), ("legge n. 206/2005", "norm"), ("n. 12345/2020", "citation_num_anno"), ("danno da mora", "semantic")])
def test_route(spark, text, want):
    assert one(spark, extract.route(F.col("x")), x=text) == want


@settings(max_examples=60, deadline=None)
@given(st.text("ab .,;\n", min_size=1, max_size=6000))
def test_chunks_cover_the_text(text):
    for spans_of in (chunk.fixed, chunk.generic, chunk.legal, chunk.backward, chunk.paragraphs):
        if not text.strip():
            continue
        at = 0
        for start, end in spans_of(text):
            assert 0 <= start < end <= len(text)
            assert not text[at:start].strip()
            at = max(at, end)
        assert not text[at:].strip()


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "x" * 2500), (2, None), (3, " ")], "id long, text string")
    rows = chunk.chunk(df, chunk.generic).collect()
    assert {r["id"] for r in rows} == {1} and all(len(r["text"]) == r["char_end"] - r["char_start"] for r in rows)


def test_scd2_applied_twice_is_applied_once(spark):
    target = spark.createDataFrame([(1, "a", date(2020, 1, 1), None), (2, "b", date(2020, 1, 1), None)], "id long, digest string, valid_from date, valid_to date")
    feed = spark.createDataFrame([(2, "c"), (3, "d")], "id long, digest string")
    day = F.lit("2021-01-01").cast("date")
    once = rel.scd2_merge(target, feed, "id", "digest", "valid_from", "valid_to", day)
    twice = rel.scd2_merge(once, feed, "id", "digest", "valid_from", "valid_to", day)
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(once) == rows(twice) and once.count() == 4


def test_upserts(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string")
    assert sorted(map(tuple, rel.upsert(a, b, ["id"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, rel.insert_ignore(a, b, ["id"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]


def test_range_join_by_buckets(spark):
    points = spark.createDataFrame([(1, 5), (1, 10), (1, 199), (2, 5)], "k int, p int")
    ranges = spark.createDataFrame([(1, 0, 10), (1, 150, 260)], "k int, s int, e int")
    got = sorted((r["p"], r["s"]) for r in rel.in_range(points, ranges, ["k"], "p", "s", "e", 100).collect())
    assert got == [(5, 0), (10, 0), (199, 150)]


def test_rrf_ignores_the_order_of_lists(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    x, y = ([tuple(r) for r in ret.rrf(lists, 10).orderBy("rank").collect()] for lists in ([a, b], [b, a]))
    assert x == y and x[0][1] == 11


def test_dense_search_against_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, "m", [float(c) for c in x]) for i, x in enumerate(v)], "id long, part string, vec array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in ret.dense_search(rows.where("id < 5").withColumnRenamed("id", "query_id"), rows, 3, -1.0).collect()}
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(5):
        assert [got[q, r] for r in (1, 2, 3)] == np.argsort(-np.round(n[q] @ n.T, 6), kind="stable")[:3].tolist()


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "query_id long, id long, rank int")
    truth = spark.createDataFrame([(1, 8), (2, 5), (3, 1)], "query_id long, id long")
    got = {r["query_id"]: r for r in evaluate.ranking_metrics(ranked, truth, 10).collect()}
    assert (got[1]["recall"], got[1]["mrr"], got[1]["noise"]) == (1.0, 0.5, 0.5)
    assert (got[2]["recall"], got[3]["recall"], got[3]["ndcg"]) == (0.0, 0.0, 0.0)


def test_graph_expansion(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (3, 1, 1.0), (2, 4, 0.1)], "source long, target long, weight double")
    seeds = spark.createDataFrame([(1,)], "id long")
    assert sorted((r["node"], r["depth"]) for r in graph.neighbors(seeds, edges, 2, 0.4).collect()) == [(2, 1), (3, 2)]
    paths = spark.createDataFrame([(i, ["a", "b", str(i)]) for i in range(8)] + [(9, ["z"])], "id long, path array<string>")
    assert [r["sibling"] for r in graph.siblings(seeds, paths).orderBy("sibling").collect()] == [0, 2, 3, 4, 5]


def test_fingerprint_pairs_against_all_pairs(spark):
    import random

    random.seed(4)
    base = [random.getrandbits(63) for _ in range(20)]
    values = base + [b ^ (1 << random.randrange(60)) ^ (1 << random.randrange(60)) for b in base] + [base[0]]
    rows = spark.createDataFrame(list(enumerate(values)) + [(99, None)], "id long, f long")
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(min(i, j), max(i, j)) for v, i in first.items() for w, j in first.items() if i < j and bin(v ^ w).count("1") <= 9}
    assert {(r["a"], r["b"]) for r in dedup.fingerprint_pairs(rows, "id", "f", 9).collect()} == want


def test_calibration_interpolates(spark):
    assert one(spark, classify.calibrate(F.col("x"), [0.5714, 0.9, 0.92], [0.7573, 0.7573, 1.0]), x=0.91) == pytest.approx(0.87865)
    rows = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1)], "s double, y int")
    xs, ys = classify.isotonic_fit(rows, "s", "y")
    assert ys == sorted(ys) and len(xs) == len(ys)


def test_sources_read_back_what_was_written(spark):
    md = "# Libro I Delle cose\n## Titolo II\n\n**Art. 5-bis.** Oggetto\nTesto uno.\nRiga due.\n\nArt. 6 Altro\nFine."
    df = spark.createDataFrame([("f", md)], "name string, content string")
    got = [(r["articolo"], r["rubrica"], r["testo"], r["libro"], r["titolo"]) for r in articles.markdown_articles(df).orderBy("articolo").collect()]
    assert got == [("5-bis", "Oggetto", "Testo uno.\nRiga due.", "I", "II"), ("6", "Altro", "Fine.", "I", "II")]
    assert articles.html_text("<nav>menu</nav><main><p>a&nbsp;b</p><script>x</script><p>c</p></main>") == "a b\nc"


def test_circuit_breaker(spark):
    from datetime import datetime, timedelta

    t = datetime(2025, 1, 1)
    kinds = ["error"] * 3 + ["view", "view", "view"]
    at = [0, 1, 2, 3, 400, 401]
    rows = spark.createDataFrame([(i, 1, t + timedelta(seconds=s), k) for i, (s, k) in enumerate(zip(at, kinds))], "event_id long, user_id long, ts timestamp_ntz, event_type string")
    got = [r["state"] for r in events.circuit_breaker(rows).orderBy("event_id").collect()]
    assert got == ["closed", "closed", "closed", "open", "half_open", "closed"]
