"""The operators of the subpackage on small fixtures: brute force, round trips, and the cases their docstrings define."""

import math
import os
import random
import re
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fondaco.llm import consensus, counts, linkage, nearest, neardup, packing, residue, scans, tokens

VOCAB = f"{tokens.TOKENIZERS}/byte_bpe_50k.json"
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")
T0 = datetime(2025, 1, 1)

# Names that the operators use inside, as extra columns of their inputs.
CLASH = {"key": "k", "rec": 1, "label": "x", "n": 2, "votes": 3, "vec": 4, "cid": 5, "class": "c", "part": 6, "words": "w", "host": "h"}


def clash(df, *skip):
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items() if k not in df.columns and k not in skip])


# Consensus

VOTES = "id long, massima_id long, model_a string, model_a_label string, model_b string, model_b_label string, judge_model string, judge_label string, created_at timestamp_ntz"
FIELDS = [("model_a", "model_a_label"), ("model_b", "model_b_label"), ("judge_model", "judge_label")]


def agree(spark, rows):
    items, models = consensus.consensus(clash(spark.createDataFrame(rows, VOTES)), "massima_id", "id", "created_at", FIELDS)
    return {r["item"]: r for r in items.collect()}, {r["annotator"]: r["competence"] for r in models.collect()}


def test_consensus_follows_the_competent_and_knows_the_spammer(spark):
    random.seed(3)
    rows, truth = [], {}
    for i in range(300):
        truth[i] = random.choice(consensus.LABELS[:3])
        good = lambda p, i=i: truth[i] if random.random() < p else random.choice(consensus.LABELS)
        rows.append((i, i, "buono", good(0.95), "spam", "CIVILE", "medio", good(0.7), T0))
    items, models = agree(spark, rows)
    assert models["buono"] > models["medio"] > models["spam"] or models["buono"] > 0.85
    assert sum(items[i]["label"] == truth[i] for i in truth) >= 270


def test_consensus_spellings_nulls_repeats_and_ties(spark):
    rows = [
        (1, 1, "a", " Civile.", "b", "CIVILE", None, None, T0), (1, 1, "a", " Civile.", "b", "CIVILE", None, None, T0),
        (2, 2, "a", "N/D", "b", None, "j", "", T0), (3, 3, "a", "diritto del lavoro", "b", "PEN", None, "CRISI", T0), (4, None, "a", "CIVILE", "b", "CIVILE", None, None, T0),
    ]
    items, _ = agree(spark, rows)
    assert set(items) == {1, 3}
    assert items[1]["label"] == "CIVILE" and items[1]["agreement"] == 1.0 and items[1]["n_labels"] == 1
    assert items[3]["n_labels"] == 2 and items[3]["agreement"] == 0.0
    assert agree(spark, []) == ({}, {})


def test_consensus_is_the_same_with_parameters_as_a_table(spark, monkeypatch):
    rnd = random.Random(4)
    label = lambda: rnd.choice(consensus.LABELS[:4])
    rows = [(i, i // 2, rnd.choice("ab"), label(), "c", label(), "d", label(), T0) for i in range(60)]
    df = spark.createDataFrame(rows, VOTES)
    here = [consensus.consensus(df, "massima_id", "id", "created_at", FIELDS, rounds=6)]
    monkeypatch.setattr(consensus, "DRIVER_ANNOTATORS", 2)
    here.append(consensus.consensus(df, "massima_id", "id", "created_at", FIELDS, rounds=6))
    items = [{r["item"]: (r["label"], round(r["confidence"], 6), r["n_labels"]) for r in x[0].collect()} for x in here]
    models = [{r["annotator"]: (round(r["competence"], 6), r["votes"]) for r in x[1].collect()} for x in here]
    assert items[0] == items[1] and models[0] == models[1] and len(items[0]) == 30


# Near duplicates


def brute(texts, threshold, width):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    out = set()
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if c / (len(sets[i]) + len(sets[j]) - c) >= threshold - 1e-12:
                    out.add((i, j))
    return out


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"p{k}" for k in range(60)]
    texts = []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(rnd.randint(5, 60))] if not texts or rnd.random() < 0.5 else rnd.choice(texts)[1].split()
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append((i, " ".join(t)))
    return texts


@pytest.mark.parametrize("threshold, width", [(0.6, 3), (0.8, 5)])
def test_near_pairs_against_all_pairs(spark, threshold, width):
    texts = corpus(150, width) + [(900, None), (901, ""), (902, "una due"), (903, "Uno, due; TRE quattro cinque sei."), (904, "uno due tre quattro cinque sei")]
    rows = clash(spark.createDataFrame(texts, "id long, text string"))
    got = [(r["id_a"], r["id_b"]) for r in neardup.near_pairs(rows, "id", "text", threshold=threshold, width=width).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, threshold, width)


def test_near_pairs_of_hot_tokens_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 20)
    monkeypatch.setattr(neardup, "PAIRS_AT_ONCE", 50)
    base = [f"w{k}" for k in range(40)]
    rnd = random.Random(5)
    texts = [(i, " ".join(base[: rnd.randint(30, 40)] + [f"x{i}"])) for i in range(70)]
    rows = spark.createDataFrame(texts, "id long, text string")
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_pairs(rows, "id", "text", threshold=0.6, width=3).collect()}
    assert got == brute(texts, 0.6, 3)


@pytest.mark.parametrize("cells", [16, 1 << 12])
def test_near_pairs_whatever_the_table_and_the_copies(spark, monkeypatch, cells):
    monkeypatch.setattr(neardup, "cells_for", lambda keys: cells)
    monkeypatch.setattr(neardup, "HOT", 20)
    monkeypatch.setattr(neardup, "COPIES", 3)
    texts = corpus(90, 31)
    texts += [(200 + i, texts[3][1]) for i in range(8)] + [(300 + i, texts[3][1] + " coda") for i in range(4)]
    got = [(r["id_a"], r["id_b"]) for r in neardup.near_pairs(spark.createDataFrame(texts, "id long, text string"), "id", "text", threshold=0.6, width=3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, 0.6, 3)


def test_groups_join_chains_and_keep_copies_together(spark):
    a = " ".join(f"w{k}" for k in range(60))
    b, c = a.replace("w0 ", "y0 "), a.replace("w0 ", "y0 ").replace("w59", "y59")
    rows = spark.createDataFrame([(5, a), (3, a), (9, b), (7, c), (8, "altro testo del tutto diverso da quelli di prima")], "id long, text string")
    got = {r["id"]: (r["group_id"], r["links"]) for r in neardup.near_groups(rows, "id", "text", threshold=0.9, width=3).collect()}
    assert {got[i][0] for i in (5, 3, 9, 7)} == {3} and got[8] == (8, 0)
    assert neardup.near_groups(rows.where("false"), "id", "text").count() == 0


def test_long_text_is_compared_whole(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = spark.createDataFrame([(1, long), (2, long + " coda"), (3, long.replace("w2", "v2"))], "id long, text string")
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_pairs(rows, "id", "text", threshold=0.8, width=5).collect()}
    assert got == {(1, 2)}


# Scans


def page(lines):
    return "\n".join(lines)


WORDS = "il contratto di locazione conserva efficacia durante la fase esecutiva salvo che il creditore dimostri la responsabilità tecnico-scientifica della società".split()


def scanned():
    """A clean corpus of one sentence in many orders, and noisy records."""
    rnd = random.Random(2)
    clean = []
    for i in range(200):
        w = WORDS[:]
        k = rnd.randrange(len(w))
        clean.append((i, " ".join(w[k:] + w[:k]) + "."))
    return clean


def test_repair_joins_corrects_and_drops_furniture(spark):
    noisy = [
        (1000, page(["il contratto di loca-", "zione conserva cfficacia durante la fase", "    RASSEGNA GENERALE | 12", "", "esecut1va salvo che il creditore dimostri la responsa¬", "- 13 -", "bilità tecnico-", "scientifica della soeietà."])),
        (1001, "il contrattto di lcoazione conserva efficacia"), (1002, None), (1003, "  \n "), (1004, ""),
    ]
    rows = clash(spark.createDataFrame(scanned() + noisy + noisy[:1], "id long, testo string"))
    found = {(r["id"], r["kind"], r["item"]) for r in scans.findings(rows, "id", "testo").where("id >= 1000").collect()}
    assert found == {
        (1000, "parola", w) for w in ("locazione", "efficacia", "esecutiva", "responsabilità", "tecnico-scientifica", "società")
    } | {(1000, "riga", "RASSEGNA GENERALE | 12"), (1000, "riga", "- 13 -")}
    text = {r["id"]: r["text"] for r in scans.repair(rows, "id", "testo").collect()}
    assert text[1000] == "il contratto di locazione conserva efficacia durante la fase esecutiva salvo che il creditore dimostri la responsabilità tecnico-scientifica della società."
    assert text[1001] == noisy[1][1] and text[1002] == text[1003] == text[1004] == ""


@pytest.mark.parametrize("chars, parts", [(300, 1), (300, 7), (10**9, 3)])
def test_repair_does_not_depend_on_the_split(spark, monkeypatch, chars, parts):
    monkeypatch.setattr(scans, "CHARS_A_PART", chars)
    noisy = [(1000 + 2048 * i, page(["la rcsponsabilità della", "RASSEGNA GENERALE", "", f"fase cseeutiva del contra-", "tto di locazionc"])) for i in range(3)]  # noqa: F541
    rows = spark.createDataFrame(scanned() + noisy, "id long, testo string").repartition(parts)
    found = {(r["id"], r["kind"], r["item"]) for r in scans.findings(rows, "id", "testo").collect()}
    want = {("parola", w) for w in ("responsabilità", "esecutiva", "contratto", "locazione")} | {("riga", "RASSEGNA GENERALE")}
    assert found == {(1000 + 2048 * i, *w) for i in range(3) for w in want}


def test_joins_foresee_every_joined_word():
    assert {"tecnico-scientifica", "scientifica", "respon-sabile"} <= scans.joins(["tecnico-scien-", "3", "", "tifica respon-", "RASSEGNA", "sabile"])
    assert {"responsabile", "respon"} <= scans.joins(["re-", "spon-", "sabile"])


def test_findings_of_an_empty_table(spark):
    assert scans.findings(spark.createDataFrame([], "id long, testo string"), "id", "testo").count() == 0


def test_misreading_paths():
    assert scans.misreading("cfficacia", "efficacia") == pytest.approx(math.log(0.14))
    assert scans.misreading("rnotivo", "motivo") is not None and scans.misreading("omtivo", "motivo") is None
    for seen, true, _ in scans.CONFUSIONS:
        if true != "0":
            assert scans.fold("a" + seen) == scans.fold("a" + true)


# Linkage


def test_linkage_by_place_heading_and_text(spark):
    rnd = random.Random(7)
    words = [f"parola{k}" for k in range(400)]
    body = lambda: " ".join(rnd.choice(words) for _ in range(60)) + "."
    acts = spark.createDataFrame([(1, "CPOR", "Codice dei porti", "Cod. porti", ["c.p."], "26", T0.date()), (2, "CPES", "Codice dei pesi", "Cod. pesi", ["c.p."], "518", T0.date())],
        "id long, code string, nome_completo string, nome_breve string, abbreviazioni array<string>, atto_numero string, atto_data date")
    right = [(100 + i, 1 + i % 2, str(i // 2 + 1), f"Oggetto {i}", body()) for i in range(40)]
    text = {r[0]: r[4] for r in right}
    left = [
        (1, "CPOR", "Art. 1", "Oggetto 0", text[100]), (2, "c.p.", "l0", None, text[118][:200]), (3, "", "", None, text[125]), (4, "Cod. pesi", "3.", "oggetto 5", body()),
        (5, "CPOR", "4", "Altro del tutto", body()), (6, None, None, None, None), (7, "CPOR", "Art. 1", "Oggetto 0", text[100]), (None, "CPOR", "1", "Oggetto 0", text[100]),
    ]
    l = clash(spark.createDataFrame(left, "id long, codice string, articolo string, rubrica string, testo string"))  # noqa: E741
    r = clash(spark.createDataFrame(right, "id long, work_id long, articolo string, rubrica string, testo string"))
    got = {x["left_id"]: x["right_id"] for x in linkage.link(l, r, acts).collect()}
    assert got == {1: 100, 2: 118, 3: 125, 4: 105, 7: 100}
    assert linkage.link(l.where("false"), r, acts).count() == 0 and linkage.link(l, r.where("false"), acts).count() == 0


def test_linkage_of_hot_copies_hot_keys_and_short_texts(spark):
    rnd = random.Random(11)
    body = lambda n: " ".join(f"parola{rnd.randrange(5000)}" for _ in range(n))
    acts = spark.createDataFrame([(1, "CPOR", "Codice dei porti", "Cod. porti", ["c.p."], "26", T0.date())],
        "id long, code string, nome_completo string, nome_breve string, abbreviazioni array<string>, atto_numero string, atto_data date")
    copied, short = body(60), [body(5) for _ in range(12)]
    right = [(100 + i, 1, "1", "Oggetto primo", copied) for i in range(70)] + [(300 + i, 1, "2", f"Titolo {'abcdefgh'[i % 8]} {'ilmnopqr'[i // 8]} proprio{i}", None) for i in range(60)]
    right += [(500 + i, 1, str(10 + i), f"Voce{i}", t) for i, t in enumerate(short)]
    left = [(1, "CPOR", "1", "Oggetto primo", copied), (2, "CPOR", "2", "Titolo c l proprio10 corretto", None)] + [(10 + i, None, None, None, t) for i, t in enumerate(short)]
    l = spark.createDataFrame(left, "id long, codice string, articolo string, rubrica string, testo string")  # noqa: E741
    r = spark.createDataFrame(right, "id long, work_id long, articolo string, rubrica string, testo string")
    got = {x["left_id"]: x["right_id"] for x in linkage.link(l, r, acts, 0.0).collect()}
    sure = {x["left_id"] for x in linkage.link(l.where("id <> 2"), r, acts).collect()}
    assert sure == {1, *range(10, 22)}
    assert got == {1: 100, 2: 310} | {10 + i: 500 + i for i in range(12)}


@pytest.mark.parametrize("shrink, pairs", [(1, 100_000), (64, 7), (1024, 100_000)])
def test_linkage_by_text_alone_whatever_the_table_and_the_blocks(spark, monkeypatch, shrink, pairs):
    monkeypatch.setattr(linkage, "PAIRS_A_TASK", pairs)
    usual = linkage.cells_for
    monkeypatch.setattr(linkage, "cells_for", lambda keys: max(16, usual(keys) // (64 * shrink)))
    rnd = random.Random(13)
    phrases = [" ".join(f"voce{rnd.randrange(300)}" for _ in range(6)) for _ in range(40)]
    body = lambda: " ".join(rnd.choice([rnd.choice(phrases), " ".join(f"parola{rnd.randrange(900)}" for _ in range(6))]) for _ in range(12))
    right = [(100 + i, None, None, None, body()) for i in range(300)]
    left = [(i, None, None, None, " ".join(w if rnd.random() > 0.05 else "xx" for w in right[i][4].split()[: rnd.randint(40, 80)])) for i in range(300)]
    left += [(600 + i, "CPOR", None, f"Titolo {i}", left[0][4]) for i in range(30)]  # one text under many headings
    left += [(400, None, None, None, ""), (401, None, None, None, "  "), (402, None, None, None, "due parole")]
    acts = spark.createDataFrame([], "id long, code string, nome_completo string, nome_breve string, abbreviazioni array<string>, atto_numero string, atto_data date")
    l = spark.createDataFrame(left, "id long, codice string, articolo string, rubrica string, testo string")  # noqa: E741
    r = spark.createDataFrame(right + [(500, None, None, None, "")], "id long, work_id long, articolo string, rubrica string, testo string")
    got = {x["left_id"]: x["right_id"] for x in linkage.link(l, r, acts).collect()}
    assert got == {i: 100 + i for i in range(300)} | {600 + i: 100 for i in range(30)}


def test_blank_text_is_unknown(spark):
    acts = spark.createDataFrame([(1, "CPOR", "Codice dei porti", "Cod. porti", ["c.p."], "26", T0.date())],
        "id long, code string, nome_completo string, nome_breve string, abbreviazioni array<string>, atto_numero string, atto_data date")
    right = [(100 + i, 1, str(i), f"Oggetto {i}", None) for i in range(1, 4)]
    confidences = []
    for blank in (None, "", " \n"):
        left = [(i, "CPOR", str(i), f"oggetto {i}" if i != 2 else "cosa diversa", blank) for i in range(1, 4)]
        l = spark.createDataFrame(left, "id long, codice string, articolo string, rubrica string, testo string")  # noqa: E741
        r = spark.createDataFrame(right, "id long, work_id long, articolo string, rubrica string, testo string")
        confidences.append({(x["left_id"], x["right_id"]): round(x["confidence"], 6) for x in linkage.link(l, r, acts, 0.0).collect()})
    assert confidences[0] == confidences[1] == confidences[2] and {(1, 101), (3, 103)} <= set(confidences[0])


def test_text_blocks_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(linkage, "COMMON", 3)
    rnd = random.Random(17)
    texts = [(i, " ".join(f"p{rnd.randrange(4)}" for _ in range(rnd.randint(3, 40)))) for i in range(60)]
    sides = [spark.createDataFrame(t, "id long, text string").mapInArrow(linkage._grams, "id long, grams binary").cache() for t in (texts[:30], texts[30:] + [(90, texts[0][1]), (91, texts[1][1] + " p1 p2 p3")])]
    table = counts.hashed_counts(sides[0].unionByName(sides[1]).select("grams"), lambda b: [linkage._unpack(b.column("grams"))[0].astype(np.uint64)], 1 << 12)
    got = {(r["cid"], r["nid"]) for r in linkage._share_text(*sides, spark.sparkContext.broadcast(table), 1 << 12).collect()}
    sets = [{r["id"]: set(np.frombuffer(r["grams"], np.uint32).tolist()) for r in side.collect()} for side in sides]
    w = lambda keys: sum(1 / math.sqrt(max(int(table[k % 4096]), 1)) for k in keys)
    want = {(a, b) for a, x in sets[0].items() for b, y in sets[1].items() if x and y and w(x & y) >= linkage.BLOCK * min(w(x), w(y))}
    assert len(want) > 2 and want <= got


def test_linkage_leaves_little_on_disk_and_is_whole_in_any_slices(spark, monkeypatch):
    def shuffled():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p: p.stat().st_size for folder in folders for p in Path(folder.getPath()).rglob("shuffle_*.data")}

    rnd = random.Random(19)
    body = lambda: " ".join(f"v{rnd.randrange(12)}" for _ in range(60))
    right = [(100 + i, 1, str(i % 40), f"Oggetto {i % 7}", body()) for i in range(400)]
    left = [(i, "CPOR", str(i % 40) if i % 3 else None, None, " ".join(right[i][4].split()[:50])) for i in range(400)]
    acts = spark.createDataFrame([(1, "CPOR", "Codice dei porti", "Cod. porti", ["c.p."], "26", T0.date())],
        "id long, code string, nome_completo string, nome_breve string, abbreviazioni array<string>, atto_numero string, atto_data date")
    l = spark.createDataFrame(left, "id long, codice string, articolo string, rubrica string, testo string").repartition(2)  # noqa: E741
    r = spark.createDataFrame(right, "id long, work_id long, articolo string, rubrica string, testo string").repartition(3)
    found = lambda: {(x["left_id"], x["right_id"], round(x["confidence"], 6)) for x in linkage.link(l, r, acts, 0.0).collect()}
    before = set(shuffled())
    linked = linkage.link(l, r, acts, 0.0)
    kept = sum(size for p, size in shuffled().items() if p not in before)
    assert kept < 2 * sum(len(x[4]) for x in left + right)
    want = {(x["left_id"], x["right_id"], round(x["confidence"], 6)) for x in linked.collect()}
    assert {x[:2] for x in want} == {(i, 100 + i) for i in range(400)}
    monkeypatch.setattr(linkage, "SLICE", 40_000)
    monkeypatch.setattr(linkage, "MEETS", 500)
    assert found() == want


def test_solver_keeps_values_exclusive_and_rows_of_one_text_together():
    left, right = np.array([1, 1, 2, 2]), np.array([10, 11, 10, 11])
    pull = np.array([3.0, 3.0, 3.0, 0.0])
    z = linkage.solve(left, right, np.array([7, 7, 7, 7]), [(pull, -1, np.ones(4)), (np.full(4, 0.1), 1, np.zeros(4))], 5.0, 400)
    assert z[0] + z[1] <= 1.02 and z[2] + z[3] <= 1.02
    assert z[0] > z[1] and z[2] > z[3]  # the second row, of the same text, decides for the first


@pytest.mark.parametrize("raw, want", [("Art. 32", "32"), ("131BIS", "131-bis"), ("Articolo 9 - quater", "9-quater"), ("l26", "126"), ("1O9", "109"), ("§ 7", "7"), ("", None)])
def test_article_keys(spark, raw, want):
    assert spark.range(1).select(linkage.article_key(F.lit(raw))).first()[0] == want


# Nearest vectors

VECTORS = "id long, model string, dims int, embedding array<float>"


def test_nearest_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST_SIZE", 40)
    monkeypatch.setattr(nearest, "BLOCK", 60)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(25, 16))
    x = (centers[rng.integers(25, size=500)] + 0.15 * rng.normal(size=(500, 16))).astype(np.float32)
    x[100:108] = x[99]  # copies
    rows = [(i, "m", 16, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, "m", 16, None), (901, "m", 16, [0.0] * 16), (902, "m", 16, [float("nan")] * 16), (903, "m", 16, [1.0] * 8), (904, None, 16, [1.0] * 16), (905, "solo", 2, [1.0, 2.0]), rows[5]]
    got = [(r["id_a"], r["id_b"]) for r in nearest.nearest_pairs(clash(spark.createDataFrame(rows, VECTORS)), "id", "model", "dims", "embedding", 5, 0.85).collect()]
    n = x.astype(np.float64)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    cos = np.round(n @ n.T, 6)
    np.fill_diagonal(cos, -2)
    want = {(min(i, j), max(i, j)) for i in range(500) for j in np.argsort(-cos[i], kind="stable")[:5].tolist() if cos[i, j] >= 0.85}
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.97 * len(want)
    assert all((99, i) in set(got) for i in range(100, 105))
    assert nearest.nearest_pairs(spark.createDataFrame([], VECTORS), "id", "model", "dims", "embedding").count() == 0


def test_recall_of_every_fiftieth_row_against_all(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST_SIZE", 100)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(60, 24))
    x = (centers[rng.integers(60, size=6000)] + 0.35 * rng.normal(size=(6000, 24))).astype(np.float32)
    rows = spark.createDataFrame([(i, "m", 24, v.tolist()) for i, v in enumerate(x)], VECTORS)
    got = {(r["id"], r["near"]) for r in nearest.nearest(rows, "id", "model", "dims", "embedding", 5, 0.85).where("id % 50 = 0").collect()}
    n = x.astype(np.float64)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    cos = np.round(n[::50] @ n.T, 6)
    cos[np.arange(len(cos)), np.arange(0, 6000, 50)] = -2
    want = {(50 * q, j) for q in range(len(cos)) for j in np.argsort(-cos[q], kind="stable")[:5].tolist() if cos[q, j] >= 0.85}
    assert len(want) > 300 and len(got & want) >= 0.99 * len(want)


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    c = rng.normal(size=(300, 8)).astype(np.float32)
    q = rng.normal(size=(200, 8)).astype(np.float32)
    ids, dist = nearest.CentroidGraph(c).search(q, 4)
    exact = ((q[:, None] - c[None]) ** 2).sum(2).argsort(1)[:, :4]
    assert np.mean([len(set(a) & set(b)) / 4 for a, b in zip(ids.tolist(), exact.tolist())]) > 0.9
    assert (np.diff(dist, axis=1) >= 0).all()


# Tokens

TEXTS = ["", "Il contratto è nullo.", "  due  spazi\n\ne righe \t", "<|endoftext|> non è speciale", "aaaaaaaaaaaaaaaaaa", "naïve – “testo” 漢字 🙂", "x" * 20_000, "l'art. 1454-ter c.c. 12345678901234567890"]


@needs_vocab
def test_ids_equal_those_of_the_library(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(VOCAB)
    reference.encode_special_tokens = True
    rows = clash(spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None), (1, TEXTS[1])], "doc_id long, text string").withColumn("ids", F.lit(0)))
    got = tokens.encode(rows).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = reference.encode(TEXTS[r["doc_id"]], add_special_tokens=False).ids if r["doc_id"] < 99 else []
        assert r["ids"] == want


@needs_vocab
def test_ids_round_trip(spark):
    import json

    vocab = {i: s for s, i in json.load(open(VOCAB, encoding="utf-8"))["model"]["vocab"].items()}
    to_byte = {s: b for b, s in enumerate(tokens.byte_symbols())}
    for text, ids in zip(TEXTS, tokens.MergeReplay(VOCAB).encode(TEXTS)):
        assert bytes(to_byte[c] for i in ids for c in vocab[i]).decode("utf-8") == text


@needs_vocab
def test_words_kept_between_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    replay = tokens.MergeReplay(VOCAB)
    first = replay.encode(["uno due tre quattro cinque"])
    assert not replay.kept and replay.encode(["uno due tre quattro cinque"]) == first


# Packing


def test_hilbert_neighbours_are_one_step_apart():
    bits = 4
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@needs_vocab
def test_containers_hold_each_token_once(spark):
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choice(["uno", "due", "contratto", "nullo"]) for _ in range(rnd.randint(1, 60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "parola " * 700), (903, docs[0][1])] + [(1000 + i, "sempre lo stesso testo") for i in range(150)]
    rows = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(rows).collect()}
    got = packing.containers(rows, "doc_id", "text", capacity=256).collect()
    room, pieces = {}, {}
    for r in got:
        if r["container"] is None:
            assert sizes[r["id"]] == 0
            continue
        room[r["container"]] = room.get(r["container"], 0) + r["n_tokens"]
        pieces.setdefault(r["id"], []).append((r["start"], r["n_tokens"]))
    assert max(room.values()) <= 256 and {r["id"] for r in got} == set(sizes)
    for i, p in pieces.items():
        p.sort()
        assert [s for s, _ in p] == list(np.cumsum([0, *[n for _, n in p[:-1]]])) and sum(n for _, n in p) == sizes[i]
        assert len(p) == math.ceil(sizes[i] / 256)
    assert sum(room.values()) >= 0.95 * 256 * (len(room) - 1)
    assert packing.containers(rows.where("false"), "doc_id", "text").count() == 0


# Residue

BAD = {
    "error": ["Errore 503 - Manutenzione programmata in corso.", "Testo valido.\nHTTP 401", '{"error": {"code": 503, "message": "x"}}', "404 Not Found", "<h1>Bad Gateway</h1><hr>nodo-3"],
    "script": ["Please enable JavaScript to continue.", "Per visualizzare questa pagina è necessario abilitare JavaScript nel browser."],
    "placeholder": ["La parte {{ nome }} chiede", "il ${importo} dovuto", "n. ____ del ____", "il <%= anno %> decreto", "la [INSERIRE parte] sua", "&Importo; dovuto", "## fine ##luogo##", "dal <Oggetto> del"],
    "filler": ["Lorem ipsum dolor sit amet consectetur adipiscing elit.", "xx xxxx xx xxx xxxxxx xx", "Frase uguale qui. Frase uguale qui. Frase uguale qui."],
}
GOOD = [
    "La pagina restituiva il messaggio «errore 404» e il bene era altrove.", "L'opposizione di terzo ex art. 404 c.p.c. presuppone il danno.", "Il portale imponeva di abilitare JavaScript per depositare l'istanza.",
    "L'insieme dei debitori {a, b, c} risponde in solido.", "La sigla <<omissis>> sostituisce la quota.", "Il signor A.B. (omissis) aveva ceduto alla società [...] la quota.", "Il tasso del 5 % annuo e l'importo di $ 1.200.",
    "Si dice «lorem ipsum dolor sit amet consectetur».", "Al capo XXX della sentenza.", "", "   \n ", None,
]


def test_residue_kinds(spark):
    bad = [(i, t, "h", k) for i, (k, t) in enumerate((k, t) for k, ts in BAD.items() for t in ts)]
    rows = [(i, t, h) for i, t, h, _ in bad] + [(1000 + i, t, None) for i, t in enumerate(GOOD)] + [(0, bad[0][1], "h")]
    got = {r["id"]: r["kinds"] for r in residue.residue(clash(spark.createDataFrame(rows, "doc_id long, text string, source string")), "doc_id", "text", "source").collect()}
    assert got == {i: [k] for i, _, _, k in bad}


def test_messages_of_wording_that_no_list_holds(spark):
    unseen = [
        "Your browser does not accept cookies from this domain.", "DNS lookup failed, proxy server not reachable", "La cache del browser va svuotata prima di un nuovo accesso.", "nginx/1.18 upstream timeout on backend 3",
        "Der Server antwortet nicht, bitte Login wiederholen", "Le serveur a refusé la connexion : SSL, gateway absent",
    ]
    fine = [
        "Il gestore del server risponde dei danni verso il cliente.", "La clausola relativa al login dell'utente è nulla se non approvata per iscritto.", "L'accesso alla pagina richiesta dal creditore non è disponibile al terzo.",
        "Il perito ha esaminato il server e il browser dell'imputato e ha riferito che la corrispondenza telematica tra le parti, durata per oltre tre anni, non conteneva alcun accenno al contratto di locazione.",
    ]
    rows = spark.createDataFrame([(i, f"Testo di diritto.\n{t}", "h") for i, t in enumerate(unseen + fine)], "doc_id long, text string, source string")
    got = {r["id"] for r in residue.residue(rows, "doc_id", "text", "source").collect()}
    assert not got & set(range(len(unseen), 100)) and len(got) >= 5  # recall 5 of 6 at full precision; the French one names its server otherwise


def test_boilerplate_of_a_host_is_no_evidence(spark):
    notice = "Please enable JavaScript to continue."
    rows = [(i, f"Testo numero {i} del sito.\n{notice}", "a") for i in range(60)] + [(100, f"Altro.\n{notice}", "b"), (101, f"Testo.\n{notice}\nil {{{{nome}}}} manca", "a")]
    got = {r["id"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    assert got == {100, 101}
    assert residue.residue(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", "text", "source").count() == 0


def test_copies_of_a_bad_page_stay_cases(spark):
    notice, schema = "Please enable JavaScript to continue.", "doc_id long, text string, source string"
    page = "Errore 404: pagina non trovata\nTorna alla pagina iniziale del sito oppure usa la ricerca.\n"
    slugs = ["".join(random.Random(i).choices("ghijklmnop", k=9)) for i in range(300)]
    good = [(i, f"Il testo {slugs[i]} della sentenza di merito.\n{notice}", "a") for i in range(60)]
    exact = [(1000 + i, page, "a") for i in range(30)]
    near = [(2000 + i, f"{page}{slugs[100 + i]}", "a") for i in range(30)]
    only = [(3000 + i, notice, "a") for i in range(5)]
    got = {r["id"] for r in residue.residue(spark.createDataFrame(good + exact + near + only, schema), "doc_id", "text", "source").collect()}
    assert got == {i for i, _, _ in exact + near + only}


def test_very_long_lines(spark):
    rows = [(1, "xx " * 100_000), (2, "lorem ipsum dolor " * 30_000), (3, "bozza " * 50_000), (4, "<p> " * 50_000), (5, "parola diversa " * 30_000), (6, "e" * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("h"))
    got = {r["id"] for r in residue.residue(df, "doc_id", "text", "source").collect()}
    assert {1, 2, 3} <= got and not {5, 6} & got
    texts = df.select(F.col("doc_id").alias("id"), F.concat(F.lit("INTESTAZIONE | 3\n"), "text").alias("testo"))
    assert {r["item"] for r in scans.findings(texts, "id", "testo").where("kind = 'riga'").collect()} == {"INTESTAZIONE | 3"}


# Counts


def test_hashed_counts_add_up_over_tasks(spark):
    rows = spark.range(0, 1000, 1, 5).select((F.col("id") % 7).alias("v"))
    table = counts.hashed_counts(rows, lambda b: [counts.mix(b.column("v").to_numpy().astype(np.uint64))], 1 << 12)
    assert table.sum() == 1000 and sorted(table[table > 0].tolist()) == [142] + [143] * 6
    for h in (0, 1, 2**63, 2**64 - 1):
        assert counts.mix_one(h) == int(counts.mix(np.array([h], np.uint64))[0])
