"""Pairs of sets, texts and fingerprints at size: what is met, sent and broadcast, and that the pairs are those of brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fondaco.functions import similarity as sim, text as tx
from fondaco.operators import dedup as dd, retrieval as ret


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def no_broadcast_by_size(spark):
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shingles_take_their_words_once(spark):
    rows = spark.createDataFrame([(1, "a b c d a b c"), (2, "a"), (3, None)], "id long, text string").repartition(1)
    got = rows.select("id", tx.words(F.col("text")).alias("w")).select("id", F.array_sort(sim.shingles(F.col("w"), 3)).alias("s")).where("size(s) > 0")
    assert [tuple(r) for r in got.collect()] == [(1, ["a b c", "b c d", "c d a", "d a b"])]
    assert plan(got).count("split(") <= 2  # in the filter and in the column; not for every run


def _sets():
    draw = random.Random(7)
    sets = [[f"w{draw.randrange(60)}" for _ in range(draw.randrange(1, 30))] for _ in range(60)]
    for s in list(sets):
        sets += [[*s, f"x{draw.randrange(9)}"], s[1:] or ["y"], [f"z{draw.randrange(3)}"]]
    return sets


@pytest.mark.parametrize("threshold", [0.85, 0.5, 0.3])
def test_jaccard_pairs_equal_brute_force(spark, threshold):
    rows = [(i, s) for i, s in enumerate(_sets())]
    got = dd.jaccard_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", F.col("t"), threshold)
    first = {}
    for i, s in rows:
        first.setdefault(frozenset(s), i)
    want = {(i, j, round(len(a & b) / len(a | b), 6)) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) / len(a | b) >= threshold - 1e-12}
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == sorted(want)


def test_jaccard_pairs_never_broadcast_the_sets(spark, no_broadcast_by_size):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    got = dd.jaccard_pairs(spark.createDataFrame([(i, s) for i, s in enumerate(_sets())], "id long, t array<string>"), "id", F.col("t"), 0.85)
    assert got.count() > 20 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_pairs_are_told_once_without_another_shuffle(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(63) for _ in range(20)]
    prints = [f ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(12))}) for f in base for _ in range(8)]
    prints = [f - (1 << 64) if f >> 63 else f for f in prints]
    got = dd.fingerprint_pairs(spark.createDataFrame(list(enumerate(prints)), "id long, f long"), "id", "f", 9)
    first = {}
    for i, f in enumerate(prints):
        first.setdefault(f, i)
    far = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {(i, j, far(a, b)) for a, i in first.items() for b, j in first.items() if i < j and far(a, b) <= 9}
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == sorted(want)
    assert plan(got).splitlines()[0].startswith("Project")  # no distinct over the pairs


def _trigrams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def test_trigram_bits_are_the_trigrams():
    texts = ["", "  ab   c ", "  a ", "  città   àb𝄞 ", "  ab   c   ab "]
    bits = sim.trigram_bits(texts)
    sets = [{t[i : i + 3] for i in range(len(t) - 2) if t[i + 1 : i + 3] != "  "} for t in texts]
    shared = lambda a, b: sum(int(x & y).bit_count() for x, y in zip(bits[a], bits[b]))
    assert all(shared(i, j) == len(sets[i] & sets[j]) for i in range(5) for j in range(5))


def test_trigram_search_compares_texts_and_writes_no_pairs(spark):
    draw = random.Random(5)
    names = [" ".join(draw.choice(["Atto", "attore", "rilevanza", "L'onere", "città", "di"]) for _ in range(draw.randrange(4))) for _ in range(30)] + [None, "-"]
    docs = [(i, draw.choice(names)) for i in range(400)]
    asked = [(i, t) for i, t in docs if i % 9 == 0]
    got = ret.trgm_search(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "id long, text string"), 20, 0.3)
    want = []
    for q, t in asked:
        a = _trigrams(t or "")
        found = [(-round(len(a & b) / len(a | b), 6), i) for i, d in docs if (b := _trigrams(d or "")) and a & b]
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(x for x in found if -x[0] >= 0.3)[:20])]
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == sorted(want)
    assert "array_intersect" not in plan(got)


def test_align_in_small_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dd, "LEFT_BLOCK", 15), monkeypatch.setattr(dd, "RIGHT_BLOCK", 20)
    draw = random.Random(11)
    vocabulary = [a + b for a in ("contr", "dan", "tut", "reg", "leg", "pol") for b in ("atto", "no", "ore", "istro", "ato", "izza", "o", "i")]
    right = [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 25))) for _ in range(70)]

    def edited(text):
        words = text.split()
        for _ in range(draw.randrange(len(words))):
            k = draw.randrange(len(words))
            words[k] = draw.choice([draw.choice(vocabulary), words[k] + "e", words[k][:-1] or "a"])
        return " ".join(words)

    left = [edited(draw.choice(right)) for _ in range(90)] + [right[0].upper() + "!", None, "  "]
    frame = lambda rows: spark.createDataFrame([(i + 100, t) for i, t in enumerate(rows)], "id long, text string")
    got = {r.id: (r.target, r.stage, r.score) for r in dd.align(frame(left), frame(right)).collect()}
    normal = lambda t: " ".join("".join(c for c in t.lower() if c.isalnum() or c == " ").split())
    kept = {}
    for i, t in enumerate(right):
        kept.setdefault(normal(t), (i + 100, t.lower()))
    sides = [{normal(t): t.lower() for t in left if t and t.strip() and normal(t) not in kept}, {k: t for k, (_, t) in kept.items()}]
    counts = {}
    for side in sides:
        for t in side.values():
            for w in set(t.split()):
                counts[w] = counts.get(w, 0) + 1
    least = lambda n: math.ceil(n * 0.65 - 1e-9)
    prefix = lambda w: set(sorted(w, key=lambda x: (counts[x], x))[: len(w) - least(len(w)) + dd.AGREE])
    alike = lambda a, b: round(len(a & b) / len(a | b), 6)
    for i, t in enumerate(left):
        want = (None, "unmatched", 0.0)
        if t and t.strip() and normal(t) in kept:
            want = (kept[normal(t)][0], "exact", 1.0)
        elif t and t.strip():
            a, near = set(t.split()), []
            for k, b in kept.values():
                b = set(b.split())
                if min(len(a), len(b)) >= max(len(a), len(b)) * 0.65 - 1e-9 and len(prefix(a) & prefix(b)) >= min(dd.AGREE, least(min(len(a), len(b)))):
                    near.append(k)
            by = lambda f: max(((alike(f(t.lower()), f(next(x for y, x in kept.values() if y == k))), -k) for k in near), default=(0.0, 0))
            (w, wk), (g, gk) = by(lambda x: set(x.split())), by(_trigrams)
            want = (-wk, "tokens", w) if w >= 0.65 else (-gk, "grams", g) if g >= 0.7 else (-wk, "weak", w) if w > 0.3 else want
        assert got[i + 100] == want, (t, want)
    assert {"exact", "tokens", "grams", "weak", "unmatched"} <= {s for _, s, _ in got.values()}


def test_matched_texts_are_never_broadcast(spark, no_broadcast_by_size):
    from fondaco.plans import quality

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    for told in (quality.aligned(spark, "/root/testdata/sf0.001"), quality.sequence_ratio(spark, "/root/testdata/sf0.001")):
        within = None
        for line in told._jdf.queryExecution().executedPlan().toString().splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            within = within if within is not None and depth > within else depth if "BroadcastExchange" in line else None
            assert within is None or "testo" not in line


@pytest.mark.parametrize("all_terms", [False, True])
def test_bm25_adds_weights_in_blocks_and_writes_no_shared_rows(spark, all_terms):
    draw = random.Random(2)
    vocabulary = ["contratto", "danno", "tutore", "legato", "polizza", "onere", "rendita"]
    docs = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 9)))) for i in range(120)]
    asked = [(i, " ".join(draw.sample(vocabulary, 1 + i % 3))) for i in range(12)] + [(99, "assente"), (98, None)]
    got = ret.bm25_search(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "id long, text string"), 7, all_terms=all_terms)
    words = {i: t.split() for i, t in docs}
    average = sum(map(len, words.values())) / len(docs)
    want = []
    for q, t in asked:
        terms, scores = set((t or "").split()), []
        for i, w in words.items():
            held = [x for x in terms if x in w]
            if held and (not all_terms or len(held) == len(terms)):
                df = {x: sum(x in v for v in words.values()) for x in held}
                scores.append((-round(sum(math.log(1 + (len(docs) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / average)) for x in held), 6), i))
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:7])]
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == sorted(want)
    assert "FlatMapCoGroupsInArrow" in plan(got)


def test_dense_search_sends_vectors_as_they_are_stored(spark):
    rows = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", [1.0, 1.0]), (3, "m", [0.0, -1.0])], "id long, part string, vec array<float>")
    got = ret.dense_search(rows.where("id < 3").withColumnRenamed("id", "query_id"), rows)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1.0, 1), (1, 2, 0.707107, 2), (2, 1, 0.707107, 2), (2, 2, 1.0, 1)]
    assert "array<double>" not in plan(got)
