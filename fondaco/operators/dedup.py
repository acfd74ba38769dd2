"""Exact and near duplicates by stored keys and fingerprints, and alignment of two text collections."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fondaco.functions import similarity as sim, text as tx
from fondaco.session import discard, materialise, release, tasks_of


def exact(rows: DataFrame, key: str, digest: Column) -> DataFrame:
    """(key, kept): each row with the smallest key of its content; a null digest stands alone."""
    told = rows.select(key, digest.alias("_d"))
    first = told.where("_d is not null").groupBy("_d").agg(F.min(key).alias("kept"))
    return told.join(first, "_d", "left").select(key, F.coalesce("kept", key).alias("kept"))


def fingerprint_pairs(rows: DataFrame, key: str, fingerprint: str, most: int) -> DataFrame:
    """(a, b, distance): pairs of fingerprints that differ in at most ``most`` bits.

    The bits are cut in bands, half as many as ``most`` + 1; two such fingerprints differ in at most one bit of one band at least. So
    one side of each band meets the other as it is and with each of its bits turned, and bands are wide enough to be rare. Equal
    fingerprints are one class, named by its smallest key, so copies cost nothing; the pairs are between classes.
    """
    bands = (most + 2) // 2
    classes = rows.where(F.col(fingerprint).isNotNull()).groupBy(fingerprint).agg(F.min(key).alias("_k"))
    start = lambda i: f"cast({i} * 64 div {bands} as int)"
    mask = f"shiftleft(1L, {start('(i + 1)')} - {start('i')}) - 1" if bands > 1 else "-1L"
    banded = lambda df: df.withColumn("v", F.expr(f"shiftrightunsigned(g, {start('i')}) & ({mask})"))
    exact = banded(classes.select("_k", F.col(fingerprint).alias("_f"), F.col(fingerprint).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("i")))
    turned = classes.select("_k", F.col(fingerprint).alias("_f"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))
    turned = banded(turned.select("_k", "_f", F.expr("_f ^ shiftleft(1L, j)").alias("g"), F.expr(f"cast(((j + 1) * {bands} - 1) div 64 as int)").alias("i")))
    near = exact.unionByName(turned).select(F.col("_k").alias("_k2"), F.col("_f").alias("_f2"), "i", "v")
    of_band = lambda i: F.expr(f"bit_count(shiftrightunsigned(_f ^ _f2, {start(i)}) & (shiftleft(1L, {start(f'({i} + 1)')} - {start(i)}) - 1))")
    first = reduce(and_, [(F.col("i") <= j) | (of_band(str(j)) > 1) for j in range(bands - 1)], F.lit(True))
    found = exact.select("_k", "_f", "i", "v").join(near.hint("merge"), ["i", "v"]).where("_k < _k2").withColumn("distance", sim.hamming(F.col("_f"), F.col("_f2"))).where(F.col("distance") <= most)
    return found.where(first).select(F.col("_k").alias("a"), F.col("_k2").alias("b"), "distance")


#: Prefix tokens that candidates of an alignment share; prefixes are longer by one less.
AGREE = 4


#: Rows of the two sides in a block of an alignment.
LEFT_BLOCK, RIGHT_BLOCK = 4_000, 10_000


def _ordered(sets: DataFrame) -> DataFrame:
    """(side, id, t) of (side, id, t): the tokens of each as numbers, rarest first over all sets."""
    spread = sets.select("side", "id", F.explode("t").alias("token"))
    counts = spread.groupBy("token").agg(F.count("*").alias("c"))
    ordered = spread.join(counts.hint("merge"), "token").groupBy("side", "id").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("o"))
    return ordered.select("side", "id", F.transform("o", lambda x: F.xxhash64(x["token"])).alias("t"))


def _aligner(tokens_at: float, grams_at: float):
    """Of a block of each side, (id, target, kind, score): the best candidate of each left row by words (kind 0), and by trigrams (1) if that is below ``tokens_at``.

    Candidates may have Jaccard similarity ``tokens_at``: two such sets share AGREE tokens among the first n - ceil(tokens_at * n) +
    AGREE of each, rarest first over all sets, or as many as the smaller one must share at all; and neither is smaller than
    ``tokens_at`` times the other. Shared tokens are counted, so scores are exact.
    """
    bits, pack, agree = sim.trigram_bits, sim.packed, AGREE

    def half_up(shared: np.ndarray, union: np.ndarray) -> np.ndarray:  # at six decimals, as Spark rounds
        return (2_000_000 * shared + union) // (2 * union)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, targets = left.column("id").to_numpy(), right.column("id").to_numpy()
            nl, nr = len(ids), len(targets)
            lists = [t.column("t").combine_chunks() for t in (left, right)]
            n = np.concatenate([x.value_lengths().to_numpy() for x in lists]).astype(np.int64)
            least = np.ceil(n * tokens_at - 1e-9).astype(np.int64)
            kinds, code = np.unique(np.concatenate([x.flatten().to_numpy() for x in lists]), return_inverse=True)
            often = np.argsort(-np.bincount(code, minlength=len(kinds)), kind="stable")  # common words stand together
            place = np.empty(len(kinds), np.int64)
            place[often] = np.arange(len(kinds))
            code, row, starts = place[code], np.repeat(np.arange(nl + nr), n), np.concatenate([[0], np.cumsum(n)])
            first = np.arange(len(code)) - starts[row] < (n - least + agree)[row]  # the prefixes
            words = pack(row, code, nl + nr, len(kinds))
            mine, theirs = words[:nl], np.ascontiguousarray(words[nl:].T)
            held = first & (row >= nl)
            order = np.argsort(code[held], kind="stable")
            posted, ends = (row[held] - nl)[order], np.concatenate([[0], np.cumsum(np.bincount(code[held], minlength=len(kinds)))])
            grams = bits(left.column("text").to_pylist() + right.column("text").to_pylist())
            many = np.bitwise_count(grams).sum(1, dtype=np.int64)
            need = np.minimum(agree, least)
            for i in range(nl):
                asked = code[starts[i] : starts[i + 1]][first[starts[i] : starts[i + 1]]]
                met = np.bincount(np.concatenate([posted[ends[c] : ends[c + 1]] for c in asked]), minlength=nr)
                near = np.flatnonzero(met >= np.minimum(need[nl:], need[i]))
                size = n[nl + near]
                near = near[np.minimum(size, n[i]) >= np.maximum(size, n[i]) * tokens_at - 1e-9]
                if not len(near):
                    continue
                shared = np.zeros(len(near), np.int64)
                for w in np.flatnonzero(mine[i]):
                    shared += np.bitwise_count(theirs[w][near] & mine[i, w])
                score = half_up(shared, n[i] + n[nl + near] - shared)
                best = score.max()
                out.append((ids[i], targets[near[score == best]].min(), 0, best / 1e6))
                if best / 1e6 >= tokens_at:
                    continue
                size = many[nl + near]
                near = near[np.minimum(size, many[i]) >= np.maximum(size, many[i]) * (grams_at - 1e-6)]
                top, whose = -1, 0
                for at in range(0, len(near), 4_096):
                    some = near[at : at + 4_096]
                    shared = np.bitwise_count(grams[nl + some] & grams[i]).sum(1, dtype=np.int64)
                    score = half_up(shared, many[i] + many[nl + some] - shared)
                    best = score.max()
                    at_best = targets[some[score == best]].min()
                    if best > top or best == top and at_best < whose:
                        top, whose = best, at_best
                if top / 1e6 >= grams_at:
                    out.append((ids[i], whose, 1, top / 1e6))
        columns = list(zip(*out)) or [[], [], [], []]
        kinds_of = [pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds_of)], names=["id", "target", "kind", "score"])

    return run


def align(left: DataFrame, right: DataFrame, tokens_at: float = 0.65, grams_at: float = 0.70, weak_at: float = 0.3) -> DataFrame:
    """(id, target, stage, score): the best match of every row of (id, text) in another (id, text), by stages.

    exact, equal after normalisation; tokens, Jaccard similarity of words; grams, of trigrams of characters; weak, the best
    words below; unmatched, with null target. Rows without an equal one meet on the rarest words of their texts, as many as
    any pair of ``tokens_at`` must share, so no such pair is lost; the later stages look at the same candidates. Ties go to the
    smaller target. Null and empty texts are unmatched. Equal texts of one side are one class while they are compared. Blocks of both
    sides meet in a grid of tasks that keep the best of each row, so candidates are not written.
    """
    hashed = lambda df: df.where("text is not null and trim(text) <> ''").select("id", "text", F.unhex(F.sha2(tx.normalize_for_hash(F.col("text")), 256)).alias("h"))
    a = materialise(hashed(left).select("id", "h", "text"), "left")
    first = lambda df: df.groupBy("h").agg(F.min("id").alias("id"), F.min_by("text", "id").alias("text"))
    words = F.array_distinct(tx.words(F.col("text"))).alias("t")
    classes = first(a)
    targets = materialise(first(hashed(right)).select("h", "id", "text", words), "targets")
    exact = classes.join(targets.select("h", F.col("id").alias("target")), "h").select("h", "target", F.lit("exact").alias("stage"), F.lit(1.0).alias("score"))
    rest = materialise(classes.join(targets.select("h"), "h", "left_anti").select("h", "id", "text", words), "rest")
    side = lambda df, n: df.where(F.size("t") > 0).select(F.lit(n).alias("side"), "id", "t")
    ordered = _ordered(side(rest, 0).unionByName(side(targets, 1)))
    spaced = lambda df, n: df.select(F.lit(n).alias("side"), "id", sim.spaced(F.col("text")).alias("text"))
    told = materialise(ordered.join(spaced(rest, 0).unionByName(spaced(targets, 1)).hint("merge"), ["side", "id"]), "told")
    nl, nr = (told.where(F.col("side") == n).count() for n in (0, 1))
    rb = max(1, math.ceil(nr / RIGHT_BLOCK))
    lb = max(1, math.ceil(nl / LEFT_BLOCK), math.ceil(tasks_of(told.sparkSession) / rb))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    x = told.where("side = 0").select("id", "t", "text", block(lb).alias("lb"), cells(rb).alias("rb"))
    y = told.where("side = 1").select("id", "t", "text", block(rb).alias("rb"), cells(lb).alias("lb"))
    met = x.groupBy("lb", "rb").cogroup(y.groupBy("lb", "rb")).applyInArrow(_aligner(tokens_at, grams_at), "id long, target long, kind int, score double")
    met = materialise(met, "met")
    best = lambda df: df.groupBy("id").agg(F.max(F.struct("score", (-F.col("target")).alias("t"))).alias("b")).select("id", (-F.col("b.t")).alias("target"), "b.score")
    by_words = best(met.where("kind = 0")).withColumn("stage", F.when(F.col("score") >= tokens_at, "tokens").when(F.col("score") > weak_at, "weak"))
    by_grams = best(met.where("kind = 1"))
    by_grams = by_grams.select("id", F.struct("target", F.lit("grams").alias("stage"), "score").alias("g"))
    chosen = by_words.select("id", F.struct("target", "stage", "score").alias("w")).join(by_grams, "id", "left")
    chosen = chosen.select("id", F.when(F.col("w.stage") == "tokens", F.col("w")).otherwise(F.coalesce("g", "w")).alias("m")).where("m.stage is not null").select("id", "m.*")
    of_class = exact.unionByName(chosen.join(rest.select("id", "h"), "id").select("h", "target", "stage", "score"))
    found = a.select("id", "h").join(of_class, "h").select("id", "target", "stage", "score")
    return left.select("id").join(found, "id", "left").select("id", "target", F.coalesce("stage", F.lit("unmatched")).alias("stage"), F.coalesce("score", F.lit(0.0)).alias("score"))


def overlap_kind(same: Column, similarity: Column) -> Column:
    """exact, format_diff (> 0.95), content_diff (> 0.80), else mismatch."""
    return F.when(same, "exact").when(similarity > 0.95, "format_diff").when(similarity > 0.80, "content_diff").otherwise("mismatch")


def jaccard_pairs(rows: DataFrame, key: str, tokens: Column, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of different token sets with Jaccard similarity of ``threshold`` or more; a and b are the smallest keys of their sets.

    Equal sets are one class. Sets meet on pairs of tokens of their prefix, rarest first, of which any such pair of sets must share one;
    a set that may share a single token only meets its like on single ones. What met is verified once, on the tokens as they are. Joins
    never broadcast: the sets are far larger than the files that Spark would judge them by.
    """
    sets = rows.select(F.col(key).alias("_k"), F.array_sort(F.array_distinct(tokens)).alias("_t")).where(F.size("_t") > 0)
    classes = materialise(sets.groupBy("_t").agg(F.min("_k").alias("_k")).select("_k", "_t"), "sets")
    release(rows.sparkSession)  # shuffle files of each step go before the next
    # Tokens travel as numbers; two that fall on one number only add a candidate.
    spread = classes.select("_k", F.size("_t").alias("_n"), F.explode(F.transform("_t", lambda w: F.xxhash64(w))).alias("_w"))
    counts = spread.groupBy("_w").agg(F.count("*").alias("_c"))
    # The prefix of each set, gathered again: as long as the set, whatever the corpus.
    ordered = spread.join(counts.hint("merge"), "_w").groupBy("_k", "_n").agg(F.array_sort(F.collect_list(F.struct("_c", "_w"))).alias("_o"))
    least = F.ceil(F.col("_n") * threshold - 1e-9).cast("int")
    prefix = F.filter(F.slice("_o", F.lit(1), (F.col("_n") - least + 2).cast("int")), lambda x: x["_c"] > 1)
    told = materialise(ordered.select("_k", "_n", least.alias("_least"), F.transform(prefix, lambda x: x["_w"]).alias("_p")), "prefixes")
    release(rows.sparkSession)
    twos = F.flatten(F.transform("_p", lambda x, i: F.transform(F.slice("_p", i + 2, F.size("_p")), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))
    met = F.concat(twos, F.when(F.col("_least") < 2, F.col("_p")).otherwise(F.array().cast("array<long>")))
    left = told.select("_k", "_n", F.explode(met).alias("_w"))
    right = left.select(F.col("_k").alias("_k2"), F.col("_n").alias("_n2"), "_w")
    near = left.join(right.hint("merge"), "_w").where("_k < _k2").where(F.least("_n", "_n2") >= F.greatest("_n", "_n2") * threshold - 1e-9).select("_k", "_k2").distinct()
    near = materialise(near, "near")
    discard(told)
    release(rows.sparkSession)
    other = classes.select(F.col("_k").alias("_k2"), F.col("_t").alias("_t2"))
    told = near.join(classes.hint("merge"), "_k").join(other.hint("merge"), "_k2").withColumn("similarity", sim.jaccard(F.col("_t"), F.col("_t2")))
    return told.where(F.col("similarity") >= threshold - 1e-12).select(F.col("_k").alias("a"), F.col("_k2").alias("b"), F.round("similarity", 6).alias("similarity"))
