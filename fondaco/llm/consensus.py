"""Consensus from the labels of several annotators: a competence-and-spamming mixture fitted by expectation-maximisation.

Each label is either truthful (with the annotator's competence as probability) or drawn from the annotator's own guess
distribution. EM alternates between the posterior of each item's true label and the annotators' competences and guesses.

Items with the same multiset of votes have the same posterior, so the fit runs over distinct vote patterns with their number
of items, not over items. A vote that recurs on an item is a count, so a pattern has at most annotators x labels entries,
whatever the number of votes on a hot item. A round is one pass over the written patterns with the annotators' parameters at
hand; it shuffles one row of sums for each annotator and task, and posteriors are computed where an item's votes lie, so no
pattern that many items share is joined. Beyond ``DRIVER_ANNOTATORS`` annotators the parameters are a table that votes join.

Defined results: rows delivered twice under one id count once, the one created last holding; null items, null annotators and
values that name none of the labels are no votes; items without a vote have no consensus; ties go to the label listed first;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from fondaco.session import materialise

# The labels, and the prefixes by which a spelling names one.
LABELS = ["CIVILE", "PENALE", "LAVORO", "TRIBUTARIO", "AMMINISTRATIVO", "CRISI"]
PREFIXES = ["civ", "pen", "lav", "trib", "amm", "crisi"]
#: Up to so many annotators their parameters (some 60 bytes each) travel with the tasks.
DRIVER_ANNOTATORS = 10_000
#: Rounds end when no competence moves by TOLERANCE; at MOST_ROUNDS with a warning.
TOLERANCE, MOST_ROUNDS = 1e-4, 200


def label_index(raw: Column) -> Column:
    """Position in LABELS of the label a spelling names, else null."""
    words = F.regexp_extract(F.lower(raw), r"^[^\p{L}]*(?:(?:diritto|dir|materia)[^\p{L}]+)?(?:(?:del|della|dell|di)[^\p{L}]+)?(\p{L}+)", 1)
    found = F.when(F.lit(False), F.lit(0))
    for i, p in enumerate(PREFIXES):
        found = found.when(words.startswith(p), F.lit(i))
    return found


def votes_of(rows: DataFrame, item: str, row_id: str, created: str, fields: list[tuple[str, str]]) -> DataFrame:
    """(item, annotator, label, k): k votes of an annotator for a label, from pairs of annotator and label columns."""
    kept = [c for pair in fields for c in pair]
    last = (
        rows.where(F.col(row_id).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(row_id).alias("_id")).agg(F.max(F.struct(F.col(created).alias("_created"), F.col(item).alias("_item"), *[F.col(c).alias(f"_f{i}") for i, c in enumerate(kept)])).alias("r"))
    )
    cast = F.array(*[F.struct(F.col(f"r._f{2 * i}").alias("annotator"), label_index(F.col(f"r._f{2 * i + 1}")).alias("label")) for i in range(len(fields))])
    return (
        last.select(F.col("r._item").alias("item"), F.explode(cast).alias("v")).select("item", "v.annotator", "v.label")
        .where("annotator is not null and label is not null")
        .groupBy("item", "annotator", "label").agg(F.count("*").alias("k"))
    )


def patterns_of(votes: DataFrame) -> DataFrame:
    """(item, pattern, votes): the votes of an item, sorted, and their hash."""
    listed = votes.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", "label", "k"))).alias("votes"))
    return listed.select("item", F.sha2(F.to_json("votes"), 256).alias("pattern"), "votes")


class Parameters:
    """Competence and guesses of the annotators, in the order of ``names``, and the distribution of the labels."""

    def __init__(self, names: list[str]):
        t = len(LABELS)
        self.names, self.votes = names, np.zeros(len(names), np.int64)
        self.competence, self.guess, self.prior = np.full(len(names), 0.7), np.full((len(names), t), 1 / t), np.full(t, 1 / t)

    def posterior(self, votes: pa.Array) -> tuple[np.ndarray, ...]:
        """(q, row, who, label, k): the posterior of each list of votes, and the votes."""
        t, n = len(LABELS), len(votes)
        row = np.repeat(np.arange(n), pc.list_value_length(votes).to_numpy(zero_copy_only=False).astype(np.int64))
        flat = votes.flatten()
        who = pc.index_in(flat.field("annotator"), pa.array(self.names, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        label, k = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "k"))
        c, g = self.competence[who], self.guess[who, label]
        guessed = np.log((1 - c) * g)
        score = np.bincount(row * t + label, k * (np.log(c + (1 - c) * g) - guessed), n * t).reshape(n, t)
        score += np.bincount(row, k * guessed, n)[:, None] + np.log(self.prior)
        q = np.exp(score - score.max(1, keepdims=True)) if n else score
        return q / q.sum(1, keepdims=True), row, who, label, k

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sufficient statistics of a task: for each annotator the votes, the truthful ones and the guesses by label; under -1 the items by label."""
        t, a = len(LABELS), len(self.names)
        votes, true, spam, items = np.zeros(a), np.zeros(a), np.zeros(a * t), np.zeros(t)
        for batch in batches:
            q, row, who, label, k = self.posterior(batch.column("votes"))
            n = batch.column("n").to_numpy()
            c, g = self.competence[who], self.guess[who, label]
            w, right = n[row] * k, q[row, label] * c / (c + (1 - c) * g)
            votes += np.bincount(who, w, a)
            true += np.bincount(who, w * right, a)
            spam += np.bincount(who * t + label, w * (1 - right), a * t)
            items += n @ q
        seen = np.flatnonzero(votes)
        table = np.vstack([np.r_[items.sum(), 0, items], np.c_[votes, true, spam.reshape(a, t)][seen]])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen]), *[pa.array(x) for x in table.T]], names=["who", *STATISTICS])

    def refit(self, sums: dict[int, np.ndarray], smooth: float) -> float:
        """Takes the sums of a round in; gives the largest move of a competence."""
        before = self.competence.copy()
        for who, (votes, true, *spam) in sums.items():
            spam = np.array(spam)
            if who < 0:
                self.prior = (spam + 1) / (votes + len(LABELS))
            else:
                self.votes[who], self.competence[who], self.guess[who] = round(votes), (true + 1) / (votes + 2), (spam + smooth) / (spam.sum() + smooth * len(LABELS))
        return float(np.abs(self.competence - before).max(initial=0))


STATISTICS = ["votes", "true", *[f"s{t}" for t in range(len(LABELS))]]


def fit_in_tasks(patterns: DataFrame, names: list[str], rounds: int = MOST_ROUNDS, smooth: float = 0.1, tolerance: float = TOLERANCE) -> Parameters:
    """The parameters after EM over (n, votes), each round one aggregation of the tasks' sums."""
    params = Parameters(names)
    schema = "who long, " + ", ".join(f"{c} double" for c in STATISTICS)
    for _ in range(rounds):
        sums = patterns.select("n", "votes").mapInArrow(params.sums, schema).groupBy("who").agg(*[F.sum(c).alias(c) for c in STATISTICS])
        if params.refit({r["who"]: np.array([r[c] for c in STATISTICS]) for r in sums.collect()}, smooth) < tolerance:  # a row for each annotator
            return params
    warnings.warn(f"a competence still moved by {tolerance} after {rounds} rounds", stacklevel=2)
    return params


def _labelled(params: Parameters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = params.posterior(batch.column("votes"))[0]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("votes"), pa.array(list(q), pa.list_(pa.float64()))], names=["item", "votes", "posterior"])

    return run


def _hold(params: DataFrame) -> DataFrame:
    """The parameters of a round, cut from what made them."""
    return materialise(params, "params")


def fit_by_join(patterns: DataFrame, rounds: int = MOST_ROUNDS, smooth: float = 0.1, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """The same fit with the parameters as a table: (pattern, posterior array) and (annotator, competence, guess array, votes).

    The row with null annotator holds the distribution of the labels themselves. ``smooth`` is added to each guess count,
    one to each count of truthful and guessed votes.
    """
    n_labels = len(LABELS)
    each = F.explode("votes").alias("v")
    flat = patterns.select("pattern", "n", each).select("pattern", "n", "v.*")
    annotators = flat.groupBy("annotator").agg(F.sum(F.col("n") * F.col("k")).alias("votes"))
    uniform = F.array(*[F.lit(1.0 / n_labels)] * n_labels)
    params = annotators.select("annotator", F.lit(0.7).alias("competence"), uniform.alias("guess"), "votes")
    prior = patterns.sparkSession.range(1).select(F.lit(None).cast("string").alias("annotator"), F.lit(1.0).alias("competence"), uniform.alias("guess"), F.lit(0).cast("long").alias("votes"))
    params = _hold(params.unionByName(prior))

    def posterior(params):
        own = params.where("annotator is not null").withColumnRenamed("votes", "_votes")
        told = flat.join(own, "annotator").withColumn("_g", F.col("guess")[F.col("label")])
        likely = [F.sum(F.col("k") * F.log(F.col("competence") * (F.col("label") == t).cast("double") + (1 - F.col("competence")) * F.col("_g"))) for t in range(n_labels)]
        told = told.groupBy("pattern", "n").agg(F.array(*likely).alias("_l"), F.collect_list(F.struct("annotator", "label", "k", "competence", F.col("_g").alias("g"))).alias("votes"))
        shares = params.where("annotator is null").select(F.col("guess").alias("_prior"))  # one row
        scores = F.zip_with("_l", "_prior", lambda a, b: a + F.log(b))
        told = told.join(F.broadcast(shares)).withColumn("_s", scores)
        told = told.withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.array_max("_s"))))
        total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
        return told.withColumn("_t", total).select("pattern", "n", "votes", F.transform("_e", lambda x: x / F.col("_t")).alias("q"))

    for _ in range(rounds):
        q = posterior(params)
        right = F.col("q")[F.col("v.label")] * F.col("v.competence") / (F.col("v.competence") + (1 - F.col("v.competence")) * F.col("v.g"))
        voted = q.select("n", "q", F.explode("votes").alias("v")).select(
            F.col("v.annotator").alias("annotator"), (F.col("n") * F.col("v.k")).alias("w"), right.alias("r"), F.col("v.label").alias("label")
        )
        stats = voted.groupBy("annotator").agg(
            F.sum("w").alias("votes"), F.sum(F.col("w") * F.col("r")).alias("true"),
            F.array(*[F.sum(F.when(F.col("label") == t, F.col("w") * (1 - F.col("r"))).otherwise(0.0)) for t in range(n_labels)]).alias("spam"),
        )
        spam = F.aggregate("spam", F.lit(0.0), lambda a, x: a + x)
        fitted = stats.withColumn("_spam", spam).select(
            "annotator", ((F.col("true") + 1) / (F.col("votes") + 2)).alias("competence"),
            F.transform("spam", lambda x: (x + smooth) / (F.col("_spam") + smooth * n_labels)).alias("guess"), F.col("votes").cast("long").alias("votes"),
        )
        items = q.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col("q")[t]).alias(f"q{t}") for t in range(n_labels)])
        shares = items.where("n is not null").select(
            F.lit(None).cast("string").alias("annotator"), F.lit(1.0).alias("competence"),
            F.array(*[(F.col(f"q{t}") + 1) / (F.col("n") + n_labels) for t in range(n_labels)]).alias("guess"), F.lit(0).cast("long").alias("votes"),
        )
        before, params = params, _hold(fitted.unionByName(shares))
        moved = before.select("annotator", F.col("competence").alias("_c")).join(params, "annotator").agg(F.max(F.abs(F.col("competence") - F.col("_c"))).alias("m")).first()["m"]
        if (moved or 0.0) < tolerance:
            break
    return posterior(params).select("pattern", F.col("q").alias("posterior")), params


def consensus(rows: DataFrame, item: str, row_id: str, created: str, fields: list[tuple[str, str]], rounds: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Consensus per item and reliability per annotator.

    (item, label, confidence, agreement, n_labels): agreement is the share of pairs of votes on the item that agree (1 for a
    single vote), n_labels the number of different labels voted. (annotator, competence, votes).
    """
    spark = rows.sparkSession
    listed = materialise(patterns_of(votes_of(rows, item, row_id, created, fields)), "votes")
    patterns = materialise(listed.groupBy("pattern").agg(F.count("*").alias("n"), F.first("votes").alias("votes")), "patterns")
    names = patterns.select(F.explode("votes.annotator").alias("a")).distinct()
    if names.limit(DRIVER_ANNOTATORS + 1).count() <= DRIVER_ANNOTATORS:
        params = fit_in_tasks(patterns, sorted(r["a"] for r in names.collect()), rounds)
        told = listed.select("item", "votes").mapInArrow(_labelled(params), f"item {listed.schema['item'].dataType.simpleString()}, votes array<struct<annotator string, label int, k long>>, posterior array<double>")
        table = [(n, float(c), int(v)) for n, c, v in zip(params.names, params.competence, params.votes)]
        reliability = spark.createDataFrame(table, "annotator string, competence double, votes long")
    else:
        posterior, params = fit_by_join(patterns, rounds)
        told = listed.join(posterior, "pattern").select("item", "votes", "posterior")
        reliability = params.where("annotator is not null").select("annotator", "competence", "votes")
    total = F.aggregate("votes", F.lit(0).cast("long"), lambda a, v: a + v.k)
    per_label = F.transform(F.sequence(F.lit(0), F.lit(len(LABELS) - 1)), lambda t: F.aggregate(F.filter("votes", lambda v: v.label == t), F.lit(0).cast("long"), lambda a, v: a + v.k))
    measured = (
        told.withColumn("_k", total).withColumn("_per", per_label)
        .withColumn("confidence", F.array_max("posterior"))
        .withColumn("label", F.array(*map(F.lit, LABELS))[(F.array_position("posterior", F.col("confidence")) - 1).cast("int")])
        .withColumn("agreement", F.when(F.col("_k") < 2, 1.0).otherwise(F.aggregate("_per", F.lit(0.0), lambda a, x: a + x * (x - 1)) / (F.col("_k") * (F.col("_k") - 1))))
        .withColumn("n_labels", F.size(F.filter("_per", lambda x: x > 0)))
    )
    return measured.select("item", "label", "confidence", "agreement", "n_labels"), reliability
