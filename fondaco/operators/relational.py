"""Relational operators that plain DataFrame calls do not spell out: merges, runs, ranges, trees and rankings.

All are lazy plans of joins, aggregations and windows. Windows are partitioned, and where only the best rows of a group are
wanted the rank is filtered, which Spark turns into a limit before the shuffle. A global top-k is ``orderBy().limit()``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fondaco.session import materialise

# Merges. Tables are immutable files here: every merge gives the rows of the next state of the target.


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``; a total order makes the choice repeatable."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the feed replace those of the target with the same keys; the feed's keys must be unique."""
    return target.join(feed.select(*keys), keys, "left_anti").unionByName(feed)


def insert_ignore(target: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the feed whose keys the target lacks are added; the feed's keys must be unique."""
    return target.unionByName(feed.join(target.select(*keys), keys, "left_anti"))


def delete_by_key(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys).distinct(), keys, "left_anti")


def update_from(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """The target's column takes the source's value where there is one (source keys unique)."""
    return target.join(source.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def scd2_merge(target: DataFrame, feed: DataFrame, key: str, digest: str, begin: str, end: str, as_of: Column) -> DataFrame:
    """Versioned merge: unchanged keys stay, changed ones are closed at ``as_of`` and begun anew, new ones are begun.

    target: key, digest, begin, end and more, one open row (end null) a key; feed: key, digest and the same more columns.
    """
    more = [c for c in target.columns if c not in (begin, end)]
    open_rows = target.where(F.col(end).isNull())
    told = feed.select(key, F.col(digest).alias("_digest"))
    closed = open_rows.join(told, key).where(~F.col(digest).eqNullSafe(F.col("_digest"))).drop("_digest").withColumn(end, as_of)
    kept = open_rows.join(told, key, "left").where(F.col("_digest").isNull() | F.col(digest).eqNullSafe(F.col("_digest"))).drop("_digest")
    same = open_rows.select(key, F.col(digest).alias("_digest"))
    fresh = feed.join(same, (feed[key] == same[key]) & feed[digest].eqNullSafe(same["_digest"]), "left_anti")
    fresh = fresh.select(*more).withColumn(begin, as_of).withColumn(end, F.lit(None).cast(dict(target.dtypes)[end]))
    return reduce(DataFrame.unionByName, [target.where(F.col(end).isNotNull()), closed, kept, fresh])


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``errors``, the names of the rules they break; split on its size to route them."""
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])))


def activate_run(runs: DataFrame, run_id: int, kind: str) -> DataFrame:
    """The run is active, every other run of its kind is not."""
    return runs.withColumn("is_active", F.when(F.col("run_type") == kind, F.col("run_id") == run_id).otherwise(F.col("is_active")))


def active_run(runs: DataFrame) -> DataFrame:
    """One row: the active run of greatest id."""
    return runs.where("is_active").agg(F.max("run_id").alias("run_id"))


# Ranges and neighbours


def islands(rows: DataFrame, keys: list[str], position: str, least: int = 1) -> DataFrame:
    """(keys, first, last, length) of runs of consecutive integer positions."""
    by = Window.partitionBy(*keys).orderBy(position)
    marked = rows.select(*keys, position).distinct().withColumn("_run", F.col(position) - F.row_number().over(by))
    out = marked.groupBy(*keys, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).drop("_run")


def range_ends(rows: DataFrame, keys: list[str], start: str, last: Column) -> DataFrame:
    """Each range ends before the next one's start; the last one at ``last``."""
    by = Window.partitionBy(*keys).orderBy(start)
    return rows.withColumn("range_end", F.coalesce(F.lead(start).over(by) - 1, last))


def in_range(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, end: str, width: int) -> DataFrame:
    """Points with each range of their key that holds them: an equi-join on buckets of ``width``, then the exact test.

    A range goes to every bucket it touches; choose the width near the usual length of a range.
    """
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    at = points.withColumn("_bucket", F.floor(F.col(point) / width))
    return at.join(spread, [*keys, "_bucket"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_bucket")


def valid_at(rows: DataFrame, begin: str, end: str, day: Column) -> DataFrame:
    """Versions in force on a day; a missing bound is open."""
    return rows.where((F.col(begin).isNull() | (F.col(begin) <= day)) & (F.col(end).isNull() | (F.col(end) > day)))


def carry_forward(rows: DataFrame, keys: list[str], order: str, levels: list[str]) -> DataFrame:
    """Headings by level: each row gets the last heading seen at every level, unless one of a higher level came after it."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = {c: F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("v"))), ignorenulls=True).over(by) for c in levels}
    out = rows.select("*", *[s.alias(f"_{c}") for c, s in last.items()])
    for i, c in enumerate(levels):
        newer = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_{h}.at") > F.col(f"_{c}.at"), F.lit(False)) for h in levels[:i]], F.lit(False))
        out = out.withColumn(f"at_{c}", F.when(~newer, F.col(f"_{c}.v")))
    return out.drop(*[f"_{c}" for c in levels])


# Rankings


def rank_by(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank", most: int | None = None) -> DataFrame:
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if most is None else ranked.where(F.col(name) <= most)


def sample_per_group(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows a group, drawn by the md5 of key and seed: the same rows on every run and in every engine."""
    return rank_by(rows, [group], [F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)], "_n", n).drop("_n")


def specificity_match(rows: DataFrame, profiles: DataFrame, wildcards: dict[str, str], key: str, name: str) -> DataFrame:
    """The most specific profile of each row: a null attribute of a profile matches anything; ties go to the lesser name.

    ``profiles`` is a table of configuration and is broadcast if the session's threshold allows.
    """
    told = profiles.select(F.col(name).alias("_name"), *[F.col(p).alias(f"_{p}") for p in wildcards])
    fits = reduce(lambda a, b: a & b, [F.col(f"_{p}").isNull() | (F.col(f"_{p}") == F.col(c)) for p, c in wildcards.items()])
    special = reduce(lambda a, b: a + b, [F.col(f"_{p}").isNotNull().cast("int") for p in wildcards])
    best = rows.join(told, fits, "left").groupBy(key).agg(F.min_by("_name", F.struct(-special, F.col("_name"))).alias(name))
    return best


def write_run(rows: DataFrame, path: str, run: int) -> None:
    """Write the rows of a run to a partition of its own; a second write of the run replaces it and touches no other."""
    rows.withColumn("run_id", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_run(spark: SparkSession, path: str, run: int, like: DataFrame) -> DataFrame:
    """The rows of a run, of the columns of ``like``; other runs are not read. A run without rows is empty."""
    schema = StructType([*like.schema.fields, StructField("run_id", IntegerType())])
    return spark.read.schema(schema).parquet(path).where(F.col("run_id") == run)


def paged(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The rows with their ``page`` in the order of a unique key, pages of ``size`` rows.

    Rows are split into ranges of the key; what goes through the driver is one count a range, and a window numbers the rows of
    a range only.
    """
    ranges = rows.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id())
    ranges = materialise(ranges, "pages")
    counts = sorted((r["_range"], r["n"]) for r in ranges.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    starts = rows.sparkSession.createDataFrame(before, "_range int, _before long")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1 + F.col("_before")
    return ranges.join(F.broadcast(starts), "_range").withColumn("page", F.floor(number / size)).drop("_range", "_before")


def sharing_pairs(rows: DataFrame, key: str, item: str, least: int = 2) -> DataFrame:
    """(a, b, shared): pairs of keys with ``least`` items in common, two at the fewest.

    Keys meet on pairs of items, not on single ones, so an item that many keys hold brings only those together that share
    another with it. A key's items are gathered, so they must be few.
    """
    sets = rows.select(F.col(key).alias("k"), F.col(item).alias("i")).where("k is not null and i is not null").groupBy("k").agg(F.sort_array(F.collect_set("i")).alias("items")).where(F.size("items") >= least)
    both = F.flatten(F.transform("items", lambda x, n: F.transform(F.slice("items", n + 2, F.size("items")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    met = sets.select("k", F.explode(both).alias("p"))
    pairs = met.select(F.col("k").alias("a"), "p").join(met.select(F.col("k").alias("b"), "p"), "p").where("a < b").select("a", "b").distinct()
    told = pairs.join(sets.select(F.col("k").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("k").alias("b"), F.col("items").alias("ib")), "b")
    return told.select("a", "b", F.size(F.array_intersect("ia", "ib")).cast("long").alias("shared")).where(F.col("shared") >= least)
