"""History of changing attributes: insert-only satellites with hash-diffs and lead-based end dates.

Attributes are split by how often they change: each group of attributes is a satellite of its own and gets a row only where
its hash-diff differs from that of the key's snapshot before. No row is ever updated; the end of a version is computed by a
view over the key's next version.

Defined results: rows without key or without a readable snapshot date are left out (``unreadable_snapshots`` gives the
latter); a snapshot delivered twice counts once, and where the copies differ the row created last holds, ties to the greater
text; null text equals only null text; an empty table gives an empty history; extra columns are ignored.

Scale: rows are reduced to one per key and snapshot date by a partial aggregation before any window, so a window holds as
many rows as there are snapshot dates for one key, however often they were delivered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Dates that state nothing.
NO_DATES = ("1900-01-01", "9999-12-31")


def snapshot_date(version: Column) -> Column:
    """The date in a snapshot's name, whatever its punctuation: 20190418, 2019-04-18, 2019.04.18, V22_20190418."""
    parts = F.regexp_extract(version, r"(?:^|[^0-9])(\d{4})[-./]?(\d{2})[-./]?(\d{2})(?:[^0-9]|$)", 0)
    return F.try_to_timestamp(F.regexp_replace(parts, "[^0-9]", ""), F.lit("yyyyMMdd")).cast("date")


def stated(date: Column) -> Column:
    """The date, or null where it is a sentinel."""
    date = date.cast("date")
    return F.when(~date.isin(*[F.lit(d).cast("date") for d in NO_DATES]), date)


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+", "")


def hash_diff(*columns: Column) -> Column:
    """One hash over a group of attributes; null differs from every text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]), 256)


def unreadable_snapshots(rows: DataFrame, version: str) -> DataFrame:
    return rows.where(snapshot_date(F.col(version)).isNull())


def per_snapshot(rows: DataFrame, key: str, version: str, created: str, attributes: dict[str, Column]) -> DataFrame:
    """(key, snapshot, *attributes): one row per key and snapshot date, the one created last. Two-phase aggregation, no window."""
    seen = rows.select(
        F.col(key).alias("_key"), snapshot_date(F.col(version)).alias("_snapshot"), F.col(created).alias("_created"), *[c.alias(n) for n, c in attributes.items()]
    ).where("_key is not null and _snapshot is not null")
    last = F.max(F.struct("_created", *attributes)).alias("_last")
    return seen.groupBy("_key", "_snapshot").agg(last).select(F.col("_key").alias("key"), F.col("_snapshot").alias("snapshot"), *[F.col(f"_last.{n}").alias(n) for n in attributes])


def satellite(snapshots: DataFrame, attributes: list[str]) -> DataFrame:
    """(key, load_date, hash_diff, *attributes): rows appended where the hash-diff differs from the key's snapshot before."""
    by_key = Window.partitionBy("key").orderBy("snapshot")
    marked = snapshots.withColumn("hash_diff", hash_diff(*[F.col(a) for a in attributes])).withColumn("_before", F.lag("hash_diff").over(by_key))
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("hash_diff"))
    return marked.where(changed).select("key", F.col("snapshot").alias("load_date"), "hash_diff", *attributes)


def append_satellite(stored: DataFrame, snapshots: DataFrame, attributes: list[str], tracked: DataFrame | None = None) -> DataFrame:
    """The rows to append to a stored satellite for new snapshots: insert-only, nothing stored is touched.

    tracked: all snapshots (key, snapshot, *attributes) delivered before. With them snapshots may come in any order: a late one
    adds its own row, and the row of the snapshot after it, which did not differ from the one before until now. Without them
    snapshots must be newer than what is stored for their key. Only keys with new snapshots are looked at.
    """
    if tracked is None:
        tracked = stored.select("key", F.col("load_date").alias("snapshot"), *attributes)
    known = tracked.join(snapshots.select("key").distinct(), "key", "left_semi").select("key", "snapshot", *attributes)
    fresh = satellite(known.unionByName(snapshots.select("key", "snapshot", *attributes)).distinct(), attributes)
    return fresh.join(stored.select("key", "load_date", "hash_diff"), ["key", "load_date", "hash_diff"], "left_anti")


def satellite_view(stored: DataFrame) -> DataFrame:
    """The satellite with ``end_date`` (exclusive, null for the current version), computed by lead.

    Rows that late ones have made repeat the version before are passed over.
    """
    by_key = Window.partitionBy("key").orderBy("load_date")
    marked = stored.withColumn("_before", F.lag("hash_diff").over(by_key))
    changes = marked.where(F.col("_before").isNull() | (F.col("_before") != F.col("hash_diff"))).drop("_before")
    return changes.withColumn("end_date", F.lead("load_date").over(by_key))


def text_history(rows: DataFrame, *, key: str, text: str, begin: str, end: str, version: str, created: str) -> DataFrame:
    """(key, valid_from, valid_to): one row per longest run of consecutive snapshots with the same text, white space aside.

    valid_from is the earliest stated begin of the run, else its first snapshot; valid_to (exclusive) the earliest of its
    stated ends and the next run's valid_from, null if neither. The text is the slow satellite; the stated dates change from
    snapshot to snapshot without a new version and are the fast one, folded over the run of the slow.
    """
    seen = rows.select(
        F.col(key).alias("key"), snapshot_date(F.col(version)).alias("snapshot"), F.col(created).alias("_created"),
        hash_diff(without_space(F.col(text))).alias("_digest"), stated(F.col(begin)).alias("_from"), stated(F.col(end)).alias("_to"),
    ).where("key is not null and snapshot is not null")
    # The text of a snapshot is that of its last delivery; its dates are those stated by any.
    snapshots = seen.groupBy("key", "snapshot").agg(F.max(F.struct("_created", "_digest")).alias("_last"), F.min("_from").alias("_from"), F.min("_to").alias("_to"))
    snapshots = snapshots.select("key", "snapshot", F.col("_last._digest").alias("_digest"), "_from", "_to")
    texts = satellite_view(satellite(snapshots, ["_digest"])).select("key", F.col("load_date").alias("_begin"), F.col("end_date").alias("_end"))
    dates = satellite_view(satellite(snapshots, ["_from", "_to"]))
    during = (F.col("_end").isNull() | (F.col("load_date") < F.col("_end"))) & (F.col("end_date").isNull() | (F.col("end_date") > F.col("_begin")))
    runs = texts.join(dates, "key").where(during).groupBy("key", "_begin").agg(F.coalesce(F.min("_from"), F.col("_begin")).alias("valid_from"), F.min("_to").alias("_to"))
    after = F.lead("valid_from").over(Window.partitionBy("key").orderBy("_begin"))
    return runs.select("key", "valid_from", F.least(F.col("_to"), after).alias("valid_to"))
