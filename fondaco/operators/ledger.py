"""Incremental processing: a ledger of work items with pending, leased and done states.

A work item is one version of one record: (key, version). The ledger is a log of events and never updates a row; ``seq`` is an
event's place in the log:

* ``lease``  a run claimed the item under a fencing token until ``expires``;
* ``done``   a run finished the item under a token.

The state of an item is folded from its events. ``done`` counts unless a greater token had leased the item before it, so a
writer whose lease was taken over is rejected (fencing); a ``done`` that counts is final, whatever comes after. A lease that
expired, and one whose run failed, is ``pending`` again. Tokens name the output paths, so a retried write replaces its own
earlier output and nothing else.

Defined results: null keys or null versions are no work items; repeated rows and repeated events count once; an empty
source or an empty log gives an empty or an all-pending plan; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

EVENTS = "key long, version timestamp_ntz, event string, token long, seq long, expires timestamp_ntz"


def newest_versions(source: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version): the greatest version of each key. One partial aggregation, so a hot key never meets in one task unreduced."""
    return (
        source.select(F.col(key).cast("long").alias("key"), F.col(version).cast("timestamp_ntz").alias("version"))
        .where("key is not null and version is not null")
        .groupBy("key").agg(F.max("version").alias("version"))
    )


def events_of_runs(items: DataFrame, runs: DataFrame, *, run: str = "run_id", key: str, version: str, lease: timedelta = timedelta(hours=6)) -> DataFrame:
    """Ledger events of a log of runs: every item was leased under its run's number as token; those of successful runs are done.

    A failed or cancelled run gives its leases back at once (they expire as they begin); one still running holds them for
    ``lease``. The log of runs is joined by key; Spark broadcasts it only if its size allows.
    """
    of_run = runs.select(
        F.col(run).cast("long").alias("token"), F.col("status").alias("_status"), (F.col("status") == "success").alias("_ok"),
        F.col("started_at").cast("timestamp_ntz").alias("at"), F.col("finished_at").cast("timestamp_ntz").alias("_end"),
    ).where("token is not null")
    # An attempt that succeeded settles its run, whatever other attempts did.
    of_run = of_run.groupBy("token").agg(
        F.max("_ok").alias("_ok"), F.max(F.col("_status") == "running").alias("_running"), F.max("at").alias("at"), F.max(F.when(F.col("_ok"), F.col("_end"))).alias("_end")
    )
    claimed = (
        items.select(F.col(run).cast("long").alias("token"), F.col(key).cast("long").alias("key"), F.col(version).cast("timestamp_ntz").alias("version"))
        .where("key is not null and version is not null and token is not null")
        .join(of_run, "token")
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hold = F.when(F.col("_running"), F.col("at") + F.expr(f"interval {int(lease.total_seconds())} seconds")).otherwise(F.col("at"))
    event = lambda kind, at: F.struct(F.lit(kind).alias("event"), at.alias("seq"))
    began, ended = event("lease", micros("at")), event("done", F.coalesce(micros("_end"), micros("at")))
    kinds = F.when(F.col("_ok"), F.array(began, ended)).otherwise(F.array(began))
    return claimed.select("key", "version", F.explode(kinds).alias("e"), "token", hold.alias("expires")).select("key", "version", "e.event", "token", "e.seq", "expires")


def ledger_state(events: DataFrame, now: datetime | Column) -> DataFrame:
    """(key, version, state, token) of every item with an event. Repeated events go before the shuffle; an item has few others."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    item = Window.partitionBy("key", "version")
    leased, done = F.col("event") == "lease", F.col("event") == "done"
    ordered = item.orderBy("seq", F.desc("event")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a lease before the done of its place
    events = events.groupBy("key", "version", "event", "token", "seq").agg(F.max("expires").alias("expires"))
    events = events.withColumn("_top", F.max(F.when(leased, F.col("token"))).over(ordered))
    folded = events.groupBy("key", "version").agg(
        F.max(F.when(leased, F.col("token"))).alias("token"),
        F.max(F.when(done & (F.col("token") >= F.coalesce("_top", "token")), F.col("token"))).alias("_done"),
        F.max_by(F.when(leased, F.col("expires")), F.when(leased, F.col("token"))).alias("_expires"),
    )
    state = F.when(F.col("_done").isNotNull(), "done").when(F.coalesce(F.col("_expires") > now, F.lit(False)), "leased").otherwise("pending")
    return folded.select("key", "version", state.alias("state"), F.coalesce("_done", "token").alias("token"))


def unhandled(newest: DataFrame, state: DataFrame) -> DataFrame:
    """The newest versions that are not done: what was added or changed, came late, or was claimed by a run that did not succeed."""
    done = state.where("state = 'done'").select("key", "version")
    return newest.join(done, ["key", "version"], "left_anti")


def claimable(newest: DataFrame, state: DataFrame) -> DataFrame:
    """The newest versions that may be leased now: neither done nor under a live lease."""
    busy = state.where("state <> 'pending'").select("key", "version")
    return newest.join(busy, ["key", "version"], "left_anti")


class StaleToken(RuntimeError):
    """A newer lease covers some of the items; the writer must stop."""


class WorkLedger:
    """The ledger as a log below ``path``, a folder that all executors share.

    ``lease`` claims items, ``commit`` closes them. An entry of the log is a file named by its place, put there by a rename that
    fails if the place is taken; so entries form one sequence. A writer reads the log up to its last entry, decides, writes its
    rows to a folder of their own and tries to take the next place; if another writer was faster, it decides again on the
    longer log. So no lease lands on an item that was leased or done before it, however late its writer is, and a writer that dies
    before it took its place leaves nothing that counts. The rename must be atomic, as it is on HDFS and local disks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._fs.mkdirs(self._path(f"{self.path}/log"))

    def _entries(self) -> list[tuple[int, int, str]]:
        """(place, greatest token so far, folder) of every entry."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/log"))]
        return sorted((int(n), *self._content(int(n))) for n in names if n.isdigit())

    def _content(self, place: int) -> tuple[int, str]:
        stream = self._fs.open(self._path(f"{self.path}/log/{place}"))
        try:
            token, folder = stream.readUTF().split(" ", 1)
        finally:
            stream.close()
        return int(token), folder

    def _take(self, place: int, token: int, folder: str) -> bool:
        """Put an entry at a place of the log; False if the place is taken."""
        draft = self._path(f"{self.path}/log/.draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.writeUTF(f"{token} {folder}")
        stream.close()
        goal = self._path(f"{self.path}/log/{place}")
        try:
            self._context.rename(draft, goal, self._no_options)
            return True
        except Exception:
            self._fs.delete(draft, False)
            if not self._fs.exists(goal):
                raise
            return False

    def _append(self, rows: Callable[[DataFrame, int, int], tuple[int, DataFrame]]) -> int:
        """Append what ``rows(events, place, last token)`` gives, (token, events), at the first free place."""
        while True:
            entries = self._entries()
            place = entries[-1][0] + 1 if entries else 1
            token, events = rows(self._read(entries), place, max((t for _, t, _ in entries), default=0))
            folder = f"{self.path}/rows/{place}-{uuid.uuid4().hex}"
            events.withColumn("seq", F.lit(place).cast("long")).select(*[c.split()[0] for c in EVENTS.split(", ")]).write.parquet(folder)
            if self._take(place, token, folder):
                return token
            self._fs.delete(self._path(folder), True)

    def _read(self, entries: list[tuple[int, int, str]]) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(*[folder for _, _, folder in entries]) if entries else self.spark.createDataFrame([], EVENTS)

    def events(self) -> DataFrame:
        return self._read(self._entries())

    def lease(self, newest: DataFrame, now: datetime, ttl: timedelta) -> tuple[int, DataFrame]:
        """Claim everything claimable; gives the fencing token and the claimed (key, version) rows."""

        def claim(events: DataFrame, place: int, last: int) -> tuple[int, DataFrame]:
            rows = claimable(newest, ledger_state(events, now))
            return last + 1, rows.select("key", "version", F.lit("lease").alias("event"), F.lit(last + 1).cast("long").alias("token"), F.lit(now + ttl).cast("timestamp_ntz").alias("expires"))

        token = self._append(claim)
        return token, self.leased(token)

    def leased(self, token: int) -> DataFrame:
        return self.events().where((F.col("event") == "lease") & (F.col("token") == token)).select("key", "version")

    def output_path(self, token: int) -> str:
        """Where the work done under the token belongs: the same on each retry."""
        return f"{self.path}/output/{token}"

    def commit(self, token: int, now: datetime) -> None:
        """Mark the token's items done; raises StaleToken if any of them was leased again since. A retry changes nothing."""

        def close(events: DataFrame, place: int, last: int) -> tuple[int, DataFrame]:
            mine = events.where((F.col("event") == "lease") & (F.col("token") == token)).select("key", "version").distinct()
            newer = events.where((F.col("event") == "lease") & (F.col("token") > token)).select("key", "version")
            if mine.join(newer, ["key", "version"], "left_semi").limit(1).count():
                raise StaleToken(f"lease {token} was taken over")
            done = events.where((F.col("event") == "done") & (F.col("token") == token)).select("key", "version")
            at = F.lit(now).cast("timestamp_ntz")
            return last, mine.join(done, ["key", "version"], "left_anti").select("key", "version", F.lit("done").alias("event"), F.lit(token).cast("long").alias("token"), at.alias("expires"))

        self._append(close)
