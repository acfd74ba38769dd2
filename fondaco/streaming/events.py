"""Structured Streaming over event tables: windows, sessions, deduplication, rate limits, breakers, and incremental merges.

``run_once`` drains what is there (``availableNow``) and gives the result as a table; the same transformations run on a live
source with another trigger. Checkpoints and results lie in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fondaco.session import shared_dir


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file; event time in ``ts`` as a timestamp."""
    folder, _, name = path.rstrip("/").rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all that is there now; each batch is written under its number, so a retry replaces itself."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/fondaco-stream-{uuid.uuid4().hex}"
    last = {"n": -1}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        last["n"] = number

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    path = f"{base}/out/batch={last['n']}" if mode == "complete" else f"{base}/out"
    return spark.read.parquet(path).select(*stream.columns) if last["n"] >= 0 else spark.createDataFrame([], stream.schema)


def run_rounds(rounds: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The updates of a stream that is fed round by round and stopped in between, with the number of their ``round``.

    State and watermark outlive the stops in the checkpoint, so a later round meets the mark that the earlier ones set.
    """
    spark = rounds[0].sparkSession
    base = f"{shared_dir(spark)}/fondaco-rounds-{uuid.uuid4().hex}"
    out = None
    for rows in rounds:
        rows.write.mode("append").parquet(f"{base}/in")
        stream = transform(read_stream(spark, f"{base}/in/*.parquet", rows.schema))

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("round", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        out = stream.schema
    return spark.read.parquet(f"{base}/out").select(*out.names, "round")


def tumbling(rows: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by windows of one width."""
    told = rows.withWatermark("ts", late) if rows.isStreaming else rows
    told = told.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return told.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(rows: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    told = rows.withWatermark("ts", late) if rows.isStreaming else rows
    told = told.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return told.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(rows: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of runs of events of a user without a gap."""
    told = rows.withWatermark("ts", late) if rows.isStreaming else rows
    told = told.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return told.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def followed_by(left: DataFrame, right: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """Rows of ``left`` with the ``other_id`` of the same user's rows of ``right`` that follow within a time; on streams both keep rows only as long as a match may come."""
    mark = lambda df, ts: df.withWatermark(ts, late) if df.isStreaming else df
    other = right.select(F.col("event_id").alias("other_id"), F.col("user_id").alias("other_user"), F.col("ts").alias("other_ts"))
    near = (F.col("user_id") == F.col("other_user")) & (F.col("other_ts") >= F.col("ts")) & (F.col("other_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return mark(left, "ts").join(mark(other, "other_ts"), near)


def first_seen(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once; on a stream within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def over_limit(rows: DataFrame, most: int, width: str = "60 seconds", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): windows in which a user went over the limit."""
    told = rows.withWatermark("ts", late) if rows.isStreaming else rows
    told = told.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return told.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def _breaker(threshold: int, seconds: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, failures, until = None, 0, None
        for batch in batches:
            states = []
            for u, t, bad in zip(batch.column("user_id").to_pylist(), batch.column("at").to_pylist(), batch.column("failed").to_pylist()):
                if u != user:
                    user, failures, until = u, 0, None
                if until is not None and t < until:
                    states.append("open")
                    continue
                half = until is not None
                states.append("half_open" if half else "closed")
                failures = (threshold if half else failures + 1) if bad else 0
                until = t + seconds if failures >= threshold else None
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(states, pa.string())], names=["event_id", "state"])

    return run


def circuit_breaker(rows: DataFrame, threshold: int = 3, seconds: float = 300.0) -> DataFrame:
    """(event_id, state): the breaker's state that each event of a user met: closed, open after ``threshold`` failures in a row, half open after a pause.

    The order within a user is sequential by nature; events are sorted and streamed, so a task holds one batch, not a user.
    """
    told = rows.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "error").alias("failed"))
    told = told.select("event_id", "user_id", (F.col("us") / 1e6).alias("at"), "failed").repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return told.mapInArrow(_breaker(threshold, seconds), "event_id long, state string")


def merge_incrementally(stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], keys: list[str], checkpoint: str) -> None:
    """Upsert the batches of a stream into a table: rows of a batch replace those of the same keys."""
    from fondaco.operators.relational import upsert

    def merge(batch: DataFrame, number: int) -> None:
        save(upsert(load(), batch.dropDuplicates(keys), keys), number)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
