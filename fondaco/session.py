"""Sessions, table access, and materialisation in the folder shared by all executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str | int = "*", app: str = "fondaco", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; production code takes the session it is given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FONDACO_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="fondaco-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Folders of written tables that nothing has deleted yet.
_written: set[str] = set()


def materialise(df: DataFrame, name: str = "t", onto: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder, to the rows of ``onto`` if given, and read it back: lineage is cut, lost executors cost nothing that came before."""
    spark = df.sparkSession
    path = onto._fondaco_path if onto is not None else f"{shared_dir(spark)}/fondaco-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").mode("append" if onto is not None else "error").parquet(path)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fondaco_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of ended jobs, which else stay until the driver happens to collect its garbage."""
    for _ in range(2):  # the first lets go of what Python held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def slices(df: DataFrame, most: int) -> Iterator[DataFrame]:
    """A written table in parts of about ``most`` bytes on disk, at least one: several of its files, or a share of one by hash of id."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._fondaco_path)
    files = [(str(f.getPath()), f.getLen()) for f in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where) if f.getPath().getName().endswith(".parquet")]
    parts: list[tuple[list[str], int]] = [([], 0)]
    for path, size in sorted(files):
        if parts[-1][0] and parts[-1][1] + size > most:
            parts.append(([], 0))
        parts[-1] = ([*parts[-1][0], path], parts[-1][1] + size)
    for paths, size in parts:
        part, of = spark.read.schema(df.schema).parquet(*paths) if paths else df, max(1, -(-size // most))
        for i in range(of):
            yield part.where(F.pmod(F.xxhash64("id"), F.lit(of)) == i) if of > 1 else part


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more; other tables stay."""
    path = getattr(df, "_fondaco_path", None)
    if path in _written:
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that this process has written to the shared folder. For the end of a job: results that were not stored elsewhere go too."""
    for path in list(_written):
        _delete(spark, path)


def tasks_of(spark: SparkSession) -> int:
    """Shuffle partitions of the session, never fewer than its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
