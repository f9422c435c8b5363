"""Cutting lineage in the folder that all executors share, and joins whose small side is checked."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session within one process (tests) gets a local folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp")).rstrip("/")


#: Bits of an estimated size from which it says nothing.
MEANINGLESS = 256


def _estimate(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from files in the shared folder, so that a lost executor costs one stage and loops keep short plans.

    What is cut keeps the size that was estimated for it, and a join's is the product of its sides': in a loop that joins a table with itself it
    has twice as many digits after each round, millions in the end, all in the driver. Where it has no meaning any more it is left out.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    kept = df.checkpoint(eager=True)
    if _estimate(kept).bit_length() < MEANINGLESS:
        return kept
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), df.sparkSession)


def fitting(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` (cut, or cheap to count) to be broadcast if it has at most ``rows`` rows; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def measured_broadcasts(spark: SparkSession) -> None:
    """From now on this session's joins are broadcast by a hint, or by sizes that a shuffle has measured: those that are estimated from
    files are off by two orders where columns are dictionaries or texts are made from them, and what is broadcast passes through the driver."""
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if at != "-1":
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or at)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


#: Input bytes a task of the session's parallelism below which a small input is dealt to all of them; bytes of a task, and tasks a core at most, of
#: inputs that are compact beside the work they make.
SMALL, PIECE, PIECES = 4 << 20, 256 << 10, 64


def spread(df: DataFrame, compact: bool = False) -> DataFrame:
    """``df`` for costly work row by row: a small input, which may be one file of one row group, is dealt to all cores; others stay as they are read.

    A ``compact`` one, whose rows are made into texts, is dealt to more tasks as it grows, so that none of these does.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    size = _estimate(df)
    if compact:
        return df.repartition(max(tasks, size // PIECE)) if size < tasks * PIECES * PIECE else df
    return df.repartition(tasks) if size < tasks * SMALL else df


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    at, store = _path(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library made itself."""
    at, store = _path(spark, path)
    store.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it isn't there."""
    at, store = _path(spark, path)
    return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Gives a folder another path, at which nothing may be yet."""
    at, store = _path(spark, old)
    to = _path(spark, new)[0]
    store.mkdirs(to.getParent())
    if store.exists(to) or not store.rename(at, to):
        raise OSError(f"{old} could not be renamed to {new}")
