"""Incremental maintenance: a stream of changed entries keeps index partitions and latest states up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lineage import cut, exists, fitting, folders, remove, rename


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key, by ``order``; combines before the shuffle."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(key, "e.*")


def window_counts(changes: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Changes in each window, with a watermark, for batches and streams alike."""
    timed = changes.withColumn("__ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("__ts", late) if changes.isStreaming else timed
    return timed.groupBy(F.window("__ts", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def maintain(changes: DataFrame, target: str, checkpoint: str, key: str, order: list[str], partition: str) -> StreamingQuery:
    """Writes each batch's last change of a key over the partitions of ``target`` that it touches, keeping newer rows there.

    Touched are the partitions of the new rows and those that hold a key of the batch until now, so a key that moves
    leaves its old partition. Only these are read and rewritten, by way of a staged copy of the batch's own, so a batch
    that is repeated after a failure gives the same table; a partition that loses its last row is removed. A batch without
    rows, such as a file of none, changes nothing.
    """
    spark = changes.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        new = latest(batch, key, order)
        emptied: list[str] = []
        # Without a partition there is no schema to be read: a first write may have left the bare folder.
        if any(name.startswith(f"{partition}=") for name in folders(spark, target)):
            table = spark.read.parquet(target)
            touched = cut(new.select(partition).unionByName(table.join(new.select(key), key, "left_semi").select(partition)).distinct())
            old = table.join(fitting(touched), table[partition].eqNullSafe(touched[partition]), "left_semi")
            places = old.select(F.regexp_replace(F.input_file_name(), r"/[^/]*$", "").alias("place"), partition).distinct()
            new = cut(latest(old.select(*new.columns).unionByName(new), key, order))
            left = new.select(partition).distinct()
            emptied = [r["place"] for r in places.join(left, places[partition].eqNullSafe(left[partition]), "left_anti").collect()]
        staged = f"{target.rstrip('/')}.staged/batch-{batch_id}"
        new.write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.partitionBy(partition).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(target)
        for place in emptied:
            remove(spark, place)
        remove(spark, staged)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(rows: DataFrame, target: str) -> None:
    """Replaces a table as a whole: its rows are written beside it, the old ones step aside, and come back if the new ones can't take their place."""
    spark, mark = rows.sparkSession, uuid.uuid4().hex
    staged, aside = f"{target.rstrip('/')}.staged-{mark}", f"{target.rstrip('/')}.old-{mark}"
    rows.write.parquet(staged)
    held = exists(spark, target)
    if held:
        rename(spark, target, aside)
    try:
        rename(spark, staged, target)
    except Exception:
        if held:
            rename(spark, aside, target)
        raise
    if held:
        remove(spark, aside)


def stream_of(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with their own schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
