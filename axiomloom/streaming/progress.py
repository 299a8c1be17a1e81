"""Judgement results as a stream: task counters and newest-result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.judgement import final_status
from ..scale import keep_last


def read_results(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def task_counters(results: DataFrame) -> DataFrame:
    """Counts per task; the same code serves a batch and a stream."""
    ok = F.col("run_status") == "success"
    return results.groupBy("task_id").agg(
        F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("fail_count")
    ).withColumn("task_status", final_status(F.col("fail_count")))


def log_batches(stream: DataFrame, path: str, checkpoint: str, mode: str, **trigger):
    """Store each micro-batch under its own batch id. A replayed batch
    overwrites its own folder, so restarts neither lose nor repeat rows.
    Without a trigger the stream ends when it has read what has arrived."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The batches of a log with their number in ``batch_id``."""
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    return spark.read.schema(full).parquet(path)


def run_task_counters(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Keep running counters; state holds one row per task. Every batch logs
    only the tasks it changed, and the newest entry of a task is its counter."""
    counters = task_counters(stream)
    log_batches(counters, path, checkpoint, "update").awaitTermination()
    log = read_log(stream.sparkSession, path, counters.schema)
    return keep_last(log, ["task_id"], ["batch_id"]).drop("batch_id")


def _manifest(spark: SparkSession, path: str):
    """The newest committed (version, snapshot) of a live table. Version 0 has no snapshot."""
    none = spark.createDataFrame([("",)], "snapshot string")
    none.write.mode("ignore").parquet(f"{path}/manifest/version=0")
    versions = spark.read.schema("snapshot string, version long").parquet(f"{path}/manifest")
    return versions.orderBy(F.desc("version")).first()


def read_live(spark: SparkSession, path: str, schema: StructType, keys: list[str], seq: str) -> DataFrame:
    """Newest row per key: the last snapshot and the changes logged since. Earlier logs are not listed."""
    now = _manifest(spark, path)
    log = f"{path}/log/version={now['version']}"
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{log}/batch_id=-1")
    rows = spark.read.schema(full).parquet(log)
    if now["snapshot"]:
        rows = rows.unionByName(spark.read.schema(schema).parquet(now["snapshot"]).withColumn("batch_id", F.lit(-1).cast("long")))
    return keep_last(rows, keys, [seq, "batch_id"]).drop("batch_id")


def compact(spark: SparkSession, path: str, schema: StructType, keys: list[str], seq: str) -> None:
    """Write the newest rows as a snapshot, then switch to it.

    The switch is one small table that appears when its job commits. A crash
    before that leaves an unused snapshot folder and the table as it was. Must
    not run beside a batch: run_live_upsert calls it between batches.
    """
    now = _manifest(spark, path)
    snapshot = f"{path}/snapshot/{uuid.uuid4().hex}"
    read_live(spark, path, schema, keys, seq).write.parquet(snapshot)
    _switch(spark, path, now["version"] + 1, snapshot)


def _switch(spark: SparkSession, path: str, version: int, snapshot: str) -> None:
    spark.createDataFrame([(snapshot,)], "snapshot string").coalesce(1).write.parquet(f"{path}/manifest/version={version}")


def run_live_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str,
                    compact_every: int | None = None) -> DataFrame:
    """Newest result per key. Batches are reduced and logged as changes under the
    version of the table they follow; every ``compact_every`` batches the changes
    become a snapshot, so reads do not grow with history. A replayed batch writes
    its own folder again, or the same rows into the next version, where they change
    nothing: of equal ``seq`` the row is the same.
    """
    spark, schema = stream.sparkSession, stream.schema

    def store(batch: DataFrame, batch_id: int) -> None:
        version = _manifest(spark, path)["version"]
        keep_last(batch, keys, [seq]).write.mode("overwrite").parquet(f"{path}/log/version={version}/batch_id={batch_id}")
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact(spark, path, schema, keys, seq)

    stream.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return read_live(spark, path, schema, keys, seq)
