"""Status of running tasks as keyed state over a stream of results.

A task runs until its expected number of results has arrived; then it is a
``success`` without failures and ``completed`` with some. Rows of ``run_status``
``stopping`` and ``load_failed`` are no results but messages: they end a task as
``stopped`` or ``failed`` (a failed task counts its whole total as failures).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..scale import keep_last
from .progress import log_batches, read_log

COUNTS = ["success_count", "fail_count", "stops", "breaks"]
_STATE = StructType([StructField(c, LongType()) for c in [*COUNTS, "total_count"]])


def _marked(results: DataFrame) -> DataFrame:
    """One row of four 0/1 counts per message; a null run_status is a failure."""
    status = F.coalesce("run_status", F.lit("failed"))
    kinds = {"success_count": status == "success", "stops": status == "stopping", "breaks": status == "load_failed"}
    kinds["fail_count"] = ~status.isin("success", "stopping", "load_failed")
    return results.select("task_id", *[kinds[c].cast("long").alias(c) for c in COUNTS])


def _totals(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_id").agg(F.max("total_count").cast("long").alias("total_count"))


def _judged(counts: DataFrame) -> DataFrame:
    """Status columns from summed counts; a task without a known total keeps running."""
    seen = F.col("success_count") + F.col("fail_count")
    failed = F.col("breaks") > 0
    done: Column = F.coalesce(seen >= F.col("total_count"), F.lit(False))
    return counts.select(
        "task_id", "success_count",
        F.when(failed, F.coalesce("total_count", F.lit(0))).otherwise(F.col("fail_count")).alias("fail_count"),
        "total_count",
        F.when(failed, F.lit("failed")).when(F.col("stops") > 0, F.lit("stopped")).when(~done, F.lit("running"))
        .when(F.col("fail_count") == 0, F.lit("success")).otherwise(F.lit("completed")).alias("task_status"),
    )


def task_status(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Status of every task with a message, over a whole table.

    ``tasks`` has ``task_id`` and ``total_count``; of several rows of a task the
    largest total counts. Unknown tasks and null totals are ``running``. An empty
    table of results gives no row.
    """
    counts = _marked(results).groupBy("task_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return _judged(counts.join(_renamed(_totals(tasks)), F.col("task_id").eqNullSafe(F.col("_task")), "left").drop("_task"))


def _renamed(totals: DataFrame) -> DataFrame:
    return totals.withColumnRenamed("task_id", "_task")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per task of each Arrow batch: a hot task shuffles a row per batch, not its results."""
    for batch in batches:
        summed = pa.Table.from_batches([batch]).group_by("task_id").aggregate([(c, "sum") for c in COUNTS])
        named = summed.select(["task_id", *[f"{c}_sum" for c in COUNTS]]).rename_columns(["task_id", *COUNTS])
        yield from named.to_batches()


def _advance(idle_ms: int):
    """The step of a task's state. ``idle`` is set when the timer ends a silent task."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *sums, total = state.get if state.exists else (0, 0, 0, 0, None)
        idle = state.hasTimedOut
        for part in parts:
            sums = [old + int(part[c].sum()) for old, c in zip(sums, COUNTS)]
            known = part["total_count"].dropna()
            if len(known):
                total = max(int(known.max()), total or 0)
        open_ = total is None or sums[0] + sums[1] < total
        state.update((*sums, total))
        if open_ and not idle and not sums[2] and not sums[3]:
            state.setTimeoutDuration(idle_ms)
        row = dict(zip(COUNTS, sums), total_count=total, idle=bool(idle))
        task = None if pd.isna(key[0]) else key[0]
        yield pd.DataFrame({name: pd.Series([value], dtype=object) for name, value in {"task_id": task, **row}.items()})

    return step


def stream_task_status(stream: DataFrame, tasks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of status rows, one per batch for every task the batch touched.

    State is five numbers a task, whatever its number of results: a streaming
    aggregation inside the JVM. With ``idle_ms`` a timer, which needs a Python call
    per touched task, marks a running task ``stopped`` that had no message for so
    long; the next message sets it running again, so no result is lost.
    """
    marked = _marked(stream)
    schema = StructType([StructField("task_id", marked.schema["task_id"].dataType),
                         *[StructField(c, LongType()) for c in COUNTS]])
    sums = marked.mapInArrow(_tally, schema)
    known = sums.join(_renamed(_totals(tasks)), F.col("task_id").eqNullSafe(F.col("_task")), "left").drop("_task")
    if not idle_ms:
        return _judged(known.groupBy("task_id").agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("total_count").alias("total_count")))
    out = StructType([*schema.fields, StructField("total_count", LongType()), StructField("idle", BooleanType())])
    moved = known.groupBy("task_id").applyInPandasWithState(
        _advance(idle_ms), out, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    silent = moved.withColumn("stops", F.when(F.col("idle"), F.greatest("stops", F.lit(1))).otherwise(F.col("stops")))
    return _judged(silent)


def run_task_status(stream: DataFrame, tasks: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain what has arrived and return the newest status per task. The state
    lives in ``checkpoint``, so a later call goes on where this one ended."""
    rows = stream_task_status(stream, tasks)
    log_batches(rows, path, checkpoint, "update").awaitTermination()
    return newest_status(rows, path)


def watch_task_status(stream: DataFrame, tasks: DataFrame, path: str, checkpoint: str, idle_ms: int,
                      every: str = "10 seconds") -> tuple[StreamingQuery, DataFrame]:
    """Run on with the timer, which needs the clock and so never drains: the
    running query and its rows, whose log newest_status reads at any time."""
    rows = stream_task_status(stream, tasks, idle_ms)
    return log_batches(rows, path, checkpoint, "update", processingTime=every), rows


def newest_status(rows: DataFrame, path: str) -> DataFrame:
    return keep_last(read_log(rows.sparkSession, path, rows.schema), ["task_id"], ["batch_id"]).drop("batch_id")
