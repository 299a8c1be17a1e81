"""Service joins, paging, keyed replacement and task reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scale import dense_position, keep_last
from ..session import scratch_path
from .metrics import binary_metrics, explanation_rates_all, explanation_rates_correct, service_metrics



def correct_case() -> Column:
    return (F.col("run_status") == "success") & (F.col("true_label") == F.col("predict_label"))


def annotations_outer(results: DataFrame, annotations: DataFrame, status: str | None = None) -> DataFrame:
    """Correct results with their annotation, if any; 'pending' includes none."""
    notes = annotations.select(
        "task_id", F.col("result_id").alias("id"), "explanation_correct_label",
        "hallucination_label", "annotation_status",
    )
    joined = results.filter(correct_case()).join(notes, ["task_id", "id"], "left")
    state = F.col("annotation_status")
    if status == "pending":
        return joined.filter(state.isNull() | (state == "pending"))
    return joined.filter(state == status) if status else joined


def eval_metrics_join(records: DataFrame, results: DataFrame, keys: Sequence[str] = ("axiom_type",)) -> DataFrame:
    """Scores of a task's results against the dataset records they point to."""
    pairs = results.join(
        records.select(F.col("id").alias("record_id"), "axiom_type", "label"), "record_id", "inner"
    )
    return service_metrics(pairs, keys, "label", "pred")


def explanation_by_model(models: DataFrame, tasks: DataFrame, results: DataFrame,
                         annotations: DataFrame) -> DataFrame:
    joined = (
        annotations.join(results.select(F.col("id").alias("result_id"), "task_id"), "result_id")
        .join(tasks.select(F.col("id").alias("task_id"), "model_id"), "task_id")
        .join(models.select(F.col("id").alias("model_id"), F.col("name").alias("model")), "model_id")
    )
    return explanation_rates_all(joined)


def task_listing(tasks: DataFrame, datasets: DataFrame, models: DataFrame, prompts: DataFrame) -> DataFrame:
    out = tasks
    for name, dim in (("dataset", datasets), ("model", models), ("prompt", prompts)):
        out = out.join(dim.select(F.col("id").alias(f"{name}_id"), F.col("name").alias(f"{name}_name")),
                       f"{name}_id", "left")
    return out


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_last(df, keys, order)


def task_report(tasks: DataFrame, datasets: DataFrame, models: DataFrame, prompts: DataFrame,
                results: DataFrame, annotations: DataFrame, stability: DataFrame) -> DataFrame:
    """One nested row per task; every fact table is aggregated before the join."""
    scores = binary_metrics(results, ["task_id"], "true_label", "predict_label")
    notes = explanation_rates_correct(annotations_outer(results, annotations))
    newest = latest_per_key(stability, ["base_task_id"], ["created_time", "id"]).select(
        F.col("base_task_id").alias("task_id"), "hard_consistency", "soft_consistency"
    )
    wide = task_listing(tasks, datasets, models, prompts).withColumnRenamed("id", "task_id")
    for part in (scores, notes, newest):
        wide = wide.join(part, "task_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return wide.select(
        F.struct("task_id", "task_name", "dataset_name", "model_name", "prompt_name", "task_status").alias("task_info"),
        F.struct("total_count", *[zero(c) for c in ("accuracy", "precision", "recall", "f1")]).alias("classification"),
        F.struct(*[zero(c) for c in ("correct_case_count", "annotated_count", "explanation_correct_count",
                                     "hallucination_count", "explanation_accuracy", "hallucination_rate")]).alias("explanation"),
        F.struct("hard_consistency", "soft_consistency").alias("stability"),
    )


def resume_pending(inputs: DataFrame, outputs: DataFrame, lists: Sequence[str]) -> DataFrame:
    """Inputs without a finished output: no error and every list present."""
    done = F.coalesce(F.col("error"), F.lit("")) == ""
    for name in lists:
        done = done & F.col(name).isNotNull()
    return inputs.join(outputs.filter(done).select("doc_id").distinct(), "doc_id", "left_anti")


def method_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    columns = ["doc_id", "axiom_type", "item1", "item2"]
    return a.select(*columns).intersect(b.select(*columns))


def page(df: DataFrame, number: int, size: int, order: str = "id",
         max_size: int | None = None) -> tuple[DataFrame, int]:
    """(rows of one page, total), ties in ``order`` in any order.

    Only the order column is numbered, by ranges; the page is then read by the
    two values at its ends, which reach the scan as filters.
    """
    number, size = max(number, 1), max(size if max_size is None else min(size, max_size), 1)
    first = (number - 1) * size + 1
    ranked = dense_position(df.select(F.col(order).alias("_v")), [], "_v", "_n")
    total = ranked.agg(F.max("_n").alias("n")).first()["n"] or 0
    if first > total:
        return df.limit(0), total
    ends = ranked.filter(F.col("_n").isin(first, min(first + size - 1, total))).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    skipped = first - ranked.filter(F.col("_v") == ends["lo"]).agg(F.min("_n").alias("n")).first()["n"]
    near = df.filter(F.col(order).between(ends["lo"], ends["hi"]))
    return near.orderBy(order).limit(skipped + size).offset(skipped), total


@dataclass(frozen=True)
class PageIndex:
    """A table stored in ranges of an order column, for many page calls.

    ``ranges`` holds (number, first position, rows), one entry per range; ties in
    the order column keep one fixed order, so the pages of an index share no row.
    """

    spark: SparkSession
    path: str
    order: str
    schema: StructType
    ranges: tuple[tuple[int, int, int], ...]

    @property
    def total(self) -> int:
        return self.ranges[-1][1] + self.ranges[-1][2] - 1 if self.ranges else 0

    def page(self, number: int, size: int, max_size: int | None = None) -> DataFrame:
        """The rows of one page in order. Only the ranges it touches are read,
        one of them unless the page crosses an edge; beyond the end it is empty."""
        number, size = max(number, 1), max(size if max_size is None else min(size, max_size), 1)
        first = (number - 1) * size + 1
        near = [r for r in self.ranges if r[1] < first + size and first < r[1] + r[2]]
        skipped = first - near[0][1] if near else 0
        chosen = F.col("_range").isin(*[r[0] for r in near]) if near else F.lit(False)
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").filter(chosen)
        rows = stored.orderBy(F.col(self.order).asc_nulls_first(), "_tie").offset(skipped).limit(size)
        return rows.drop("_tie", "_range")


def build_page_index(df: DataFrame, order: str = "id", rows_per_range: int = 1_000_000,
                     path: str | None = None) -> PageIndex:
    """Store ``df`` in about ``rows / rows_per_range`` ranges of ``order`` and
    count them, nulls first. Equal values are told apart by a hash of the row and
    where it was read, so a value with a third of all rows is split as well.
    ``df`` may not have columns named ``_tie`` or ``_range``.
    """
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, "pages")
    ranges = max(1, -(-df.count() // rows_per_range))
    tied = df.withColumn("_tie", F.struct(F.xxhash64(*df.columns).alias("h"), F.monotonically_increasing_id().alias("at")))
    dealt = tied.repartitionByRange(ranges, F.col(order).asc_nulls_first(), "_tie").withColumn("_range", F.spark_partition_id())
    dealt.sortWithinPartitions("_range", F.col(order).asc_nulls_first(), "_tie").write.partitionBy("_range").parquet(f"{path}/rows")
    stored = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
    counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"))
    counts.coalesce(1).write.parquet(f"{path}/ranges")
    info = spark.createDataFrame([(order, dealt.schema.json())], "order string, schema string")
    info.coalesce(1).write.parquet(f"{path}/info")
    return open_page_index(spark, path)


def open_page_index(spark: SparkSession, path: str) -> PageIndex:
    """An index that some session stored; only its small tables are read."""
    info = spark.read.schema("order string, schema string").parquet(f"{path}/info").first()
    ranges, at = [], 1
    for number, rows in spark.read.schema("_range int, rows long").parquet(f"{path}/ranges").orderBy("_range").collect():
        ranges.append((number, at, rows))
        at += rows
    return PageIndex(spark, path, info["order"], StructType.fromJson(json.loads(info["schema"])), tuple(ranges))


def preview(df: DataFrame, n: int = 20, order: str = "id") -> DataFrame:
    return df.orderBy(order).limit(n)


def upsert_latest(base: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Keyed replacement: the row with the highest sequence number stays."""
    return keep_last(base.unionByName(changes), keys, [seq])


def annotation_status(df: DataFrame) -> DataFrame:
    both = F.col("explanation_correct_label").isNotNull() & F.col("hallucination_label").isNotNull()
    return df.withColumn(
        "annotation_status", F.when(both, F.lit("completed")).otherwise(F.lit("pending"))
    )


def preferred_layer_result(results: DataFrame, preferred: str) -> DataFrame:
    """Per chunk: the last result of the preferred layer, else the first of any."""
    wanted = F.col("layer_name") == preferred
    ranked = results.withColumns({
        "_wanted": wanted, "_turn": F.when(wanted, F.col("id")).otherwise(-F.col("id")),
    })
    return keep_last(ranked, ["task_id", "chunk_record_id"], ["_wanted", "_turn"]).drop("_wanted", "_turn")


def dashboard_counts(**tables: DataFrame) -> DataFrame:
    """One row with the size of each table."""
    parts = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        parts = n if parts is None else parts.unionByName(n)
    return parts.agg(*[F.sum(F.when(F.col("name") == t, F.col("n"))).alias(t) for t in tables])
