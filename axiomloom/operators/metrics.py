"""Classification, explanation and consistency metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.judgement import binary_label, clean_label


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 when the denominator is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def _cells(df: DataFrame, keys: Sequence[str], label: Column, pred: Column) -> DataFrame:
    """Row counts per key, label and prediction: a handful of rows per key.

    Grouping by the two values evaluates a parsed label once per row, however
    many counters are derived from it afterwards.
    """
    return df.groupBy(*keys, label.alias("_y"), pred.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))


def _confusion(cells: DataFrame, keys: Sequence[str], total: str, counted: Column) -> DataFrame:
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    cell = lambda t, p: count((F.col("_y") == t) & (F.col("_p") == p))
    return cells.groupBy(*keys).agg(
        count(counted).alias(total), cell(1, 1).alias("tp"), cell(0, 1).alias("fp"),
        cell(0, 0).alias("tn"), cell(1, 0).alias("fn"))


def _scores(total: Column, digits: int | None) -> list[Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [
        _rounded(c, digits).alias(n)
        for n, c in (("accuracy", ratio(tp + tn, total)), ("precision", p), ("recall", r), ("f1", f1))
    ]


def binary_metrics(df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred",
                   digits: int | None = None) -> DataFrame:
    """Confusion counts and scores per key; rows without a label or prediction are left out.

    One pass with map-side partial sums: a task sends one row per key.
    """
    both = F.col("_y").isNotNull() & F.col("_p").isNotNull()
    counted = _confusion(_cells(df, keys, F.col(label), F.col(pred)), keys, "samples", both)
    if keys:
        counted = counted.filter("samples > 0")
    return counted.select(*keys, "samples", "tp", "fp", "tn", "fn", *_scores(F.col("samples"), digits))


def parsed_vs_total(df: DataFrame, keys: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_samples"), F.count(pred).alias("parsed_samples")
    )


def accuracy_by_label(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    rows = df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull())
    return rows.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("samples"),
        ratio(F.count_if(F.col(label) == F.col(pred)), F.count(F.lit(1))).alias("accuracy"),
    ).withColumn("label_name", F.when(F.col("label") == 1, F.lit("positive")).otherwise(F.lit("negative")))


def service_metrics(df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred",
                    digits: int | None = None) -> DataFrame:
    """Scores over text labels. Values that are neither yes nor no still count
    in the total, so they lower the accuracy but not precision or recall."""
    given = df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull()).select(
        *keys, clean_label(label).alias("_label"), clean_label(pred).alias("_pred"))
    counted = _confusion(_cells(given, keys, binary_label("_label"), binary_label("_pred")), keys, "total", F.lit(True))
    return counted.select(*keys, "total", *_scores(F.col("total"), digits))


def explanation_rates_all(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Rates over all annotations, per model and overall (model is null)."""
    label = F.col("explanation_label")
    counted = df.rollup("model").agg(
        F.count(F.lit(1)).alias("total_annotations"),
        F.count_if(label == "correct").alias("correct_count"),
        F.count_if(label == "hallucination").alias("hallucination_count"),
        F.grouping("model").alias("is_overall"),
    )
    total = F.col("total_annotations")
    return counted.select(
        "model", "is_overall", "total_annotations", "correct_count", "hallucination_count",
        _rounded(ratio(F.col("correct_count"), total), digits).alias("explanation_accuracy"),
        _rounded(ratio(F.col("hallucination_count"), total), digits).alias("hallucination_rate"),
    )


def explanation_rates_correct(joined: DataFrame, keys: Sequence[str] = ("task_id",),
                              digits: int | None = None) -> DataFrame:
    """Rates whose denominator is every correct case, annotated or not."""
    counted = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("correct_case_count"),
        F.count_if(F.col("annotation_status") == "completed").alias("annotated_count"),
        F.count_if(F.col("explanation_correct_label") == 1).alias("explanation_correct_count"),
        F.count_if(F.col("hallucination_label") == 1).alias("hallucination_count"),
    )
    cases = F.col("correct_case_count")
    return counted.withColumns({
        "explanation_accuracy": _rounded(ratio(F.col("explanation_correct_count"), cases), digits),
        "hallucination_rate": _rounded(ratio(F.col("hallucination_count"), cases), digits),
    })


def macro_average(metrics: DataFrame, keys: Sequence[str], value: str = "accuracy") -> DataFrame:
    """Unweighted mean of per-dataset values."""
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("datasets"), F.avg(value).alias(f"macro_{value}")
    )


def summary(df: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Positive, negative and overall accuracy with P/R/F1 per key, in one pass."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return binary_metrics(df, keys, label, pred).select(
        *keys, "samples", ratio(tp, tp + fn).alias("positive_accuracy"),
        ratio(tn, tn + fp).alias("negative_accuracy"),
        F.col("accuracy").alias("overall_accuracy"), "precision", "recall", "f1",
    )


def error_cases(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.filter(F.col(label) != F.col(pred))


def leaderboard(metrics: DataFrame, name: str = "model", value: str = "accuracy") -> DataFrame:
    """Ranks aggregated metrics: one row per model, so the single window is small."""
    order = W.orderBy(F.col(value).desc())
    return metrics.withColumn("rank", F.dense_rank().over(order)).orderBy("rank", name)


def pivot_ordered(metrics: DataFrame, row: str, column: str, value: str,
                  rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fixed category order on both axes; absent cells are null."""
    position = F.array_position(F.array(*[F.lit(r) for r in rows]), F.col(row)).cast("int")
    table = metrics.filter(F.col(row).isin(*rows)).groupBy(row).pivot(column, list(columns)).agg(F.first(value))
    return table.withColumn("row_order", position).orderBy("row_order")


def stats_long(df: DataFrame) -> DataFrame:
    return df.groupBy("axiom_type", "label").agg(F.count(F.lit(1)).alias("count")).orderBy("axiom_type", "label")


def stats_wide(df: DataFrame) -> DataFrame:
    return df.rollup("axiom_type").agg(
        F.count_if(F.col("label") == 1).alias("positive_count"),
        F.count_if(F.col("label") == 0).alias("negative_count"),
        F.count_if(F.col("label").isin(0, 1)).alias("total"),
        F.grouping("axiom_type").alias("_all"),
    ).withColumn(
        "axiom_type", F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col("axiom_type"))
    ).orderBy("_all", "axiom_type").drop("_all")


def value_distribution(df: DataFrame, column: Column, n: int) -> DataFrame:
    """The n most frequent values; ties are broken by value."""
    return df.groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), "value"
    ).limit(n)
