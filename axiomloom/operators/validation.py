"""Column checks, row validation, filters and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axioms import complete
from ..functions.text import not_blank, nullable_trim, strip
from ..scale import dense_position

# Required fields in the order they are checked, and messages.
REQUIRED = ("axiom_type", "subject", "predicate", "object", "source", "axiom_text")
OPTIONAL = ("negative_strategy", "subject_context", "object_context", "context_info")
BLANK_FIELD = "第 %s 行字段 %s 不能为空"
BAD_LABEL = "第 %s 行字段 label 只能为 0 或 1"
FIRST_DATA_ROW = 2


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    some = F.lit(False)
    for c in columns or df.columns:
        some = some | not_blank(F.col(c).cast("string"))
    return df.filter(some)


def first_error(row_number: Column) -> Column:
    """The first rule a row breaks, or null."""
    n = row_number.cast("string")
    label = nullable_trim("label")
    checks = [
        F.when(nullable_trim(f).isNull(), F.format_string(BLANK_FIELD, n, F.lit(f))) for f in REQUIRED
    ]
    checks.append(F.when(label.isNull(), F.format_string(BLANK_FIELD, n, F.lit("label"))))
    checks.append(F.when(~label.isin("0", "1"), F.format_string(BAD_LABEL, n)))
    return F.coalesce(*checks)


def validate_axioms(df: DataFrame, position: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects). ``position`` is the 0-based input order of the rows."""
    require_columns(df, [*REQUIRED, "label", position])
    row_number = F.col(position) + FIRST_DATA_ROW
    checked = df.withColumn("_error", first_error(row_number))
    optional = [c for c in OPTIONAL if c in df.columns]
    valid = checked.filter(F.col("_error").isNull()).select(
        F.col(position), *[nullable_trim(c).alias(c) for c in REQUIRED],
        strip("label").cast("int").alias("label"),
        *[nullable_trim(c).alias(c) for c in optional],
    )
    rejects = checked.filter(F.col("_error").isNotNull()).select(
        row_number.alias("row_number"), F.col("_error").alias("error")
    )
    return valid, rejects


def reject_report(rejects: DataFrame, shown: int = 20) -> DataFrame:
    """The first ``shown`` errors in row order, each with the number of errors not shown."""
    total = rejects.agg(F.count(F.lit(1)).alias("total"))
    first = rejects.orderBy("row_number").limit(shown)
    hidden = total.select(F.greatest(F.col("total") - shown, F.lit(0)).alias("more")).first()["more"]
    return first.withColumn("more", F.lit(hidden).cast("bigint"))


def load_axioms(df: DataFrame, position: str, errors_shown: int = 20) -> DataFrame:
    """All-or-nothing: the valid rows, or an error naming the first rejects."""
    valid, rejects = validate_axioms(df, position)
    shown = reject_report(rejects, errors_shown).collect()
    if shown:
        more = shown[0]["more"]
        tail = f" (and {more} more)" if more else ""
        raise ValueError("; ".join(r["error"] for r in shown) + tail)
    return valid


def assign_sample_ids(df: DataFrame, order: str, column: str = "id", pattern: str = "sample_%04d") -> DataFrame:
    """Number the rows in input order when they carry no id of their own."""
    if column in df.columns:
        return df
    numbered = dense_position(df, [], order, "_n")
    return numbered.withColumn(column, F.format_string(pattern, F.col("_n"))).drop("_n")


def filter_records(df: DataFrame, axiom_type: str | None = None, label: int | None = None,
                   source: str | None = None) -> DataFrame:
    if axiom_type:
        df = df.filter(F.col("axiom_type") == axiom_type)
    if label is not None:
        df = df.filter(F.col("label") == label)
    if source:
        df = df.filter(F.col("source").contains(source))
    return df


def filter_results(df: DataFrame, axiom_type: str | None = None, true_label: int | None = None,
                   predict_label: int | None = None, run_status: str | None = None) -> DataFrame:
    wanted = {
        "axiom_type": axiom_type.strip() if axiom_type else None, "true_label": true_label,
        "predict_label": predict_label, "run_status": run_status.strip() if run_status else None,
    }
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def search_tasks(df: DataFrame, name: str | None = None, status: str | None = None) -> DataFrame:
    if name and name.strip():
        df = df.filter(F.col("task_name").like(f"%{name.strip()}%"))
    if status:
        df = df.filter(F.col("task_status") == status.strip())
    return df.orderBy(F.col("created_time").desc(), F.col("id").desc())


def count_valid_triples(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("triples"), F.count_if(complete(*fields)).alias("valid_triples")
    )


def count_valid_axioms(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Complete axioms and distinct non-blank terms per key.

    Ends are exploded and counted once; the distinct runs on (keys, term), so
    terms are spread over tasks even when one key holds most rows.
    """
    flags = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("axioms"),
        F.count_if(complete("subject", "relation", "object", "evidence")).alias("valid_axioms"),
    )
    ends = df.select(*keys, F.explode(F.array(strip("subject"), strip("object"))).alias("term"))
    terms = ends.filter(F.col("term") != "").groupBy(*keys).agg(
        F.count_distinct("term").alias("terms")
    )
    return flags.join(terms, list(keys), "left").na.fill(0, ["terms"])


# Fragments of the skip reasons.
NO_OUTLINE, TOO_MANY = "没有找到书签结构", "书签数量过多"


def outcome_kind(success: Column, error: Column) -> Column:
    e = F.coalesce(error, F.lit(""))
    return (
        F.when(success, F.lit("ok"))
        .when(e.contains(NO_OUTLINE), F.lit("no_outline"))
        .when(e.contains(TOO_MANY), F.lit("too_many"))
        .otherwise(F.lit("failed"))
    )


def batch_outcome_stats(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of counters, one row per skipped file with its reason)."""
    kind = outcome_kind(F.col("success"), F.col("error"))
    tagged = files.withColumn("outcome", kind)
    stats = tagged.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("outcome") == k).alias(k) for k in ("ok", "no_outline", "too_many", "failed")],
    )
    reason = F.when(F.col("outcome") == "no_outline", F.concat("file_name", F.lit(": 无书签结构"))).otherwise(
        F.concat_ws(": ", "file_name", "error")
    )
    skipped = tagged.filter(F.col("outcome") != "ok").select("file_name", "outcome", reason.alias("reason"))
    return stats, skipped
