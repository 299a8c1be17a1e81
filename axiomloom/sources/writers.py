"""Table and run-log writers (plain UTF-8). ``exports`` has one-document CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Without these Spark trims every cell it writes.
KEEP_SPACE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error",
                partition_by: tuple[str, ...] = ()) -> None:
    if fmt not in {"csv", "json", "parquet"}:
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="", **KEEP_SPACE)
    elif fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.parquet(path)


def append_run_record(df: DataFrame, path: str) -> None:
    """Append records to a run log; each append adds files and rewrites none."""
    df.write.mode("append").csv(path, header=True, quoteAll=True, escape='"', emptyValue="", **KEEP_SPACE)
