"""Readers. Every reader takes an explicit schema; files are never inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.text import not_blank, strip
from ..scale import shuffled_join
from ..session import cut_lineage

DOMAINS = ("medical", "geography", "transportation")


def spread_few_files(df: DataFrame) -> DataFrame:
    """Spread a table of fewer files than cores, whose row groups cannot be
    split further. A table of many files is returned as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def scan_axiom_csv(spark: SparkSession, path: str, schema: StructType = schemas.AXIOM_CSV) -> DataFrame:
    """Axiom table with a header row and quoted cells that may span lines."""
    return spark.read.csv(
        path, schema=schema, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8"
    )


def clean_triples(df: DataFrame) -> DataFrame:
    """Drop the header-like row and every row with a blank field."""
    low = lambda c: F.lower(strip(c))
    header = (low("subject") == "entity") & (low("predicate") == "relation") & (low("object") == "value")
    return df.filter(not_blank("subject") & not_blank("predicate") & not_blank("object") & ~header)


def scan_triples_tsv(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Headerless triple dump; rows with another number of fields are skipped.

    A gzip file is a single split, so ``partitions`` can spread it once on read.
    """
    rows = spark.read.csv(path, schema=schemas.TRIPLE, sep="\t", mode="DROPMALFORMED")
    rows = clean_triples(rows)
    return rows.repartition(partitions) if partitions else rows


def resolve_column(df: DataFrame, *names: str) -> str | None:
    """The first column whose lower-cased name is one of ``names``."""
    wanted = {n.lower() for n in names}
    return next((c for c in df.columns if c.lower() in wanted), None)


def scan_property_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Property table read as text with nulls as ''."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')
    return rows.na.fill("")


def domain_of_path(path) -> F.Column:
    """The first path part that names a known domain, else 'unknown'."""
    parts = F.split(F.lower(path), "/")
    known = F.array(*[F.lit(d) for d in DOMAINS])
    return F.coalesce(
        F.get(F.filter(parts, lambda p: F.array_contains(known, p)), F.lit(0)), F.lit("unknown")
    )


def _most_columns(spark: SparkSession, path: str, width: int) -> int:
    """At least the columns of the widest header below a folder, at most ``width``. A first line that is not
    plainly a whole header (blank, a quote left open or inside a cell) counts as ``width``."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.{csv,CSV}").select(
        F.col("_metadata.file_path").alias("path"), F.struct(
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("no"), "value")
    first = lines.groupBy("path").agg(F.regexp_replace(F.min_by("value", "no"), "^\ufeff", "").alias("line"))
    cell = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
    plain = (F.trim("line") != "") & F.col("line").rlike(f"^{cell}(?:,{cell})*+$")
    commas = F.length("line") - F.length(F.replace("line", F.lit(",")))
    return first.agg(F.max(F.when(plain, F.least(commas + 1, F.lit(width))).otherwise(width))).first()[0] or 1


def scan_rows_csv(spark: SparkSession, path: str, width: int = 256, breaks: bool = True) -> DataFrame:
    """(path, payload): every row of the CSV files below a folder as a JSON object named by its file's header.

    Files may differ in their columns. Where cells hold line ``breaks``, a file is
    parsed as a stream in one task, a row at a time; without them large files are
    split over tasks. A byte order mark is dropped, of equal column names the last
    counts, and cells beyond the header are left out. A file of ``width`` columns or
    more is refused. Rows are parsed with as many columns as the headers may have: Spark
    handles an error for every column that a row lacks.
    """
    columns = _most_columns(spark, path, width)
    cells = [f"c{i}" for i in range(columns)]
    files = spark.read.csv(
        path, schema=", ".join(f"{c} string" for c in cells), header=False, multiLine=breaks, quote='"', escape='"',
        encoding="UTF-8", recursiveFileLookup=True, pathGlobFilter="*.{csv,CSV}")
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    wide = F.col(cells[-1]).isNotNull() & F.lit(columns == width)
    rows = files.select(
        F.col("_metadata.file_path").alias("path"), place.alias("no"),
        F.when(wide, F.raise_error(F.lit(f"a CSV file has {width} columns or more"))).otherwise(F.array(*cells)).alias("cells"))
    header = rows.groupBy("path").agg(F.min("no").alias("first"), F.min_by("cells", "no").alias("names"))
    names = F.transform("names", lambda n, i: F.when(i == 0, F.regexp_replace(n, "^\ufeff", "")).otherwise(n))
    # What a file's rows are named by, found once a file: its last column of each name, with its place.
    placed = F.filter(F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("at"))), lambda x: x["name"].isNotNull())
    last = header.select("path", "first", F.posexplode(placed).alias("_i", "x")).groupBy("path", "first", "x.name").agg(F.max("x.at").alias("at"))
    kept = last.groupBy("path", "first").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("kept"))  # at most width
    named = shuffled_join(rows, kept, ["path"]).filter("no <> first")
    pairs = F.transform("kept", lambda k: F.struct(k["name"], F.get("cells", k["at"])))
    return named.select("path", F.to_json(F.map_from_entries(pairs)).alias("payload"))


def _in_file_order(lines: DataFrame, made: str, over: F.Column, merged: F.Column) -> DataFrame:
    """Adds ``made``: a running value over the lines before each line of its file. ``over``
    runs inside a split (its lines are one task's anyway), ``merged`` over the splits before."""
    inside = W.partitionBy("path", "split").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = lines.groupBy("path", "split").agg(merged.alias("_all"))
    lines = cut_lineage(lines, "json-lines")
    last = made == "event"
    carried = F.last("_all", ignorenulls=True) if last else F.sum("_all")
    splits = splits.withColumn("_before", carried.over(before)).drop("_all")
    here = over.over(inside)
    value = F.coalesce(here, F.col("_before")) if last else F.coalesce(here, F.lit(0)) + F.coalesce("_before", F.lit(0))
    return shuffled_join(lines, splits, ["path", "split"]).withColumn(made, value).drop("_before")


def scan_json_items(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """(path, no, payload): JSON files below a folder, one list element or root entry a row.

    For indented files. They are read by lines, so a large file is split over tasks; a
    JSON string never holds a line break, so the bracket depth of a line follows from the
    counts of the lines before, added up inside splits and then over splits. A payload is
    JSON of the file's own shape with that one part: ``[element]``, ``{"list":[element]}``
    or ``{"name": value}``; parts that share a line stay together. A file of another layout
    (a single line, brackets that leave a list inside a line, open strings) is one payload,
    its whole text. Blank files give no row.
    """
    text = F.regexp_replace("value", "^\ufeff", "")
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=names).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("no"), text.alias("value"), F.trim(F.translate(text, "\t\r", "  ")).alias("t"),
    ).filter("t <> ''")
    bare = F.regexp_replace(F.regexp_replace("t", r"\\.", ""), '"[^"]*"', "")
    step = lambda acc, c: F.struct((acc["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("d"), F.least(
        acc["low"], acc["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("low"))
    marks = F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda c: c != "")
    texts = cut_lineage(lines.withColumns({
        "move": F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), step), "open": F.contains(bare, F.lit('"')),
        "opens": F.nullif(F.regexp_extract("t", r'^("[^"\\]*")\s*:\s*\[$', 1), F.lit("")),
        "mark": F.when(F.length("t") <= 2, F.col("t")).otherwise(F.lit(""))}), "json-text")
    lines = texts.drop("value", "t")
    lines = _in_file_order(lines, "b", F.sum("move.d"), F.sum("move.d")).withColumn("a", F.col("b") + F.col("move.d"))
    roots = lines.groupBy("path").agg(F.min_by("mark", F.struct("split", "no")).alias("root"))
    lines = shuffled_join(lines, roots, ["path"])
    name = F.when((F.col("root") == "{") & (F.col("b") == 1) & (F.col("a") == 2), F.col("opens"))
    closes = (F.col("root") == "{") & (F.col("b") == 2) & (F.col("a") == 1) & F.col("mark").isin("]", "],")
    lines = lines.withColumn("says", F.when(name.isNotNull(), name).when(closes, F.lit("")))
    last = F.max_by("says", F.when(F.col("says").isNotNull(), F.col("no")))
    lines = _in_file_order(lines, "event", F.last("says", ignorenulls=True), last)
    listed = F.coalesce(F.col("event") != "", F.lit(False))
    frame = (F.col("b") == 0) | ((F.col("b") == 1) & (F.col("a") == 0) & F.col("mark").isin("]", "}")) | F.coalesce(
        (F.col("says") != "") | (listed & (F.col("says") == "")), F.lit(False))
    floor = F.when(listed, 2).otherwise(1)
    odd = F.col("open") | ~F.col("root").isin("[", "{") | ((F.col("b") == 0) & ((F.col("mark") != F.col("root")) | (F.col("a") != 1))) | (
        ~frame & (F.col("b") + F.col("move.low") < floor))
    lines = lines.withColumns({"listed": listed, "frame": frame, "odd": odd, "ends": (~frame & (F.col("a") == floor)).cast("int")})
    lines = _in_file_order(lines, "unit", F.sum("ends"), F.sum("ends"))
    whole = lines.groupBy("path").agg((F.max("odd") | (F.sum("move.d") != 0) | (F.count_if(F.col("b") == 0) != 1)).alias("whole"))
    chosen = shuffled_join(shuffled_join(lines, whole, ["path"]).filter("whole or not frame"), texts.select("no", "value"), ["no"])
    parts = chosen.groupBy(
        "path", "whole", F.when(F.col("whole"), F.lit(0)).otherwise(F.col("unit")).cast("bigint").alias("no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "no", "value"))), lambda x: x["value"]), "\n").alias("text"),
        F.first("root").alias("root"), F.first("event").alias("event"), F.first("listed").alias("listed"))
    part = F.regexp_replace("text", r",\s*$", "")
    return parts.select("path", "no", F.when(F.col("whole"), F.col("text")).when(F.col("root") == "[", F.concat(F.lit("["), part, F.lit("]")))
                        .when(F.col("listed"), F.concat(F.lit("{"), "event", F.lit(":["), part, F.lit("]}")))
                        .otherwise(F.concat(F.lit("{"), part, F.lit("}"))).alias("payload"))


def scan_results_tree(spark: SparkSession, sources: Mapping[str, str], items: bool = False, breaks: bool = True) -> DataFrame:
    """Results below each method's folder: method, path, domain, payload. A JSON file is
    one payload, or with ``items`` an element of an indented file is; a row of a CSV file is one,
    whose cells may hold line ``breaks``."""
    frames = []
    for method, path in sources.items():
        files = scan_json_items(spark, path).select("path", "payload") if items else spark.read.text(
            path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json"
        ).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
        frames += [f.select(F.lit(method).alias("method"), "path", domain_of_path(F.col("path")).alias("domain"), "payload")
                   for f in (files, scan_rows_csv(spark, path, breaks=breaks))]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def scan_doc_domain_map(spark: SparkSession, path: str) -> DataFrame:
    """File stem and parent folder of every text file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.txt").load(path).select("path")
    parts = F.split("path", "/")
    return files.select(
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("doc_id"),
        F.element_at(parts, -2).alias("domain"),
    )


def scan_layer_json(spark: SparkSession, path: str, schema: StructType,
                    required: Sequence[str] = (), per_file: bool = True) -> DataFrame:
    """One JSON object per file, or per line for large collections. Unreadable
    objects, and objects where a required list is missing or is not a list,
    keep their raw text in ``_corrupt``."""
    full = StructType(list(schema.fields)).add("_corrupt", "string")
    if per_file:
        raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    else:
        raw = spark.read.text(path, recursiveFileLookup=True)
    parsed = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("value"),
        F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt"}).alias("d"),
    )
    bad = F.col("d._corrupt").isNotNull()
    for name in required:
        bad = bad | F.col(f"d.{name}").isNull()
    return parsed.select(
        "path", *[F.col(f"d.{f.name}").alias(f.name) for f in schema.fields],
        F.when(bad, F.col("value")).alias("_corrupt"),
    )
