"""Per-document statistics of the three layers and their summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axioms import complete
from ..functions.text import not_blank, strip
from ..scale import keep_first


def layer1_stats(docs: DataFrame) -> DataFrame:
    """Distinct terms and complete triples of each document, inside its row."""
    terms = F.array_distinct(F.filter(F.transform("terms", strip), lambda t: t != ""))
    triples = F.array_distinct(F.filter(
        F.transform("triples", lambda t: F.struct(
            strip(t["subject"]).alias("s"),
            strip(F.coalesce(F.nullif(t["relation"], F.lit("")), t["predicate"])).alias("r"),
            strip(t["object"]).alias("o"))),
        lambda t: (t["s"] != "") & (t["r"] != "") & (t["o"] != ""),
    ))
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))
    return docs.select(
        "doc_id", "domain", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        size(terms).alias("term_count"), size(triples).alias("triple_count"),
    )


def layer2_stats(docs: DataFrame) -> DataFrame:
    """Distinct refined terms and their kinds; the type map wins over the list.

    In the map the last value of a name counts, in the list the first.
    """
    has_map = F.coalesce(F.size("type_map"), F.lit(0)) > 0
    form = lambda name, kind, order: F.struct(strip(name).alias("name"), strip(kind).alias("type"), order.alias("order"))
    mapped = F.transform(F.map_entries("type_map"), lambda e, i: form(e["key"], e["value"], -i))
    listed = F.transform("normalized_terms", lambda e, i: form(e["normalized"], e["type"], i))
    # one frame for both kinds of document: a union of two frames with the same keys may fail
    terms = docs.select("doc_id", F.explode(F.when(has_map, mapped).otherwise(listed)).alias("e")).select("doc_id", "e.*")
    chosen = keep_first(terms.filter((F.col("name") != "") & (F.col("type") != "")), ["doc_id", "name"], ["order"])
    counts = chosen.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("refined_term_count"),
        *[F.count_if(F.col("type") == k).alias(f"{k.lower()}_count") for k in ("Class", "Property", "Instance")],
    )
    return docs.select("doc_id", "domain").join(counts, "doc_id", "left").na.fill(0)


PAIR_LISTS = {
    "subclass": ("subClassOf", "sub", "super"),
    "subproperty": ("subPropertyOf", "sub", "super"),
    "domain": ("domain_axioms", "property", "class"),
    "range": ("range_axioms", "property", "class"),
}


def layer3_stats(docs: DataFrame) -> DataFrame:
    """Distinct complete pairs per axiom kind and their sum, inside the row."""

    def pairs(column: str, left: str, right: str) -> Column:
        kept = F.array_distinct(F.filter(
            F.transform(column, lambda p: F.struct(strip(p[left]).alias("a"), strip(p[right]).alias("b"))),
            lambda p: (p["a"] != "") & (p["b"] != "")))
        return F.coalesce(F.nullif(F.size(kept), F.lit(-1)), F.lit(0))

    counts = {k: pairs(*v) for k, v in PAIR_LISTS.items()}
    out = docs.select("doc_id", F.col("domain"), *[c.alias(f"{k}_count") for k, c in counts.items()])
    total = sum((F.col(f"{k}_count") for k in PAIR_LISTS), F.lit(0))
    return out.withColumn("axiom_count", total)


def layer_summary(papers: DataFrame, measures: Mapping[str, Sequence[str]], digits: int | None = 2) -> DataFrame:
    """Averages (and minima, maxima) per domain and overall, in one aggregation.

    ``measures`` maps a column to the statistics wanted of it.
    """
    stats = {"avg": F.avg, "min": F.min, "max": F.max}
    aggs = []
    for column, wanted in measures.items():
        for name in wanted:
            value = stats[name](column)
            if name == "avg" and digits is not None:
                value = F.round(value, digits)
            aggs.append(value.alias(f"{name}_{column}"))
    return papers.rollup("domain").agg(
        F.grouping("domain").alias("_all"), F.count(F.lit(1)).alias("paper_count"), *aggs
    ).withColumn("domain", F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col("domain"))).drop("_all")


def elapsed_seconds(docs: DataFrame, file_times: DataFrame) -> DataFrame:
    """The stated seconds when they parse, else the span of the file times."""
    spans = file_times.groupBy("doc_id").agg((F.max("mtime") - F.min("mtime")).alias("_span"))
    return docs.join(spans, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("stated_seconds").try_cast("double"), F.col("_span")).alias("elapsed_seconds")
    )


def doc_run_record(terms: DataFrame, triples: DataFrame, notes: DataFrame, chunks: DataFrame,
                   fields: Sequence[str] = ("subject", "relation", "object", "chunk", "context"),
                   ) -> tuple[DataFrame, DataFrame]:
    """(one summary row per document, its notes) from its long tables.

    Notes stay one row per failed chunk; in chunk order they are the remark of
    the record. The record carries their number.
    """
    kept = notes.filter(not_blank("note"))
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    valid = triples.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("triple_count"), F.count_if(complete(*fields)).alias("valid_triple_count"))
    out = count(chunks, "chunk_count")
    for part in (count(terms, "term_count"), valid, count(kept, "note_count")):
        out = out.join(part, "doc_id", "left")
    return out.na.fill(0), kept.select("doc_id", "chunk_no", "note")
