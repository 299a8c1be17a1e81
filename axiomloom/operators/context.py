"""Context descriptions for URIs and their attachment to axioms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import context_card, context_info
from ..functions.text import (
    classify_types, clip_text, infer_kind, infer_kind_by_namespace, norm_predicate, not_blank,
    short_name, short_uri, strip,
)
from ..scale import find_hot_keys, keep_first, keep_last, salt_hot_keys, top_n

META_FIELDS = ("description", "humanformat", "generalizations", "domain", "range")
EXTRA_FIELDS = ("generalizations", "domain", "range")


def distinct_uris(df: DataFrame, http_only: bool) -> DataFrame:
    ends = df.select(F.explode(F.array("subject", "object")).alias("uri"))
    keep = F.col("uri").startswith("http") if http_only else not_blank("uri")
    return ends.filter(keep).distinct().orderBy("uri")


def metadata_index(triples: DataFrame) -> DataFrame:
    """(subject, field, pos, value) in dump order: one row per value, so a
    subject with very many values is never collected into one list."""
    return triples.select(
        strip("subject").alias("subject"), norm_predicate("predicate").alias("field"),
        F.col("pos"), strip("object").alias("value"),
    ).filter(
        (F.col("subject") != "") & (F.col("value") != "") & F.col("field").isin(*META_FIELDS)
    )


def context_mapping(uris: DataFrame, index: DataFrame, extra_shown: int = 3) -> DataFrame:
    """One context row per URI: description > human format > template. ``extra_info``
    is for display and shows the first ``extra_shown`` values of a field."""
    described = index.filter(F.col("field").isin("description", "humanformat")).withColumn(
        "text", clip_text("value")
    ).filter(F.col("text") != "")
    texts = described.groupBy(F.col("subject").alias("uri")).agg(
        *[
            F.min_by(F.when(F.col("field") == f, F.col("text")),
                     F.when(F.col("field") == f, F.col("pos"))).alias(f)
            for f in ("description", "humanformat")
        ]
    )
    shown = top_n(index.filter(F.col("field").isin(*EXTRA_FIELDS)), ["subject", "field"],
                  [F.col("pos")], extra_shown)
    listed = shown.groupBy(F.col("subject").alias("uri")).agg(
        *[
            F.array_join(F.transform(
                F.sort_array(F.collect_list(
                    F.when(F.col("field") == f, F.struct("pos", short_name("value").alias("v"))))),
                lambda s: s["v"]), ", ").alias(f)
            for f in EXTRA_FIELDS
        ]
    )
    extra = clip_text(F.concat_ws(
        " | ", *[F.when(F.col(f) != "", F.concat(F.lit(f"{f}: "), F.col(f))) for f in EXTRA_FIELDS]
    ), 180)
    name, kind = short_name("uri"), infer_kind("uri")
    template = F.concat(
        name,
        F.when(kind == "Property", F.lit(" is a property"))
        .when(kind == "Class", F.lit(" is a class")).otherwise(F.lit(" is an entity")),
        F.lit(" in the NELL knowledge base."),
    )
    status = (
        F.when(F.col("description").isNotNull(), F.lit("ok"))
        .when(F.col("humanformat").isNotNull(), F.lit("partial"))
        .otherwise(F.lit("fallback"))
    )
    return uris.join(texts, "uri", "left").join(listed, "uri", "left").select(
        "uri", name.alias("name"), kind.alias("kind"), name.alias("label_en"),
        F.coalesce("description", "humanformat", template).alias("description"),
        extra.alias("extra_info"), F.lit("NELL_ontology").alias("source"), status.alias("status"),
    )


def _one_each(df: DataFrame, key: str) -> DataFrame:
    """One row per key, as a lookup table has it: the last by ``pos`` where there
    is such a column, else the greatest."""
    order = ["pos"] if "pos" in df.columns else [c for c in df.columns if c != key]
    return keep_last(df, [key], order)


def description_chain(uris: DataFrame, structured: DataFrame, lookups: Sequence[DataFrame]) -> DataFrame:
    """Structured rows first, then each (name, description, source) lookup in
    order, then a template; ``source`` and ``status`` record which one won.
    A key that a lookup holds twice counts once."""
    rows = uris.select("uri", short_uri("uri").alias("name"), infer_kind_by_namespace("uri").alias("kind"))
    known = _one_each(structured, "uri").select(
        "uri", F.col("label_en").alias("_label"), F.col("description").alias("_desc"),
        F.col("extra_info").alias("_extra"), F.lit(True).alias("_known"),
    )
    rows = rows.join(known, "uri", "left")
    text, origin = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, lookup in enumerate(lookups):
        found = _one_each(lookup.filter(not_blank("description")), "name").select(
            "name", F.col("description").alias(f"_d{i}"), F.col("source").alias(f"_s{i}")
        )
        rows = rows.join(found, "name", "left")
        origin = F.coalesce(origin, F.col(f"_s{i}"))
        text = F.coalesce(text, F.col(f"_d{i}"))
    kind = F.when(F.col("_known"), F.lit("Property")).otherwise(F.col("kind"))
    template = F.concat(
        F.col("name"),
        F.when(kind == "Property", F.lit(" is a property")).otherwise(F.lit(" is a class")),
        F.lit(" in the knowledge base."),
    )
    has = F.coalesce(F.col("_known"), F.lit(False))
    own = F.nullif(F.coalesce(F.col("_desc"), F.lit("")), F.lit(""))
    return rows.select(
        "uri", "name", kind.alias("kind"),
        F.when(has, F.coalesce(F.nullif("_label", F.lit("")), F.col("name"))).otherwise(F.col("name")).alias("label_en"),
        F.when(has, F.coalesce(own, template)).otherwise(F.coalesce(text, template)).alias("description"),
        F.when(has, F.coalesce("_extra", F.lit(""))).otherwise(F.lit("")).alias("extra_info"),
        F.when(has, F.lit("schema.org")).otherwise(F.coalesce(origin, F.lit("fallback"))).alias("source"),
        F.when(has, F.when(own.isNotNull(), F.lit("ok")).otherwise(F.lit("partial")))
        .otherwise(F.when(text.isNotNull(), F.lit("ok")).otherwise(F.lit("fallback"))).alias("status"),
    )


def first_english_values(bindings: DataFrame, most: int | None = None) -> DataFrame:
    """One row per URI from all its bindings, or from its ``most`` first ones."""
    rows = bindings if most is None else top_n(bindings, ["uri"], [F.col("pos")], most)

    def first(column: str):
        given = not_blank(column)
        return F.coalesce(
            F.min_by(F.when(given, strip(column)), F.when(given, F.col("pos"))), F.lit("")
        ).alias(column)

    grouped = rows.groupBy("uri").agg(
        first("label"), first("abstract"), first("comment"),
        F.collect_set(F.nullif(strip("type"), F.lit(""))).alias("types"),
    )
    silent = (F.col("abstract") == "") & (F.col("comment") == "")
    status = F.when(~silent, F.lit("ok")).when(F.col("label") != "", F.lit("partial")).otherwise(F.lit("missing"))
    return grouped.select(
        "uri", short_uri("uri").alias("name"), classify_types("types").alias("kind"),
        clip_text("label", 120).alias("label_en"), clip_text("abstract", 240).alias("abstract_en"),
        clip_text("comment", 240).alias("comment_en"), F.lit("DBpedia_SPARQL").alias("source"),
        status.alias("status"),
    )


def dedupe_mapping(df: DataFrame, order: str, policy: str = "first") -> DataFrame:
    keep = {"first": keep_first, "last": keep_last}[policy]
    return keep(df, ["uri"], [order])


def attach_context(axioms: DataFrame, mapping: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Add subject, object and combined context cards plus hit flags.

    A missing URI gets a fallback card. Very frequent ends are salted; a small
    mapping is broadcast by the planner after checking its size.
    """
    options = {} if min_rows is None else {"min_rows": min_rows}
    hot = {side: find_hot_keys(axioms, [side], **options) for side in ("subject", "object")}
    out = axioms
    for side in ("subject", "object"):
        cards = mapping.select(
            F.col("uri").alias(side),
            context_card("name", "kind", ["abstract_en", "comment_en", "label_en", "name"]).alias(f"_{side}_card"),
        )
        out = salt_hot_keys(out, cards, [side], hot[side], "left")
        miss = short_uri(side)
        fallback = context_card(miss, F.lit("Unknown"), [miss])
        out = out.withColumns({
            f"{side}_hit": F.col(f"_{side}_card").isNotNull(),
            f"{side}_context": F.coalesce(F.col(f"_{side}_card"), fallback),
        }).drop(f"_{side}_card")
    return out.withColumn("context_info", context_info(F.col("subject_context"), F.col("object_context")))


def context_hits(attached: DataFrame) -> DataFrame:
    return attached.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("subject_hit").alias("subject_hits"),
        F.count_if("object_hit").alias("object_hits"),
    )
