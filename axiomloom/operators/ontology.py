"""Flattening, merging, counting and ranking of ontology documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axioms import merged_evidence, parse_functional
from ..functions.text import as_col, not_blank, strip, strip_token
from ..scale import find_hot_keys, keep_first, rank_by_value, salt_hot_keys
from ..schemas import RESULT_ITEM

# Service axiom types in display order.
SERVICE_TYPES = ("class", "property", "subClassOf", "subPropertyOf", "domain", "range")
EDGES = ("subClassOf", "subPropertyOf", "domain", "range")


def distinct_first_seen(values) -> Column:
    """Trimmed, non-blank, distinct strings in their first order."""
    return F.array_distinct(F.filter(F.transform(as_col(values), strip), lambda v: v != ""))


def _names(column: str, kind: str) -> Column:
    """struct(kind, item1, item2) per name of a string list."""
    items = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return F.transform(items, lambda v: F.struct(
        F.lit(kind).alias("kind"), strip(v).alias("item1"), F.lit("").alias("item2")))


def _pairs(column: str, kind: str, left: str, right: str) -> Column:
    items = F.coalesce(
        F.col(column), F.array().cast(f"array<struct<`{left}`:string,`{right}`:string>>")
    )
    return F.transform(items, lambda v: F.struct(
        F.lit(kind).alias("kind"), strip(v[left]).alias("item1"), strip(v[right]).alias("item2")))


def _all_items(class_kind: str, property_kind: str, domain: str, range_: str) -> Column:
    """Every axiom of a document row, in the fixed kind order, as one array."""
    return F.concat(
        F.filter(_names("classes", class_kind), lambda x: x["item1"] != ""),
        F.filter(_names("properties", property_kind), lambda x: x["item1"] != ""),
        _pairs("subClassOf", "subClassOf", "sub", "super"),
        _pairs("subPropertyOf", "subPropertyOf", "sub", "super"),
        _pairs(domain, "domain", "property", "class"),
        _pairs(range_, "range", "property", "class"),
    )


def flatten_axioms(docs: DataFrame) -> DataFrame:
    """One row per axiom, numbered from 1 inside its document. Order lives in
    the document's own arrays, so no shuffle is needed."""
    rows = docs.select(
        "doc_id", "domain",
        F.posexplode(_all_items("Class", "Property", "domain_axioms", "range_axioms")).alias("_p", "_x"),
    )
    kind = F.col("_x.kind")
    predicate = (
        F.when(kind == "Class", F.lit("declare_class"))
        .when(kind == "Property", F.lit("declare_property")).otherwise(kind)
    )
    s, o = F.col("_x.item1"), F.col("_x.item2")
    return rows.select(
        "doc_id", "domain", (F.col("_p") + 1).alias("axiom_no"), kind.alias("axiom_type"),
        s.alias("subject"), predicate.alias("predicate"), o.alias("object"),
        strip(F.concat(s, F.lit(" "), predicate, F.lit(" "), o)).alias("axiom_text"),
    )


def service_axiom_rows(docs: DataFrame, execution_mode: str, source_layer: str) -> DataFrame:
    """Flattening used by the service: incomplete pairs dropped, JSON payload kept."""
    items = F.filter(
        _all_items("class", "property", "domain", "range"),
        lambda x: (x["item1"] != "") & (x["kind"].isin("class", "property") | (x["item2"] != "")),
    )
    rows = docs.select("task_id", F.posexplode(items).alias("_p", "_x"))
    kind, s, o = F.col("_x.kind"), F.col("_x.item1"), F.col("_x.item2")
    text = (
        F.when(kind == "class", F.concat(F.lit("Class("), s, F.lit(")")))
        .when(kind == "property", F.concat(F.lit("Property("), s, F.lit(")")))
        .otherwise(F.concat(s, F.lit(" rdfs:"), kind, F.lit(" "), o))
    )
    in_list = lambda c: F.to_json(F.array(c))  # a JSON text of its own, control characters included
    quoted = lambda c: F.substr(in_list(c), F.lit(2), F.length(in_list(c)) - 2)
    pair = lambda a, b: F.format_string(f'{{"{a}": %s, "{b}": %s}}', quoted(s), quoted(o))
    payload = (
        F.when(kind.isin("class", "property"), quoted(s))
        .when(kind.isin("subClassOf", "subPropertyOf"), pair("sub", "super"))
        .otherwise(pair("property", "class"))
    )
    return rows.select(
        "task_id", (F.col("_p") + 1).alias("row_no"),
        F.lit(execution_mode).alias("execution_mode"), F.lit(source_layer).alias("source_layer"),
        kind.alias("axiom_type"), s.alias("subject_term"),
        F.nullif(o, F.lit("")).alias("object_term"), text.alias("axiom_text"), payload.alias("payload_json"),
    )


def annotation_rows(docs: DataFrame, domain_map: DataFrame, model: str, config: str) -> DataFrame:
    """Blank review sheet: one row per axiom of a document with its evidence."""
    rows = docs.join(domain_map, "doc_id", "left").select(
        "doc_id", F.coalesce("domain", "folder").alias("domain"), F.posexplode("axioms").alias("_p", "_a")
    )
    return rows.select(
        F.lit(model).alias("model"), "domain", "doc_id", F.lit(config).alias("config"),
        (F.col("_p") + 1).alias("axiom_no"), strip("_a.subject").alias("subject"),
        strip("_a.relation").alias("relation"), strip("_a.object").alias("object"),
        merged_evidence("_a.chunk", "_a.evidence").alias("evidence"),
        F.lit("").alias("is_correct"), F.lit("").alias("error_type"), F.lit("").alias("remark"),
    )


def _payload_items(payloads: DataFrame) -> DataFrame:
    """(method, domain, listed, item): every candidate record as JSON text.

    ``listed`` names the list an item came from; rows of a list payload and a
    single-row payload have none. Items stay text here, so one value that is
    not an object does not spoil its neighbours.
    """
    given = lambda c: F.nullif(strip_token(c), F.lit(""))
    lists = "struct<method:string,domain:string,subClassOf:array<string>,subPropertyOf:array<string>>"
    base = payloads.withColumn("is_list", F.ltrim("payload").startswith("[")).select(
        "method", "domain", "payload", "is_list",
        F.when(F.col("is_list"), F.from_json("payload", "array<string>")).alias("rows"),
        F.when(~F.col("is_list"), F.from_json("payload", lists)).alias("doc"))
    tag = lambda items, kind: F.transform(items, lambda i: F.struct(F.lit(kind).alias("listed"), i.alias("item")))
    none = F.array().cast("array<struct<listed:string,item:string>>")
    of_list = F.concat(*[F.coalesce(tag(F.col(f"doc.{k}"), k), none) for k in ("subClassOf", "subPropertyOf")])
    has_lists = F.col("doc.subClassOf").isNotNull() | F.col("doc.subPropertyOf").isNotNull()
    plain = lambda items: F.transform(items, lambda i: F.struct(F.lit(None).cast("string").alias("listed"), i.alias("item")))
    items = F.when(F.col("is_list"), plain(F.col("rows"))).when(has_lists, of_list).otherwise(plain(F.array("payload")))
    return base.select(
        F.coalesce(given("doc.method"), "method").alias("method"),
        F.coalesce(given("doc.domain"), "domain").alias("domain"),
        F.explode(items).alias("x"),
    ).select("method", "domain", "x.listed", "x.item").filter(F.ltrim("item").startswith("{"))


def heterogeneous_axioms(payloads: DataFrame) -> DataFrame:
    """Hierarchy pairs from JSON payloads in any of the known spellings.

    Input: (method, domain, payload). A payload is an object with lists, a list
    of rows, or one row; ends come from four key pairs, else from the text. A
    row outside a list may name its own method, domain and axiom type.
    """
    given = lambda c: F.nullif(strip_token(c), F.lit(""))
    spellings = (("subject", "object"), ("sub", "super"), ("subjectTerm", "objectTerm"), ("child", "parent"))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"i.{n}"), F.lit("")) for n in names])
    parsed = _payload_items(payloads).withColumn("i", F.from_json("item", RESULT_ITEM))
    fields = parsed.select(
        F.when(F.col("listed").isNull(), F.coalesce(given("i.method"), "method")).otherwise(F.col("method")).alias("method"),
        F.when(F.col("listed").isNull(), F.coalesce(given("i.domain"), "domain")).otherwise(F.col("domain")).alias("domain"),
        F.coalesce("listed", strip_token(first("axiom_type", "axiomType", "type"))).alias("stated"),
        F.array(*[F.struct(strip_token(f"i.{a}").alias("left"), strip_token(f"i.{b}").alias("right")) for a, b in spellings]).alias("pairs"),
        first("axiom_text", "axiomText").alias("text"),
    )
    usable = lambda p: (p["left"] != "") & (p["right"] != "") & (p["left"] != p["right"])
    ends = fields.select(
        "method", "domain", "stated", F.get(F.filter("pairs", usable), F.lit(0)).alias("keyed"),
        *[parse_functional("text", F.lit(k)).alias(k) for k in ("subClassOf", "subPropertyOf")])
    known = F.col("stated").isin("subClassOf", "subPropertyOf")
    from_text = F.when(F.col("stated") == "subClassOf", F.col("subClassOf")).otherwise(F.col("subPropertyOf"))
    found = ends.select(
        "method", "domain",
        F.when(known, F.col("stated")).when(F.col("subClassOf").isNotNull(), F.lit("subClassOf"))
        .otherwise(F.lit("subPropertyOf")).alias("axiom_type"),
        F.when(known, F.coalesce("keyed", from_text)).otherwise(F.coalesce("subClassOf", "subPropertyOf")).alias("p"))
    return found.filter(F.col("p").isNotNull()).select(
        "method", "domain", "axiom_type", F.col("p.left").alias("sub"), F.col("p.right").alias("super"))


def union_merge(chunk_results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Ordered distinct union of the six lists over the chunk results of a key.

    Output is one row per merged item with the (chunk order, list position) of
    its first appearance; sorting by them gives the merged list. Partial
    minima are taken before the shuffle, which runs on the item, not the key.
    """
    items = chunk_results.select(
        *keys, F.col(order).alias("first_chunk"),
        F.posexplode(_all_items("class", "property", "domain", "range")).alias("first_pos", "_x"),
    ).select(
        *keys, F.col("_x.kind").alias("kind"), F.col("_x.item1").alias("item1"),
        F.col("_x.item2").alias("item2"), "first_chunk", "first_pos",
    ).filter(
        (F.col("item1") != "") & (F.col("kind").isin("class", "property") | (F.col("item2") != ""))
    )
    merged = items.groupBy(*keys, "kind", "item1", "item2").agg(
        F.min(F.struct("first_chunk", "first_pos")).alias("_f")
    )
    return merged.select(*keys, "kind", "item1", "item2", "_f.first_chunk", "_f.first_pos")


def merge_task_outputs(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Merged lists per task: successes of the layer its execution mode ends with."""
    layer = F.when(F.col("execution_mode") == "layered", F.lit("concept_modeling")).otherwise(F.lit("baseline"))
    chosen = results.join(tasks.select("task_id", layer.alias("layer_name")), ["task_id", "layer_name"])
    return union_merge(chosen.filter(F.col("run_status") == "success"), ["task_id"], "id")


def ontology_from_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged items per document, one summary row per document)."""
    merged = union_merge(chunks, ["doc_id"], "chunk_no")
    summary = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count_if(not_blank("error")).alias("failed_chunks")
    )
    counts = merged.groupBy("doc_id").pivot("kind", list(SERVICE_TYPES)).count().na.fill(0)
    return merged, summary.join(counts, "doc_id", "left").na.fill(0, list(SERVICE_TYPES))


def layer_groups(results: DataFrame) -> DataFrame:
    """Results of the three learning layers in (layer, chunk, id) order."""
    layers = ("semantic_network", "term_refinement", "concept_modeling")
    position = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer_name")).cast("int")
    return results.filter(F.col("layer_name").isin(*layers)).withColumn("layer_no", position).orderBy(
        "layer_no", "chunk_record_id", "id"
    )


def axiom_type_counts(tasks: DataFrame, axioms: DataFrame) -> DataFrame:
    """Six counts per task, zeros included, next to the task's run counters."""
    counts = axioms.groupBy("task_id").pivot("axiom_type", list(SERVICE_TYPES)).count()
    return tasks.join(counts, "task_id", "left").na.fill(0, list(SERVICE_TYPES))


def relation_counts(axioms: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("relation"), F.col("predicate"), F.lit("unknown"))
    label = F.coalesce(F.nullif(strip(name), F.lit("")), F.lit("unknown"))
    return axioms.groupBy(label.alias("relation")).agg(F.count(F.lit(1)).alias("count"))


def chunk_run_stats(tasks: DataFrame, results: DataFrame, merged: DataFrame) -> DataFrame:
    ok = F.col("run_status") == "success"
    layers = ("semantic_network", "term_refinement", "concept_modeling")
    runs = results.groupBy("task_id").agg(
        *[F.count_if(ok & (F.col("layer_name") == x)).alias(f"{x}_success") for x in layers]
    )
    sizes = merged.groupBy("task_id").pivot("kind", list(SERVICE_TYPES)).count()
    names = [*[f"{x}_success" for x in layers], *SERVICE_TYPES]
    return tasks.join(runs, "task_id", "left").join(sizes, "task_id", "left").na.fill(0, names)


def degree_rank(axioms: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Rank inside each type by the degree of the ends over all edge axioms.

    Ranks come from a (type, weight) histogram, so the six types are never
    sorted as six groups.
    """
    options = {} if min_rows is None else {"min_rows": min_rows}
    linked = axioms.filter(F.col("axiom_type").isin(*EDGES) & (F.col("subject_term") != "") & (F.col("object_term") != ""))
    degree = linked.select(F.explode(F.array("subject_term", "object_term")).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("degree")
    )
    rows = axioms.withColumn("_key", F.coalesce(F.nullif("subject_term", F.lit("")), "object_term"))
    hot = {c: find_hot_keys(rows, [c], **options) for c in ("_key", "object_term")}
    rows = salt_hot_keys(rows, degree.select(F.col("term").alias("_key"), F.col("degree").alias("_s")), ["_key"], hot["_key"], "left")
    rows = salt_hot_keys(rows, degree.select(F.col("term").alias("object_term"), F.col("degree").alias("_o")), ["object_term"], hot["object_term"], "left")
    alone = F.col("axiom_type").isin("class", "property")
    weight = F.coalesce("_s", F.lit(0)) + F.when(alone, F.lit(0)).otherwise(F.coalesce("_o", F.lit(0)))
    weighted = rows.withColumn("weight", weight.cast("bigint")).drop("_key", "_s", "_o")
    return rank_by_value(weighted, ["axiom_type"], "weight", "rank")


def graph_elements(axioms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); a node keeps the type of its first appearance by axiom id."""
    edge = ~F.col("axiom_type").isin("class", "property") & (F.col("subject_term") != "") & (F.col("object_term") != "")
    property_source = F.col("axiom_type").isin("property", "subPropertyOf", "domain", "range")
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("subject_term").alias("node"),
                 F.when(property_source, F.lit("property")).otherwise(F.lit("class")).alias("type")),
        F.when(edge, F.struct(
            F.lit(1).alias("side"), F.col("object_term").alias("node"),
            F.when(F.col("axiom_type") == "subPropertyOf", F.lit("property")).otherwise(F.lit("class")).alias("type"))),
    )
    usable = edge | (F.col("axiom_type").isin("class", "property") & (F.col("subject_term") != ""))
    seen = axioms.filter(usable).select("task_id", "id", F.explode(ends).alias("e")).filter(F.col("e").isNotNull())
    seen = seen.select("task_id", "id", "e.side", "e.node", "e.type")
    nodes = keep_first(seen, ["task_id", "node"], ["id", "side"]).select("task_id", "node", "type")
    edges = axioms.filter(edge).select(
        "task_id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("edge_id"),
        F.col("subject_term").alias("source"), F.col("object_term").alias("target"),
        F.col("axiom_type").alias("label"),
    )
    return nodes, edges
