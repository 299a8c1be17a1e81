"""Exports as ordered documents. Each returns (seq, line); ``write_lines`` stores them in order."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_term
from .writers import KEEP_SPACE

# The formats' opening and closing lines and namespaces.
TURTLE_HEAD = (
    "@prefix : <http://example.org/ontology#> .",
    "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .",
    "@prefix owl: <http://www.w3.org/2002/07/owl#> .",
    "",
)
RDFXML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"',
    '         xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"',
    '         xmlns:owl="http://www.w3.org/2002/07/owl#"',
    '         xmlns:ex="http://example.org/ontology#">',
)
RDFXML_TAIL = ("</rdf:RDF>",)
NAMESPACE = "http://example.org/ontology#"

# Line patterns per axiom type; %s takes the subject, then the object.
TURTLE = {
    "class": ":%s a owl:Class .",
    "property": ":%s a owl:ObjectProperty .",
    "subClassOf": ":%s rdfs:subClassOf :%s .",
    "subPropertyOf": ":%s rdfs:subPropertyOf :%s .",
    "domain": ":%s rdfs:domain :%s .",
    "range": ":%s rdfs:range :%s .",
}
FUNCTIONAL = {
    "class": "Declaration(Class(:%s))",
    "property": "Declaration(ObjectProperty(:%s))",
    "subClassOf": "SubClassOf(:%s :%s)",
    "subPropertyOf": "SubObjectPropertyOf(:%s :%s)",
    "domain": "ObjectPropertyDomain(:%s :%s)",
    "range": "ObjectPropertyRange(:%s :%s)",
}


def _rdfxml(element: str, predicate: str | None = None) -> str:
    opened = f'  <owl:{element} rdf:about="{NAMESPACE}%s"'
    if predicate is None:
        return opened + " />"
    return f'{opened}><rdfs:{predicate} rdf:resource="{NAMESPACE}%s" /></owl:{element}>'


RDFXML = {
    "class": _rdfxml("Class"),
    "property": _rdfxml("ObjectProperty"),
    "subClassOf": _rdfxml("Class", "subClassOf"),
    "subPropertyOf": _rdfxml("ObjectProperty", "subPropertyOf"),
    "domain": _rdfxml("ObjectProperty", "domain"),
    "range": _rdfxml("ObjectProperty", "range"),
}


def _line(patterns: dict[str, str]) -> Column:
    s, o = safe_term("subject_term"), safe_term("object_term")
    line = F.lit(None).cast("string")
    for kind, pattern in patterns.items():
        args = [s, o][: pattern.count("%s")]
        line = F.when(F.col("axiom_type") == kind, F.format_string(pattern, *args)).otherwise(line)
    return line


def _export(axioms: DataFrame, patterns, head=(), tail=()) -> DataFrame:
    body = axioms.select(F.col("id").cast("bigint").alias("seq"), _line(patterns).alias("line"))
    return _framed(body.filter(F.col("line").isNotNull()), head, tail)


def _framed(body: DataFrame, head=(), tail=(), before: int = 0) -> DataFrame:
    """The lines between fixed ones; ``before`` is at most every ``seq`` of the body."""
    last = 2**62
    fixed = [(before + i - len(head), t) for i, t in enumerate(head)] + [(last + i, t) for i, t in enumerate(tail)]
    if not fixed:
        return body
    return body.unionByName(body.sparkSession.createDataFrame(fixed, "seq bigint, line string"))


def export_turtle(axioms: DataFrame) -> DataFrame:
    return _export(axioms, TURTLE, TURTLE_HEAD)


def export_rdfxml(axioms: DataFrame) -> DataFrame:
    return _export(axioms, RDFXML, RDFXML_HEAD, RDFXML_TAIL)


def export_owl_functional(axioms: DataFrame) -> DataFrame:
    return _export(axioms, FUNCTIONAL)


def export_axiom_json(axioms: DataFrame) -> DataFrame:
    """One ordered JSON object per axiom; nulls are written, the payload is nested."""
    payload = F.try_parse_json("payload_json")
    record = F.struct(
        F.col("id"), F.col("task_id").alias("taskId"),
        F.col("execution_mode").alias("executionMode"), F.col("source_layer").alias("sourceLayer"),
        F.col("axiom_type").alias("axiomType"), F.col("subject_term").alias("subjectTerm"),
        F.col("object_term").alias("objectTerm"), F.col("axiom_text").alias("axiomText"),
        payload.alias("payloadJson"),
    )
    return axioms.select(
        F.col("id").cast("bigint").alias("seq"),
        F.to_json(record, {"ignoreNullFields": "false"}).alias("line"),
    )


def csv_document(df: DataFrame, seq: str, bom: bool = True) -> DataFrame:
    """One CSV document: a header, then the rows by ``seq``, which is not written itself.

    Cells are quoted where they must be, quotes are doubled, nulls are empty. With
    ``bom`` the document starts with a byte order mark, as spreadsheets want it. A
    table without rows is its header.
    """
    names = [c for c in df.columns if c != seq]
    header = io.StringIO()
    csv.writer(header, lineterminator="").writerow(names)
    how = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", **{k: str(v).lower() for k, v in KEEP_SPACE.items()}}
    body = df.select(F.col(seq).cast("bigint").alias("seq"), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names]), how).alias("line"))
    return _framed(body, (("\ufeff" if bom else "") + header.getvalue(),), before=-(2**62))


def json_document(df: DataFrame, seq: str) -> DataFrame:
    """One indented JSON list of the rows by ``seq``, which is not written itself.

    A field is a line; nulls are written, nested values stay on their line. The
    last row is found by one maximum, so no row waits for another.
    """
    names = [c for c in df.columns if c != seq]

    def value(c: str) -> Column:
        told = F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"})
        return F.substring(told, F.lit(6), F.length(told) - 6)

    fields = [F.concat(F.lit(f"    {json.dumps(c, ensure_ascii=False)}: "), value(c)) for c in names]
    last = df.agg(F.max(seq).alias("last")).scalar()
    body = df.select(F.col(seq).cast("bigint").alias("seq"), F.concat(
        F.lit("  {\n"), F.concat_ws(",\n", *fields), F.lit("\n  }"), F.when(F.col(seq) < last, ",").otherwise("")).alias("line"))
    return _framed(body, ("[",), ("]",), before=-(2**62))


def write_lines(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """A document in ordered text parts: reading the parts in name order gives it.

    Lines are dealt to ranges of ``seq``, as many as there are shuffle partitions
    unless ``parts`` says otherwise. ``path``/manifest lists each part with its
    place, lines and bytes, written once all parts are there.
    """
    spark = lines.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, "seq").sortWithinPartitions("seq").select("line").write.text(f"{path}/parts")
    written = spark.read.text(f"{path}/parts").groupBy(F.col("_metadata.file_name").alias("part")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    place = F.regexp_extract("part", r"^part-(\d+)", 1).cast("int")
    written.select(place.alias("place"), "part", "lines", "bytes").coalesce(1).sortWithinPartitions("place").write.json(f"{path}/manifest")
