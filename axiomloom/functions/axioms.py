"""Expressions over axioms: rendering, parsing, naming and quality rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, as_col, not_blank, short_name, strip, strip_token

EDGE_TYPES = ("subClassOf", "subPropertyOf", "domain", "range")

CLASS_NAME = r"^[A-Z][A-Za-z0-9]*\z"
PROPERTY_NAME = r"^[a-z][A-Za-z0-9]*\z"

# Annotation words of the published tables.
YES, NO = "是", "否"
CONFIDENCE_HIGH, CONFIDENCE_REVIEW, CONFIDENCE_WRONG = "较高置信", "待复核", "可能错误"
NOTE_CHUNKS = "evidence chunks: "
NOTE_EXTENSION = "更接近建模扩展而非原文显式陈述"
NOTE_NAMING = "命名形式不规范"
NOTE_NO_CONTEXT = "未检索到稳定上下文证据"


def render_axiom(axiom_type, subject, predicate, obj) -> Column:
    t, s, o = as_col(axiom_type), short_name(subject), short_name(obj)
    return (
        F.when(t == "subClassOf", F.concat(s, F.lit(" ⊑ "), o))
        .when(t == "subPropertyOf", F.concat(s, F.lit(" ⊑p "), o))
        .when(t.isin("domain", "range"), F.concat(t, F.lit("("), s, F.lit(") = "), o))
        .otherwise(F.concat(s, F.lit(" "), as_col(predicate), F.lit(" "), o))
    )


def _pair(left: Column, right: Column) -> Column:
    return F.struct(left.alias("left"), right.alias("right"))


def parse_axiom(text, axiom_type) -> Column:
    """Strict inverse of render_axiom: struct(left, right), null when it does not parse."""
    c, t = as_col(text), as_col(axiom_type)
    by_sign = lambda sign: F.when(
        F.size(F.split(c, sign)) == 2,
        _pair(strip(F.split(c, sign)[0]), strip(F.split(c, sign)[1])),
    )
    functional = rf"\((.*?)\){SPACE}*={SPACE}*(.*)"
    by_call = lambda name: F.when(
        F.regexp_like(c, F.lit(rf"^{name}{functional}")),
        _pair(
            strip(F.regexp_extract(c, rf"^{name}{functional}", 1)),
            strip(F.regexp_extract(c, rf"^{name}{functional}", 2)),
        ),
    )
    return (
        F.when(t == "subClassOf", by_sign("⊑"))
        .when(t == "subPropertyOf", by_sign("⊑p"))
        .when(t == "domain", by_call("domain"))
        .when(t == "range", by_call("range"))
    )


def parse_axiom_loose(text) -> Column:
    """Best-effort ends of an axiom text; '⊑p' leaves its 'p' on the right end."""
    c = F.coalesce(as_col(text), F.lit(""))
    call = rf"(?i)(?:domain|range)\(([^)]+)\){SPACE}*={SPACE}*(.+)"
    words = F.split(strip(c), rf"{SPACE}+")
    halves = F.split(c, "⊑", 2)
    return (
        F.when(c.contains("⊑"), _pair(strip(halves[0]), strip(halves[1])))
        .when(
            F.regexp_like(c, F.lit(call)),
            _pair(strip(F.regexp_extract(c, call, 1)), strip(F.regexp_extract(c, call, 2))),
        )
        .when(F.size(words) >= 3, _pair(words[0], F.element_at(words, -1)))
        .otherwise(_pair(strip(c), F.lit("")))
    )


def parse_functional(text, axiom_type) -> Column:
    """Ends of ``SubClassOf(A B)`` or ``A subClassOf B``; blank or equal ends are null."""
    c, t = strip_token(text), as_col(axiom_type)

    def attempt(name: str) -> Column:
        call = rf"(?i){name}{SPACE}*\({SPACE}*(.+?){SPACE}+(.+?){SPACE}*\)"
        infix = rf"(?iU)([^\s()]+){SPACE}+{name}{SPACE}+([^\s()]+)"
        found = []
        for pattern in (call, infix):
            left = strip_token(F.regexp_extract(c, pattern, 1))
            right = strip_token(F.regexp_extract(c, pattern, 2))
            found.append(F.when((left != "") & (right != "") & (left != right), _pair(left, right)))
        return F.coalesce(*found)

    return F.when(t == "subClassOf", attempt("subClassOf")).when(
        t == "subPropertyOf", attempt("subPropertyOf")
    )


def naming_ok(axiom_type, item1, item2) -> Column:
    t, a, b = as_col(axiom_type), as_col(item1), as_col(item2)
    cls = lambda c: F.coalesce(c.rlike(CLASS_NAME), F.lit(False))
    prop = lambda c: F.coalesce(c.rlike(PROPERTY_NAME), F.lit(False))
    return (
        F.when(t == "Property", prop(a))
        .when(t == "Class", cls(a))
        .when(t == "subPropertyOf", prop(a) & prop(b))
        .when(t.isin("domain", "range"), prop(a) & cls(b))
        .otherwise(cls(a) & cls(b))
    )


def keep_axiom(explicit: Column, reasonable: Column, naming: Column) -> Column:
    return explicit | (reasonable & naming)


def quality_notes(first_chunks: Column, explicit: Column, reasonable: Column, naming: Column) -> Column:
    chunks = F.coalesce(first_chunks, F.lit(""))
    return F.concat_ws(
        "；",
        F.when(chunks != "", F.concat(F.lit(NOTE_CHUNKS), chunks)),
        F.when(~explicit & reasonable, F.lit(NOTE_EXTENSION)),
        F.when(~naming, F.lit(NOTE_NAMING)),
        F.when(~reasonable, F.lit(NOTE_NO_CONTEXT)),
    )


def baseline_confidence(has_chunks: Column) -> Column:
    return F.when(has_chunks, F.lit(CONFIDENCE_REVIEW)).otherwise(F.lit(CONFIDENCE_WRONG))


def layered_confidence(axiom_type, has_context: Column) -> Column:
    t = as_col(axiom_type)
    return (
        F.when(~has_context, F.lit(CONFIDENCE_WRONG))
        .when(t.isin("domain", "range", "Property"), F.lit(CONFIDENCE_HIGH))
        .when(t.isin("Class", "subClassOf", "subPropertyOf"), F.lit(CONFIDENCE_REVIEW))
        .otherwise(F.lit(CONFIDENCE_WRONG))
    )


def merged_evidence(chunk, evidence) -> Column:
    c, e = strip(chunk), strip(evidence)
    return F.when((c != "") & (e != ""), F.concat(c, F.lit(": "), e)).when(e != "", e).otherwise(c)


def complete(*parts) -> Column:
    """All parts are non-blank."""
    cond = F.lit(True)
    for p in parts:
        cond = cond & not_blank(p)
    return cond
