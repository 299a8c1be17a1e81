"""Evidence lookup for axioms and the quality rates built on it.

Evidence is kept long: one row per (axiom, list, value) with the position of
its first appearance, never one unbounded list per axiom. Axioms, keys, chunks
and contexts are matched and grouped by 128-bit numbers inside their document;
their texts are attached at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axioms import (
    baseline_confidence, keep_axiom, layered_confidence, naming_ok, quality_notes,
)
from ..functions.text import collapse, mentions, not_blank, page_range, shorten, split_identifier, strip
from ..scale import attach_within, salted_join, top_n
from ..session import cut_lineage

AXIOM = ["doc_id", "axiom_type", "item1", "item2"]


NO = ["doc_id", "a1", "a2"]
AT = ["g1", "g2", "t1", "t2"]
LISTS = ("chunk", "context", "page")


def _numbers(a: str, b: str, *parts: Column | str) -> list[Column]:
    """Two 64-bit hashes that stand for the parts; null if a part is."""
    whole = reduce(lambda x, y: x & y, [(F.col(p) if isinstance(p, str) else p).isNotNull() for p in parts])
    return [F.when(whole, F.xxhash64(*parts)).alias(a), F.when(whole, F.xxhash64(F.lit(1), *parts)).alias(b)]


def _numbered_axioms(axioms: DataFrame) -> DataFrame:
    """(doc_id, a1, a2, axiom): each distinct axiom once under its numbers; ``axiom`` holds its texts."""
    rows = axioms.select("doc_id", *_numbers("a1", "a2", *AXIOM[1:]), F.struct(*AXIOM[1:]).alias("axiom"))
    whole = F.when(F.col("a1").isNotNull(), F.col("axiom"))  # a filter on a1 would compute the axioms' texts twice
    return rows.groupBy(*NO).agg(F.any_value(whole).alias("axiom")).filter("axiom is not null")


def _chunk_info(chunks: DataFrame, with_text: bool) -> DataFrame:
    """Numbers of each chunk's name (g1, g2) and, with_text, of its trimmed text (t1, t2), with its pages."""
    rows = chunks.select("doc_id", *_numbers("g1", "g2", "chunk_id"), "page_start", "page_end",
                         *([strip("text").alias("text")] if with_text else []))
    return rows.select("*", *_numbers("t1", "t2", "text")) if with_text else rows


def _of_chunks(hits: DataFrame, info: DataFrame, parts: Sequence[str], gathered: bool, how: str = "left") -> DataFrame:
    """``hits`` with the ``parts`` of each row that ``info`` has for their chunk."""
    on = ["doc_id", "g1", "g2"]
    if not gathered:
        return hits.join(info.select(*on, *parts).distinct(), on, how)
    told = info.groupBy(*on).agg(F.collect_set(F.struct(*parts)).alias("_told"))
    rows = attach_within(hits, told, on, "_told").select(*hits.columns, F.explode_outer("_told").alias("_told"))
    return rows.select(*hits.columns, *[F.col(f"_told.{c}").alias(c) for c in parts])


def _page_lists(hits: DataFrame, info: DataFrame, gathered: bool = False) -> DataFrame:
    """(numbers, list, value, first_pos) of the pages of the chunks hit; grouped by page numbers, written at last."""
    pages = _of_chunks(hits, info, ["page_start", "page_end"], gathered, "inner").groupBy(
        *NO, "page_start", "page_end").agg(F.min("pos").alias("first_pos"))
    value = strip(page_range("page_start", "page_end"))
    return pages.select(*NO, F.lit("page").alias("list"), value.alias("value"), "first_pos").filter("value <> ''")


def _with_axioms(lists: DataFrame, numbered: DataFrame, gathered: bool) -> DataFrame:
    """The lists of the numbered axioms with the texts of these."""
    return attach_within(lists, numbered, NO, "axiom").filter("axiom is not null") if gathered else lists.join(numbered, NO)


def _shown(lists: DataFrame) -> DataFrame:
    return lists.select("doc_id", *[F.col(f"axiom.{c}").alias(c) for c in AXIOM[1:]], "list", "value", "first_pos")


def baseline_evidence(axioms: DataFrame, chunk_axioms: DataFrame, chunks: DataFrame,
                      min_rows: int | None = None, gathered: bool = False) -> DataFrame:
    """(axiom, list, value, first_pos): ``numbered_baseline`` with the axioms' texts."""
    return _shown(numbered_baseline(axioms, chunk_axioms, chunks, min_rows, gathered=gathered)[0])


def numbered_baseline(axioms: DataFrame, chunk_axioms: DataFrame, chunks: DataFrame, min_rows: int | None = None,
                      values: bool = True, gathered: bool = False, kept: Sequence[str] = LISTS) -> tuple[DataFrame, DataFrame]:
    """((numbers, axiom, list, value, first_pos), numbered axioms): chunks whose own output states the axiom, with their text and pages.

    ``chunk_axioms``: (doc_id, axiom_type, item1, item2, chunk, pos). Axioms, chunk
    names and texts are matched and grouped by number; texts join the result, those of
    axioms before the longer ones of chunks. ``gathered``: the rows of a document lie in
    one task in all three tables; then nothing is stored or moved. ``kept``: the lists wanted.
    """
    if not values:  # which axioms have chunks; no text is moved
        hits, numbered = _stated(axioms, chunk_axioms, min_rows, gathered)
        return hits.select(*NO, F.lit("chunk").alias("list")), numbered
    found, texts, numbered = _baseline(axioms, chunk_axioms, chunks, min_rows, gathered)
    found = found.filter(F.col("list").isin(*kept))
    return _with_texts(_with_axioms(found, numbered, gathered), texts, gathered), numbered


def _stated(axioms: DataFrame, chunk_axioms: DataFrame, min_rows: int | None, gathered: bool) -> tuple[DataFrame, DataFrame]:
    """((numbers, g1, g2, pos, chunk), numbered axioms): the chunks that state an axiom; if ``gathered``, one asked for or not."""
    options = {} if min_rows is None else {"min_rows": min_rows}
    numbered = _numbered_axioms(axioms)
    rows = chunk_axioms.filter(not_blank("chunk")).select(
        "doc_id", *_numbers("a1", "a2", *AXIOM[1:]), *_numbers("g1", "g2", "chunk"), strip("chunk").alias("chunk"), "pos")
    stated = rows.groupBy(*NO, "g1", "g2").agg(F.min("pos").alias("pos"), F.any_value("chunk").alias("chunk"))
    if gathered:
        return stated, numbered
    numbered = cut_lineage(numbered, "axioms")
    return cut_lineage(salted_join(cut_lineage(stated, "stated"), numbered.select(*NO), NO, "left_semi", **options), "hits"), numbered


def _baseline(axioms: DataFrame, chunk_axioms: DataFrame, chunks: DataFrame, min_rows: int | None,
              gathered: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((numbers, list, value, first_pos, ``AT``), chunk texts, numbered axioms). Chunk names and pages are
    values already; a context is found by the numbers ``AT`` of its text and of the first chunk that has it.
    """
    hits, numbered = _stated(axioms, chunk_axioms, min_rows, gathered)
    info = _chunk_info(chunks, with_text=True)
    info = info if gathered else cut_lineage(info, "chunks")
    told = info.withColumns({c: F.when(F.col("text") != "", F.col(c)) for c in ("t1", "t2")})
    places = _of_chunks(hits, told, ["t1", "t2", "page_start", "page_end"], gathered)
    none = F.lit(None)
    entry = lambda name, value, t1, t2: F.struct(
        F.lit(name).alias("list"), value.cast("string").alias("value"), t1.cast("bigint").alias("t1"), t2.cast("bigint").alias("t2"))
    entries = F.array(entry("chunk", F.col("chunk"), none, none), entry("context", none, F.col("t1"), F.col("t2")),
                      entry("page", strip(page_range("page_start", "page_end")), none, none))
    rows = places.select(*NO, "g1", "g2", "pos", F.explode(entries).alias("e")).select(*NO, "g1", "g2", "pos", "e.*")
    found = rows.filter("value <> '' or t1 is not null").groupBy(*NO, "list", "value", "t1", "t2").agg(
        F.min(F.struct("pos", "g1", "g2")).alias("at"))
    found = found.select(*NO, "list", "value", F.col("at.pos").alias("first_pos"), "at.g1", "at.g2", "t1", "t2")
    texts = info.filter("text <> ''").groupBy("doc_id", *AT).agg(F.any_value("text").alias("text"))
    return found, texts, numbered


def _with_texts(found: DataFrame, texts: DataFrame, gathered: bool) -> DataFrame:
    """The lists with the texts of contexts. The rows of a chunk come out next to each other, where files pack them best."""
    on = ["doc_id", *AT]
    out = attach_within(found, texts, on, "text") if gathered else found.join(texts, on, "left")
    return out.select(*[F.coalesce("value", "text").alias(c) if c == "value" else c for c in found.columns if c not in AT])


def _axiom_lookups(numbered: DataFrame) -> DataFrame:
    """The key numbers (k1, k2) under which each axiom is looked up in triples."""
    kind, a, b = F.col("axiom.axiom_type"), F.col("axiom.item1"), F.col("axiom.item2")
    look = lambda role, *keys: F.struct(*_numbers("k1", "k2", F.lit(role), *keys))
    lookups = (
        F.when(kind == "Class", F.array(look("end", a)))
        .when(kind == "Property", F.array(look("relation", a)))
        .when(kind == "subClassOf", F.array(look("end", a), look("end", b)))
        .when(kind == "subPropertyOf", F.array(look("relation", a), look("relation", b)))
        .when(kind == "domain", F.array(look("relation+subject", a, b)))
        .when(kind == "range", F.array(look("relation+object", a, b)))
    )
    return numbered.select(*NO, F.explode(lookups).alias("l")).select(*NO, "l.k1", "l.k2").distinct()


def layered_evidence(axioms: DataFrame, evidence: DataFrame, chunks: DataFrame,
                     min_rows: int | None = None, gathered: bool = False) -> DataFrame:
    """(axiom, list, value, first_pos): ``numbered_layered`` with the axioms' texts."""
    lists, numbered = numbered_layered(axioms, evidence, chunks, min_rows, gathered=gathered)
    return _shown(lists if gathered else _with_axioms(lists, numbered, gathered))


def _keyed(evidence: DataFrame) -> DataFrame:
    """Triples with their chunk and context, the numbers of these and of the keys they are found under."""
    rows = evidence.select("doc_id", "pos", *[strip(c).alias(c) for c in ("subject", "relation", "object", "chunk", "context")])
    key = lambda role, *keys: F.struct(*_numbers("k1", "k2", F.lit(role), *keys))
    return rows.select(
        "doc_id", "pos", "chunk", "context", *_numbers("g1", "g2", "chunk"),
        *_numbers("t1", "t2", F.nullif("context", F.lit(""))), F.array(
            key("end", "subject"), key("end", "object"), key("relation", "relation"), key("relation+subject", "relation", "subject"),
            key("relation+object", "relation", "object")).alias("keys"))


def _entries() -> Column:
    """The chunk and the context of a hit by their numbers."""
    return F.array(F.struct(F.lit("chunk").alias("list"), F.col("g1").alias("v1"), F.col("g2").alias("v2")),
                   F.struct(F.lit("context").alias("list"), F.col("t1").alias("v1"), F.col("t2").alias("v2")))


def _layered_within(axioms: DataFrame, evidence: DataFrame, chunks: DataFrame, values: bool = True,
                    kept: Sequence[str] = LISTS) -> tuple[DataFrame, DataFrame]:
    """((numbers, list, value, first_pos, v1, v2), (doc_id, v1, v2, text)) of documents that lie in one task each:
    chunks and contexts by number, pages as values. A posting meets all the axioms that look for its key.
    """
    keyed = _keyed(evidence)
    asked = _axiom_lookups(axioms.select("doc_id", *_numbers("a1", "a2", *AXIOM[1:]), F.struct(*AXIOM[1:]).alias("axiom")))
    asked = asked.groupBy("doc_id", "k1", "k2").agg(F.collect_list(F.struct("a1", "a2")).alias("axioms"))
    postings = keyed.select("doc_id", F.explode(F.array_distinct("keys")).alias("k"), "pos", "g1", "g2", "t1", "t2").select(
        "doc_id", "k.k1", "k.k2", "pos", "g1", "g2", "t1", "t2")
    found = attach_within(postings, asked, ["doc_id", "k1", "k2"], "axioms").select(
        "doc_id", F.explode("axioms").alias("a"), "pos", "g1", "g2", "t1", "t2")
    hits = found.groupBy("doc_id", F.col("a.a1").alias("a1"), F.col("a.a2").alias("a2"), "g1", "g2", "t1", "t2").agg(F.min("pos").alias("pos"))
    if not values:  # which axioms have contexts
        return hits.filter("t1 is not null").select(*NO, F.lit("context").alias("list")), None
    entries, page = _entries(), F.lit(None).cast("string")
    if "page" in kept:
        hits = _of_chunks(hits, _chunk_info(chunks, with_text=False), ["page_start", "page_end"], True)
        none = F.lit(None).cast("bigint")
        entries, page = F.concat(entries, F.array(F.struct(F.lit("page").alias("list"), none.alias("v1"), none.alias("v2")))), strip(page_range("page_start", "page_end"))
    rows = hits.select(*NO, "pos", page.alias("page"), F.explode(entries).alias("e"))
    rows = rows.select(*NO, "pos", "e.*", F.when(F.col("e.list") == "page", F.col("page")).alias("value"))
    rows = rows.filter(F.col("list").isin(*kept) & ((F.col("value") != "") | F.col("v1").isNotNull()))
    found = rows.groupBy(*NO, "list", "value", "v1", "v2").agg(F.min("pos").alias("first_pos"))
    names = F.array(F.struct(F.col("g1").alias("v1"), F.col("g2").alias("v2"), F.col("chunk").alias("text")),
                    F.struct(F.col("t1").alias("v1"), F.col("t2").alias("v2"), F.col("context").alias("text")))
    texts = keyed.select("doc_id", F.explode(names).alias("n")).select("doc_id", "n.*").groupBy("doc_id", "v1", "v2").agg(
        F.any_value("text").alias("text"))
    return found.select(*NO, "list", "value", "first_pos", "v1", "v2"), texts


def _with_values(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The lists of ``_layered_within`` with the texts of chunks and contexts."""
    out = attach_within(found, texts, ["doc_id", "v1", "v2"], "text").withColumn("value", F.coalesce("value", "text"))
    return out.filter("value <> ''").drop("v1", "v2", "text")


def numbered_layered(axioms: DataFrame, evidence: DataFrame, chunks: DataFrame, min_rows: int | None = None,
                     values: bool = True, gathered: bool = False, kept: Sequence[str] = LISTS) -> tuple[DataFrame, DataFrame]:
    """((numbers, list, value, first_pos), numbered axioms): evidence of the triples an axiom's ends occur in.

    ``evidence``: (doc_id, pos, subject, relation, object, chunk, context). An
    inverted index: every triple is stored once with numbers for its keys, chunk
    and context; a posting is (document, key number, row, position). Axioms list
    the keys they can be found under, so the disjunctive match is one equi join of
    integers, and first positions are minima over integers. Chunk names and
    contexts are read from the stored rows that came first. ``gathered``: the rows of a
    document lie in one task in all three tables; then nothing is stored or moved, and
    the lists have the axioms' texts too (``axiom``). ``kept``: the lists wanted.
    """
    if gathered:
        numbered = _numbered_axioms(axioms)
        found, texts = _layered_within(axioms, evidence, chunks, values, kept)
        return (_with_values(_with_axioms(found, numbered, True), texts) if values else found), numbered
    options = {} if min_rows is None else {"min_rows": min_rows}
    numbered = cut_lineage(_numbered_axioms(axioms), "axioms")
    stored = cut_lineage(_keyed(evidence).withColumn("row", F.monotonically_increasing_id()), "triples")
    postings = stored.select("doc_id", F.explode(F.array_distinct("keys")).alias("k"), F.struct("pos", "row").alias("at"), "g1", "g2", "t1", "t2")
    postings = postings.select("doc_id", "k.k1", "k.k2", "at", "g1", "g2", "t1", "t2")
    found = salted_join(postings, _axiom_lookups(numbered), ["doc_id", "k1", "k2"], "inner", **options)
    hits = cut_lineage(found.groupBy(*NO, "g1", "g2", "t1", "t2").agg(F.min("at").alias("at")), "hits")
    if not values:  # which axioms have contexts
        return hits.filter("t1 is not null").select(*NO, F.lit("context").alias("list")), numbered
    firsts = hits.select(*NO, "at", F.explode(_entries()).alias("e")).select(*NO, "at", "e.*").filter(
        F.col("v1").isNotNull() & F.col("list").isin(*kept)).groupBy(
        *NO, "list", "v1", "v2").agg(F.min("at").alias("at"))
    texts = firsts.select(*NO, "list", F.col("at.pos").alias("first_pos"), F.col("at.row").alias("row")).join(
        stored.select("row", "chunk", "context"), "row")
    value = F.when(F.col("list") == "chunk", F.col("chunk")).otherwise(F.col("context"))
    lists = texts.select(*NO, "list", value.alias("value"), "first_pos").filter("value <> ''")
    if "page" not in kept:
        return lists, numbered
    paged = hits.select(*NO, "g1", "g2", F.col("at.pos").alias("pos"))
    return lists.unionByName(_page_lists(paged, _chunk_info(chunks, with_text=False))), numbered


def _first_values(lists: DataFrame, name: str, n: int, sep: str, value: Column, out: str) -> DataFrame:
    rows = lists.filter(F.col("list") == name)
    kept = top_n(rows, NO, [F.col("first_pos"), F.col("value")], n)
    return kept.groupBy(*NO).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("first_pos", value.alias("v")))), lambda x: x["v"]), sep).alias(out))


def _by_number(lists: DataFrame) -> DataFrame:
    return lists.select("doc_id", *_numbers("a1", "a2", *AXIOM[1:]), "list", "value", "first_pos")


def _texts(numbered: DataFrame, *more: str) -> DataFrame:
    return numbered.select("doc_id", *[F.col(f"axiom.{c}").alias(c) for c in AXIOM[1:]], *more)


def axiom_flags(axioms: DataFrame, lists: DataFrame) -> DataFrame:
    """(axiom, explicit, reasonable, naming, keep): boolean aggregates over all contexts."""
    return _texts(numbered_flags(_by_number(lists), _numbered_axioms(axioms)), "explicit", "reasonable", "naming", "keep")


def numbered_flags(lists: DataFrame, numbered: DataFrame, gathered: bool = False) -> DataFrame:
    """(numbers, axiom, explicit, reasonable, naming, keep): contexts are read where their axiom's texts lie."""
    kind, hay = F.col("axiom.axiom_type"), F.lower(collapse("value"))
    both = kind.isin("domain", "range")
    says = F.when(kind.isin("Class", "Property") | both, mentions(hay, split_identifier("axiom.item1")) & (
        ~both | mentions(hay, split_identifier("axiom.item2"))))
    contexts = lists.filter(F.col("list") == "context")
    contexts = contexts if "axiom" in contexts.columns else contexts.select(*NO, "value").join(numbered, NO)
    flags = contexts.select(*NO, F.coalesce(says, F.lit(False)).alias("says")).groupBy(*NO).agg(
        F.struct(F.bool_or("says").alias("explicit"), F.lit(True).alias("reasonable")).alias("_flags"))
    out = attach_within(numbered, flags, NO, "_flags") if gathered else numbered.join(flags, NO, "left")
    out = out.select(*NO, "axiom", *[F.coalesce(F.col(f"_flags.{c}"), F.lit(False)).alias(c) for c in ("explicit", "reasonable")])
    out = out.withColumn("naming", naming_ok("axiom.axiom_type", "axiom.item1", "axiom.item2"))
    return out.withColumn("keep", keep_axiom(F.col("explicit"), F.col("reasonable"), F.col("naming")))


def axiom_quality(axioms: DataFrame, lists: DataFrame, **shown: int) -> DataFrame:
    """axiom_flags with short evidence and notes, see ``numbered_quality``."""
    return numbered_quality(_by_number(lists), _numbered_axioms(axioms), **shown)


def numbered_quality(lists: DataFrame, numbered: DataFrame, chunks_shown: int = 3, pages_shown: int = 2,
                     contexts_shown: int = 2, context_length: int = 220) -> DataFrame:
    """(axiom, flags, short evidence, notes): the ``*_shown`` first values per
    axiom are put next to each other for display.
    """
    out = numbered_flags(lists, numbered)
    for part in (
        _first_values(lists, "chunk", chunks_shown, ", ", F.col("value"), "_chunks"),
        _first_values(lists, "page", pages_shown, " | ", F.col("value"), "pages"),
        _first_values(lists, "context", contexts_shown, " || ", shorten("value", context_length), "evidence_text"),
    ):
        out = out.join(part, NO, "left")
    notes = quality_notes(F.col("_chunks"), F.col("explicit"), F.col("reasonable"), F.col("naming"))
    shown = out.withColumns({
        "pages": F.coalesce("pages", F.lit("")), "evidence_text": F.coalesce("evidence_text", F.lit("")), "notes": notes})
    return _texts(shown, "explicit", "reasonable", "naming", "keep", "pages", "evidence_text", "notes")


def evidence_confidence(axioms: DataFrame, lists: DataFrame, method: str) -> DataFrame:
    """Pre-annotation label: baseline by found chunks, layered by type and context."""
    have = lists.groupBy(*AXIOM).agg(
        F.bool_or(F.col("list") == "chunk").alias("_chunks"),
        F.bool_or(F.col("list") == "context").alias("_contexts"))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    label = baseline_confidence(has("_chunks")) if method == "baseline" else layered_confidence(
        "axiom_type", has("_contexts"))
    return axioms.select(*AXIOM).distinct().join(have, AXIOM, "left").select(*AXIOM, label.alias("confidence"))


def numbered_confidence(lists: DataFrame, numbered: DataFrame, method: str, gathered: bool = False) -> DataFrame:
    """evidence_confidence by number; only the list that the method asks for is read."""
    needed = "chunk" if method == "baseline" else "context"
    have = lists.filter(F.col("list") == needed).select(*NO).distinct().withColumn("_has", F.lit(True))
    out = attach_within(numbered, have, NO, "_has") if gathered else numbered.join(have, NO, "left")
    has = F.coalesce("_has", F.lit(False))
    label = baseline_confidence(has) if method == "baseline" else layered_confidence("axiom.axiom_type", has)
    return _texts(out.withColumn("confidence", label), "confidence")


def _rates(df: DataFrame, keys: Sequence[str], flags: dict[str, Column], digits: int | None) -> DataFrame:
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"{n}_count") for n, c in flags.items()])
    rate = lambda n: F.col(f"{n}_count") / F.col("total")
    return counted.withColumns({
        f"{n}_rate": rate(n) if digits is None else F.round(rate(n), digits) for n in flags})


def quality_rates(df: DataFrame, keys: Sequence[str] = ("method",), digits: int | None = 2) -> DataFrame:
    flags = {n: F.col(n) for n in ("explicit", "reasonable", "naming", "keep")}
    return _rates(df, keys, flags, digits)


def quality_rates_fair(df: DataFrame, keys: Sequence[str] = ("method",), digits: int | None = 2) -> DataFrame:
    """Adds acceptable axioms and extensions worth keeping."""
    e, r, k = F.col("explicit"), F.col("reasonable"), F.col("keep")
    flags = {"explicit": e, "extension_keep": ~e & r & k, "acceptable": e | (r & k), "keep": k, "naming": F.col("naming")}
    return _rates(df, keys, flags, digits)
