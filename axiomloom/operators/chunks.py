"""Chunking of text that is already extracted: one row per section or page.

A section or page is one row, so its text is folded inside that row; whatever
spans rows (numbering, next headings) is written with skew-safe helpers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, as_col, clean_title, collapse, let, rstrip, strip, title_id
from ..scale import dense_position
from ..session import cut_lineage

MAX_CHUNK = 5000
MIN_HEADINGS = 3

# Words that open a reference list.
REFERENCE_WORDS = ("references", "reference", "bibliography")
# Line starts and whole lines that are markup residue.
RESIDUE_STARTS = ("%PDF-", "<<", ">>", "/", "xref", "trailer")
RESIDUE_LINES = ("stream", "endstream", "endobj", "obj")
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def _pack(lengths: Column, n: int, test: int, first: int, more: int, gap: int) -> Column:
    """Greedy packing as a fold over piece lengths: struct(cur, off, starts).

    A piece opens a new chunk when cur + length + test > n. ``first``/``more``
    are what a piece adds besides its length, ``gap`` is the separator width.
    """
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("off"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, length: Column) -> Column:
        opens = (F.size(acc["starts"]) == 0) | (acc["cur"] + length + test > n)
        return F.struct(
            F.when(opens, length + first).otherwise(acc["cur"] + length + more).alias("cur"),
            (acc["off"] + length + gap).alias("off"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["off"]))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(lengths, start, step)


def _spans(packed: Column) -> Column:
    """Array of struct(start, end) from the starts and the final offset."""
    starts = packed["starts"]
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(packed["off"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(strip(text), rf"{SPACE}+"), lambda w: w != ""))


def chunk_sections(sections: DataFrame, n: int = MAX_CHUNK) -> DataFrame:
    """Chunks of each section's text, cut at '. ' and packed greedily.

    The separator is not counted when testing the limit but is re-added, so
    the last end may pass the text's length by two.
    """
    text = F.col("text")
    base = title_id("title")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    packed = _pack(F.transform(F.split(text, r"\. "), F.length), n, 0, 2, 2, 2)
    short = F.length(text) <= n
    rows = sections.select("*", short.alias("_short"), F.when(~short, packed).alias("_packed")).select(
        *sections.columns, "_short",
        F.posexplode(F.when(F.col("_short"), whole).otherwise(_spans(F.col("_packed")))).alias("_k", "_s"))
    width = F.col("_s.end") - F.col("_s.start")
    content = strip(F.substr(F.concat(text, F.lit(". ")), F.col("_s.start") + 1, width))
    rows = rows.withColumn("content", F.when(F.col("_short"), text).otherwise(content))
    kept = [c for c in sections.columns if c != "text"]
    return rows.select(
        *kept, (F.col("_k") + 1).alias("chunk_no"),
        F.when(F.col("_short"), base).otherwise(F.concat(base, (F.col("_k") + 1).cast("string"))).alias("chunk_id"),
        "content", F.col("_s.start").alias("start_char"), F.col("_s.end").alias("end_char"),
        word_count(F.col("content")).alias("word_count"),
    )


SENTENCE_GAP = "(?<=[.!?。！？]) +"


def chunk_pages(pages: DataFrame, n: int = MAX_CHUNK) -> DataFrame:
    """Chunks of each page's collapsed text with a document-wide index.

    ``pages``: (doc_id, page_no, text). The index is numbered by key ranges, so
    a document with very many pages is not sorted in one task.
    """
    rows = pages.withColumn("text", collapse("text")).filter(F.col("text") != "")
    text = F.col("text")
    packed = _pack(F.transform(F.split(text, SENTENCE_GAP), F.length), n, 1, 0, 1, 1)
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.length(text) + 1).alias("end")))
    rows = rows.select("*", F.when(F.length(text) > n, packed).alias("_packed")).select(
        "doc_id", "page_no", "text",
        F.posexplode(F.coalesce(_spans(F.col("_packed")), whole)).alias("_k", "_s"))
    content = F.substr(text, F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start") - 1)
    part = F.col("_k") + 1
    rows = rows.select(
        "doc_id", "page_no", part.alias("part"),
        F.format_string("page_%s_chunk_%s", F.col("page_no").cast("string"), part.cast("string")).alias("chunk_id"),
        F.format_string("Page %s", F.col("page_no").cast("string")).alias("section_title"),
        content.alias("text"),
    )
    chunks = cut_lineage(rows, "chunks")
    return dense_position(chunks, ["doc_id"], "page_no", "chunk_index", tie=["part"])


def valid_heading(title: Column | str) -> Column:
    t = strip(title)
    return t.rlike(r"(?i)^abstract\b") | t.rlike(r"^(?U:[\d.\s]*)[A-Z]")


def filter_headings(headings: DataFrame) -> DataFrame:
    return headings.filter(valid_heading("title"))


def cut_at_references(headings: DataFrame) -> DataFrame:
    """Drop the first reference heading of a document and all later ones.

    The cut is a minimum per document, aggregated before the shuffle."""
    low = F.lower(strip("title"))
    marks = low.contains("reference") | low.contains("bibliography")
    cut = headings.groupBy("doc_id").agg(F.min(F.when(marks, F.col("pos"))).alias("_cut"))
    return headings.join(cut, "doc_id").filter(F.col("_cut").isNull() | (F.col("pos") < F.col("_cut"))).drop("_cut")


def _next_at_or_above(headings: DataFrame) -> DataFrame:
    """(doc_id, no, next_page): the page of the next heading of the same or a higher level.

    ``headings``: (doc_id, no, level, page), numbered inside a document. For each
    level of a document the headings at it or above form a sequence; a heading's
    next one follows it in the sequence of its own level. Sequences are numbered by
    stored ranges, so the work is the headings times the levels, in any document.
    """
    levels = headings.filter("level is not null").groupBy("doc_id").agg(F.collect_set("level").alias("levels"))
    rows = headings.join(levels, "doc_id").select(
        "doc_id", "no", "level", "page", F.explode(F.filter("levels", lambda t: t >= F.col("level"))).alias("upto"))
    placed = cut_lineage(dense_position(cut_lineage(rows, "levels"), ["doc_id", "upto"], "no", "place"), "places")
    later = placed.select("doc_id", "upto", (F.col("place") - 1).alias("place"), F.col("page").alias("next_page"))
    return placed.filter("upto = level").join(later, ["doc_id", "upto", "place"]).select("doc_id", "no", "next_page")


def section_spans(headings: DataFrame, pages: DataFrame, most: int | None = None, least: int = MIN_HEADINGS) -> DataFrame:
    """Page span of each section: (doc_id, section_id, title, level, page_start, page_end).

    ``headings``: (doc_id, pos, title, level, page), pages 0-based; ``pages``:
    (doc_id, total_pages). A section ends before the next heading of the same
    or a higher level. Fewer than ``least`` valid headings, or more than ``most`` if it is
    given, make the document one section.
    """
    valid = filter_headings(headings)
    counts = valid.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter(
        (F.col("_n") >= least) & (F.lit(True) if most is None else F.col("_n") <= most)).select("doc_id")
    counts = cut_lineage(counts, "outlined-docs")
    outlined = cut_at_references(valid.join(counts, "doc_id", "left_semi")).select("doc_id", "pos", "level", "title", "page")
    numbered = cut_lineage(dense_position(cut_lineage(outlined, "outline"), ["doc_id"], "page", "no", tie=["pos", "level", "title"]), "numbered")
    nxt, page = F.col("next_page"), F.col("page")
    end = F.when(nxt.isNull(), F.col("total_pages") - 1).when(nxt == page, nxt).otherwise(nxt - 1)
    sections = numbered.join(_next_at_or_above(numbered), ["doc_id", "no"], "left").join(pages, "doc_id").select(
        "doc_id", F.concat(F.lit("section_"), F.col("no").cast("string")).alias("section_id"),
        clean_title("title").alias("title"), "level",
        (page + 1).cast("int").alias("page_start"), (end + 1).cast("int").alias("page_end"))
    whole = pages.join(counts, "doc_id", "left_anti").select(
        "doc_id", F.lit("section_1").alias("section_id"), F.lit("Complete Document").alias("title"),
        F.lit(1).alias("level"), F.lit(1).alias("page_start"), F.col("total_pages").cast("int").alias("page_end"))
    return sections.unionByName(whole)


def _before_first(lines: Column, hit) -> Column:
    """The lines before the first one for which hit(line, index) holds."""
    first = F.array_position(F.transform(lines, hit), True)
    return let(first, lambda at: F.when(at > 0, F.slice(lines, 1, (at - 1).cast("int"))).otherwise(lines))


def strip_references(text: Column | str) -> Column:
    """Cut at a heading-like reference line or at the start of a citation list."""

    def heading(line: Column) -> Column:
        def test(low: Column) -> Column:
            width = F.length(low)
            letters = F.regexp_replace(low, r"[^\p{L}]", "")
            hit = F.lit(False)
            for w in REFERENCE_WORDS:
                hit = hit | (low.startswith(w) & (width < 30)) | (low.contains(w) & (width < 20)) | (
                    (width < 30) & (letters == w))
            return hit

        return let(F.lower(strip(line)), test)

    def cut(lines: Column) -> Column:
        def with_citations(cited: Column) -> Column:
            follows = lambda i: F.size(F.filter(F.slice(cited, i + 1, F.lit(5)), lambda c: c)) >= 2
            return _before_first(lines, lambda l, i: heading(l) | (F.get(cited, i) & follows(i)))

        return let(F.transform(lines, lambda l: strip(l).rlike(r"^\[(?U:\d+)\]")), with_citations)

    return F.array_join(let(F.split(as_col(text), "\n"), cut), "\n")


def section_text(text: Column | str, title: Column | str, next_title: Column | str | None = None,
                 numbered: bool = True) -> Column:
    """Text after the title line, up to the next title or a short reference line;
    '' without a text. Titles that are not ``numbered`` keep digits and dots in front."""
    name_of = clean_title if numbered else collapse

    def after_title(lines: Column) -> Column:
        def matches(line: Column, name: Column) -> Column:
            return let(F.lower(clean_title(line)), lambda c: (F.contains(c, name) | F.contains(name, c)) & (
                F.length(name) > 5) & (F.length(c) > 5))

        found = let(F.lower(name_of(title)), lambda name: F.array_position(
            F.transform(lines, lambda l: matches(l, name)), True).cast("int"))
        return let(found, lambda at: F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(lines))

    body = let(F.split(F.coalesce(as_col(text), F.lit("")), "\n"), after_title)
    if next_title is None:
        return F.array_join(body, "\n")

    def ends(line: Column, after: Column) -> Column:
        def test(low: Column) -> Column:
            mark = F.lit(False)
            for w in REFERENCE_WORDS:
                mark = mark | low.contains(w)
            return F.contains(low, after) | (mark & (F.length(strip(line)) < 50))

        return let(F.lower(line), test)

    until = let(F.lower(name_of(next_title)), lambda after: let(
        body, lambda lines: _before_first(lines, lambda l, _i: ends(l, after))))
    return F.array_join(until, "\n")


def clean_extracted_text(text: Column | str) -> Column:
    def keep(line: Column) -> Column:
        residue = line.isin(*RESIDUE_LINES)
        for s in RESIDUE_STARTS:
            residue = residue | line.startswith(s)
        return (F.length(line) >= 3) & ~residue

    lines = F.filter(F.transform(F.split(as_col(text), LINE_BREAK), strip), keep)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"(?U)[^\S\r\n]+", " "))


def _rfind(text: Column, part: str) -> Column:
    at = F.locate(part[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at - len(part) + 1).otherwise(F.lit(-1))


def trim_at_break(text: Column | str, n: int) -> Column:
    """At most n characters, cut back to a break if it lies past 70 % of n."""
    c = as_col(text)
    cut = rstrip(F.left(c, F.lit(n)))
    last = F.greatest(_rfind(cut, "\n\n"), _rfind(cut, ". "), _rfind(cut, "\n"))
    shorter = F.when(last > n * 0.7, rstrip(F.left(cut, last))).otherwise(cut)
    return F.when(F.length(c) <= n, c).otherwise(shorter)


def chunk_records(chunks: DataFrame, lang: str = "en") -> DataFrame:
    """Chunks in the stored layout: id, metadata struct and text."""
    return chunks.select(
        "doc_id", F.col("chunk_id").alias("id"),
        F.struct(F.lit(lang).alias("lang"), F.col("title").alias("section_title"),
                 "page_start", "page_end").alias("metadata"),
        F.col("content").alias("text"))
