"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (10 consecutive words; shorter items are one window) are sets
of 5-word shingles. A window can only occur where all its shingles do, so the
join needs a prefix of one token: its rarest shingle, by how often the corpus
holds it. A window with a shingle that the corpus never holds cannot occur at
all. Joined positions pass the length and position bounds and are then verified
word by word.

The corpus texts are read once: a Bloom filter over the benchmark's shingles,
sized by their number, leaves few positions of each text, kept with the words
around them. False positives of the filter fall out in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import lower_ascii, whole

WINDOW, SHINGLE = 10, 5
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_BITS, MOST_BITS = 16, 24   # log2 of the filter's bits; a larger benchmark only lets more positions through
BITS_PER_TOKEN = 32
PROBES = (0, 13, 26, 39)


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), DELIMITERS), lambda w: w != "")


def _hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(length)])


def _starts(size: Column, length: int) -> Column:
    return F.when(size >= length, F.sequence(F.lit(0), size - length)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(items: DataFrame, text: str, key: str) -> DataFrame:
    """(item_id, window, len): the windows of every item, null texts have none."""
    def of(ws: Column) -> Column:
        n = F.size(ws)
        long = F.transform(_starts(n, WINDOW), lambda i: F.array_join(F.slice(ws, i + 1, WINDOW), " "))
        return F.when(n >= WINDOW, long).when(n > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))
    windows = F.get(F.transform(F.array(words_of(whole(text))), of), 0)
    found = items.select(F.col(key).alias("item_id"), F.explode(windows).alias("window"))
    return found.withColumn("len", F.size(F.split("window", " ")))


def _tokens(windows: DataFrame) -> DataFrame:
    """(window, len, off, width, h): the shingles of distinct windows."""
    words = F.split("window", " ")
    width = F.least(F.col("len"), F.lit(SHINGLE))
    rows = windows.select("window", "len").distinct().select(
        "window", "len", words.alias("ws"), width.alias("width"),
        F.explode(F.sequence(F.lit(0), F.col("len") - width)).alias("off"))
    h = F.coalesce(*[F.when(F.col("width") == k, _hash(F.col("ws"), F.col("off"), k)) for k in range(1, SHINGLE + 1)])
    return rows.select("window", "len", "off", "width", h.alias("h"))


def _bloom(tokens: DataFrame, count: int):
    """A test for hashes: true for every token. At most 2**24 bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, (count * BITS_PER_TOKEN).bit_length()))
    mask = F.lit(2**bits - 1)
    at = tokens.select(F.explode(F.array(*[F.shiftrightunsigned("h", p).bitwiseAND(mask) for p in PROBES])).alias("p"))
    cells = at.groupBy((F.shiftright("p", 6)).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("v"))
    cell = [0] * (2**bits >> 6)
    for r in cells.collect():  # at most 2**18 rows by construction
        cell[r["cell"]] = r["v"]
    table = F.split(F.lit(",".join(map(str, cell))), ",").cast("array<bigint>")

    def test(h: Column) -> Column:
        def probe(p: int) -> Column:
            at = F.shiftrightunsigned(h, p).bitwiseAND(mask)
            word = F.get(table, F.shiftright(at, 6).cast("int"))
            return F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
        out = probe(PROBES[0])
        for p in PROBES[1:]:
            out = out & probe(p)
        return out
    return test


def _candidates(docs: DataFrame, text: str, key: str, widths: list[int], test) -> DataFrame:
    """(doc_id, row_key, n_words, found): positions that pass the filter, with
    the words from 5 before to 9 after them."""
    t = whole(text)

    def passing(ws: Column, width: int) -> Column:
        hashed = F.transform(_starts(F.size(ws), width), lambda i: F.struct(i.alias("at"), _hash(ws, i, width).alias("h")))
        return F.transform(F.filter(hashed, lambda x: test(x["h"])), lambda x: F.struct(
            x["at"].alias("at"), F.lit(width).alias("width"), x["h"].alias("h"),
            F.least(x["at"], F.lit(WINDOW - SHINGLE)).alias("lead"),
            F.concat_ws(" ", *[F.get(ws, x["at"] + k) for k in range(SHINGLE - WINDOW, WINDOW)]).alias("around")))

    def of(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("bigint").alias("n_words"), F.concat(*[passing(ws, w) for w in widths]).alias("found"))

    row_key = F.md5(F.concat_ws("\x00", F.coalesce(F.col(key).cast("string"), F.lit("-")), t))
    made = docs.select(F.col(key).alias("doc_id"), row_key.alias("row_key"),
                       F.get(F.transform(F.array(words_of(t)), of), 0).alias("x"))
    return made.select("doc_id", "row_key", "x.*")


def _matches(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """(row_key, start, len, window) of every occurrence of a window."""
    rarity = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(rarity, "h", "left").select("window", "len", F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), "h", "off", "width").alias("t"))
    prefix = ranked.groupBy("window", "len").agg(F.min("t").alias("t")).filter("t.n > 0").select("window", "len", "t.h", "t.off", "t.width")
    joined = found.join(prefix, ["h", "width"])
    start = F.col("at") - F.col("off")
    bounds = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    there = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("off") + 1, F.col("len")), " ")
    return joined.filter(bounds).filter(there == F.col("window")).select("row_key", start.alias("start"), "len", "window")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id",
                  item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Words of each document inside any occurrence of a benchmark window.

    One row out per document row. Null texts have no words and no hits; an empty
    benchmark hits nothing; equal items share their windows and are all named.
    Repeated rows get equal answers (rows are keyed by id and text). Null item
    ids are not listed. Only the named columns are read.
    """
    windows = cut_lineage(benchmark_windows(items, item_text, item_key), "item-windows")
    tokens = cut_lineage(_tokens(windows), "item-tokens")
    widths = sorted(r[0] for r in tokens.select("width").distinct().collect())  # five values at most
    rows = cut_lineage(_candidates(docs, text, key, widths or [SHINGLE], _bloom(tokens, tokens.count())), "found")
    found = rows.filter(F.size("found") > 0).select("row_key", "n_words", F.explode("found").alias("f")).select("row_key", "n_words", "f.*").distinct()
    matches = cut_lineage(_matches(cut_lineage(found, "positions"), tokens), "matches")

    end = F.col("start") + F.col("len")
    earlier = W.partitionBy("row_key").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest("start", F.coalesce(F.max(end).over(earlier), F.lit(0)))
    hits = matches.select("row_key", "start", "len").distinct().select(
        "row_key", F.greatest(end - reach, F.lit(0)).alias("new")).groupBy("row_key").agg(F.sum("new").alias("n_hit"))
    named = matches.select("row_key", "window").distinct().join(windows.select("window", "item_id").distinct(), "window")
    listed = named.groupBy("row_key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.select("doc_id", "row_key", "n_words").join(hits, "row_key", "left").join(listed, "row_key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
