"""How document filters interact, whatever the order they are applied in.

Every document gets a mask of the filters it fails. What happens to it depends
on the mask alone, so documents are counted per (part, mask) where they lie, and
the rest works on at most 2**k counts per part.

States of the lattice are the sets of filters applied so far; an edge applies
one more. Forward path counting says how many orders reach a state, backward
counting how many leave it for the end; an edge lies on the product of the two.
What an edge removes, times the orders that pass it, sums up to the filter's
Shapley value over all orders (not divided by their number), and the steps of
one order are the edges on its path.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import SPACES, UPPER, whole

#: Failure conditions of single texts; E, exact copies, needs the table.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
NAMES = "ABCDE"


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """(orders that lead from nothing to each state, orders that lead on to all k filters)."""
    n = 1 << k
    into, onward = [0] * n, [0] * n
    into[0] = onward[n - 1] = 1
    for state in range(n):
        for f in range(k):
            if not state >> f & 1:
                into[state | 1 << f] += into[state]
    for state in reversed(range(n)):
        for f in range(k):
            if not state >> f & 1:
                onward[state] += onward[state | 1 << f]
    return into, onward


def edges(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders passing) of every edge of the lattice."""
    into, onward = path_counts(k)
    return [(s, f, into[s] * onward[s | 1 << f]) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def order_steps(names: Sequence[str]) -> list[tuple[int, int, str, int]]:
    """(state, filter, order, step) of every step of every order."""
    out = []
    for order in permutations(range(len(names))):
        state, name = 0, "".join(names[f] for f in order)
        for step, f in enumerate(order, 1):
            out.append((state, f, name, step))
            state |= 1 << f
    return out


def count_masks(flagged: DataFrame, flags: Sequence[Column], part: Column, counts: dict[str, Column]) -> DataFrame:
    """(part, mask, n, counts...): documents by the filters they fail; ``flags`` in bit order."""
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)])
    return flagged.select(part.alias("part"), mask.alias("mask"), *[c.cast("int").alias(n) for n, c in counts.items()]).groupBy(
        "part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in counts])


def audit(masks: DataFrame, names: Sequence[str] = NAMES, lost: Sequence[str] = ()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <lost>_lost..., shapley) for every
    order of the filters and every part of ``masks``.

    The report itself has k! * k rows per part, so few filters are meant. All orders of an empty table are no rows.
    """
    k = len(names)
    every = ", ".join(f"named_struct('state', {s}, 'filter', {f}, 'orders', {w}L)" for s, f, w in edges(k))
    at = masks.select("part", "mask", "n", *lost, F.explode(F.expr(f"array({every})")).alias("e")).select(
        "part", "mask", "n", *lost, "e.*")
    bit, state, mask = F.expr("shiftleft(1, filter)"), F.col("state"), F.col("mask")
    fails = mask.bitwiseAND(bit) != 0
    removed = fails & (mask.bitwiseAND(state) == 0)
    total = lambda hit, c="n": F.sum(F.when(hit, F.col(c)).otherwise(0))
    on_edge = at.groupBy("part", "state", "filter", "orders").agg(
        total(mask.bitwiseAND(state.bitwiseOR(bit)) == 0).alias("kept"), total(removed).alias("removed"),
        total(fails & ~removed).alias("redundant"), total(mask == bit).alias("unique_fails"),
        *[total(removed, c).alias(f"{c}_lost") for c in lost])
    passing: dict[tuple[int, int], list] = {}
    for s, f, order, step in order_steps(names):
        passing.setdefault((s, f), []).append((order, step))
    paths = masks.sparkSession.createDataFrame([(s, f, steps) for (s, f), steps in passing.items()],
                                               "state int, filter int, steps array<struct<filter_order: string, step: int>>")
    values = on_edge.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    steps = on_edge.join(F.broadcast(paths), ["state", "filter"]).withColumn("s", F.explode("steps"))  # k! * k small rows
    return steps.join(values, ["part", "filter"]).select(
        "part", "s.filter_order", "s.step", "kept", "removed", "redundant", "unique_fails", *[f"{c}_lost" for c in lost], "shapley")


def text_flags(text: Column) -> tuple[Column, list[Column]]:
    """(words, failure conditions A to D given the words as column w)."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return words, [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n,
                   100 * capitals.cast("bigint") > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS)]


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents, by source.

    Null texts and sources are empty. A document fails E if its text is that of
    a smaller doc_id: texts are compared by SHA-256, whose smallest id per text is
    found with map-side reduction, and rows look themselves up by (id, digest),
    so neither a popular text nor one source meets in a task. Rows without an id
    are no copies and make none; repeated rows of one id and text are no copies of
    each other. A document with several label rows counts as good (toxic) if any
    of them says so.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), whole("text").alias("t"))
    words, flags = text_flags(F.col("t"))
    marked = rows.withColumn("w", words).select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *[f.alias(f"f{i}") for i, f in enumerate(flags)])
    marked = cut_lineage(marked, "filter-flags")
    first = marked.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("x")).filter("doc_id is not null").groupBy(
        "doc_id").agg(F.max(F.col("q") == 1).alias("good"), F.max(F.col("x") == 1).alias("toxic"))
    told = lambda c: F.coalesce(F.col(c), F.lit(False))
    named = marked.filter("doc_id is not null").join(first, ["doc_id", "digest"], "left").join(said, "doc_id", "left").withColumns(
        {"f4": F.col("first").isNull(), "good": told("good"), "toxic": told("toxic")}).drop("first")
    nameless = marked.filter("doc_id is null").withColumns({c: F.lit(False) for c in ("f4", "good", "toxic")})
    both = named.select(*nameless.columns).unionByName(nameless)
    masks = count_masks(both, [F.col(f"f{i}") for i in range(5)], F.col("part"), {"good": F.col("good"), "toxic": F.col("toxic")})
    return audit(masks, NAMES, ("good", "toxic"))
