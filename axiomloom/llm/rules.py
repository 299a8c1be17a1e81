"""Quality rules: a table of thresholds compiled into one projection.

Each row of the table names a measure, a comparison and a bound given as a
fraction of two integers, so that every engine decides the same way. The whole
table becomes one boolean column; Spark evaluates it row by row inside the JVM
with no shuffle and no user function.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES, space_words, whole


class Rule(NamedTuple):
    """The text fails where ``over * den  OP  num * under`` holds."""

    name: str
    over: str
    under: str
    op: str
    num: int
    den: int


#: Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to a in is it that for on with was be by are this from as at or an have not "
    "der die das und in zu den mit von ist für im nicht ein eine auf des sich dem auch "
    "de la le et les des en un une du est que pour dans qui par sur au pas il avec "
    "el los las y que se del con su una por lo es para no al como más"
)

#: The documented thresholds. Ratios are ``over / under``.
RULES = (
    Rule("too_few_words", "n_words", "one", "<", 50, 1),
    Rule("repeated_windows", "n_repeat_words", "n_words", ">", 1, 2),
    Rule("words_too_long", "word_chars", "n_words", ">", 20, 1),
    Rule("words_too_short", "word_chars", "n_words", "<", 2, 1),
    Rule("symbols", "n_symbols", "n_words", ">", 1, 4),
    Rule("shouting", "n_bangs", "n_words", ">", 1, 4),
    Rule("few_stop_words", "n_stop_words", "n_words", "<", 1, 100),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", ">", 1, 2),
)
BASE_RULES = ("too_few_words", "repeated_windows")


def _stop_words() -> list[str]:
    return sorted(set(STOP_WORDS.split()))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text.

    Windows are sorted next to their positions, equal neighbours are repeats;
    each repeated start then covers the words up to the next one, three at most.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - 3)
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))

    def starts_of_repeats(sorted_windows: Column) -> Column:
        same = lambda x, k: F.get(sorted_windows, k)["w"] == x["w"]
        kept = F.filter(sorted_windows, lambda x, k: F.coalesce((k > 0) & same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    # nested one-element transforms bind an array once, so it is not computed again at each use
    bound = F.transform(F.array(windows), starts_of_repeats)
    total = F.get(F.transform(bound, covered), 0)
    return F.when(n >= 4, total).otherwise(F.lit(0)).cast("bigint")


def measures(text: str = "text") -> list[Column]:
    """The measured columns of a text; null counts as empty."""
    t = whole(text)
    words = space_words(t)

    def of(ws: Column) -> Column:
        joined = F.array_join(ws, "")
        stops = F.filter(ws, lambda w: F.lower(w).isin(_stop_words()))
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.length(joined).cast("bigint").alias("word_chars"),
            F.size(stops).cast("bigint").alias("n_stop_words"),
            _repeat_words(ws).alias("n_repeat_words"),
        )

    by_words = F.get(F.transform(F.array(words), of), 0)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, SPACES, "") != "")
    by_lines = F.get(F.transform(F.array(lines), lambda ls: F.struct(
        F.size(ls).cast("bigint").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"))), 0)
    count = lambda chars: (F.length(t) - F.length(F.regexp_replace(t, chars, ""))).cast("bigint")
    return [by_words.alias("_w"), by_lines.alias("_l"),
            count(r"[#*$%&|<>]").alias("n_symbols"), count("!").alias("n_bangs")]


def verdict(rules: Sequence[Rule]) -> Column:
    """True where any rule of the table fails."""
    def fails(r: Rule) -> Column:
        under = F.lit(1) if r.under == "one" else F.col(r.under)
        left, right = F.col(r.over) * r.den, under * r.num
        return left < right if r.op == "<" else left > right

    return reduce(lambda a, b: a | b, [fails(r) for r in rules], F.lit(False))


def quality_rules(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",),
                  rules: Sequence[Rule] = RULES, base: Sequence[str] = BASE_RULES) -> DataFrame:
    """Measures, base verdict and final verdict of each row.

    One row out per row in, repeated rows included. Null, empty and blank texts
    have no words and fail the base rules. Only ``keys`` and ``text`` are read,
    so other columns of any name do no harm; an empty table gives no rows.
    """
    flat = docs.select(*keys, *measures(text)).select(*keys, "_w.*", "_l.*", "n_symbols", "n_bangs")
    by_name = {r.name: r for r in rules}
    failed = verdict([by_name[n] for n in base])
    return flat.select(
        *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~(failed | verdict(rules))).alias("kept"),
        "n_stop_words", "n_lines", "n_bangs",
    )
