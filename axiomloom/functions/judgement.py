"""Parsing of model verdicts and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, as_col, let, strip

# Verdict words and line markers of the judgement format.
RIGHT, WRONG = "正确", "错误"
VERDICT = "判断结果"
EXPLANATION = "解释"

_CHINESE = rf"{VERDICT}{SPACE}*[:：]{SPACE}*\[?{SPACE}*({RIGHT}|{WRONG})"
_ENGLISH = rf"(?i)Judgment Result{SPACE}*[:：]{SPACE}*\[?{SPACE}*(Correct|Incorrect)"
_WHY_CHINESE = rf"(?s){EXPLANATION}{SPACE}*[:：]{SPACE}*(.+)"
_WHY_ENGLISH = rf"(?is)Explanation{SPACE}*[:：]{SPACE}*(.+)"


def parse_judgement(text) -> Column:
    """1, 0 or null from a verdict line, with the marker-plus-word fallback."""
    c = F.coalesce(as_col(text), F.lit(""))
    word = F.regexp_extract(c, _CHINESE, 1)
    right, wrong = c.contains(RIGHT), c.contains(WRONG)
    return (
        F.when(word == RIGHT, F.lit(1))
        .when(word == WRONG, F.lit(0))
        .when(c.contains(VERDICT) & right & ~wrong, F.lit(1))
        .when(c.contains(VERDICT) & wrong & ~right, F.lit(0))
    )


def parse_judgement_bilingual(text) -> Column:
    """struct(judgment, label, explanation); Chinese wording is tried first."""
    c = F.coalesce(as_col(text), F.lit(""))
    words = F.array(F.regexp_extract(c, _CHINESE, 1), F.lower(F.regexp_extract(c, _ENGLISH, 1)))
    first = F.get(F.filter(words, lambda w: w != ""), F.lit(0))
    label = let(first, lambda w: F.when(w.isNotNull(), w.isin(RIGHT, "correct").cast("int")))
    found = lambda p: F.when(F.regexp_like(c, F.lit(p)), strip(F.regexp_extract(c, p, 1)))
    return F.struct(
        F.when(label == 1, F.lit(RIGHT)).when(label == 0, F.lit(WRONG)).alias("judgment"),
        label.alias("label"),
        F.coalesce(found(_WHY_CHINESE), found(_WHY_ENGLISH)).alias("explanation"),
    )


def clean_label(value) -> Column:
    return F.lower(strip(as_col(value).cast("string")))


def binary_label(clean) -> Column:
    """1, 0 or null from a label already trimmed and lower-cased. Common
    spellings are compared as text; only the rest is cast to a number."""
    c = as_col(clean)
    number = c.try_cast("double")
    return (
        F.when(c.isin("1", "1.0", "correct", "true", "yes"), F.lit(1))
        .when(c.isin("0", "0.0", "incorrect", "false", "no"), F.lit(0))
        .when(number == 1.0, F.lit(1))
        .when(number == 0.0, F.lit(0))
    )


def normalize_binary_label(value) -> Column:
    return binary_label(clean_label(value))


def final_status(fail_count: Column) -> Column:
    return F.when(fail_count == 0, F.lit("success")).otherwise(F.lit("completed"))
