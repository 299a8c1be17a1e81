"""Paraphrase templates and consistency of judgements over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axioms import EDGE_TYPES, parse_axiom
from .metrics import ratio

# The paraphrase wordings of the offline dataset. %1$s is the
# left end and %2$s the right end; template 1 is the axiom text itself.
DATASET_TEMPLATES = {
    "subClassOf": (
        "%1$s is a subclass of %2$s.",
        "Every instance of %1$s is also an instance of %2$s.",
        "If an entity belongs to class %1$s, then it also belongs to class %2$s.",
        "The class %1$s is included in the class %2$s.",
    ),
    "subPropertyOf": (
        "%1$s is a subproperty of %2$s.",
        "If two resources are related by %1$s, then they are also related by %2$s.",
        "For any x and y, if x %1$s y holds, then x %2$s y also holds.",
        "The property %1$s is more specific than the property %2$s.",
    ),
    "domain": (
        "The domain of %1$s is %2$s.",
        "If a resource uses property %1$s as subject, then it should belong to class %2$s.",
        "For any x and y, if x %1$s y holds, then x is an instance of %2$s.",
        "Property %1$s can only be applied to subjects of class %2$s.",
    ),
    "range": (
        "The range of %1$s is %2$s.",
        "If a resource appears as the object of property %1$s, then it should belong to class %2$s.",
        "For any x and y, if x %1$s y holds, then y is an instance of %2$s.",
        "Property %1$s can only point to objects of class %2$s.",
    ),
}

# The five wordings the evaluation service uses.
SERVICE_TEMPLATES = {
    "subClassOf": (
        "%1$s ⊑ %2$s",
        "%1$s is a subclass of %2$s",
        "Every instance of %1$s is also an instance of %2$s",
        "If x is a %1$s, then x is also an %2$s",
        "The class %1$s is included in the class %2$s",
    ),
    "subPropertyOf": (
        "%1$s ⊑ %2$s",
        "%1$s is a subproperty of %2$s",
        "If two entities are related by %1$s, they are also related by %2$s",
        "If x %1$s y, then x %2$s y",
        "The property %1$s is included in the property %2$s",
    ),
    "domain": (
        "domain(%1$s) = %2$s",
        "The domain of %1$s is %2$s",
        "If an entity uses the property %1$s as subject, it should belong to %2$s",
        "If x %1$s y, then x is an instance of %2$s",
        "The subject of property %1$s must belong to class %2$s",
    ),
    "range": (
        "range(%1$s) = %2$s",
        "The range of %1$s is %2$s",
        "If an entity appears as the object of %1$s, it should belong to %2$s",
        "If x %1$s y, then y is an instance of %2$s",
        "The object of property %1$s must belong to class %2$s",
    ),
}


def _wordings(templates: Mapping[str, Sequence[str]], left: Column, right: Column, first: int) -> Column:
    """Array of struct(template_id, text) chosen by the row's axiom type."""
    choice = None
    for kind, patterns in templates.items():
        texts = F.array(*[
            F.struct(F.lit(first + i).alias("template_id"), F.format_string(p, left, right).alias("text"))
            for i, p in enumerate(patterns)
        ])
        test = F.col("axiom_type") == kind
        choice = F.when(test, texts) if choice is None else choice.when(test, texts)
    return choice


def expand_templates(axioms: DataFrame) -> DataFrame:
    """Five rows per axiom: the original text and four typed paraphrases.

    Rows whose text does not parse as their type have none; ``template_rejects``
    returns them."""
    ends = parse_axiom("axiom_text", "axiom_type")
    original = F.array(F.struct(F.lit(1).alias("template_id"), F.col("axiom_text").alias("text")))
    rows = axioms.withColumn("_ends", ends).filter(F.col("_ends").isNotNull())
    wordings = _wordings(DATASET_TEMPLATES, F.col("_ends.left"), F.col("_ends.right"), 2)
    exploded = rows.select(
        F.col("id").alias("original_id"), "axiom_type", "context_info", "label",
        F.explode(F.concat(original, wordings)).alias("_t"),
    )
    return exploded.select(
        "original_id", F.col("_t.template_id").alias("template_id"),
        F.concat_ws("_t", F.col("original_id").cast("string"), F.col("_t.template_id").cast("string")).alias("variant_id"),
        "axiom_type", F.col("_t.text").alias("axiom_text"), "context_info", "label",
    )


def template_rejects(axioms: DataFrame) -> DataFrame:
    """The rows that expand_templates cannot use, whole."""
    return axioms.filter(parse_axiom("axiom_text", "axiom_type").isNull())


def perturb_results(results: DataFrame) -> DataFrame:
    """Five service wordings for every successful result of the four types."""
    rows = results.filter((F.col("run_status") == "success") & F.col("axiom_type").isin(*EDGE_TYPES))
    wordings = _wordings(SERVICE_TEMPLATES, F.col("subject"), F.col("object"), 1)
    exploded = rows.select(
        F.col("id").alias("original_id"), "axiom_type",
        F.col("predict_label").alias("original_predict_label"), F.explode(wordings).alias("_t"),
    )
    return exploded.select(
        "original_id", "axiom_type", "original_predict_label",
        F.col("_t.template_id").alias("template_id"),
        F.concat_ws("_tpl", F.col("original_id").cast("string"), F.col("_t.template_id").cast("string")).alias("variant_id"),
        F.col("_t.text").alias("perturbed_text"),
    )


def consistency(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hard and soft consistency per key.

    Hard: share of originals whose every variant succeeded with the original
    prediction. Soft: mean variance of the predictions, where a missing one
    counts as 0. Predictions are 0/1, so the variance needs only counts.
    """
    p = F.col("pred")
    agrees = (F.col("run_status") == "success") & p.isNotNull() & (p == F.col("original_pred"))
    share = F.sum(F.coalesce(p, F.lit(0)).cast("double")) / F.count(F.lit(1))
    per_original = records.groupBy(*keys, "original_id").agg(
        F.bool_and(F.coalesce(agrees, F.lit(False))).alias("hard"), share.alias("_share")
    )
    return per_original.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("originals"),
        ratio(F.count_if("hard"), F.count(F.lit(1))).alias("hard_consistency"),
        F.avg(F.col("_share") * (1 - F.col("_share"))).alias("soft_consistency"),
    )
