"""Labelled axiom datasets from triples and property tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axioms import render_axiom
from ..functions.text import normalize_schema_uri, norm_predicate, strip
from ..scale import dense_position, gathering_tasks, hash_int, hash_long, keep_first, salted_join, shuffled_join
from ..session import cut_and_count, cut_lineage
from ..sources.readers import resolve_column

AXIOM_KEY = ["axiom_type", "subject", "predicate", "object"]
AXIOM_COLUMNS = [*AXIOM_KEY, "label", "source", "negative_strategy"]

# Predicate name in a dump -> axiom type, and RDFS predicate.
DUMP_PREDICATES = {"subClassOf": "generalizations", "domain": "domain", "range": "range"}
EARLY_TRIES = 8


def _axioms(rows: DataFrame, axiom_type: str, source: str) -> DataFrame:
    """Shape (subject, object) rows as positive axioms; blanks and loops go."""
    return rows.filter(
        (F.col("subject") != "") & (F.col("object") != "") & (F.col("subject") != F.col("object"))
    ).select(
        F.lit(axiom_type).alias("axiom_type"), "subject",
        F.lit(f"rdfs:{axiom_type}").alias("predicate"), "object",
        F.lit(1).alias("label"), F.lit(source).alias("source"), F.lit("").alias("negative_strategy"),
    )


def extract_axioms(triples: DataFrame, axiom_type: str, source: str = "NELL") -> DataFrame:
    rows = triples.filter(norm_predicate("predicate") == DUMP_PREDICATES[axiom_type]).select(
        strip("subject").alias("subject"), strip("object").alias("object")
    )
    return _axioms(rows, axiom_type, source).dropDuplicates()


def relation_names(domain_axioms: DataFrame, range_axioms: DataFrame) -> DataFrame:
    return domain_axioms.select("subject").union(range_axioms.select("subject")).distinct()


def _retype(df: DataFrame, axiom_type: str) -> DataFrame:
    return df.withColumns({
        "axiom_type": F.lit(axiom_type), "predicate": F.lit(f"rdfs:{axiom_type}")
    }).select(*AXIOM_COLUMNS)


def _ends_filter(generalizations: DataFrame, relations: DataFrame, how: str) -> DataFrame:
    subjects = relations.select(F.col("subject"))
    objects = relations.select(F.col("subject").alias("object"))
    return generalizations.join(subjects, "subject", how).join(objects, "object", how)


def subproperty_axioms(generalizations: DataFrame, relations: DataFrame) -> DataFrame:
    """Generalizations whose two ends are both relation names."""
    return _retype(_ends_filter(generalizations, relations, "left_semi"), "subPropertyOf")


def refine_subclass(generalizations: DataFrame, relations: DataFrame) -> DataFrame:
    """Generalizations with no relation name at either end."""
    return _retype(_ends_filter(generalizations, relations, "left_anti"), "subClassOf")


def extract_all(triples: DataFrame, source: str = "NELL") -> DataFrame:
    """Axioms of all three dump predicates from one scan and one distinct."""
    predicate, kind = norm_predicate("predicate"), F.lit(None).cast("string")
    for axiom_type, name in DUMP_PREDICATES.items():
        kind = F.when(predicate == name, F.lit(axiom_type)).otherwise(kind)
    rows = triples.select(
        kind.alias("axiom_type"), strip("subject").alias("subject"), strip("object").alias("object")
    ).filter(
        F.col("axiom_type").isNotNull() & (F.col("subject") != "") & (F.col("object") != "")
        & (F.col("subject") != F.col("object"))
    ).distinct()
    return rows.select(
        "axiom_type", "subject", F.concat(F.lit("rdfs:"), "axiom_type").alias("predicate"), "object",
        F.lit(1).alias("label"), F.lit(source).alias("source"), F.lit("").alias("negative_strategy"),
    )


def positives_from_triples(triples: DataFrame, source: str = "NELL") -> dict[str, DataFrame]:
    """The four kinds of positive axioms. The extract is stored once, because
    the relation names and all four results read it."""
    axioms = cut_lineage(extract_all(triples, source), "axioms")
    of = lambda kind: axioms.filter(F.col("axiom_type") == kind)
    relations = relation_names(of("domain"), of("range"))
    return {
        "subClassOf": refine_subclass(of("subClassOf"), relations),
        "subPropertyOf": subproperty_axioms(of("subClassOf"), relations),
        "domain": of("domain"),
        "range": of("range"),
    }


# Accepted column spellings per axiom type (lower case).
PROPERTY_COLUMNS = {
    "subPropertyOf": ("subpropertyof", "rdfs:subpropertyof"),
    "domain": ("domainincludes",),
    "range": ("rangeincludes",),
}


def explode_property_axioms(props: DataFrame, axiom_type: str, source: str = "schema.org") -> DataFrame:
    """One axiom per comma-separated value of a property table column."""
    column = resolve_column(props, *PROPERTY_COLUMNS[axiom_type])
    if column is None:
        if axiom_type != "subPropertyOf":
            raise ValueError(f"property table has no column for {axiom_type}")
        props, column = props.withColumn("_none", F.lit("")), "_none"
    key = "id" if "id" in props.columns else props.columns[0]
    parts = F.filter(F.transform(F.split(F.col(column), ","), strip), lambda v: v != "")
    rows = props.select(normalize_schema_uri(key).alias("subject"), F.explode(parts).alias("_v")).select(
        "subject", normalize_schema_uri("_v").alias("object")
    )
    return _axioms(rows, axiom_type, source)


def clean_positives(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(AXIOM_KEY).filter(F.col("subject") != F.col("object"))


def inverse_negatives(df: DataFrame) -> DataFrame:
    return df.select(
        "axiom_type", F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"),
        F.lit(0).alias("label"), "source", F.lit("direction_inversion").alias("negative_strategy"),
    )


def exclude_existing_pairs(candidates: DataFrame, known: DataFrame,
                           on: Sequence[str] = ("axiom_type", "subject", "object")) -> DataFrame:
    return candidates.join(known.select(*on).distinct(), list(on), "left_anti")


def replacement_negatives(positives: DataFrame, known: DataFrame | None = None,
                          strategy: str = "constraint_replacement", seed: str = "42") -> DataFrame:
    """One negative per axiom: another object of the same type's object pool
    that is not a known object of the subject.

    Draws are the first free place from a hashed start in the numbered pool,
    around its end, so they are reproducible and every row whose subject leaves
    an object free gets one. Most rows settle within EARLY_TRIES neighbours, whose
    draws are dealt to as many tasks as their number asks for; for the rest the runs of taken places are measured. ``known`` adds to the positives.
    """
    positives, stored = cut_and_count(positives, "positives")
    tasks = gathering_tasks(positives.sparkSession, stored["rows"] * EARLY_TRIES)
    pairs = positives.select("axiom_type", "subject", "object")
    if known is not None:
        pairs = pairs.unionByName(known.select("axiom_type", "subject", "object"))
    pairs = pairs.distinct()
    pool = positives.select("axiom_type", "object").distinct().withColumn(
        "_order", hash_long("object", seed="pool")
    )
    pool = dense_position(cut_lineage(pool, "pool"), ["axiom_type"], "_order", "_slot", tie=["object"]).select(
        "axiom_type", F.col("object").alias("_candidate"), (F.col("_slot") - 1).alias("_slot")
    )
    pool = cut_lineage(pool, "slots")
    sizes = pool.groupBy("axiom_type").agg(F.count(F.lit(1)).alias("_size"))
    rows = positives.join(sizes, "axiom_type").withColumn(
        "_start", hash_int("axiom_type", "subject", "object", seed=seed)
    )

    def probe(df: DataFrame, first: int, last: int) -> DataFrame:
        tries = F.sequence(F.lit(first), F.least(F.lit(last), F.col("_size").cast("int") - 1))
        tries = F.when(F.col("_size") > first, tries)
        drawn = df.repartition(tasks, *AXIOM_KEY).withColumn("_try", F.explode(tries)).withColumn(
            "_slot", F.pmod(F.col("_start") + F.col("_try"), F.col("_size"))
        )
        drawn = drawn.join(pool, ["axiom_type", "_slot"]).filter(F.col("_candidate") != F.col("object"))
        on = ["axiom_type", "subject", "_candidate"]
        taken = pairs.withColumnRenamed("object", "_candidate").repartition(tasks, *on)
        open_ = shuffled_join(drawn.repartition(tasks, *on), taken, on, "left_anti")
        return open_.repartition(tasks, *AXIOM_KEY, "source").groupBy(*AXIOM_KEY, "source").agg(
            F.min_by("_candidate", "_try").alias("_candidate")
        )

    early = cut_lineage(probe(rows, 0, EARLY_TRIES - 1), "early")
    unsettled, seen = cut_and_count(shuffled_join(rows, early.select(*AXIOM_KEY), AXIOM_KEY, "left_anti"), "unsettled")
    found = early.unionByName(_first_free(unsettled, pairs, pool)) if seen["rows"] else early
    return found.select(
        "axiom_type", "subject", "predicate", F.col("_candidate").alias("object"),
        F.lit(0).alias("label"), "source", F.lit(strategy).alias("negative_strategy"),
    )


def _first_free(rows: DataFrame, pairs: DataFrame, pool: DataFrame, min_rows: int | None = None) -> DataFrame:
    """The first free place from each row's start: taken places of a subject form
    runs, and the place after the run that holds the start is free.

    Taken places are numbered inside their subject by stored ranges; place minus
    number is the same along a run, so runs are a grouped minimum and maximum. A
    start that is taken finds its run, and the run its end, by equality. A subject
    with any share of all pairs is split like other rows.
    """
    options = {} if min_rows is None else {"min_rows": min_rows}
    of = ["axiom_type", "subject"]
    slots = pool.select("axiom_type", F.col("_candidate").alias("object"), "_slot")
    taken = salted_join(pairs, rows.select(*of).distinct(), of, "left_semi", **options).join(slots, ["axiom_type", "object"])
    numbered = dense_position(cut_lineage(taken.select(*of, "_slot"), "taken"), of, "_slot", "_no").select(
        *of, "_slot", (F.col("_slot") - F.col("_no")).alias("_run"))
    numbered = cut_lineage(numbered, "taken-runs")
    runs = cut_lineage(numbered.groupBy(*of, "_run").agg(F.min("_slot").alias("_lo"), F.max("_slot").alias("_hi")), "runs")
    starts = rows.select(*AXIOM_KEY, "source", "_size", F.pmod("_start", "_size").alias("_at"))
    met = cut_lineage(starts.join(numbered.withColumnRenamed("_slot", "_at"), [*of, "_at"], "left"), "starts")
    ended = salted_join(met, runs.select(*of, "_run", "_hi"), [*of, "_run"], "left", **options)
    heads = runs.filter("_lo = 0").select(*of, (F.col("_hi") + 1).alias("_head"))
    placed = salted_join(ended, heads, of, "left", **options)
    ahead = F.coalesce(F.col("_hi") + 1, "_at")  # beyond the last place it goes on at the first
    slot = F.when(ahead < F.col("_size"), ahead).otherwise(F.coalesce("_head", F.lit(0)))
    return placed.withColumn("_slot", slot).join(pool, ["axiom_type", "_slot"]).select(*AXIOM_KEY, "source", "_candidate")


def assemble_dataset(positives: Sequence[DataFrame], negatives: Sequence[DataFrame]) -> DataFrame:
    """Union of all parts; the first part holding a (key, label) wins. A positive has about one negative:
    rows are dealt to tasks by that number before a winner is chosen."""
    out, rows = None, reduce(DataFrame.unionAll, [p.select(F.lit(1)) for p in positives]).count() * 2
    for order, part in enumerate([*positives, *negatives]):
        part = part.select(*AXIOM_COLUMNS, F.lit(order).alias("_part"))
        out = part if out is None else out.unionByName(part)
    key = [*AXIOM_KEY, "label"]
    out = keep_first(out.repartition(gathering_tasks(out.sparkSession, rows), *key), key, ["_part", "source", "negative_strategy"]).drop("_part")
    return out.withColumn("axiom_text", render_axiom("axiom_type", "subject", "predicate", "object"))


def overlay_sources(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Later sources replace the rows of the same key in earlier ones."""
    out = None
    for order, layer in enumerate(layers):
        layer = layer.withColumn("_layer", F.lit(order))
        out = layer if out is None else out.unionByName(layer)
    newest = F.max("_layer").alias("_newest")
    winners = out.groupBy(*keys).agg(newest)
    return out.join(winners, list(keys)).filter(F.col("_layer") == F.col("_newest")).drop("_layer", "_newest")
