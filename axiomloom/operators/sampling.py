"""Capped and balanced samples with reproducible hash order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scale import dense_position, hash_key, top_n
from ..session import cut_lineage

# Relation spelling -> kind, in tie-breaking order.
TARGET_RELATIONS = {
    "rdfs:subClassOf": "subClassOf",
    "owl:subObjectPropertyOf": "subPropertyOf",
    "rdfs:domain": "domain",
    "rdfs:range": "range",
}


def cap_per_type(df: DataFrame, n: int, seed: str, keys: Sequence[str] = ("axiom_type",),
                 identity: Sequence[str] = ("subject", "predicate", "object")) -> DataFrame:
    """At most n rows per type in shuffled order; smaller types stay whole."""
    shuffled = df.withColumn("_h", hash_key(*identity, seed=seed))
    return top_n(shuffled, list(keys), [F.col("_h"), *[F.col(c) for c in identity]], n).drop("_h", "_rank")


def balanced_quotas(counts: Mapping[str, int], n: int = 100) -> dict[str, int]:
    """Rows to take per kind: small kinds whole, the rest filled level by level.

    Works on one number per kind. Leftover slots after the last full level go
    to the kinds with fewest taken, then most left, then first in order.
    """
    order = list(TARGET_RELATIONS.values())
    counts = {k: counts.get(k, 0) for k in order}
    quota = {k: (c if c <= n // 4 else 0) for k, c in counts.items()}
    slots = min(n, sum(counts.values())) - sum(quota.values())
    while slots > 0:
        open_ = [k for k in order if quota[k] < counts[k]]
        if not open_:
            break
        step = min(slots // len(open_), min(counts[k] - quota[k] for k in open_))
        if step == 0:
            open_.sort(key=lambda k: (quota[k], quota[k] - counts[k], order.index(k)))
            for k in open_[:slots]:
                quota[k] += 1
            break
        for k in open_:
            quota[k] += step
        slots -= step * len(open_)
    return quota


def balanced_sample(df: DataFrame, seed: str, identity: Sequence[str], n: int = 100) -> DataFrame:
    """A sample over the four kinds; only the four counts reach the driver."""
    kind = F.lit(None).cast("string")
    for relation, name in TARGET_RELATIONS.items():
        kind = F.when(F.trim("relation") == relation, F.lit(name)).otherwise(kind)
    tagged = df.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    counts = {r["kind"]: r["count"] for r in tagged.groupBy("kind").count().collect()}
    quotas = balanced_quotas(counts, n)
    shuffled = tagged.withColumn("_h", hash_key(*identity, seed=seed))
    ranked = top_n(shuffled, ["kind"], [F.col("_h"), *[F.col(c) for c in identity]], n)
    allowed = F.lit(0)
    for name, quota in quotas.items():
        allowed = F.when(F.col("kind") == name, F.lit(quota)).otherwise(allowed)
    return ranked.filter(F.col("_rank") <= allowed).drop("_h", "_rank")


def fair_per_paper_sample(df: DataFrame, identity: Sequence[str], per_paper: int = 10,
                          seed: str = "20260417") -> DataFrame:
    """About ``per_paper`` rows per paper, covering the axiom types first.

    The k-th row of each type comes before the (k+1)-th of any, so no type
    dominates until the others run out.
    """
    shuffled = df.withColumn("_h", hash_key(*identity, seed=seed))
    order = [F.col("_h"), *[F.col(c) for c in identity]]
    by_type = top_n(shuffled, ["doc_id", "axiom_type"], order, per_paper, rank="_in_type")
    by_paper = top_n(by_type, ["doc_id"], [F.col("_in_type"), *order], per_paper, rank="_in_paper")
    return by_paper.drop("_h", "_in_type", "_in_paper")


def water_quotas(groups: DataFrame, room: str, amount: int, out: str, order: str) -> DataFrame:
    """``groups`` with a quota each: up to a common level, at most ``room``, ``amount`` in total (or all there is).

    The level comes from the histogram of the rooms with prefix sums. What is
    left below one more for all goes to the first groups, by ``order``, that have room.
    """
    sizes = groups.groupBy(room).agg(F.count(F.lit(1)).alias("_n"))
    upto = W.orderBy(room)  # a row per distinct room
    before, groups_before = F.sum(F.col(room) * F.col("_n")).over(upto), F.sum("_n").over(upto)
    filled = sizes.select(F.col(room).alias("_room"), before.alias("_full"), groups_before.alias("_g"))
    total = groups.agg(F.count(F.lit(1)).alias("g"), F.sum(room).alias("n")).first()
    want = min(amount, total["n"] or 0)
    # groups of room up to _room are full; the others share what is left
    fits = filled.filter(F.col("_full") + F.col("_room") * (total["g"] - F.col("_g")) <= want).agg(
        F.max(F.struct("_room", "_full", "_g")).alias("m")).first()["m"]
    full, done = (fits["_full"], fits["_g"]) if fits else (0, 0)
    open_ = total["g"] - done
    level, more = divmod(want - full, open_) if open_ else (0, 0)
    if not open_:
        return groups.withColumn(out, F.col(room).cast("bigint"))
    ranked = dense_position(cut_lineage(groups.filter(F.col(room) > level), "with-room"), [], order, "_place", tie=["doc_id"])
    first = ranked.filter(F.col("_place") <= more).select("doc_id", F.lit(1).alias("_one"))
    quota = F.least(F.col(room), F.lit(level)) + F.coalesce("_one", F.lit(0))
    return groups.join(first, "doc_id", "left").withColumn(out, quota.cast("bigint")).drop("_one")


def fair_total_sample(df: DataFrame, identity: Sequence[str], total: int, type_cap: int | None = None,
                      seed: str = "20260417") -> DataFrame:
    """Exactly ``total`` rows (or all, if fewer), spread evenly over papers and, in a paper, over axiom types.

    Papers get equal shares as far as they have rows. In a paper the k-th row of
    each type comes before the (k+1)-th of any. With ``type_cap`` a paper gives at
    most so many rows of one type as long as other papers can make up for it;
    only if all of them together cannot, the rest comes from rows beyond the cap.
    """
    order = ["_h", *[c for c in identity if c != "doc_id"]]
    shuffled = cut_lineage(df.withColumn("_h", hash_key(*identity, seed=seed)), "shuffled")
    typed = dense_position(shuffled, ["doc_id", "axiom_type"], "_h", "_in_type", tie=order[1:])
    over = F.lit(False) if type_cap is None else F.col("_in_type") > type_cap
    typed = cut_lineage(typed.withColumn("_over", over), "typed")
    papers = typed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("_over")).alias("_capped"))
    papers = cut_lineage(papers.withColumn("_ph", hash_key("doc_id", seed=seed)), "papers")
    capped = papers.agg(F.sum("_capped")).first()[0] or 0
    if capped >= total:
        quotas = water_quotas(papers, "_capped", total, "_quota", "_ph")
    else:
        beyond = papers.withColumn("_beyond", F.col("_n") - F.col("_capped"))
        quotas = water_quotas(beyond, "_beyond", total - capped, "_more", "_ph").withColumn("_quota", F.col("_capped") + F.col("_more"))
    rank = F.struct("_over", "_in_type").alias("_rank")
    placed = dense_position(cut_lineage(typed.withColumn("_rank", rank), "ranked"), ["doc_id"], "_rank", "_place", tie=order)
    return placed.join(quotas.select("doc_id", "_quota"), "doc_id").filter("_place <= _quota").select(*df.columns)
