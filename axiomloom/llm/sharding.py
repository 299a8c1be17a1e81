"""Shards by a k-d tree over row metadata.

The tree splits a cell along its widest metadata dimension at the weighted
median (weighted k1/k quantile when the cell's number of shards is odd) until
every leaf is one shard of the target bytes. Only metadata rows are read after
the first pass. A median is found by radix descent: each pass adds up bytes per
digit of the cut key inside the range that still holds the cut, so the driver
sees at most 4096 sums per cell and no rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import whole

CODE_BITS = 31          # of a dimension's code in the upper half of a cut key
DIGIT_BITS = 12         # of the cut key read in one pass
KEY_BITS = CODE_BITS + 32
TOLERANCE = 0.0005      # of a shard's bytes: a cut range this light needs no finer look
ROWS_PER_BUCKET = 5_000  # rows numbered together inside a shard
OVERHEAD = 16           # bytes of a row besides its text


class Cell(NamedTuple):
    """A node still to be split: the shards it gets, first number included."""

    first: int
    shards: int


def _coded(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Adds c_<i>: each dimension as a number below 2**31. Numbers keep their
    order, scaled to their range; texts take the place their hash gives them."""
    kinds = dict(df.dtypes)
    numeric = [d for d in dims if kinds[d] not in ("string", "binary", "boolean")]
    ends = df.agg(*[f(F.col(d).cast("double")).alias(f"{n}_{d}") for d in numeric
                    for n, f in (("lo", F.min), ("hi", F.max))]).first() if numeric else None
    top = float(2**CODE_BITS - 1)
    out = df
    for i, d in enumerate(dims):
        if d in numeric:
            lo, hi = ends[f"lo_{d}"] or 0.0, ends[f"hi_{d}"] or 0.0
            code = F.floor((F.col(d).cast("double") - lo) / max(hi - lo, 1e-9) * top).cast("bigint")
        else:
            code = F.shiftrightunsigned(F.xxhash64(F.col(d)), 64 - CODE_BITS)
        out = out.withColumn(f"c_{i}", F.coalesce(code, F.lit(0)))
    return out


def _key(i: int) -> Column:
    """The order rows are cut in along dimension i: code, text, then row."""
    return F.shiftleft(F.col(f"c_{i}"), 32).bitwiseOR(F.col("tie"))


def _descend(keyed: DataFrame, weight: str, goals: dict[int, tuple[float, float]]) -> dict[int, int]:
    """For each cell of ``goals`` (cell -> bytes wanted below, slack) the cut
    key: rows with a smaller ``k`` go left."""
    state = {c: (0, 0.0) for c in goals}  # range start, bytes below it
    cuts: dict[int, int] = {}
    shift = KEY_BITS
    while state:
        width, shift = min(DIGIT_BITS, shift), max(0, shift - DIGIT_BITS)
        above = shift + width
        if above < KEY_BITS:
            here = F.struct(F.col("cell"), F.shiftright("k", above))
            inside = here.isin([F.struct(F.lit(c), F.lit(lo >> above).cast("bigint")) for c, (lo, _) in state.items()])
        else:
            inside = F.col("cell").isin(list(state))
        digit = F.shiftright("k", shift).bitwiseAND(F.lit(2**width - 1))
        sums: dict[int, dict[int, int]] = {c: {} for c in state}
        for r in keyed.filter(inside).groupBy("cell", digit.alias("d")).agg(F.sum(weight).alias("b")).collect():
            sums[r["cell"]][r["d"]] = r["b"]
        for c, (lo, below) in list(state.items()):
            goal, slack = goals[c]
            for d in sorted(sums[c]):
                b = sums[c][d]
                if below + b >= goal:
                    break
                below += b
            start = lo | (d << shift)
            if shift == 0 or b <= slack:
                cuts[c] = start if goal - below < below + b - goal else start + (1 << shift)
                del state[c]
            else:
                state[c] = (start, below)
    return cuts


def kd_shards(coded: DataFrame, dims: int, weight: str, shards: int) -> DataFrame:
    """``coded`` (with c_0..c_<dims-1> and ``tie``) with its column ``shard``.

    One level of the tree at a time; the rows' cells are written as a table per
    level, so a pass reads plain columns and a lost executor costs one level.
    """
    ranges = [f(f"c_{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    live = {1: Cell(0, shards)}  # the cells still to be split, by node number
    leaves: dict[int, int] = {}
    rows, total = coded.withColumn("cell", F.lit(1)), None
    while live:
        wide = {r["cell"]: r for r in rows.filter(F.col("cell").isin(list(live))).groupBy("cell")
                .agg(F.sum(weight).alias("b"), *ranges).collect()}
        total = total or sum(r["b"] for r in wide.values())
        dim = {n: max(range(dims), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i)) for n, r in wide.items()}
        split = {n: c for n, c in live.items() if c.shards > 1}
        goals = {n: (wide[n]["b"] * (c.shards // 2) / c.shards, TOLERANCE * total / shards)
                 for n, c in split.items() if n in wide}
        leaves |= {n: c.first for n, c in live.items() if c.shards == 1}
        if not goals:
            break
        key = F.coalesce(*[F.when(F.col("cell") == n, _key(dim[n])) for n in goals])
        keyed = cut_lineage(rows.withColumn("k", key), "shard-cells")
        cuts = _descend(keyed, weight, goals)
        right = F.coalesce(*[F.when(F.col("cell") == n, (F.col("k") >= cut).cast("int")) for n, cut in cuts.items()])
        rows = keyed.withColumn("cell", F.coalesce(F.col("cell") * 2 + right, F.col("cell"))).drop("k")
        live = {}
        for n, c in split.items():
            live[2 * n] = Cell(c.first, c.shards // 2)
            live[2 * n + 1] = Cell(c.first + c.shards // 2, c.shards - c.shards // 2)
    names = [F.when(F.col("cell") == n, F.lit(first)) for n, first in leaves.items()]
    return rows.withColumn("shard", F.coalesce(*names, F.lit(0))).drop("cell")


def shard_documents(docs: DataFrame, shards: int = 40, dims: Sequence[str] = ("size", "lang", "text_crc32"),
                    text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row with its shard (sizes near equal: law ``bytes``) and its slot.

    Size is the text's UTF-8 bytes plus 16; a null text has no bytes and the
    checksum of the empty text. ``dims`` are columns of the table; ``size`` and
    ``text_crc32`` are the computed ones whatever the table's own columns are
    called. Cut keys end in the text's checksum and a hash of the row, so equal
    texts lie next to each other and a group larger than a shard is cut like
    anything else. Repeated rows, null keys and null metadata are rows like
    others; an empty table gives no rows.
    """
    t = whole(text)
    made = {"size": (F.octet_length(t) + OVERHEAD).cast("bigint"), "text_crc32": F.crc32(t.cast("binary"))}
    named = [f"m_{i}" for i in range(len(dims))]
    meta = cut_lineage(docs.select(
        F.col(key).alias("doc_id"), made["size"].alias("size"), made["text_crc32"].alias("text_crc32"),
        *[(made[d] if d in made else F.col(d)).alias(m) for d, m in zip(dims, named, strict=True)],
    ), "shard-meta")
    tie = F.shiftleft(F.shiftright("text_crc32", 16), 16).bitwiseOR(
        F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit(0xFFFF)))
    coded = _coded(meta, named).withColumn("tie", tie).drop(*named)
    buckets = -(-meta.count() // (shards * ROWS_PER_BUCKET)) or 1
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32") + F.spark_partition_id(), F.lit(buckets))
    placed = kd_shards(coded, len(dims), "size", shards)
    placed = cut_lineage(placed.select(
        "doc_id", "size", "text_crc32", "shard", bucket.cast("int").alias("bucket")), "shard-rows")
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return placed.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.row_number().over(inside) - 1 + F.col("offset")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
