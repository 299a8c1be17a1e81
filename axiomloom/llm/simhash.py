"""Near-duplicates by SimHash with deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints at
three or fewer differing bits have a segment that differs by at most one bit, so
each fingerprint is indexed under both its segments and under each of their 32
one-wildcard variants (the segment with one bit deleted). Fingerprints that meet
under a key are verified on all bits.

Only distinct fingerprints are indexed. Inside a key no pairs are listed: a task
reports the edges of a spanning forest of the links among the members of a block
(or of two blocks, when a key has more members than a block holds), which keeps
the components and grows with the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow import blocks, list_values, small_batches, sums_per_piece
from .components import components
from .text import lower_ascii, space_words, whole

BITS, SEGMENT, NEAR = 64, 32, 3
SHINGLE = 3
BLOCK = 2048             # members of a key compared in one task
HASHES_AT_ONCE = 1 << 16  # unpacked to 64 bytes each


def shingle_hashes(text: Column) -> Column:
    """XXH64 (seed 42) of every 3-word shingle, repeats included."""
    def of(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(
            F.concat_ws(" ", *[F.get(words, i + k) for k in range(SHINGLE)])))
        few = F.array(F.xxhash64(F.array_join(words, " ")))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE, few).otherwise(many)

    return F.get(F.transform(F.array(space_words(lower_ascii(text))), of), 0)


def majority_bits(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the 64-bit number whose bits are set in over half its values."""
    ones = np.zeros((len(offsets) - 1, BITS), np.int64)
    for lo, hi, rows, starts in blocks(offsets, HASHES_AT_ONCE):
        bits = np.unpackbits(values[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(ones, rows, sums_per_piece(bits, starts, np.int64))
    over = 2 * ones > np.diff(offsets)[:, None]
    return np.packbits(over, axis=1, bitorder="little").reshape(-1, 8).copy().view(np.int64).ravel()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            values, offsets = list_values(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(majority_bits(np.ascontiguousarray(values, np.int64), offsets))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number. Null,
    empty and blank texts have fingerprint zero."""
    small_batches(docs.sparkSession)
    hashed = docs.select(F.col(key).alias("doc_id"), shingle_hashes(whole(text)).alias("h"))
    return hashed.mapInArrow(_fingerprints, hashed.select("doc_id", F.lit(0).cast("bigint").alias("fp")).schema)


def _variants(fp: Column) -> Column:
    """Keys of a fingerprint. Bits 0-31: the segment, a wildcard bit cleared;
    32-37: wildcard position, 32 for none; 38: which segment."""
    low = fp.bitwiseAND(F.lit(2**SEGMENT - 1))
    high = F.shiftrightunsigned(fp, SEGMENT)
    def keys(seg: Column, no: int) -> Column:
        masked = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda b: F.struct(
            seg.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))
            .bitwiseOR(F.call_function("shiftleft", (b + 64 * no).cast("bigint"), F.lit(SEGMENT))).alias("key"),
            F.call_function("shiftright", seg, b).bitwiseAND(F.lit(1)).cast("int").alias("bit")))
        exact = F.struct(seg.bitwiseOR(F.lit((SEGMENT + 64 * no) << SEGMENT)).alias("key"), F.lit(0).alias("bit"))
        return F.concat(F.array(exact), masked)
    return F.explode(F.concat(keys(low, 0), keys(high, 1)))


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray, exact: bool, bit: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of the links between members ``left`` and ``right``."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i in left:
        near = right[np.bitwise_count(fps[right] ^ fps[i]) <= NEAR]
        if not exact:  # members with the same bit there meet under the whole segment
            near = near[bit[near] != bit[i]]
        for j in near:
            a, b = root(int(i)), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(fps[i]), int(fps[j])))
    return edges


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, fp, bit, block) sorted by (key, i, j): one group after another."""
    def solve(group: list[np.ndarray]) -> list[tuple[int, int]]:
        key, i, j, fp, bit, block = (np.concatenate(x) for x in zip(*group, strict=True))
        at = np.arange(len(fp))
        left, right = at[block == i[0]], at[block == j[0]]
        exact = bool((int(key[0]) >> SEGMENT) & 63 == SEGMENT)
        return _forest(fp.view(np.uint64), left, right, exact, bit)

    held: list[list[np.ndarray]] = []
    found: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
        for n, (lo, hi) in enumerate(zip([0, *new], [*new, batch.num_rows], strict=True)):
            part = [c[lo:hi] for c in cols]
            if held and (n or any(held[-1][k][0] != part[k][0] for k in range(3))):
                found += solve(held)
                held = []
            held.append(part)
        if len(found) > 10_000:
            yield out()
    if held:
        found += solve(held)
    yield out()


def link_forest(fps: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components as all links of the distinct
    fingerprints in column ``fp``."""
    index = fps.select("fp", _variants(F.col("fp")).alias("v")).select("fp", "v.*")
    exact = F.shiftrightunsigned("key", SEGMENT).bitwiseAND(F.lit(63)) == SEGMENT
    # keys are mostly single: dealing them out first keeps the hash maps of the tasks small
    keys = index.repartition("key").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"),
        F.min("bit").alias("lo"), F.max("bit").alias("hi"),
    ).filter((F.col("n") > 1) & (exact | (F.col("lo") < F.col("hi"))))
    keys = cut_lineage(keys, "variant-keys")
    pairs = keys.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR)).select("a", "b")
    crowded = keys.filter("n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = index.join(crowded, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = members.select("key", "fp", "bit", "block", F.explode(every).alias("other")).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "bit", "block")
    grouped = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return pairs.unionByName(grouped.mapInArrow(_edges, "a bigint, b bigint"))


def linked(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, root, component_id) of every row: near_duplicates with the fingerprint as a number, and
    the fingerprint that its component is named by inside."""
    marked = cut_lineage(fingerprints(docs, text, key), "fingerprints")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first")).repartition(spread, "fp")  # 66 keys each follow
    distinct = cut_lineage(distinct, "distinct-fps")
    roots = components(link_forest(distinct.select("fp")))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id reachable over links of at most three
    differing bits. Rows with equal fingerprints, repeated rows and all texts
    without words (fingerprint zero) are linked like any others. Null keys stay
    rows of their own and never name a component that has another key. An empty
    table gives no rows; other columns are not read.
    """
    return linked(docs, text, key).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
