"""Skew-safe building blocks shared by the operators.

Each helper keeps the amount of data one task sees bounded even when a single
key owns a large share of all rows: work is aggregated before the shuffle,
split by ranges of an order key, or salted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import cut_lineage

FEW_HOT_KEYS = 1024
HOT_KEY_ROWS = 1_000_000
LEAST_SLICES = 64
GATHERED_ROWS = 50_000
GATHERED_BYTES = 8 << 20
HOT_KEY_BYTES = 256 << 20
MAP_SIDE_ROWS = 100
SLICE_ROWS = 4096


def hash_int(*parts: Column | str, seed: str = "") -> Column:
    """A 32-bit unsigned number from md5, identical in every SQL engine."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *cols))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_long(*parts: Column | str, seed: str = "") -> Column:
    """Like hash_int with 60 bits, for orders over many rows."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *cols))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_key(*parts: Column | str, seed: str = "") -> Column:
    """The whole md5 text, used as a reproducible shuffle order."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(seed), *cols))


def _salt(columns: Sequence[str], salts: Column) -> Column:
    """A slice number. The partition id also spreads rows that are exact copies;
    it depends only on where a row was read or shuffled to, so retries agree."""
    return F.pmod(F.xxhash64(*columns) + F.spark_partition_id(), salts)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the smallest order columns.

    ``min_by`` aggregates map-side, so a hot key sends one row per map task.
    """
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the largest order columns."""
    return _keep(df, keys, order, F.max_by)


def _keep(df: DataFrame, keys, order, chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        chooser(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          rank: str = "_rank") -> DataFrame:
    """At most ``n`` rows per key, exactly, without one task owning a key.

    Up to ``MAP_SIDE_ROWS`` rows Spark limits each key on the map side, so a task
    sends ``n`` rows of a key at most. For more, a first ranking runs inside salted
    slices of each key, so at most ``n`` rows per key and slice reach the second
    ranking. There are as many slices as shuffle partitions, at least ``LEAST_SLICES``.
    """
    whole = W.partitionBy(*keys).orderBy(*order)
    if n <= MAP_SIDE_ROWS:
        return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)
    slices = max(LEAST_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = _salt(df.columns, F.lit(slices))
    sliced = W.partitionBy(*keys, "_salt").orderBy(*order)
    pre = (
        df.withColumn("_salt", salt)
        .withColumn("_pre", F.row_number().over(sliced))
        .filter(F.col("_pre") <= n)
        .drop("_pre", "_salt")
    )
    return pre.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)


def dense_position(df: DataFrame, keys: Sequence[str], order: str, out: str,
                   tie: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """1-based position of each row inside its key, by an order column.

    ``order`` (with ``tie``) must be unique inside a key. Rows are dealt to
    ranges of (keys, order, tie), as many as there are shuffle partitions unless
    ``ranges`` says otherwise, and stored in that order with a running number;
    a row's position is its number inside its range, shifted by the counts of
    the ranges before. ``df`` is read once, and one key or the whole table is
    split like anything else.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [*keys, order, *tie]
    dealt = df.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    stored = cut_lineage(dealt.withColumn("_no", F.monotonically_increasing_id()), "positions")
    tagged = stored.withColumn("_bucket", F.shiftright("_no", 33))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_bucket").agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
        .drop("_n", "_first")
    )
    on = [*keys, "_bucket"]
    joined = tagged.join(_null_safe(offsets, on), _match(tagged, on), "inner")
    return joined.select(*df.columns, (F.col("_no") + F.col("_shift")).cast("bigint").alias(out))


def _null_safe(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_r_{c}") for c in on],
                     *[c for c in df.columns if c not in on])


def _match(df: DataFrame, on: Sequence[str]) -> Column:
    cond = None
    for c in on:
        part = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = part if cond is None else cond & part
    return cond


def rank_by_value(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """SQL ``rank()`` by descending value inside keys, from a histogram.

    Only the distinct (key, value) counts are windowed; rows join their rank
    back, so a key with a third of the table is never sorted in one task.
    """
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    above = W.partitionBy(*keys).orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, -1)
    ranks = hist.select(
        *keys, value, (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias(out)
    )
    return df.join(ranks, [*keys, value], "inner")


def shuffled_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join that is never broadcast. Stored rows of few distinct texts take
    little space in files and much in memory, so that the planner, which compares
    file sizes, may send a whole large table through the driver."""
    return left.join(right.hint("merge"), list(on), how)


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """The keys of ``df`` with at least ``min_rows`` rows, all of them, and in
    ``_salts`` how many slices of about ``min_rows`` rows each is cut into."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slices = F.greatest(F.ceil(F.col("_n") / min_rows), F.lit(2)).cast("int")
    return counts.filter(F.col("_n") >= min_rows).select(*keys, slices.alias("_salts"))


def find_hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_KEY_ROWS) -> DataFrame | None:
    """hot_keys as a fixed small frame, or None when no key is hot. For loops
    that join the same table many times."""
    hot = hot_keys(df, keys, min_rows)
    rows = hot.limit(FEW_HOT_KEYS + 1).collect()
    if len(rows) > FEW_HOT_KEYS:  # too many for the driver: a table in the shared folder
        return cut_lineage(hot, "hot-keys")
    return df.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                min_rows: int = HOT_KEY_ROWS, salts: int | None = None) -> DataFrame:
    """Equi join whose heaviest left keys are spread over tasks of about
    ``min_rows`` left rows each, however large a key is.

    Keys are counted first, reading only the key columns; without a hot key
    this is a plain join. Otherwise right rows of a hot key are repeated once
    per salt of that key, all others once; ``salts`` sets one number for all.
    ``how`` may be inner, left, left_semi or left_anti. When several joins share
    a left table, find their hot keys on that table and use salt_hot_keys.
    """
    return salt_hot_keys(left, right, on, find_hot_keys(left, on, min_rows), how, salts)


def salt_hot_keys(left: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame | None,
                  how: str = "inner", salts: int | None = None) -> DataFrame:
    """salted_join with the hot keys already known; None is a plain join. The
    planner chooses how to join the keys, by their size."""
    if hot is None:
        return left.join(right, list(on), how)
    if salts:
        hot = hot.withColumn("_salts", F.lit(salts))
    slices = F.coalesce("_salts", F.lit(1))
    lhs = left.join(hot, list(on), "left").withColumn("_salt", _salt(left.columns, slices).cast("int")).drop("_salts")
    rhs = right.join(hot, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_salts")
    return lhs.join(rhs, [*on, "_salt"], how).drop("_salt")


def attach_within(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """``left`` with the ``value`` that ``right`` has for its keys, null without one; ``right`` has a row a key.

    A left join for tables that are dealt to the same tasks by one of the keys already:
    a join would deal both again by all of its keys, a window over both leaves them in place.
    """
    keys = {c: f"_on_{c}" for c in on}  # a union keeps its inputs' partitioning for columns named anew only
    both = left.withColumn("_left", F.lit(True)).withColumnsRenamed(keys).unionByName(
        right.select(*on, value).withColumnsRenamed(keys), allowMissingColumns=True)
    found = F.when(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys.values()]),
                   F.first(value, ignorenulls=True).over(W.partitionBy(*keys.values())))
    out = both.withColumn(value, found).filter("_left").drop("_left")
    return out.withColumnsRenamed({k: c for c, k in keys.items()})


def gathering_tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks keep each at about ``GATHERED_ROWS`` of these rows. Exchanges of this fixed number
    are not merged by their compressed size, which says little about rows of few distinct texts."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // GATHERED_ROWS)


def gather_texts(df: DataFrame, key: str, text: str, min_bytes: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(the rows of keys with less than ``min_bytes`` of text, dealt to tasks by key; the rows of the others as they are, or None).

    What is made of the dealt rows and grouped or joined by the key and further columns
    needs no exchange of its own. There are as many tasks as keep each at about
    ``GATHERED_BYTES`` of text.
    """
    min_bytes = HOT_KEY_BYTES if min_bytes is None else min_bytes
    sizes = df.groupBy(key).agg(F.sum(F.octet_length(text)).alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max(F.when(F.col(key).isNotNull(), F.col("_n")))).first()
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total or 0) // GATHERED_BYTES)
    if (most or 0) < min_bytes:
        return df.repartition(tasks, key), None
    hot = cut_lineage(sizes.filter((F.col("_n") >= min_bytes) & F.col(key).isNotNull()).select(key), "hot-keys")
    return df.join(hot, key, "left_anti").repartition(tasks, key), df.join(hot, key, "left_semi")


def split_hot(key: str, *tables: DataFrame, min_rows: int = HOT_KEY_ROWS,
              beside: Sequence[DataFrame] = ()) -> tuple[tuple, tuple | None, int]:
    """(tables with the keys of fewer than ``min_rows`` rows in all, the tables of the others or None, tasks).

    The rows of a key that is not hot may be gathered in one task: one
    ``repartition(tasks, key)`` serves every grouping and window that starts with the
    key. There are as many tasks as keep each at about ``GATHERED_ROWS`` rows. Tables
    ``beside`` follow the others and are split alike, their rows are not counted.
    """
    counts = reduce(DataFrame.unionAll, [t.select(key) for t in tables]).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max(F.when(F.col(key).isNotNull(), F.col("_n")))).first()
    tasks = gathering_tasks(tables[0].sparkSession, total or 0)
    tables = (*tables, *beside)
    if (most or 0) < min_rows:
        return tables, None, tasks
    hot = cut_lineage(counts.filter((F.col("_n") >= min_rows) & F.col(key).isNotNull()).select(key), "hot-keys")
    part = lambda how: tuple(t.join(hot, key, how) for t in tables)
    return part("left_anti"), part("left_semi"), tasks
