"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes, with counts of
the byte that followed. A byte costs its exact code length under the longest
context known to the language; where that context never saw the byte, an escape
is paid (method C: as likely as the number of distinct followers) and the next
shorter context codes it, down to a uniform order -1. The statistics are frozen
after training, so the cost of (context, byte) is a constant; the trees of all
languages are compiled into one table of costs that scoring looks up, and a
text's code length is a sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import blocks, small_batches, sums_per_piece, text_bytes
from .text import whole

ORDER = 3
SAMPLE_PER_LANGUAGE = 400    # whole training documents per language, by hash of their id
LANGUAGES = 16               # in one cost table, which takes 1 KB per node and language; further ones have tables of their own
BYTES_AT_ONCE = 1 << 17      # scored at once, which takes some 40 times that in each Python worker
HELD_BYTES = 32 << 20        # of texts that wait for all tables when there are several
UNKNOWN = "und"


class Model(NamedTuple):
    """Counts of 4-byte windows per language, as trained; compiled where it is used."""

    languages: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]


class Trees(NamedTuple):
    """A compiled model. The node of a place is its deepest context known to any
    language; bytes that no language saw share one column of costs."""

    languages: list[str]
    pair_row: np.ndarray  # the two bytes before -> row of ``node``
    node: np.ndarray      # (rows, 256): with the third byte before -> node
    column: np.ndarray    # byte -> column of ``cost``
    cost: np.ndarray      # (nodes, columns, languages): code length in bits


def training_sample(docs: DataFrame, text: str, lang: str, key: str, per_language: int) -> DataFrame:
    """(lang, text): at most ``per_language`` rows of each language, of every language."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    ids = labelled.select(F.col(key).alias("k"), F.col(lang).alias("lang")).distinct()
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    place = F.xxhash64(F.col("k").cast("string"), F.lit("langid"))
    # a fifth more than wanted passes the hash, so that no task ranks a whole language
    share = F.shiftrightunsigned(place, 11) / float(2**53)
    ids = ids.join(F.broadcast(sizes), "lang").filter(share <= 1.2 * per_language / F.col("size"))  # a row per language
    best = W.partitionBy("lang").orderBy(place, "k")
    ids = ids.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= per_language)
    rows = labelled.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    picked = rows.join(F.broadcast(ids.select("k", "lang")), ["k", "lang"])  # at most per_language ids of each language
    return picked.dropDuplicates(["k", "lang"]).select("lang", "text")


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of 4-byte windows (three bytes of context, zero before the start)."""
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            for text in rows["text"]:
                b = np.concatenate([np.zeros(ORDER, np.uint32), np.frombuffer(text.encode(), np.uint8).astype(np.uint32)])
                if len(b) > ORDER:
                    windows = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                    grams, n = np.unique(windows, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n.astype(np.int64)})


def _level(grams: np.ndarray, counts: np.ndarray, k: int, column: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """For one order: known contexts, and their counts of the next byte's column."""
    known, row = np.unique((grams >> 8) & ((1 << 8 * k) - 1), return_inverse=True)
    table = np.zeros((len(known), columns), np.float32)
    np.add.at(table, (row, column[grams & 255]), counts)
    return known, table


def compile_model(model: Model) -> Trees:
    """Unfold the trees into costs, from the empty context to the longest. A
    context that a language does not know costs what its suffix costs."""
    n = len(model.languages)
    used = np.unique(np.concatenate([g & 255 for g in model.grams])) if n else np.zeros(0, np.int64)
    column = np.full(256, len(used))
    column[used] = np.arange(len(used))
    shorter, below = np.zeros(1, np.int64), np.full((1, len(used) + 1, n), 8.0, np.float32)
    parts, depth = [], []
    for k in range(ORDER + 1):
        level = [_level(g, c, k, column, len(used) + 1) for g, c in zip(model.grams, model.counts, strict=True)]
        contexts = np.unique(np.concatenate([known for known, _ in level])) if n else np.zeros(1 if k == 0 else 0, np.int64)
        cost = below[np.searchsorted(shorter, contexts & ((1 << 8 * max(k - 1, 0)) - 1))]
        for j, (known, seen) in enumerate(level):
            at = np.searchsorted(contexts, known)
            total, distinct = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore"):
                cost[at, :, j] = np.where(seen > 0, -np.log2(seen / (total + distinct)), cost[at, :, j] - np.log2(distinct / (total + distinct)))
        parts.append(cost)
        depth.append((contexts, sum(map(len, parts[:-1])) + np.arange(len(contexts))))
        shorter, below = contexts, cost
    # rows: one for each pair of bytes known as a context, one for each last byte, known or not
    (_, root), (ones, one_nodes), (twos, two_nodes), (threes, three_nodes) = depth
    of_last = np.full(256, root[0])
    of_last[ones] = one_nodes
    node = np.concatenate([np.repeat(two_nodes[:, None], 256, 1), np.repeat(of_last[:, None], 256, 1)]).astype(np.int32)
    node[np.searchsorted(twos, threes & 0xFFFF), threes >> 16] = three_nodes
    pair_row = len(twos) + (np.arange(1 << 16) & 255)
    pair_row[twos] = np.arange(len(twos))
    return Trees(model.languages, pair_row.astype(np.int32), node, column, np.concatenate(parts))


_COMPILED: dict[str, Trees] = {}


def _compiled(model: Model) -> Trees:
    """The compiled model of this Python worker, which serves many tasks."""
    mark = hashlib.sha256(repr(model.languages).encode() + b"".join(a.tobytes() for x in (model.grams, model.counts) for a in x)).hexdigest()
    if mark not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[mark] = compile_model(model)
    return _COMPILED[mark]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from labelled rows. The sample is bounded per language; what
    reaches the driver are byte statistics, not texts."""
    small_batches(docs.sparkSession)
    counts = training_sample(docs, text, lang, key, per_language).mapInPandas(
        _grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = counts.toPandas().sort_values(["lang", "gram"])
    by_lang = {name: own for name, own in grams.groupby("lang")}
    return Model(list(by_lang), [x["gram"].to_numpy() for x in by_lang.values()], [x["n"].to_numpy() for x in by_lang.values()])


def groups(model: Model) -> list[Model]:
    """Parts of at most LANGUAGES languages, in order. What a text costs under a
    language does not depend on the languages that share its table."""
    return [Model(*(x[i:i + LANGUAGES] for x in model)) for i in range(0, len(model.languages), LANGUAGES)]


def held_together(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches whose texts (of that column) take about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def code_lengths(model: Trees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, languages): bits that each text takes under each language."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    for lo, hi, rows, starts in blocks(offsets, BYTES_AT_ONCE, ORDER):
        b = data[lo:hi].astype(np.int32)
        context = np.zeros(len(b), np.int32)
        for k in range(1, ORDER + 1):
            context[k:] |= b[:-k] << (8 * (k - 1))
        carried = lo > offsets[rows[0]]  # a later piece of a long text begins with the bytes before it
        if not carried:
            for k in range(ORDER):       # no context reaches across the start of a text
                first = starts[starts + k < len(b)] + k
                first = first[np.searchsorted(starts, first, side="right") - 1 == np.searchsorted(starts, first - k, side="right") - 1]
                context[first] &= (1 << 8 * k) - 1
        bits = model.cost[model.node[model.pair_row[context & 0xFFFF], context >> 16], model.column[b]]
        if carried:
            bits = bits[ORDER:]
        np.add.at(out, rows, sums_per_piece(bits, starts))
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", keep: tuple[Column, ...] = (),
            with_text: bool = False) -> DataFrame:
    """(doc_id, ``keep`` columns, the text if asked for, lang_pred, score, bits_per_byte) of every row.

    ``und`` with score 0 where the text is null, empty or has no letter, or
    where the model knows no language. The score is the posterior of the best
    language under equal priors; ties go to the first in alphabetical order.
    Repeated rows get equal answers; only the named columns are read. Pack rows
    whose columns may clash with the result's into one struct to keep them.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # byte statistics of a bounded sample, a few MB
    rows = docs.select(F.col(key).alias("doc_id"), *keep, F.col(text).alias("text"), whole(text).rlike(r"\p{L}").alias("_letters"))

    n = len(rows.columns)
    passed = n - 1 if with_text else n - 2

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names, parts = np.array([*model.languages, UNKNOWN], dtype=object), groups(model)
        for some in held_together(batches, n - 2, HELD_BYTES if len(parts) > 1 else 0):
            texts = [text_bytes(pc.fill_null(batch.column(n - 2), "")) for batch in some]
            bits = [np.zeros((batch.num_rows, len(model.languages))) for batch in some]
            for j, part in enumerate(parts):
                m = _compiled(part)
                for own, (data, offsets) in zip(bits, texts, strict=True):
                    own[:, j * LANGUAGES:j * LANGUAGES + len(part.languages)] = code_lengths(m, data, offsets)
                del m  # one table in memory at a time
            for batch, own, (_, offsets) in zip(some, bits, texts, strict=True):
                letters = batch.column(n - 1).to_numpy(zero_copy_only=False)
                size = np.maximum(np.diff(offsets), 1)
                if model.languages:
                    best = own.argmin(axis=1)
                    least = own[np.arange(len(own)), best]
                    posterior = 1 / np.exp2(np.minimum(0, least[:, None] - own)).sum(axis=1)
                else:
                    best, least, posterior = np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size))
                    letters = np.zeros(len(size), bool)
                yield pa.RecordBatch.from_arrays([
                    *batch.columns[:passed],
                    pa.array(names[np.where(letters, best, len(model.languages))], pa.string()),
                    pa.array(np.where(letters, posterior, 0.0)), pa.array(least / size)],
                    names=[*batch.schema.names[:passed], "lang_pred", "score", "bits_per_byte"])

    schema = (rows if with_text else rows.drop("text")).drop("_letters").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("bits_per_byte", F.lit(0.0)).schema
    return rows.mapInArrow(score, schema)


def held_out(key: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows whose crc32(doc_id) mod 3 is not 1, predict all rows."""
    model = train(docs.filter(~held_out("doc_id", 3, 1)))
    out = predict(docs, model, keep=(held_out("doc_id", 3, 1).alias("held_out"),))
    return out
