"""Quality classifier: hashed word n-grams, logistic regression, FTRL.

A text is a sparse vector: hashed words and word pairs, the words' shapes (which
kinds of characters they hold) and pairs of shapes, and words that repeat the
one before, each as its share of the words. Follow-the-regularised-leader
(FTRL-Proximal) updates train the weights row by row; a score is the logistic
of a sparse dot product. Hashing works on whole batches of UTF-8 bytes at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, text_bytes
from .text import whole

WORD_BITS, SHAPES = 17, 128
WORDS = 1 << WORD_BITS
SIZE = WORDS + SHAPES + SHAPES * SHAPES + 2  # words and pairs, shapes, shape pairs, repeats, too-short texts
LABELLED_ROWS = 3_000    # training rows, by hash of their id
EPOCHS = 4
SCALE = 10.0             # of the shares, so that weights stay small
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-3
THRESHOLD = 0.3
BYTES_AT_ONCE = 1 << 20
_PRIME = 0x100000001B3

#: Kinds of characters, one bit each: a-z, A-Z, 0-9, marks of markup, bar, bang, other ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 64
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 4
for _c, _bit in (("#*$%&<>", 8), ("|", 16), ("!", 32)):
    _KIND[list(_c.encode())] = _bit
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(256, _PRIME, np.uint64), dtype=np.uint64)


def _pieces(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """Blocks of rows of about ``most`` bytes: (start, end, rows, their starts, goes
    on with the row of the block before). Long rows are cut at white space; only a
    word longer than a block is cut inside."""
    n, row = len(offsets) - 1, 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        if last > row:
            yield int(offsets[row]), int(offsets[last]), np.arange(row, last), offsets[row:last] - offsets[row], False
            row = last
            continue
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at < end:
            to = min(at + most, end)
            if to < end:
                gaps = np.flatnonzero(_SPACE[data[at:to]])
                to = at + int(gaps[-1]) + 1 if len(gaps) else to
            yield at, to, np.array([row]), np.array([0]), at > offsets[row]
            at = to
        row += 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of every n-gram, five for each word but the first of a row."""
    before = (np.uint64(0), 0)  # hash and shape of the word before the block, in the same row
    for lo, hi, rows, starts, goes_on in _pieces(data, offsets, BYTES_AT_ONCE):
        b = data[lo:hi]
        if not len(b):
            continue
        gap = _SPACE[b]
        first = ~gap
        first[1:] &= gap[:-1]
        begins = starts[starts < len(b)]
        first[begins] = ~gap[begins]
        at = np.flatnonzero(first)
        if not len(at):
            continue
        word = np.cumsum(first) - 1
        within = np.arange(len(b)) - at[np.maximum(word, 0)]
        h = np.where(gap, np.uint64(0), (_LOWER[b] + np.uint64(1)) * _POWERS[within & 255])
        h = _mix(np.add.reduceat(h, at))
        shape = np.bitwise_or.reduceat(np.where(gap, 0, _KIND[b]), at).astype(np.int64)
        of = np.searchsorted(starts, at, side="right") - 1
        opens = np.ones(len(at), bool)
        opens[1:] = of[1:] != of[:-1]
        h1, s1 = np.roll(h, 1), np.roll(shape, 1)
        if goes_on:
            h1[0], s1[0], opens[0] = *before, False
        before = (h[-1], int(shape[-1]))
        row = rows[of]
        pair = ~opens
        mask = np.uint64(WORDS - 1)
        yield row, (h & mask).astype(np.int64)
        yield row, WORDS + shape
        yield row[pair], (_mix(h[pair] * np.uint64(31) + h1[pair]) & mask).astype(np.int64)
        yield row[pair], WORDS + SHAPES + s1[pair] * SHAPES + shape[pair]
        again = pair & (h == h1)
        yield row[again], np.full(again.sum(), SIZE - 2)


class Weights(NamedTuple):
    w: np.ndarray
    bias: float


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """FTRL-Proximal over sparse rows (features, values); the bias is not regularised."""
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    zb = nb = 0.0

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    bias = lambda: -zb / ((BETA + np.sqrt(nb)) / ALPHA)
    order = np.random.default_rng(2)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, v = rows[r]
            w, b = weight(i), bias()
            g = 1 / (1 + np.exp(-np.clip(w @ v + b, -35, 35))) - labels[r]
            gi = g * v
            z[i] += gi - (np.sqrt(n[i] + gi * gi) - np.sqrt(n[i])) / ALPHA * w
            n[i] += gi * gi
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * b
            nb += g * g
    return Weights(weight(np.arange(SIZE)).astype(np.float32), float(bias()))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quality, features, values): counts of a labelled text, merged per feature."""
    for b in batches:
        data, offsets = text_bytes(b.column(0))
        out_i, out_v = [], []
        for k in range(b.num_rows):
            found = [f for _, f in word_features(data[offsets[k]:offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))]
            i, c = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            words = c[(i >= WORDS) & (i < WORDS + SHAPES)].sum()
            out_i.append(i if words else np.array([SIZE - 1]))
            out_v.append(c * (SCALE / words) if words else np.array([SCALE]))
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out_i, pa.list_(pa.int64())), pa.array(out_v, pa.list_(pa.float64()))],
                                         names=["y", "i", "v"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          most: int = LABELLED_ROWS) -> Weights:
    """Weights from at most ``most`` labelled rows. Rows without a label or a text
    and repeated ids are not learned from; without both labels every score is the bias."""
    small_batches(docs.sparkSession)
    picked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.min(F.col(label)).cast("int").alias("y"))
    picked = F.broadcast(picked.orderBy(F.xxhash64(F.col("k").cast("string"), F.lit("quality")), "k").limit(most))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull()).join(picked, "k")
    found = rows.dropDuplicates(["k"]).orderBy("k").select("t", "y").mapInArrow(_vectors, "y int, i array<bigint>, v array<double>").toPandas()
    return ftrl([(np.asarray(i), np.asarray(v)) for i, v in zip(found["i"], found["v"], strict=True)], found["y"].to_numpy(float))


def score(docs: DataFrame, weights: Weights, text: str = "text", keep: tuple[Column | str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted of every row.

    Null, empty and blank texts have one feature of their own. Repeated rows get
    equal scores; only ``text`` and ``keep`` are read.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)  # SIZE numbers, whatever the corpus
    rows = docs.select(*keep, whole(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = held.value
        for b in batches:
            data, offsets = text_bytes(b.column(b.num_columns - 1))
            total, words = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for k, (row, feature) in enumerate(word_features(data, offsets)):
                total += np.bincount(row, w[feature], minlength=b.num_rows)
                if k % 5 == 0:
                    words += np.bincount(row, minlength=b.num_rows)
            x = np.where(words > 0, total * SCALE / np.maximum(words, 1), w[SIZE - 1] * SCALE) + bias
            p = 1 / (1 + np.exp(-np.clip(x, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                                             names=[*b.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, rows.drop("_t").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema)
