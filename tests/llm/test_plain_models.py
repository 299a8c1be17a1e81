"""The classifier and the sharding tree against plain versions: word by word, weight by weight, cell by cell."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axiomloom.llm import quality, sharding

FOLDER = "/root/testdata/sf0.001"
TEXTS = ["", " \t ", "The the THE cat", "one|two !! #3 $x% café 中文 中文", "a" * 700 + " b b", "tail  word\n" * 9,
         "  nbsp is no gap", "x"]


def mixed(h):
    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % 2**64
    return h ^ (h >> 32)


def kind(c):
    if 97 <= c <= 122:
        return 1
    if 65 <= c <= 90:
        return 2
    if 48 <= c <= 57:
        return 4
    if chr(c) in "#*$%&<>":
        return 8
    return {"|": 16, "!": 32}.get(chr(c), 64 if 33 <= c <= 126 else 0)


def plain_features(text):
    """The features of a text with repeats, and its number of words."""
    out, before = [], None
    words = [w for w in text.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    for w in words:
        h = mixed(sum((c + 1) * pow(0x100000001B3, (i & 255) + 1, 2**64) for i, c in enumerate(w.lower())) % 2**64)
        shape = 0
        for c in w:
            shape |= kind(c)
        out += [h % quality.WORDS, quality.WORDS + shape]
        if before:
            out.append(mixed((h * 31 + before[0]) % 2**64) % quality.WORDS)
            out.append(quality.WORDS + quality.SHAPES + before[1] * quality.SHAPES + shape)
            if h == before[0]:
                out.append(quality.SIZE - 2)
        before = h, shape
    return out, len(words)


def plain_row(text):
    found, words = plain_features(text)
    if not words:
        return {quality.SIZE - 1: quality.SCALE}
    row = {}
    for f in found:
        row[f] = row.get(f, 0.0) + quality.SCALE / words
    return row


def plain_ftrl(rows, labels, epochs):
    """Follow the regularised leader, one coordinate at a time; returns a weight function and the bias."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= quality.L1:
            return 0.0
        return -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    zb = nb = 0.0
    shuffle = np.random.default_rng(2)
    for _ in range(epochs):
        for r in shuffle.permutation(len(rows)):
            bias = -zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)
            now = {i: weight(i) for i in rows[r]}
            g = 1 / (1 + math.exp(-(sum(now[i] * v for i, v in rows[r].items()) + bias))) - labels[r]
            for i, v in rows[r].items():
                old = n.get(i, 0.0)
                n[i] = old + (g * v) ** 2
                z[i] = z.get(i, 0.0) + g * v - (math.sqrt(n[i]) - math.sqrt(old)) / quality.ALPHA * now[i]
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / quality.ALPHA * bias
            nb += g * g
    return weight, -zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)


@pytest.mark.parametrize("block", [1 << 20, 1000, 24])
def test_features_equal_plain_features(monkeypatch, block):
    texts = [t for t in TEXTS if block > 700 or max(map(len, t.split()), default=0) < 20]
    monkeypatch.setattr(quality, "BYTES_AT_ONCE", block)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    got = [[] for _ in texts]
    for row, feature in quality.word_features(data, offsets):
        for r, f in zip(row, feature, strict=True):
            got[r].append(int(f))
    assert [sorted(g) for g in got] == [sorted(plain_features(t)[0]) for t in texts]


def test_training_and_scores_equal_plain_ftrl(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    extra = spark.createDataFrame([(-i - 1, t) for i, t in enumerate([None, *TEXTS])], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").unionByName(extra).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    assert len(known) < quality.LABELLED_ROWS
    learned = [k for k in sorted(known) if texts.get(k) is not None]
    weight, bias = plain_ftrl([plain_row(texts[k]) for k in learned], [known[k] for k in learned], quality.EPOCHS)
    model = quality.train(docs, labels)
    assert model.bias == pytest.approx(bias, abs=1e-9)
    scored = quality.score(docs.select("doc_id", "text").unionByName(extra), model).collect()
    assert len(scored) == len(texts)
    for r in scored:
        x = sum(weight(i) * v for i, v in plain_row(texts[r["doc_id"]] or "").items()) + bias
        want = 1 / (1 + math.exp(-x))
        assert r["score"] == pytest.approx(want, abs=1e-5), r["doc_id"]
        assert abs(want - quality.THRESHOLD) < 1e-5 or r["predicted"] == int(want >= quality.THRESHOLD)


def plain_tree(rows, dims, first, shards):
    """{row: shard}: split at the weighted median of the widest dimension, by sorting."""
    if shards == 1 or not rows:
        return {r["id"]: first for r in rows}
    spans = [max(r[f"c_{i}"] for r in rows) - min(r[f"c_{i}"] for r in rows) for i in range(dims)]
    wide = spans.index(max(spans))
    key = lambda r: (r[f"c_{wide}"] << 32) | r["tie"]
    goal = sum(r["size"] for r in rows) * (shards // 2) / shards
    below, cut = 0, 0
    for k in sorted({key(r) for r in rows}):
        here = sum(r["size"] for r in rows if key(r) == k)
        if below + here >= goal:
            cut = k if goal - below < below + here - goal else k + 1
            break
        below += here
    left, right = [r for r in rows if key(r) < cut], [r for r in rows if key(r) >= cut]
    return plain_tree(left, dims, first, shards // 2) | plain_tree(right, dims, first + shards // 2, shards - shards // 2)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_equal_a_plain_tree(spark, monkeypatch, shards):
    """Without the tolerance, the descent must find the very cuts of sorted rows: ties, heavy rows, a hot code."""
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    coded = spark.range(600).select(
        "id", F.when(F.col("id") % 3 == 0, 77).otherwise(F.xxhash64("id", F.lit(1)).bitwiseAND(F.lit(2**31 - 1))).alias("c_0"),
        F.xxhash64(F.col("id") % 50).bitwiseAND(F.lit(2**30 - 1)).alias("c_1"), (F.col("id") % 5).alias("c_2"),
        F.xxhash64("id", F.lit(2)).bitwiseAND(F.lit(2**(32 if shards == 7 else 4) - 1)).alias("tie"),
        F.when(F.col("id") == 9, 30_000).otherwise(16 + F.col("id") % 400).cast("bigint").alias("size"))
    got = {r["id"]: r["shard"] for r in sharding.kd_shards(coded, 3, "size", shards).collect()}
    assert got == plain_tree(coded.collect(), 3, 0, shards)
