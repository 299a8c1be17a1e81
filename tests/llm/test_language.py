"""The compiled trees against a plain PPM coder, and held-out accuracy."""

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from axiomloom.llm import langid
from axiomloom.llm import queries as q

TEXTS = {"aa": ["the cat sat on the mat", "a cat and a hat"], "bb": ["der hund und die katze", "über die straße"]}


def plain_bits(training: list[str], text: str) -> float:
    """PPM, escape method C, order 3, frozen, byte by byte with dictionaries."""
    trees = [defaultdict(Counter) for _ in range(4)]
    for t in training:
        b = bytes(3) + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                trees[k][b[i - k:i]][b[i]] += 1
    total, b = 0.0, text.encode()
    padded = bytes(3) + b
    for i in range(len(b)):
        for k in range(3, -1, -1):
            seen = trees[k].get(padded[i + 3 - k:i + 3])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if padded[i + 3] in seen:
                total -= math.log2(seen[padded[i + 3]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_equal_a_plain_coder():
    grams = {}
    for lang, texts in TEXTS.items():
        count = Counter()
        for t in texts:
            b = bytes(3) + t.encode()
            count.update(int.from_bytes(b[i - 3:i + 1], "big") for i in range(3, len(b)))
        grams[lang] = count
    model = langid.Model(list(grams), [np.array(sorted(c)) for c in grams.values()], [np.array([c[g] for g in sorted(c)]) for c in grams.values()])
    trees = langid.compile_model(model)
    probes = ["the hat", "", "die katze über", "zzz\x00 é", "a", "the cat sat on the mat" * 3]
    data = b"".join(p.encode() for p in probes)
    offsets = np.cumsum([0] + [len(p.encode()) for p in probes])
    want = [[plain_bits(TEXTS[lang], p) for lang in grams] for p in probes]
    for size in (langid.BYTES_AT_ONCE, 7):  # also in pieces shorter than a text
        langid.BYTES_AT_ONCE, before = size, langid.BYTES_AT_ONCE
        got = langid.code_lengths(trees, np.frombuffer(data, np.uint8), offsets)
        langid.BYTES_AT_ONCE = before
        assert np.allclose(got, want, rtol=1e-4)


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    r = q.QUERIES["op10_language_id"](spark, folder).join(docs, "doc_id").filter("held_out")
    right, n = r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right >= 0.98


def test_memory_of_scoring_and_compiling():
    """What a worker takes beside the tables follows neither the text at hand nor all tables at once."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 1 << 21).astype(np.uint8)
    grams = np.unique(rng.integers(97, 123, (20_000, 4)) @ np.array([1 << 24, 1 << 16, 1 << 8, 1]))
    model = langid.Model(["aa", "bb", "cc", "dd"], [grams] * 4, [np.ones(len(grams), np.int64)] * 4)
    tracemalloc.start()
    trees = langid.compile_model(model)
    held, compiling = tracemalloc.get_traced_memory()
    tracemalloc.reset_peak()
    langid.code_lengths(trees, data, np.arange(0, len(data) + 1, 1 << 13))
    scoring = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert scoring < 10e6
    assert compiling < 4 * held
