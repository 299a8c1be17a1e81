"""More labels than one cost table holds."""

import random

import numpy as np
import pyarrow as pa

from axiomloom.llm import langid


def made(n_languages, texts, seed=11):
    """(doc_id, text, lang): each language has letters and words of its own; later ones have fewer texts."""
    rng, rows = random.Random(seed), []
    for j in range(n_languages):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzéöüßñç", 8)
        words = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(40)]
        for _ in range(texts + n_languages - j):
            rows.append((len(rows), " ".join(rng.choices(words, k=40)), f"l{j:02d}"))
    return rows


def test_every_label_is_learned_and_predicted(spark):
    rows = made(40, 6)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs.filter("doc_id % 4 <> 1"))
    assert model.languages == sorted({r[2] for r in rows})
    want = {i: lang for i, _, lang in rows}
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) and all(r.lang_pred == want[r.doc_id] and r.score > 0.99 for r in got)


def test_rows_per_label_stay_bounded(spark):
    rows = made(20, 6)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sizes = {r["lang"]: r["count"] for r in langid.training_sample(docs, "text", "lang", "doc_id", 5).groupBy("lang").count().collect()}
    assert len(sizes) == 20 and max(sizes.values()) <= 5


def test_groups_cost_what_one_table_costs(monkeypatch):
    rng = np.random.default_rng(2)
    grams = [np.unique(rng.integers(97, 103, (300, 4)) @ (1 << np.array([24, 16, 8, 0]))) for _ in range(5)]
    model = langid.Model([f"l{i}" for i in range(5)], grams, [rng.integers(1, 9, len(g)) for g in grams])
    data = np.frombuffer(b"abcdef fedcba zz aaaabbbb", np.uint8)
    offsets = np.array([0, 6, 13, 25])
    whole = langid.code_lengths(langid.compile_model(model), data, offsets)
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    parts = langid.groups(model)
    assert [len(p.languages) for p in parts] == [2, 2, 1]
    assert np.allclose(np.hstack([langid.code_lengths(langid.compile_model(p), data, offsets) for p in parts]), whole, rtol=1e-5)
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * 100]}) for _ in range(5)]
    assert [len(h) for h in langid.held_together(iter(batches), 0, 200)] == [2, 2, 1]
