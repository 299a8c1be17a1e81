"""Dictionaries and bounds are taken from all rows, not from a sample."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from axiomloom.llm import langid, secret_scan


def test_the_dictionary_holds_words_of_all_documents(spark):
    word = lambda i: "w" + "".join(chr(97 + int(c)) for c in f"{i:05d}")
    words = [word(i) for i in range(2_300)]
    docs = spark.createDataFrame([(i, f"{w.upper()} the") for i, w in enumerate(words)], "doc_id long, text string")
    lang = secret_scan.learn(docs).lang
    assert lang.words == {*words, "the"}
    counted = secret_scan.language([*[(w, 1) for w in words], ("the", 2_300)])
    assert np.allclose(lang.transitions, counted.transitions)


def test_transitions_count_words_beyond_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "DICTIONARY", 2)
    docs = spark.createDataFrame([(1, "aa aa aa bb bb"), (2, "qzqz"), (3, None)], "doc_id long, text string")
    lang = secret_scan.learn(docs).lang
    assert np.allclose(lang.transitions, secret_scan.language([("aa", 3), ("bb", 2), ("qzqz", 1)]).transitions)


def test_the_bound_of_bits_reads_all_other_rows(spark, monkeypatch):
    docs = spark.range(1_400).selectExpr("id as doc_id", "concat('the house and the garden ', id) as text", "'en' as lang")
    others = docs.filter(~corpus_pipeline._trains())
    assert others.count() > langid.SAMPLE_PER_LANGUAGE
    read, predict = [], langid.predict

    def seen(rows, *args, **options):
        read.append(rows.count())
        return predict(rows, *args, **options)

    monkeypatch.setattr(langid, "predict", seen)
    model = langid.train(docs.filter(corpus_pipeline._trains()))
    bound = corpus_pipeline._most_bits(spark, docs, model)
    assert read == [others.count()]
    assert docs.select(bound.alias("b")).filter(F.col("b") < 100).count() == docs.count()
