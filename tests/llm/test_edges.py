"""Nulls, empty and long texts, repeated rows, empty tables and clashing names for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from axiomloom.llm import chat, decontam, langid, pii, quality, rules, secret_scan, sharding, simhash
from axiomloom.llm import sentencepiece as pieces

CLASHING = ("k", "t", "h", "w", "y", "size", "fp", "row", "ids", "no", "part", "held_out", "score", "spans", "n_words",
            "row_key", "found", "component_id", "fingerprint", "_t", "letters", "lang_pred", "text_crc32", "shard", "bucket", "n")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "A short text of a few words."), (4, "A short text of a few words."),
    (5, "lorem ipsum dolor " * 20_000), (None, "no id here"), (None, None), (6, "a" * 120_000), (7, "é 😀 ▁▁   <|im_end|>"),
    (8, "write to jane.doe@example.org or +49 170 555 1234, 10.0.0.1, 4111 1111 1111 1111"), (9, 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" in it'),
    (10, "12345 67890 !!! 42"), (11, "one two three four five six seven eight nine ten eleven"), (12, "ONE two three four five six seven eight nine ten eleven"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", "src1", len(t or "")) for i, t in ROWS], SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "short text"),
                                  (1, "one two three four five six seven eight nine ten"), (None, "lorem ipsum")], "item_id bigint, text string")


def all_operators(docs, labels, items):
    model = pieces.read_model()
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), "text", "k", "t", "h")
    return {
        "pii": lambda: pii.find(docs, pii.learn(docs)),
        "quality": lambda: quality.score(docs, quality.train(docs, labels)),
        "chat": lambda: chat.conversation_digests(chat.format_turns(turns)),
        "secrets": lambda: secret_scan.scan(docs, secret_scan.learn(docs)),
        "decontam": lambda: decontam.decontaminate(docs, items),
        "pieces": lambda: pieces.decode_documents(pieces.encode_documents(docs, model), model),
        "simhash": lambda: simhash.near_duplicates(docs),
        "shards": lambda: sharding.shard_documents(docs, 4),
        "rules": lambda: rules.quality_rules(docs),
        "language": lambda: langid.predict(docs, langid.train(docs)),
    }


NAMES = ("pii", "quality", "chat", "secrets", "decontam", "pieces", "simhash", "shards", "rules", "language")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, labels, items, name):
    got = all_operators(docs, labels, items)[name]().collect()
    if name == "chat":  # one row per conversation: repeated and null keys share theirs
        assert len(got) == len({i for i, _ in ROWS})
        return
    assert len(got) == len(ROWS)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(by_id[4]) == 2 and len(by_id[None]) == 2
    one = lambda i: by_id[i][0]
    if name == "pii":
        assert (one(8).n_email, one(8).n_ip, one(8).n_card, one(8).n_phone) == (1, 1, 1, 1)
        assert one(1).spans == one(2).spans == one(5).spans == ""
    elif name == "quality":
        assert all(0 <= r.score <= 1 for r in got) and one(1).score == one(2).score == one(3).score
        assert by_id[4][0].score == by_id[4][1].score
    elif name == "secrets":
        assert one(9).spans == "assigned:9:49" and one(1).n_candidates == one(5).n_candidates == 0
    elif name == "decontam":
        assert (one(1).n_words, one(1).n_hit) == (0, 0) and (one(11).n_hit, one(12).n_hit) == (10, 10)
        assert (one(4).n_hit, one(5).n_hit) == (2, 40_000) and one(11).n_items == 1 and one(5).n_items == 0
    elif name == "pieces":
        assert all(r.decoded == t for i, t in ROWS if t and i not in (None, 4, 7) for r in by_id[i]) and one(1).ids == one(2).ids == []
        assert one(7).decoded == ROWS[9][1].replace("▁", " ")  # the mark itself decodes to a space
    elif name == "simhash":
        assert one(1).component_id == one(2).component_id == one(3).component_id == 1 and one(3).fingerprint == "0" * 16
        assert one(11).component_id == one(12).component_id == 11 and {r.component_id for r in by_id[4]} == {4}
    elif name == "shards":
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert one(1).size == 16 and one(1).text_crc32 == 0
    elif name == "rules":
        assert all(by_id[i][0].base_failed and not by_id[i][0].kept for i in (1, 2, 3)) and one(5).n_repeat_words == 60_000
    else:
        assert all(by_id[i][0].lang_pred == "und" for i in (1, 2, 3, 10)) and one(5).lang_pred == "en"


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, labels, items, name):
    assert all_operators(docs.limit(0), labels.limit(0), items.limit(0))[name]().count() == 0


def test_pipeline_stages_keep_columns(spark, docs, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert not {1, 2, 3, 4, 10, 11, 12} & set(kept)    # no language, copies, benchmark windows
    assert kept[9] == 'token = "[SECRET]" in it'
    assert {8, 9} <= set(kept)


def test_unknown_languages_and_repeated_ids(spark):
    """Random letters and a script that no language has are rejected; unlike texts with one id both stay."""
    import random

    rnd = random.Random(1)
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    noise = "".join(rnd.choice("bcdfghjklmnpqrstvwxzqjx") for _ in range(5_000))
    greek = "αυτό είναι ένα κείμενο σε μια γλώσσα που δεν έχει μάθει κανείς εδώ " * 40
    odd = spark.createDataFrame([(-1, noise, None, "s", 1), (-2, greek, None, "s", 1)], SCHEMA)
    rows = plain.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, rows, "").select("doc_id").collect()}
    assert not {-1, -2} & kept
    lettered = plain.filter(F.col("text").rlike(r"\p{L}")).count()
    assert len(kept) >= 0.97 * lettered

    texts = ["one lone text about the sea and its many ships", "another text on mountains, snow and long winters", "a third one, of rivers"]
    same = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (3, texts[2]), (7, texts[2]), (9, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in same], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(7, texts[0]), (7, texts[1]), (3, texts[2]), (None, texts[0])], key=repr)


def test_tokens_of_long_texts_in_levels(spark):
    """The last stage, and states handed through several levels of combined matrices."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=pieces.read_model())
    texts = ["hello world é😀 abc " * 400, "x" * 9_000, None, "", "le chat noir " * 900, "y"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    want = {i: library.encode(t or "") for i, t in enumerate(texts)}
    for options in ({"chunk": 300, "fan": 3}, {"chunk": 200, "fan": 64}, {"chunk": 1_000, "fan": 2}):
        assert {r.doc_id: r.ids for r in pieces.encode_documents(docs, pieces.read_model(), **options).collect()} == want
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_ids"]
    assert {r.doc_id: r.ids for r in last.collect()} == want
