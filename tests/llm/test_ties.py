"""Stated orders of ties."""

import hashlib
import random

from axiomloom.llm import chat, langid

TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_equal_languages_go_to_the_first_by_name(spark):
    texts = ["one and the same text of both", "another text that both have", "words in either"]
    rows = [(i, t, lang) for lang in ("zz", "aa", "mm") for i, t in enumerate(texts)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, texts[0]), (2, "both"), (3, "1 2 3")], "doc_id bigint, text string"), model).collect()
    assert [(r.lang_pred, round(r.score, 6)) for r in sorted(got)] == [("aa", 0.333333)] * 2 + [("und", 0.0)]


def test_turns_of_one_number_follow_the_formatted_text(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 1, "assistant", "end"), (1, 0, "user", "a"),
            (1, None, "system", "first"), (2, 5, None, None), (2, 5, None, None)]
    want = {1: "system\nfirst\nassistant\nz\nuser\na\nuser\na\nuser\nb\nassistant\nend\n", 2: "\n\n\n\n"}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = chat.conversation_digests(chat.format_turns(spark.createDataFrame(rows, TURNS).repartition(4))).collect()
        assert {r.conv_id: r.turns_sha256 for r in got} == {c: hashlib.sha256(t.encode()).hexdigest() for c, t in want.items()}
        assert {r.conv_id: r.loss_chars for r in got} == {1: 4, 2: 0}
