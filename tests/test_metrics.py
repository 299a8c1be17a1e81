import pytest
from pyspark.sql import functions as F

from axiomloom.functions import judgement as jd
from axiomloom.operators import metrics as me
from axiomloom.operators import reports as rp
from axiomloom.operators import stability as st


@pytest.fixture
def judged(spark):
    data = [
        ("s1", "domain", 1, "Judgment Result: Correct\nExplanation: ok"), ("s2", "domain", 0, "Judgment Result: Correct\n"),
        ("s3", "range", 1, "Judgment Result: Incorrect\n"), ("s4", "range", 0, "Judgment Result: Incorrect\n"), ("s5", "range", 0, ""),
    ]
    df = spark.createDataFrame(data, "id string, axiom_type string, label int, raw string")
    return df.withColumn("pred", jd.parse_judgement_bilingual("raw")["label"])


def test_four_judgements_score_one_half(judged):
    r = me.binary_metrics(judged).first()
    assert (r.samples, r.tp, r.fp, r.tn, r.fn) == (4, 1, 1, 1, 1)
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5, 0.5)
    counts = me.parsed_vs_total(judged).first()
    assert (counts.total_samples, counts.parsed_samples) == (5, 4)


def test_scores_by_type_and_error_cases(judged, rows):
    by_type = me.binary_metrics(judged, ["axiom_type"])
    assert rows(by_type, "axiom_type", "samples", "accuracy", "precision", "recall", "f1") == [
        ("domain", 2, 0.5, 0.5, 1.0, 2 / 3), ("range", 2, 0.5, 0.0, 0.0, 0.0)]
    assert rows(me.error_cases(judged), "id") == [("s2",), ("s3",)]
    total, parts = me.binary_metrics(judged).first(), by_type.agg(F.sum("tp"), F.sum("fp"), F.sum("tn"), F.sum("fn")).first()
    assert tuple(parts) == (total.tp, total.fp, total.tn, total.fn)


def test_verdict_texts(spark):
    cases = [("判断结果：[正确]", 1), ("判断结果: 错误", 0), ("判断结果 正确", 1), ("判断结果 正确 错误", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r.p for r in df.orderBy("i").select(jd.parse_judgement("t").alias("p")).collect()]
    assert got == [want for _, want in cases]


def test_explanation_runs_to_the_end(spark):
    df = spark.createDataFrame([("Judgment result：[INCORRECT]\nExplanation: a\nb ",)], "t string")
    p = df.select(jd.parse_judgement_bilingual("t").alias("p")).first().p
    assert (p.judgment, p.label, p.explanation) == ("错误", 0, "a\nb")


def test_unreadable_labels_lower_only_the_accuracy(spark):
    df = spark.createDataFrame([("1", "correct"), ("0", "no"), ("yes", "maybe"), ("2", "1"), (None, "1")], "label string, pred string")
    r = me.service_metrics(df).first()
    assert (r.total, r.accuracy, r.precision, r.recall, r.f1) == (4, 0.5, 1.0, 1.0, 1.0)


def test_annotation_rates(spark):
    df = spark.createDataFrame([("m", "correct"), ("m", "hallucination"), ("m", "wrong")], "model string, explanation_label string")
    r = me.explanation_rates_all(df, 4).filter("is_overall = 1").first()
    assert (r.total_annotations, r.explanation_accuracy, r.hallucination_rate) == (3, 0.3333, 0.3333)


def test_rates_divide_by_correct_cases(spark):
    results = spark.createDataFrame([(i, 1, "success", 1, 1) for i in range(4)] + [(9, 1, "success", 1, 0)],
                                    "id int, task_id int, run_status string, true_label int, predict_label int")
    notes = spark.createDataFrame([(0, 1, 1, 0, "completed"), (1, 1, 0, 1, "completed"), (9, 1, 1, 1, "completed")],
                                  "result_id int, task_id int, explanation_correct_label int, hallucination_label int, annotation_status string")
    r = me.explanation_rates_correct(rp.annotations_outer(results, notes)).first()
    assert (r.correct_case_count, r.annotated_count, r.explanation_accuracy, r.hallucination_rate) == (4, 2, 0.25, 0.25)
    assert rp.annotations_outer(results, notes, "pending").count() == 2


def test_consistency(spark):
    data = [(1, 1, p) for p in (1, 1, 1, 1, 1)] + [(2, 1, p) for p in (1, 0, 1, None, 1)] + [(3, 0, 1)] * 5
    df = spark.createDataFrame(data, "original_id int, original_pred int, pred int").withColumn(
        "run_status", F.when(F.col("pred").isNull(), F.lit("failed")).otherwise(F.lit("success")))
    r = st.consistency(df).first()
    assert r.originals == 3
    assert r.hard_consistency == pytest.approx(1 / 3)
    assert r.soft_consistency == pytest.approx(0.08)


def test_templates(spark, rows):
    df = spark.createDataFrame([("a", "subPropertyOf", "P ⊑p Q", "ctx", 1), ("b", "domain", "range(P) = C", "ctx", 0)],
                               "id string, axiom_type string, axiom_text string, context_info string, label int")
    out = st.expand_templates(df)
    assert rows(out, "template_id", "variant_id", "axiom_text")[:2] == [(1, "a_t1", "P ⊑p Q"), (2, "a_t2", "P is a subproperty of Q.")]
    assert out.count() == 5


def test_stats_wide(spark):
    df = spark.createDataFrame([("domain", 1), ("domain", 0), ("range", 1)], "axiom_type string, label int")
    got = [tuple(r) for r in me.stats_wide(df).select("axiom_type", "positive_count", "negative_count", "total").collect()]
    assert got == [("domain", 1, 1, 2), ("range", 1, 0, 1), ("TOTAL", 2, 1, 3)]


def test_leaderboard_and_pivot(spark):
    m = spark.createDataFrame([("b", "domain", 0.5), ("a", "domain", 0.5), ("c", "domain", 0.9)], "model string, axiom_type string, accuracy double")
    assert [(r.model, r["rank"]) for r in me.leaderboard(m).collect()] == [("c", 1), ("a", 2), ("b", 2)]
    p = me.pivot_ordered(m, "axiom_type", "model", "accuracy", ["range", "domain"], ["c", "z"]).first()
    assert (p.row_order, p["c"], p["z"]) == (2, 0.9, None)


def test_pages(spark):
    df = spark.range(25)
    rows, total = rp.page(df, 2, 20)
    assert ([r.id for r in rows.collect()], total) == ([20, 21, 22, 23, 24], 25)
    assert rp.page(df, 0, 1000)[0].count() == 25
    assert rp.preview(df).count() == 20
    deep, total = rp.page(spark.range(20_000), 150, 100)
    assert sorted(r.id for r in deep.collect()) == list(range(14_900, 15_000))


def test_upsert_and_preferred_layer(spark, rows):
    base = spark.createDataFrame([(1, 1, 1, None), (2, 2, 1, 0)], "id int, seq int, explanation_correct_label int, hallucination_label int")
    new = spark.createDataFrame([(1, 5, 0, 1)], base.schema)
    out = rp.annotation_status(rp.upsert_latest(base, new, ["id"]))
    assert rows(out, "id", "seq", "annotation_status") == [(1, 5, "completed"), (2, 2, "completed")]
    layers = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 1, 3, "b"), (1, 2, 4, "a"), (1, 2, 5, "c")],
                                   "task_id int, chunk_record_id int, id int, layer_name string")
    assert rows(rp.preferred_layer_result(layers, "b"), "chunk_record_id", "id") == [(1, 3), (2, 4)]
