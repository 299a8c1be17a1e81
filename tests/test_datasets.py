import pytest
from pyspark.sql import functions as F

from axiomloom.operators import context as cx
from axiomloom.operators import datasets as ds
from axiomloom.operators import metrics as me
from axiomloom.operators import ontology as on
from axiomloom.operators import sampling as sa
from axiomloom.operators import validation as va
from axiomloom.sources import readers, writers

DUMP = [
    ("Entity", "Relation", "Value"), ("concept:dog", "generalizations", "concept:animal"),
    ("concept:dog", "generalizations", "concept:animal"), ("concept:animal", "generalizations", "concept:animal"),
    ("relation:barksat", "domain", "concept:dog"), ("relation:barksat", "range", "concept:person"),
    ("relation:noisyat", "domain", "concept:animal"), ("relation:barksat", " Generalizations ", "relation:noisyat"),
    ("", "domain", "concept:x"),
]


@pytest.fixture
def positives(spark):
    dump = spark.createDataFrame(DUMP, "subject string, predicate string, object string")
    return ds.positives_from_triples(readers.clean_triples(dump))


def test_positives(positives, rows):
    assert rows(positives["subClassOf"], "subject", "object") == [("concept:dog", "concept:animal")]
    assert rows(positives["subPropertyOf"], "subject", "object") == [("relation:barksat", "relation:noisyat")]
    assert positives["domain"].count() == 2
    assert positives["range"].count() == 1


def test_negatives_and_counts(positives, rows):
    forced = ds.replacement_negatives(positives["domain"])
    assert rows(forced, "subject", "object") == [("relation:barksat", "concept:animal"), ("relation:noisyat", "concept:dog")]
    assert ds.replacement_negatives(positives["range"]).count() == 0
    whole = ds.assemble_dataset(list(positives.values()), [
        ds.inverse_negatives(positives["subClassOf"]), ds.inverse_negatives(positives["subPropertyOf"]), forced])
    got = [tuple(r) for r in me.stats_wide(whole).select("axiom_type", "positive_count", "negative_count", "total").collect()]
    assert got == [("domain", 2, 2, 4), ("range", 1, 0, 1), ("subClassOf", 1, 1, 2), ("subPropertyOf", 1, 1, 2), ("TOTAL", 5, 4, 9)]
    assert whole.filter("axiom_type = 'subPropertyOf' and label = 0").first().axiom_text == "noisyat ⊑p barksat"


def test_replacements_never_hit_known_pairs(spark):
    rows = [("domain", f"p{i % 40}", "rdfs:domain", f"c{i % 23}", 1, "S", "") for i in range(300)]
    df = spark.createDataFrame(rows, "axiom_type string, subject string, predicate string, object string, label int, source string, negative_strategy string").distinct()
    neg = ds.replacement_negatives(df)
    known = {(r.subject, r.object) for r in df.collect()}
    got = neg.collect()
    assert got and not [r for r in got if (r.subject, r.object) in known]
    possible = {r.subject for r in df.collect() if len({o for s, o in known if s == r.subject}) < 23}
    assert {r.subject for r in got} == possible


def test_tsv_reader_skips_bad_rows(spark, tmp_path, rows):
    import gzip

    text = "Entity\tRelation\tValue\na\tb\tc\nonly\ttwo\n1\t2\t3\t4\n \tx\ty\n"
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write(text)
    assert rows(readers.scan_triples_tsv(spark, str(tmp_path / "t.csv.gz"), 2), "subject", "predicate", "object") == [("a", "b", "c")]


def test_csv_with_bom_and_lines_in_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,axiom_type,subject,predicate,object,label,source,negative_strategy,axiom_text,context_info\n1,domain,s,p,o,1,x,,t,"line 1\nline ""2"""\n', encoding="utf-8")
    r = readers.scan_axiom_csv(spark, str(tmp_path / "a.csv")).first()
    assert (r.id, r.context_info) == ("1", 'line 1\nline "2"')


def test_validation_is_all_or_nothing(spark):
    cols = "pos long, axiom_type string, subject string, predicate string, object string, label string, source string, axiom_text string"
    good = spark.createDataFrame([(0, " domain ", "s", "p", "o", " 1 ", "x", "t")], cols)
    assert va.load_axioms(good, "pos").first().axiom_type == "domain"
    bad = good.union(spark.createDataFrame([(i, "domain", "s", "p", " ", "7", "x", "t") for i in range(1, 31)], cols))
    with pytest.raises(ValueError, match=r"第 3 行字段 object 不能为空.*and 10 more"):
        va.load_axioms(bad, "pos")
    with pytest.raises(ValueError, match="missing columns: label"):
        va.require_columns(good.drop("label"), ["label", "pos"])


def test_property_table(spark, rows):
    props = spark.createDataFrame([("https://schema.org/p", "A, schema:B,, http://schema.org/p", "C")], "id string, DomainIncludes string, rangeincludes string")
    assert rows(ds.explode_property_axioms(props, "domain"), "subject", "object") == [
        ("http://schema.org/p", "http://schema.org/A"), ("http://schema.org/p", "http://schema.org/B")]
    assert ds.explode_property_axioms(props, "subPropertyOf").count() == 0
    with pytest.raises(ValueError):
        ds.explode_property_axioms(props.drop("rangeincludes"), "range")


def test_quotas():
    counts = {"subClassOf": 60, "subPropertyOf": 5, "domain": 40, "range": 30}
    assert sa.balanced_quotas(counts) == {"subClassOf": 33, "subPropertyOf": 5, "domain": 32, "range": 30}
    assert sa.balanced_quotas({"domain": 3}) == {"subClassOf": 0, "subPropertyOf": 0, "domain": 3, "range": 0}
    assert sum(sa.balanced_quotas({k: 10**9 for k in counts}, 10**6 + 1).values()) == 10**6 + 1


def test_fair_sample_covers_types_first(spark):
    rows = [("d", "domain", f"x{i}") for i in range(50)] + [("d", "range", "y"), ("d", "subClassOf", "z"), ("e", "range", "q")]
    df = spark.createDataFrame(rows, "doc_id string, axiom_type string, item string")
    out = sa.fair_per_paper_sample(df, ["doc_id", "axiom_type", "item"])
    got = {(r.doc_id, r.axiom_type): r["count"] for r in out.groupBy("doc_id", "axiom_type").count().collect()}
    assert got == {("d", "domain"): 8, ("d", "range"): 1, ("d", "subClassOf"): 1, ("e", "range"): 1}


def test_context_hit_miss_and_duplicates(spark):
    mapping = spark.createDataFrame(
        [(1, "http://x/A", "A one", "Class", "", "", "c"), (2, "http://x/A", "A two", "", "", "long  text", "c")],
        "n int, uri string, name string, kind string, label_en string, abstract_en string, comment_en string")
    axioms = spark.createDataFrame([("http://x/A", "http://x/B")], "subject string, object string")
    first = cx.attach_context(axioms, cx.dedupe_mapping(mapping, "n")).first()
    assert first.subject_context == "- 名称：A one\n- 类型：Class\n- 简介：c"
    assert first.object_context == "- 名称：B\n- 类型：Unknown\n- 简介：B"
    assert first.context_info == f"背景知识：\n条目1：\n{first.subject_context}\n\n条目2：\n{first.object_context}"
    last = cx.attach_context(axioms, cx.dedupe_mapping(mapping, "n", "last")).first()
    assert last.subject_context == "- 名称：A two\n- 类型：Unknown\n- 简介：long text"
    assert tuple(cx.context_hits(cx.attach_context(axioms, cx.dedupe_mapping(mapping, "n"))).first()) == (1, 1, 0)


def test_files_per_document(spark, tmp_path, rows):
    from axiomloom import schemas

    for folder, name, text in (("Medical", "a", '{"doc_id": "a", "classes": ["X", " "], "subClassOf": [{"sub": "X", "super": "Y"}]}'),
                               ("misc", "b", "{broken"), ("misc", "c", '{"doc_id": "c", "classes": 5}')):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.json").write_text(text)
        (tmp_path / folder / f"{name}.txt").write_text("x")
    docs = readers.scan_layer_json(spark, str(tmp_path), schemas.LAYER3_DOC, ["classes"])
    assert rows(docs.filter("_corrupt is null"), "doc_id") == [("a",)]
    assert docs.filter("_corrupt is not null").count() == 2
    tree = readers.scan_results_tree(spark, {"m": str(tmp_path)})
    assert rows(tree.filter("domain = 'medical'"), "method", "domain") == [("m", "medical")]
    assert rows(readers.scan_doc_domain_map(spark, str(tmp_path)), "doc_id", "domain") == [("a", "Medical"), ("b", "misc"), ("c", "misc")]
    flat = on.flatten_axioms(docs.filter("_corrupt is null").withColumn("domain", F.lit("medical")))
    assert rows(flat, "axiom_no", "axiom_type", "axiom_text") == [(1, "Class", "X declare_class"), (2, "subClassOf", "X subClassOf Y")]
    with pytest.raises(ValueError):
        writers.write_table(docs, str(tmp_path / "z"), "xml")


def test_tasks_of_a_dataset_follow_its_rows(spark, rows, monkeypatch):
    """Winners and draws lie in as many tasks as their number asks for, whatever their compressed size."""
    from axiomloom import scale

    positives = spark.range(120).select(
        F.lit("domain").alias("axiom_type"), F.concat(F.lit("s"), (F.col("id") % 40).cast("string")).alias("subject"), F.lit("rdfs:domain").alias("predicate"),
        F.concat(F.lit("o"), (F.col("id") % 7).cast("string")).alias("object"), F.lit(1).alias("label"), F.lit("x").alias("source"), F.lit("").alias("negative_strategy")).distinct()
    assembled = lambda: ds.assemble_dataset([positives], [ds.replacement_negatives(positives)])
    want = assembled()
    monkeypatch.setattr(scale, "GATHERED_ROWS", 4)
    got = assembled()
    assert rows(got, *want.columns) == rows(want, *want.columns)
    assert got.rdd.getNumPartitions() == positives.count() * 2 // 4
