"""Evidence by number against the lists with texts."""

import re

from pyspark.sql import functions as F

from axiomloom import scale
from axiomloom.operators import evidence as ev
from axiomloom.plans import catalog, q_learning
from axiomloom.plans.registry import Tables


def test_first_rows_need_one_exchange(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    got = scale.top_n(df, ["k"], [F.col("id")], 3)
    assert got.count() == 21 and got.agg(F.max("id")).first()[0] == 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and "WindowGroupLimit" in plan


def test_confidence_and_flags_by_number(spark, rows, monkeypatch):
    triples = spark.createDataFrame([(1, 0, "Hub", "uses", "o1", "c0", "Hub uses o1"), (1, 1, "x", "near", "y", "", " ")],
                                    "doc_id int, pos bigint, subject string, relation string, object string, chunk string, context string")
    axioms = spark.createDataFrame([(1, "Class", "Hub", ""), (1, "Class", "x", ""), (1, "Property", "uses", ""), (1, "domain", "uses", "Hub")],
                                   "doc_id int, axiom_type string, item1 string, item2 string")
    chunks = spark.createDataFrame([(1, "c0", "t", 1, 2)], "doc_id int, chunk_id string, text string, page_start int, page_end int")
    stated = axioms.limit(1).withColumns({"chunk": F.lit("c0"), "pos": F.lit(0).cast("bigint")})
    found = {"baseline": (ev.baseline_evidence(axioms, stated, chunks), lambda: ev.numbered_baseline(axioms, stated, chunks, values=False)),
             "layered": (ev.layered_evidence(axioms, triples, chunks), lambda: ev.numbered_layered(axioms, triples, chunks, values=False))}
    for method, (lists, numbered) in found.items():
        want = ev.evidence_confidence(axioms, lists, method)
        assert rows(ev.numbered_confidence(*numbered(), method), *want.columns) == rows(want, *want.columns)
    want = ev.axiom_quality(axioms, found["layered"][0])
    got = ev.numbered_quality(*ev.numbered_layered(axioms, triples, chunks))
    assert rows(got, *want.columns) == rows(want, *want.columns)
    assert rows(got, "axiom_type", "item1", "explicit", "reasonable") == [
        ("Class", "Hub", True, True), ("Class", "x", False, False), ("Property", "uses", True, True), ("domain", "uses", True, True)]


AXIOMS = "doc_id long, axiom_type string, item1 string, item2 string"


def moved_by(df):
    return re.findall(r"\bExchange (?:hash|range)partitioning\(([^)]*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_baseline_moves_documents_once(spark, rows, tmp_path, monkeypatch):
    """J04: whole documents are dealt once and nothing is stored, however its rows are grouped and joined after."""
    from compare import check, connect
    folder = "/root/testdata/sf0.001"
    for module in (ev, scale):
        monkeypatch.setattr(module, "cut_lineage", lambda df, tag: (_ for _ in ()).throw(AssertionError(tag)))
    monkeypatch.setattr(scale, "GATHERED_BYTES", 20_000)
    df = catalog.QUERIES["J04_baseline_evidence"](spark, folder)
    assert {re.sub(r"#\d+L?", "", keys) for keys in moved_by(df)} == {"doc_id"}
    df.write.parquet(str(tmp_path / "out"))
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    parts = documents.agg(F.sum(F.octet_length("text"))).first()[0] // 20_000
    assert parts > 8 and set(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())) == {str(parts)}
    assert check(spark, connect(folder), "J04_baseline_evidence", folder)[0] == ""


def test_large_documents_are_left_as_they_lie(spark, rows):
    """Documents of many bytes take the salted joins; both parts give the rows of the whole."""
    t = Tables(spark, "/root/testdata/sf0.001")
    parts = t.by_document(3000)
    ids = [{r[0] for r in d.documents.select("doc_id").collect()} for d, _ in parts]
    assert [g for _, g in parts] == [True, False] and not ids[0] & ids[1] and len(ids[0] | ids[1]) == t.documents.count() and ids[1]
    got = [ev.baseline_evidence(d.v_doc_axioms, d.v_chunk_axioms, d.v_chunks, min_rows=3, gathered=g) for d, g in parts]
    want = ev.baseline_evidence(t.v_doc_axioms, t.v_chunk_axioms, t.v_chunks)
    assert rows(got[0].unionByName(got[1]), *want.columns) == rows(want, *want.columns)
    none = spark.createDataFrame([(None, "a" * 99), (None, "b"), (1, None), (2, "xy")], "doc_id int, text string")
    small, large = scale.gather_texts(none, "doc_id", "text", 3)
    assert large is None and small.count() == 4
    assert [x.count() for x in scale.gather_texts(none, "doc_id", "text", 2)] == [3, 1]


def test_gathered_evidence_of_odd_rows(spark, rows):
    """No id, no name, a name twice, blank names and texts, one text in two chunks, an axiom nobody states."""
    axioms = spark.createDataFrame([(1, "Class", "A", ""), (1, "Class", "A", ""), (1, "Class", "B", ""), (1, "Class", None, ""), (None, "Class", "A", ""),
                                    (2, "Class", "A", ""), (1, "Class", "never", "")], AXIOMS)
    stated = spark.createDataFrame(
        [(1, "Class", "A", "", "c0", 7), (1, "Class", "A", "", " c0 ", 5), (1, "Class", "A", "", "c1", 3), (1, "Class", "A", "", "gone", 9), (1, "Class", "B", "", " ", 1),
         (1, "Class", "B", "", None, 1), (1, "Class", None, "", "c0", 1), (None, "Class", "A", "", "c0", 1), (1, "Class", "extra", "", "c0", 1), (2, "Class", "A", "", "c0", 4)],
        AXIOMS + ", chunk string, pos long")
    chunks = spark.createDataFrame([(1, "c0", " same ", 1, 1), (1, "c0", "other", 1, 2), (1, "c1", "same", 2, 2), (2, "c0", " ", None, None), (2, "c0", None, 4, 4), (1, None, "x", 1, 1),
                                    (None, "c0", "y", 1, 1)], "doc_id long, chunk_id string, text string, page_start int, page_end int")
    want = [(1, "chunk", "c0", 5), (1, "chunk", "c1", 3), (1, "chunk", "gone", 9), (1, "context", "other", 7), (1, "context", "same", 3),
            (1, "page", "1", 7), (1, "page", "1-2", 7), (1, "page", "2", 3), (2, "chunk", "c0", 4), (2, "page", "4", 4)]
    dealt = [df.repartition(5, "doc_id") for df in (axioms, stated, chunks)]
    for got in (ev.baseline_evidence(axioms, stated, chunks), ev.baseline_evidence(axioms, stated, chunks, min_rows=1), ev.baseline_evidence(*dealt, gathered=True)):
        assert rows(got.filter("axiom_type = 'Class' and item1 = 'A' and item2 = ''"), "doc_id", "list", "value", "first_pos") == want and got.count() == len(want)
    lists, numbered = ev.numbered_baseline(*dealt, gathered=True)
    flags = ev.numbered_flags(lists, numbered).filter("doc_id is not null")
    assert rows(flags, "doc_id", "axiom.item1", "reasonable") == [(1, "A", True), (1, "B", False), (1, "never", False), (2, "A", False)]


def test_layers_move_documents_once(spark, rows, monkeypatch):
    """J05: the same for triples, of which each is found under five keys."""
    from compare import check, connect
    folder = "/root/testdata/sf0.001"
    for module in (ev, scale):
        monkeypatch.setattr(module, "cut_lineage", lambda df, tag: (_ for _ in ()).throw(AssertionError(tag)))
    df = catalog.QUERIES["J05_layered_evidence"](spark, folder)
    assert {re.sub(r"#\d+L?", "", keys) for keys in moved_by(df)} == {"doc_id"}
    assert check(spark, connect(folder), "J05_layered_evidence", folder)[0] == ""


def test_gathered_layers_of_odd_rows(spark, rows):
    """A key of many axioms, ends that are one word, no id, no item, blank chunks and contexts, a chunk named like a context."""
    kinds = ["Class", "Property", "subClassOf", "subPropertyOf", "domain", "range"]
    axioms = spark.createDataFrame([(d, k, a, b) for d in (1, 2, None) for k in kinds for a in ("A", "uses", None) for b in ("B", "A", "uses", "")], AXIOMS)
    triples = spark.createDataFrame(
        [(1, 4, "A", "uses", "A", "c0", " said "), (1, 2, "A", " uses", "B", " c0", "said"), (1, 3, "B", "uses", "A", "c1", " "), (1, 9, "x", "uses", "A", " ", "c1"),
         (1, 9, "A", "is", "B", None, None), (2, 0, "B", "A", "uses", "c0", "said"), (2, 0, "B", "A", "uses", "c0", "twice"), (None, 0, "A", "uses", "B", "c0", "said"), (1, 1, None, "uses", "B", "c9", "z")],
        "doc_id long, pos long, subject string, relation string, object string, chunk string, context string")
    chunks = spark.createDataFrame([(1, "c0", "t", 1, 1), (1, "c0", "t", 1, 2), (1, "c1", "t", 2, 2), (2, "c0", "t", None, None), (None, "c0", "t", 5, 5)],
                                   "doc_id long, chunk_id string, text string, page_start int, page_end int")
    dealt = [df.repartition(5, "doc_id") for df in (axioms, triples, chunks)]
    want = ev.layered_evidence(axioms, triples, chunks)
    assert want.count() > 60 and {r[0] for r in want.select("list").distinct().collect()} == {"chunk", "context", "page"}
    for got in (ev.layered_evidence(*dealt, gathered=True), ev.layered_evidence(axioms, triples, chunks, min_rows=2)):
        assert rows(got, *want.columns) == rows(want, *want.columns)
    lists, numbered = ev.numbered_layered(*dealt, gathered=True)
    whole = ev.numbered_flags(*ev.numbered_layered(axioms, triples, chunks))
    out = ["doc_id", "axiom.axiom_type", "axiom.item1", "axiom.item2", "explicit", "reasonable", "naming", "keep"]
    assert rows(ev.numbered_flags(lists, numbered).filter("doc_id > 0"), *out) == rows(whole.filter("doc_id > 0"), *out)


def test_labels_and_rates_store_no_texts(spark, monkeypatch):
    """T17, A19: nothing is stored but the methods of documents, and no step moves texts but the one that deals documents."""
    stored, plain = {}, ev.cut_lineage

    def store(df, tag):
        stored[tag] = df.columns
        return plain(df, tag)
    for module in (ev, scale, q_learning):
        monkeypatch.setattr(module, "cut_lineage", store)
    for name, keys in (("T17_evidence_confidence", {"doc_id"}), ("A19_quality_rates", {"doc_id", "method, axiom_type"})):
        df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert {re.sub(r"#\d+L?", "", k) for k in moved_by(df)} <= keys
    assert stored == {"methods": ["doc_id", "method"]}


def test_only_the_lists_wanted(spark, rows):
    t = Tables(spark, "/root/testdata/sf0.001")
    (d, _), = t.by_document()
    for found, name in ((ev.numbered_baseline, "v_chunk_axioms"), (ev.numbered_layered, "v_doc_triples")):
        whole = found(t.v_doc_axioms, getattr(t, name), t.v_chunks)[0].filter("list = 'context'")
        want = rows(whole, "doc_id", "a1", "a2", "list", "value", "first_pos")
        assert want
        for x, gathered in ((t, False), (d, True)):
            got = found(x.v_doc_axioms, getattr(x, name), x.v_chunks, gathered=gathered, kept=["context"])[0]
            assert rows(got, "doc_id", "a1", "a2", "list", "value", "first_pos") == want
