"""Results beyond former limits, and rounds that do not grow with path length."""

import pytest
from pyspark.sql import functions as F

from axiomloom import scale
from axiomloom.functions import axioms as ax
from axiomloom.functions import text as tx
from axiomloom.operators import chunks, context, datasets, graph, reports, stability, terms


@pytest.fixture
def chain(spark):
    """257 numbered nodes in one line, in an order that a hash would give."""
    names = spark.range(257).select("id", (F.abs(F.xxhash64("id")) % 1_000_003).alias("n")).collect()
    number = [r["n"] for r in sorted(names, key=lambda r: r["id"])]
    return number, spark.createDataFrame(list(zip(number, number[1:])), "src bigint, dst bigint")


def counted(monkeypatch, name):
    calls, plain = [], getattr(graph, name)

    def wrapper(*args, **kwargs):
        calls.append(1)
        return plain(*args, **kwargs)
    monkeypatch.setattr(graph, name, wrapper)
    return calls


def test_labels_of_a_long_chain(monkeypatch, chain):
    number, arcs = chain
    calls = counted(monkeypatch, "cut_and_count")
    got = {r["node"]: r["label"] for r in graph._smallest_reaching(arcs).collect()}
    assert got == {n: min(number[:i + 1]) for i, n in enumerate(number)}
    assert len(calls) <= 24


def test_closure_of_a_long_chain(monkeypatch, chain):
    number, arcs = chain
    calls = counted(monkeypatch, "_measured")
    pairs = graph.closure_pairs(arcs.select(F.col("src").alias("sub"), F.col("dst").alias("super")))
    row = pairs.agg(F.count("*").alias("n"), F.max("longest").alias("l"), F.sum(F.col("longest") - F.col("steps")).alias("d")).first()
    assert (row["n"], row["l"], row["d"]) == (257 * 256 // 2, 256, 0)
    assert len(calls) <= 11


def test_leftover_terms_form_as_many_groups_as_needed(spark):
    vocab = spark.range(500).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"))
    triples = spark.createDataFrame([(1, 0, "a", "b", "c")], "doc_id int, pos bigint, subject string, relation string, object string")
    got = terms.group_triples(vocab, triples)
    assert got.filter("source <> 'mentioned'").select("term").distinct().count() == 500
    assert got.groupBy("group_index").count().agg(F.max("count")).first()[0] <= 80


def test_bindings_beyond_twenty(spark):
    rows = [("u", i, "", "", "", "") for i in range(30)] + [("u", 30, "late", "", "", "")]
    df = spark.createDataFrame(rows, "uri string, pos int, label string, abstract string, comment string, type string")
    assert context.first_english_values(df).first()["label_en"] == "late"
    assert context.first_english_values(df, 20).first()["label_en"] == ""


def test_outline_of_many_headings(spark):
    heads = spark.createDataFrame([(1, i, f"{i + 1}. Part", 1, i) for i in range(14)], "doc_id int, pos int, title string, level int, page int")
    pages = spark.createDataFrame([(1, 14)], "doc_id int, total_pages int")
    assert chunks.section_spans(heads, pages).count() == 14
    assert chunks.section_spans(heads, pages, 10).count() == 1


def test_pages_of_any_size(spark, rows):
    df = spark.range(1, 1201).select("id", (F.col("id") % 7).alias("v"))
    got, total = reports.page(df, 2, 500)
    assert total == 1200 and rows(got, "id") == [(i,) for i in range(501, 1001)]
    assert reports.page(df, 1, 500, max_size=100)[0].count() == 100
    tied, _ = reports.page(df, 3, 400, order="v")
    assert tied.count() == 400 and reports.page(df, 9, 400)[0].count() == 0


def test_names_end_where_the_text_ends(spark):
    df = spark.createDataFrame([("Class", "Foo\n"), ("Class", "Foo")], "t string, a string")
    assert [r[0] for r in df.select(ax.naming_ok("t", "a", F.lit(""))).collect()] == [False, True]


def test_all_words_of_a_term(spark):
    df = spark.createDataFrame([("alpha beta gamma", "alphaBetaGammaDelta")], "text string, term string")
    assert df.select(tx.contains_term("text", "term"), tx.contains_term("text", "term", None)).first() == (True, False)


def test_lookups_with_a_name_twice(spark):
    uris = spark.createDataFrame([("http://x.org/Foo",)], "uri string")
    none = spark.createDataFrame([], "uri string, label_en string, description string, extra_info string")
    name = uris.select(tx.short_uri("uri")).first()[0]
    lookup = spark.createDataFrame([(name, "first", "s", 0), (name, "second", "s", 1)], "name string, description string, source string, pos int")
    assert [r["description"] for r in context.description_chain(uris, none, [lookup]).collect()] == ["second"]


def test_rows_that_no_template_fits(spark):
    df = spark.createDataFrame([(1, "subClassOf", "A ⊑ B", "", 1), (2, "domain", "nothing", "", 0)],
                               "id int, axiom_type string, axiom_text string, context_info string, label int")
    assert [r["id"] for r in stability.template_rejects(df).collect()] == [2]
    assert stability.expand_templates(df).select("original_id").distinct().count() == 1


def test_hot_keys_have_no_limit(spark):
    df = spark.range(6000).select((F.col("id") % 1500).alias("k"))
    assert scale.find_hot_keys(df, ["k"], 4).count() == 1500


def test_ranges_shrink_as_partitions_grow(spark, monkeypatch):
    seen = []

    def stored(df, tag):
        seen.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return plain(df, tag)
    plain = scale.cut_lineage
    monkeypatch.setattr(scale, "cut_lineage", stored)
    df = spark.range(4000)
    for n in (2, 20):
        assert scale.dense_position(df, [], "id", "n", ranges=n).filter("n <> id + 1").isEmpty()
    assert seen[1] < seen[0] / 4


def test_negatives_of_subjects_that_know_nearly_all(spark):
    """One of 400 objects is free for each of three subjects; a fourth knows all."""
    rows = [("domain", f"s{s}", "p", f"o{o}", 1, "x", "") for s in range(4) for o in range(400) if s == 3 or o != 100 * s + 7]
    df = spark.createDataFrame(rows, "axiom_type string, subject string, predicate string, object string, label int, source string, negative_strategy string")
    got = datasets.replacement_negatives(df)
    assert got.count() == 3 * 399
    assert {(r["subject"], r["object"]) for r in got.select("subject", "object").distinct().collect()} == {(f"s{s}", f"o{100 * s + 7}") for s in range(3)}


def test_first_free_places_of_a_hot_subject(spark, rows):
    """A subject with a third of all pairs, with and without salting, against a walk over the places."""
    import random

    rnd, size = random.Random(4), 600
    taken = {("hot", s) for s in range(size) if s not in (7, 8, 300, 599)} | {(f"s{i % 40}", rnd.randrange(size)) for i in range(1200)}
    taken |= {("full", s) for s in range(size)} | {("edge", s) for s in (0, 1, 2, 598, 599)}
    starts = [(subject, slot, rnd.randrange(size)) for subject, slot in taken] + [("edge", 598, 597), ("edge", 599, 598), ("new", 0, 599)]
    pool = spark.createDataFrame([("domain", f"o{s}", s) for s in range(size)], "axiom_type string, _candidate string, _slot bigint")
    pairs = spark.createDataFrame([("domain", s, f"o{o}") for s, o in taken], "axiom_type string, subject string, object string")
    df = spark.createDataFrame([("domain", s, f"p{i}", f"o{o}", "x", size, at) for i, (s, o, at) in enumerate(starts)],
                               "axiom_type string, subject string, predicate string, object string, source string, _size bigint, _start bigint")
    want = []
    for i, (subject, _o, at) in enumerate(starts):
        free = next((k % size for k in range(at, at + size) if (subject, k % size) not in taken), None)
        want += [] if free is None else [(subject, f"p{i}", f"o{free}")]
    for options in ({}, {"min_rows": 50}):
        assert rows(datasets._first_free(df, pairs, pool, **options), "subject", "predicate", "_candidate") == sorted(want)


def test_a_hundred_thousand_headings(spark):
    """One document; ends against a stack."""
    n, levels = 100_000, [1 + (i * 7919) % 5 for i in range(100_000)]
    heads = spark.createDataFrame([(1, i, f"{i + 1}. Part", levels[i], i // 3) for i in range(n)], "doc_id int, pos int, title string, level int, page int")
    pages = spark.createDataFrame([(1, n)], "doc_id int, total_pages int")
    want, stack = [None] * n, []
    for i in reversed(range(n)):
        while stack and levels[stack[-1]] > levels[i]:
            stack.pop()
        want[i] = n if not stack else max(stack[-1] // 3, i // 3 + 1)
        stack.append(i)
    got = {r.section_id: r.page_end for r in chunks.section_spans(heads, pages).select("section_id", "page_end").collect()}
    assert got == {f"section_{i + 1}": e for i, e in enumerate(want)}
