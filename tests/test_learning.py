import re

import pytest
from pyspark.sql import functions as F

from axiomloom.functions import text as tx
from axiomloom.operators import chunks as ch
from axiomloom.operators import graph as gr
from axiomloom.operators import scoring as sc
from axiomloom.operators import terms as te
from axiomloom.session import cut_lineage, scratch_path, shared_dir
from axiomloom.streaming import progress as sp


def test_chunk_offsets(spark, rows):
    df = spark.createDataFrame([("d", "2.1 Main Results", "aaaa. bbbb. cc. dddddd"), ("e", "2.1 Main Results", "short. x")], "doc_id string, title string, text string")
    out = ch.chunk_sections(df, 8)
    assert rows(out, "doc_id", "chunk_id", "content", "start_char", "end_char", "word_count") == [
        ("d", "mainresults1", "aaaa.", 0, 6, 1), ("d", "mainresults2", "bbbb. cc.", 6, 16, 2), ("d", "mainresults3", "dddddd.", 16, 24, 1),
        ("e", "mainresults", "short. x", 0, 8, 2)]


def test_chunks_keep_every_word(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("title", F.lit("T"))
    chunks = ch.chunk_sections(docs.select("doc_id", "title", "text"), 300)
    joined = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "content"))), lambda x: x["content"]), " ").alias("all"))
    letters = lambda c: F.regexp_replace(c, r"[^\p{L}]", "")
    assert docs.join(joined, "doc_id").filter(letters("text") != letters("all")).count() == 0


def test_page_chunks_against_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lit("one").alias("doc_id"), F.col("doc_id").alias("page_no"), "text")
    got = {}
    for r in ch.chunk_pages(docs, 250).collect():
        got.setdefault(r.page_no, []).append((r.part, r.text))
    for row in docs.collect():
        text, out, current = re.sub(r"\s+", " ", row.text).strip(), [], ""
        pieces = [text] if len(text) <= 250 else re.split(r"(?<=[.!?。！？])\s+", text)
        for p in pieces:
            if len(pieces) == 1 or len(current) + len(p) + 1 <= 250:
                current = f"{current} {p}".strip()
            else:
                out += [current] if current else []
                current = p
        out.append(current)
        assert [t for _, t in sorted(got[row.page_no])] == out


def test_reference_cut(spark):
    body = "intro\n[1] one\ntext\nmore\nx\ny\n[1] a\nmid\n[2] b\nend"
    df = spark.createDataFrame([(body,), ("a\n7. References \nb",), ("a\n[3] lone\nb",)], "t string")
    assert [r[0] for r in df.select(ch.strip_references("t")).collect()] == ["intro\n[1] one\ntext\nmore\nx\ny", "a", "a\n[3] lone\nb"]


def test_section_text(spark):
    df = spark.createDataFrame([("head\n3 Main Results\nbody one\nbody two\n4. Discussion here\nrest", "Main Results", "Discussion"),
                                ("no title\nReferences\nx", "Main Results", "Discussion")], "t string, a string, b string")
    assert [r[0] for r in df.select(ch.section_text("t", "a", "b")).collect()] == ["body one\nbody two", "no title"]


def test_section_spans_use_heading_levels(spark, rows):
    heads = spark.createDataFrame([("d", 0, "1 Intro", 1, 0), ("d", 1, "1.1 Sub", 2, 0), ("d", 2, "2 Next", 1, 3), ("d", 3, "lower", 1, 4), ("d", 4, "References", 1, 5), ("e", 0, "One", 1, 0)],
                                  "doc_id string, pos int, title string, level int, page int")
    pages = spark.createDataFrame([("d", 9), ("e", 4)], "doc_id string, total_pages int")
    assert rows(ch.section_spans(heads, pages), "doc_id", "title", "page_start", "page_end") == [
        ("d", "Intro", 1, 3), ("d", "Next", 4, 9), ("d", "Sub", 1, 3), ("e", "Complete Document", 1, 4)]


def test_trim_and_clip(spark):
    df = spark.createDataFrame([("aaaa bbbb. cc dddd", "a  b\n")], "t string, s string")
    r = df.select(ch.trim_at_break("t", 12).alias("a"), tx.clip_text("t", 4).alias("b"), tx.shorten("t", 8).alias("c"), tx.collapse("s").alias("d")).first()
    assert tuple(r) == ("aaaa bbbb", "aaaa...", "aaaa ...", "a b")


def test_votes_and_rewriting(spark, rows):
    votes = spark.createDataFrame([(1, "LLM", "LanguageModel", "")] * 2 + [(1, "LLM", "Llm", "")] * 2 + [(1, "X", "X", ""), (1, "X", "Xylophone", "")],
                                  "doc_id int, original string, normalized string, type string")
    terms = spark.createDataFrame([(1, 0, "LLM"), (1, 1, "X"), (1, 2, "Y")], "doc_id int, pos int, term string")
    triples = spark.createDataFrame([(1, 0, "LLM", "uses", "Y", "c1", "s1"), (1, 1, "LanguageModel", "uses", "Y", "c1", "s1"),
                                     (1, 2, "LLM", "uses", "Y", "c2", "s2"), (1, 3, "", "uses", "Y", "c3", "s3")],
                                    "doc_id int, pos int, subject string, relation string, object string, chunk string, context string")
    voted = te.vote_terms(votes, te.vocabulary(terms, triples.limit(0)))
    assert rows(voted, "original", "normalized", "type") == [("LLM", "LanguageModel", ""), ("X", "X", ""), ("Y", "Y", "")]
    out, evidence = te.rewrite_triples(triples, te.term_map(voted))
    assert rows(out, "subject", "relation", "object", "evidence_count") == [("LanguageModel", "uses", "Y", 2)]
    assert rows(evidence, "first_pos", "chunk", "context") == [(0, "c1", "s1"), (2, "c2", "s2")]


def test_hierarchy_with_a_cycle(spark):
    pairs = ["AB", "BC", "AC", "DB", "CE", "EC", "FF"]
    df = spark.createDataFrame([("m", "d", "subClassOf", p[0], p[1]) for p in pairs], "method string, domain string, axiom_type string, sub string, super string")
    r = gr.semantic_summary(df).filter("domain = 'd'").first()
    assert (r.class_node_count, r.class_direct_edge_count, r.class_max_depth, r.class_semantic_content) == (5, 6, 2, 10)
    assert r.class_avg_depth == pytest.approx(0.8)
    assert r.property_node_count == 0
    comp = gr.strongly_connected(gr.collect_edges(df))
    assert sorted(x.node for x in comp.filter("size = 2").collect()) == ["C", "E"]


def test_graph_against_brute_force(spark):
    import random

    rng = random.Random(5)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)}
    edges = {(a, b) for a, b in edges if a != b}
    df = spark.createDataFrame([("g", f"{a:02d}", f"{b:02d}") for a, b in edges], "g string, sub string, super string")
    nodes = {n for e in edges for n in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        stack = [n]
        while stack:
            for a, b in edges:
                if a == stack[-1] and b not in reach[n]:
                    reach[n].add(b)
                    stack.append(b)
                    break
            else:
                stack.pop()
    comp = gr.strongly_connected(df, ["g"])
    want = {f"{n:02d}": f"{min([n, *[m for m in reach[n] if n in reach[m]]]):02d}" for n in nodes}
    assert {r.node: r.component for r in comp.collect()} == want
    dag = gr.condensed_edges(df, comp, ["g"])
    total = sum(len(reach[n] - {n}) for n in nodes)
    assert gr.semantic_content(comp, dag, ["g"]).first().semantic_content == total


def test_scorer_isolates_failures(spark):
    def make():
        def answer(prompt):
            if prompt == "bad":
                raise RuntimeError("down")
            return {"first": "none", "second": "yes"}.get(prompt, "no")
        return answer

    read = lambda text: {"yes": 1, "no": 0}.get(text)
    df = spark.createDataFrame([(1, "bad", "bad"), (2, "first", "second"), (3, "x", "y")], "id int, prompt string, again string")
    got = {r.id: (r.output, r.label, r.error) for r in sc.score_batch(df, make, read, fallback="again").collect()}
    assert got == {1: ("", None, "attempt 1: down | fallback failed: attempt 1: down"), 2: ("yes", 1, ""), 3: ("no", 0, "")}


def test_stream_equals_batch_and_survives_replay(spark, rows, tmp_path):
    data = spark.range(500).select((F.col("id") % 7).alias("task_id"), "id", F.when(F.col("id") % 14 == 3, F.lit("failed")).otherwise(F.lit("success")).alias("run_status"))
    source = str(tmp_path / "in")
    data.filter("id < 250").repartition(3).write.parquet(source)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sp.run_task_counters(sp.read_results(spark, source, data.schema, 1), out, state)
    data.filter("id >= 250").repartition(3).write.mode("append").parquet(source)
    counters = sp.run_task_counters(sp.read_results(spark, source, data.schema, 1), out, state)
    want = sp.task_counters(data)
    assert rows(counters, *want.columns) == rows(want, *want.columns)
    live = sp.run_live_upsert(sp.read_results(spark, source, data.schema, 2), str(tmp_path / "o2"), str(tmp_path / "s2"), ["task_id"], "id")
    assert rows(live, "id") == [(i,) for i in range(493, 500)]


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    table = cut_lineage(spark.range(3), "t")
    assert table.count() == 3
