"""Result trees with CSV files, shared-out samples, live tables and ordered documents."""

import random

import pytest
from pyspark.sql import functions as F

from axiomloom.operators import ontology, sampling
from axiomloom.sources import exports, readers
from axiomloom.streaming import progress


def test_csv_rows_of_a_tree(spark, tmp_path, rows):
    for folder, name, text in (("Medical", "a.csv", '﻿child,parent,axiomType\n"a, ""x""\nb",Top,subClassOf\nc,Top\n\n'),
                               ("misc", "b.CSV", "id,object,subject,subject,type\n7,O,old,S,subPropertyOf,beyond\n"),
                               ("misc", "c.json", '[{"sub": "J", "super": "K", "type": "subClassOf"}]'), ("misc", "d.txt", "child,parent\n1,2\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text, encoding="utf-8")
    tree = readers.scan_results_tree(spark, {"m": str(tmp_path)})
    assert rows(ontology.heterogeneous_axioms(tree.drop("path")), "domain", "axiom_type", "sub", "super") == [
        ("medical", "subClassOf", 'a, "x"\nb', "Top"), ("unknown", "subClassOf", "J", "K"), ("unknown", "subPropertyOf", "S", "O")]
    with pytest.raises(Exception, match="columns or more"):
        readers.scan_rows_csv(spark, str(tmp_path), 4).collect()
    (tmp_path / "empty").mkdir()
    assert readers.scan_rows_csv(spark, str(tmp_path / "empty")).count() == 0


def poured(rooms, amount):
    """One by one to the group that has least and still has room."""
    got = dict.fromkeys(rooms, 0)
    for _ in range(min(amount, sum(rooms.values()))):
        low = min(v for k, v in got.items() if v < rooms[k])
        got[next(k for k, v in got.items() if v == low and v < rooms[k])] += 1
    return got


def test_quotas_like_poured_water(spark):
    rnd = random.Random(6)
    for amount in (0, 1, 7, 25, 60, 1_000):
        rooms = {i: rnd.randint(0, 9) for i in range(12)}
        df = spark.createDataFrame([(k, v, k) for k, v in rooms.items()], "doc_id int, room bigint, ord int")
        got = {r.doc_id: r.quota for r in sampling.water_quotas(df, "room", amount, "quota", "ord").collect()}
        assert got == poured(rooms, amount), (amount, rooms)


def test_total_sample_is_exact_and_even(spark):
    rnd = random.Random(9)
    data = {(p, rnd.choice("ABC") if p else "A", f"x{i}") for p in range(8) for i in range(rnd.randint(1, 40))}
    df = spark.createDataFrame(sorted(data), "doc_id int, axiom_type string, item1 string")
    for total, cap in ((30, None), (30, 2), (60, 1), (len(data), 1), (10_000, 3)):
        got = [tuple(r) for r in sampling.fair_total_sample(df, ["doc_id", "axiom_type", "item1"], total, cap).collect()]
        assert len(set(got)) == len(got) == min(total, len(data))
        room = {p: sum(min(cap or 99, sum(d[:2] == (p, k) for d in data)) for k in "ABC") for p in range(8)}
        if total <= sum(room.values()):
            assert sorted(sum(g[0] == p for g in got) for p in range(8)) == sorted(poured(room, total).values())
            assert cap is None or all(sum(g[:2] == (p, k) for g in got) <= cap for p in range(8) for k in "ABC")


@pytest.fixture
def arrivals(spark, tmp_path):
    data = [(f"k{i % 7}", i, i * i) for i in range(60)]
    df = spark.createDataFrame(data, "k string, seq int, v int").repartition(6)
    df.write.parquet(f"{tmp_path}/in")
    newest = {}
    for k, seq, v in data:
        newest[k] = (k, seq, v)
    return f"{tmp_path}/in", df.schema, sorted(newest.values())


def test_snapshots_and_a_crash_before_the_switch(spark, tmp_path, arrivals, rows, monkeypatch):
    folder, schema, want = arrivals
    read = lambda: progress.read_results(spark, folder, schema, 1)
    path, state = f"{tmp_path}/live", f"{tmp_path}/state"
    plain, calls = progress._switch, []

    def crash(*args):
        calls.append(1)
        raise RuntimeError("crash between writing and switching")
    monkeypatch.setattr(progress, "_switch", crash)
    with pytest.raises(Exception, match="crash between"):
        progress.run_live_upsert(read(), path, state, ["k"], "seq", compact_every=3)
    assert calls and progress._manifest(spark, path)["version"] == 0
    assert rows(progress.read_live(spark, path, schema, ["k"], "seq"), "k").__len__() <= 7
    monkeypatch.setattr(progress, "_switch", plain)
    got = progress.run_live_upsert(read(), path, state, ["k"], "seq", compact_every=3)  # replays the batch that crashed
    assert rows(got, "k", "seq", "v") == want
    assert progress._manifest(spark, path)["version"] == 2
    files = got.inputFiles()
    assert all("/snapshot/" in f or "version=2" in f for f in files)  # nothing of the earlier logs is read


def test_a_document_in_ordered_parts(spark, tmp_path):
    axioms = spark.range(200).select(
        "id", F.lit(1).alias("task_id"), F.lit("layered").alias("execution_mode"), F.lit("l").alias("source_layer"), F.lit("class").alias("axiom_type"),
        F.concat(F.lit("Term "), "id").alias("subject_term"), F.lit(None).cast("string").alias("object_term"), F.lit("t").alias("axiom_text"),
        F.lit(None).cast("string").alias("payload_json"))
    lines = exports.export_rdfxml(axioms)
    exports.write_lines(lines, str(tmp_path / "doc"), parts=4)
    manifest = spark.read.schema("place int, part string, lines bigint, bytes bigint").json(str(tmp_path / "doc" / "manifest")).orderBy("place").collect()
    text = b"".join((tmp_path / "doc" / "parts" / m.part).read_bytes() for m in manifest)
    want = "".join(f"{r.line}\n" for r in sorted(lines.collect(), key=lambda r: r.seq)).encode()
    assert len(manifest) >= 3 and text == want and text.startswith(b"<?xml") and text.endswith(b"</rdf:RDF>\n")
    assert sum(m.bytes for m in manifest) == len(want) and sum(m.lines for m in manifest) == lines.count()
