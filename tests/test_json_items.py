"""JSON files read by elements: layouts, splits inside a file, broken files, the mixed tree."""

import json
import random

import pytest

from axiomloom.operators import ontology
from axiomloom.sources import readers

ROW = {"sub": "a [b] {", "super": 'q "\\" ]', "n": [1, {"x": []}], "t": "line\nbreak, é"}


def merged(payloads):
    """The parts of one file put together again."""
    docs = [json.loads(p) for p in payloads]
    if isinstance(docs[0], list):
        return [x for d in docs for x in d]
    out = {}
    for d in docs:
        for k, v in d.items():
            out[k] = out[k] + v if k in out else v
    return out


def read(spark, folder):
    files = {}
    for r in readers.scan_json_items(spark, str(folder)).orderBy("path", "no").collect():
        files.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["payload"])
    return files


@pytest.mark.parametrize("split", [None, "300b"])
def test_parts_make_the_file(spark, tmp_path, split):
    rnd = random.Random(3)
    item = lambda: rnd.choice([ROW, {}, [], "x, ]", 5, None, [ROW, "]"], {"deep": {"er": [ROW]}}])
    docs = {
        "list": [item() for _ in range(40)],
        "object": {"id": "d[1]", "classes": [item() for _ in range(20)], "meta": {"a": [1, 2], "b": {}}, "none": [],
                   "subClassOf": [ROW] * 15, "last": None},
        "flat": {"a": 1, "b": "{"},
    }
    for name, doc in docs.items():
        for indent in (2, "\t"):
            (tmp_path / f"{name}{indent == 2}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
        (tmp_path / f"{name}Line.json").write_text(json.dumps(doc), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = read(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, doc in docs.items():
        for kind in ("True", "False"):
            parts = got[f"{name}{kind}.json"]
            want = {k: v for k, v in doc.items() if v != [] or k != "none"} if name == "object" else doc
            back = merged(parts)
            back.pop("none", None) if isinstance(back, dict) else None
            assert back == want
            assert len(parts) >= len(doc) and max(map(len, parts)) < 700
        assert [json.loads(p) for p in got[f"{name}Line.json"]] == [doc]


def test_other_layouts_are_one_payload(spark, tmp_path):
    texts = {
        "dense": '{\n "a": [\n  {"x": 1}], "b": [\n  2\n ]\n}', "glued": '[{\n "a": 1\n}, {\n "a": 2\n}]',
        "open": '{\n "a": "no end\n}', "short": '[\n {"a": 1},\n', "two": '{\n "a": 1\n}\n{\n "b": 2\n}', "word": "nothing",
    }
    for name, text in {**texts, "blank": " \n\n", "empty": ""}.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    got = read(spark, tmp_path)
    assert {n.split(".")[0]: p for n, p in got.items()} == {n: ["\n".join(x for x in t.split("\n") if x.strip())] for n, t in texts.items()}
    (tmp_path / "none").mkdir()
    assert readers.scan_json_items(spark, str(tmp_path / "none")).count() == 0


def test_shared_lines_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿[\r\n  {"a": 1}, {"a": 2},\r\n  {"a":\r\n 3}\r\n]', encoding="utf-8", newline="")
    got = read(spark, tmp_path)["a.json"]
    assert [json.loads(p) for p in got] == [[{"a": 1}, {"a": 2}], [{"a": 3}]]


def test_tree_by_items_equals_tree_by_files(spark, rows, tmp_path):
    folder = tmp_path / "Medical"
    folder.mkdir()
    doc = {"subClassOf": [{"sub": f"s{i}", "super": "[T]"} for i in range(30)], "axioms": [{"child": "c", "parent": "p", "type": "subPropertyOf"}]}
    (folder / "a.json").write_text(json.dumps(doc, indent=2))
    (folder / "b.json").write_text(json.dumps([{"sub": "x", "super": "y", "type": "subClassOf"}] * 2, indent=4))
    (folder / "c.csv").write_text("child,parent,type\n1,2,subClassOf\n")
    whole, items = (ontology.heterogeneous_axioms(readers.scan_results_tree(spark, {"m": str(tmp_path)}, items=k).drop("path"))
                    for k in (False, True))
    assert rows(items, *items.columns) == rows(whole, *whole.columns) and items.count() >= 33


def test_no_join_of_lines_is_broadcast(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps([ROW, ROW], indent=1))
    plans = []
    cut = readers.cut_lineage

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, tag)

    monkeypatch.setattr(readers, "cut_lineage", seen)
    out = readers.scan_json_items(spark, str(tmp_path))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 5
    assert not [p for p in plans if "Broadcast" in p]
    assert out.count() == 2
