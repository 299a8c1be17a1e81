"""CSV files of a results tree, split inside files."""

import json

from axiomloom.sources import readers


def test_split_files_give_the_rows_of_whole_ones(spark, tmp_path):
    (tmp_path / "medical").mkdir()
    rows = [{"id": str(i), "note": f"said, \"{i}\"", "x": "y" * (i % 7)} for i in range(4_000)]
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    lines = ["id,note,x"] + [",".join([r["id"], quoted(r["note"]), quoted(r["x"])]) for r in rows]
    (tmp_path / "medical" / "big.csv").write_text("\ufeff" + "\n".join(lines) + "\n")
    (tmp_path / "medical" / "other.csv").write_text("k,v\n1,2\n")
    (tmp_path / "medical" / "header.csv").write_text("only,names\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        out = readers.scan_rows_csv(spark, str(tmp_path), breaks=False)
        found = {}
        for r in out.select("path", "payload").collect():
            found.setdefault(r.path.rsplit("/", 1)[1], []).append(json.loads(r.payload))
        splits = spark.read.text(str(tmp_path / "medical" / "big.csv")).rdd.getNumPartitions()
        whole = sorted(r.payload for r in readers.scan_rows_csv(spark, str(tmp_path)).collect())
        tree = readers.scan_results_tree(spark, {"m": str(tmp_path)}, breaks=False).collect()
    finally:
        spark.conf.set(key, before)
    assert splits > 3
    # an empty cell is null, as in files that are not split
    assert sorted(json.dumps(r) for r in found["big.csv"]) == sorted(json.dumps({k: v or None for k, v in r.items()}) for r in rows)
    assert found["other.csv"] == [{"k": "1", "v": "2"}] and "header.csv" not in found
    assert sorted(r.payload for r in tree) == whole and {r.domain for r in tree} == {"medical"}


def test_rows_are_parsed_with_the_columns_of_the_headers(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("a.csv", '﻿id,"a, b",id,,note\n1,2,3,4,"x\ny",6,7\n8\n')
    write("b.csv", "k\nv\n")
    assert readers._most_columns(spark, str(tmp_path), 256) == 6
    got = {r.payload for r in readers.scan_rows_csv(spark, str(tmp_path)).collect()}
    assert got == {'{"a, b":"2","id":"3","note":"x\\ny"}', '{"a, b":null,"id":null,"note":null}', '{"k":"v"}'}
    write("c.csv", '"open\nname",z\n1,2\n')
    assert readers._most_columns(spark, str(tmp_path), 256) == 256
    assert '{"open\\nname":"1","z":"2"}' in {r.payload for r in readers.scan_rows_csv(spark, str(tmp_path)).collect()}
