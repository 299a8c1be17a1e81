"""One-document exports, byte for byte."""

import glob
import json

import pandas as pd
import pytest

from axiomloom.sources import exports

ROWS = [(3, "c", 'say "hi", twice', 1.5, True), (1, "a", "two\nlines", -0.25, False), (2, None, " kept blanks ", None, None),
        (9, "é ü 漢", "tab\tand \\ back", 2.0, True), (-4, "first", "", 0.5, False)]
SCHEMA = "no bigint, name string, `free text` string, score double, ok boolean"


def joined(path):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/parts/part-*")))


def plain():
    rows = sorted(ROWS)
    return [dict(zip(("name", "free text", "score", "ok"), r[1:], strict=True)) for r in rows]


@pytest.mark.parametrize("parts", [1, 4])
def test_documents_are_byte_equal(spark, tmp_path, parts):
    df = spark.createDataFrame(ROWS, SCHEMA)
    exports.write_lines(exports.csv_document(df, "no"), str(tmp_path / "c"), parts)
    exports.write_lines(exports.json_document(df, "no"), str(tmp_path / "j"), parts)
    frame = pd.DataFrame(plain()).astype(object)
    frame["ok"] = frame["ok"].map(lambda x: x if x is None else str(x).lower())
    frame.to_csv(tmp_path / "want.csv", index=False, encoding="utf-8-sig", lineterminator="\n")
    assert joined(tmp_path / "c") == (tmp_path / "want.csv").read_bytes()
    assert joined(tmp_path / "j").decode() == json.dumps(plain(), ensure_ascii=False, indent=2) + "\n"


def test_empty_and_without_mark(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    exports.write_lines(exports.csv_document(none, "no", bom=False), str(tmp_path / "c"), 3)
    exports.write_lines(exports.json_document(none, "no"), str(tmp_path / "j"), 3)
    assert joined(tmp_path / "c") == b"name,free text,score,ok\n" and json.loads(joined(tmp_path / "j")) == []
