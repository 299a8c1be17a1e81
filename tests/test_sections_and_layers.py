from pyspark.sql import functions as F

from axiomloom.operators import chunks as ch
from axiomloom.operators import layers as la


def test_titles_that_are_not_numbered_keep_their_digits(spark):
    df = spark.createDataFrame([("5.1 Keit in lich. Ung\nbody", "5.1 keit in lich"), ("xx 5.1 keit in lich\nbody", "5.1 keit in lich"), (None, "5.1 keit in lich")],
                               "t string, a string")
    plain = [r[0] for r in df.select(ch.section_text("t", "a", F.lit("never"), numbered=False)).collect()]
    assert plain == ["5.1 Keit in lich. Ung\nbody", "body", ""]
    assert [r[0] for r in df.select(ch.section_text("t", "a", F.lit("never"))).collect()] == ["body", "body", ""]


def test_layer2_stats_read_maps_and_lists_in_one_frame(spark, rows):
    docs = spark.createDataFrame([
        (1, "x", {" a": "Class", "a ": "Property", "b": ""}, [("c", "Class")]),
        (2, "x", None, [("a", "Class"), (" a", "Property"), ("", "Class"), ("b", "Instance")]),
        (3, "y", {}, [("a", "Instance")]), (4, "y", None, None),
    ], "doc_id int, domain string, type_map map<string,string>, normalized_terms array<struct<normalized: string, type: string>>")
    out = la.layer2_stats(docs)
    # the union of a mapped and a listed frame failed on larger tables: "Can't zip RDDs with unequal numbers of partitions"
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rows(out, "doc_id", "domain", "refined_term_count", "class_count", "property_count", "instance_count") == [
        (1, "x", 1, 0, 1, 0), (2, "x", 2, 1, 0, 1), (3, "y", 1, 0, 0, 1), (4, "y", 0, 0, 0, 0)]
