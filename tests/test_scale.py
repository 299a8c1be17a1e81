"""Skew-safe helpers against their plain definitions, with one hot key."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axiomloom import scale
from axiomloom.operators import context, evidence, ontology, terms


def skewed(spark, n=3000):
    """A third of all rows share one key; another third are exact copies."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit("copies"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"),
        F.when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id") % 50).cast("int").alias("v"),
    )


def test_top_n_equals_plain_window(spark, rows):
    df = skewed(spark)
    got = scale.top_n(df, ["key"], [F.col("v"), F.col("id")], 5)
    want = df.withColumn("_rank", F.row_number().over(W.partitionBy("key").orderBy("v", "id"))).filter("_rank <= 5")
    assert rows(got, "key", "id", "_rank") == rows(want, "key", "id", "_rank")


def test_top_n_keeps_copies(spark):
    copies = skewed(spark).select("key", "v").filter("key = 'copies'")
    assert scale.top_n(copies, ["key"], [F.col("v")], 600).count() == 600


def test_dense_position_per_key_and_whole_table(spark, rows):
    df = skewed(spark)
    for keys in (["key"], []):
        window = W.partitionBy(*keys).orderBy("id")
        want = df.withColumn("n", F.row_number().over(window).cast("bigint"))
        assert rows(scale.dense_position(df, keys, "id", "n"), "id", "n") == rows(want, "id", "n")


def test_dense_position_bounds_every_range(spark):
    """No (key, range) holds more than a small part of a hot key's rows."""
    df = skewed(spark)
    steps = [i / 64 for i in range(1, 64)]
    cuts = sorted(set(df.agg(F.percentile_approx("id", steps, 1000).alias("c")).first()["c"]))
    sizes = df.groupBy("key", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda e: e < F.col("id")))).count()
    assert sizes.agg(F.max("count")).first()[0] <= 3000 / 64


def test_dense_position_of_empty_frame(spark):
    assert scale.dense_position(skewed(spark).filter("id < 0"), ["key"], "id", "n").count() == 0


def test_rank_by_value_equals_rank(spark, rows):
    df = skewed(spark)
    want = df.withColumn("r", F.rank().over(W.partitionBy("key").orderBy(F.col("v").desc())).cast("bigint"))
    assert rows(scale.rank_by_value(df, ["key"], "v", "r"), "id", "r") == rows(want, "id", "r")


def test_salted_join_equals_plain_join(spark, rows):
    left = skewed(spark)
    right = left.select("key").distinct().filter("key <> 'k5'").withColumn("w", F.length("key"))
    right = right.union(right.filter("key = 'hot'"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = scale.salted_join(left, right, ["key"], how, min_rows=10, salts=7)
        want = left.join(right, ["key"], how)
        assert rows(got, *want.columns) == rows(want, *want.columns)
        assert got.count() == want.count()


def test_salts_grow_with_the_rows_of_a_key(spark, rows):
    left = skewed(spark)
    left = left.unionByName(left.filter("key = 'hot' and id % 2 = 0"))
    counts = {r["key"]: r["count"] for r in left.groupBy("key").count().collect()}
    hot = {r["key"]: r["_salts"] for r in scale.find_hot_keys(left, ["key"], 100).collect()}
    assert hot == {k: max(2, -(-n // 100)) for k, n in counts.items() if n >= 100} and hot["hot"] > hot["copies"]
    right = left.select("key").distinct().withColumn("w", F.length("key"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, ["key"], how)
        assert rows(scale.salted_join(left, right, ["key"], how, min_rows=100), *want.columns) == rows(want, *want.columns)


def test_find_hot_keys(spark):
    df = skewed(spark)
    assert sorted(r["key"] for r in scale.find_hot_keys(df, ["key"], 500).collect()) == ["copies", "hot"]
    assert scale.find_hot_keys(df, ["key"]) is None


def test_keep_first_and_last(spark, rows):
    df = skewed(spark)
    assert rows(scale.keep_last(df, ["key"], ["v", "id"]).filter("key = 'hot'"), "id") == [(2949,)]
    assert rows(scale.keep_first(df, ["key"], ["v", "id"]).filter("key = 'copies'"), "id") == [(1,)]


def test_operators_agree_with_and_without_salting(spark, rows):
    triples = spark.range(400).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("pos"),
        F.when(F.col("id") % 2 == 0, F.lit("Hub")).otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("subject"),
        F.lit("uses").alias("relation"), F.concat(F.lit("o"), (F.col("id") % 9).cast("string")).alias("object"),
        F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("chunk"), F.lit("Hub uses it").alias("context"))
    names = triples.select("doc_id", F.col("subject").alias("original"), F.lower("subject").alias("normalized")).distinct()
    a, _ = terms.rewrite_triples(triples, names)
    b, _ = terms.rewrite_triples(triples, names, min_rows=3)
    assert rows(a, *a.columns) == rows(b, *a.columns)

    axioms = spark.createDataFrame(
        [(1, "Class", "Hub", ""), (1, "Property", "uses", ""), (1, "domain", "uses", "Hub"), (1, "subClassOf", "Hub", "o3")],
        "doc_id int, axiom_type string, item1 string, item2 string")
    chunks = spark.createDataFrame([(1, "c0", "t", 1, 2)], "doc_id int, chunk_id string, text string, page_start int, page_end int")
    x, y = (evidence.layered_evidence(axioms, triples, chunks, **o) for o in ({}, {"min_rows": 3}))
    assert rows(x, *x.columns) == rows(y, *x.columns)
    assert rows(x.filter("axiom_type = 'domain' and list = 'chunk'"), "value", "first_pos") == [
        ("c0", 0), ("c1", 6), ("c2", 2), ("c3", 8), ("c4", 4)]

    service = triples.select(
        F.col("pos").alias("id"), F.lit("domain").alias("axiom_type"), F.col("subject").alias("subject_term"), F.col("object").alias("object_term"))
    p, q = (ontology.degree_rank(service, **o) for o in ({}, {"min_rows": 3}))
    assert rows(p, *p.columns) == rows(q, *p.columns)

    mapping = spark.createDataFrame([("Hub", "hub", "Class", "Hub", "", "about hub")], "uri string, name string, kind string, label_en string, abstract_en string, comment_en string")
    u, v = (context.attach_context(triples, mapping, **o) for o in ({}, {"min_rows": 3}))
    assert rows(u, "pos", "subject_context", "object_hit") == rows(v, "pos", "subject_context", "object_hit")
