"""Stored page index: pages as in a sorted list, what a page reads, ties, nulls, empty tables."""

from axiomloom.operators import reports



def scanned(df):
    """Files of the partition-filtered scan, from its metrics after a run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    leaf = leaf.executedPlan().collectLeaves().head() if "AdaptiveSparkPlan" in leaf.nodeName() else leaf
    return leaf.metrics().apply("numFiles").value(), leaf.metrics().apply("numOutputRows").value()


def test_pages_equal_slices_and_read_their_range_only(spark):
    df = spark.range(20_000).selectExpr("(id * 7919) % 20011 as id", "id as v")
    want = sorted(tuple(r) for r in df.collect())
    index = reports.build_page_index(df, rows_per_range=1_000)
    assert index.total == 20_000 and len(index.ranges) > 15
    for number, size in ((1, 50), (2, 50), (40, 500), (7, 333)):
        assert [tuple(r) for r in index.page(number, size).collect()] == want[(number - 1) * size:number * size]
    files, read = scanned(index.page(2, 50))
    assert files == 1 and read <= max(n for _, _, n in index.ranges)
    again = reports.open_page_index(spark, index.path)
    assert again.ranges == index.ranges and again.page(3, 10).collect() == index.page(3, 10).collect()
    assert index.page(0, 1000, max_size=100).count() == 100 and index.page(402, 50).count() == 0


def test_hot_value_is_split_and_each_row_is_on_one_page(spark):
    df = spark.range(6_000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 5L else id end as k",
                                       "id % 2 as v", "'x' as range")
    index = reports.build_page_index(df, "k", rows_per_range=500)
    assert max(n for _, _, n in index.ranges) < 1_500
    rows = [r for n in range(1, 13) for r in index.page(n, 500).collect()]
    keys = [r["k"] for r in rows]
    assert len(rows) == 6_000 and keys == sorted(keys, key=lambda k: (k is not None, k))
    assert sorted(map(str, rows)) == sorted(map(str, df.collect()))


def test_empty_table(spark):
    index = reports.build_page_index(spark.range(0).toDF("id"))
    assert index.total == 0 and index.page(1, 10).columns == ["id"] and index.page(1, 10).count() == 0
