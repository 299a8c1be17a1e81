"""Components, depths and content against plain graph walks, and what is stored on the way."""

import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from axiomloom import scale
from axiomloom.operators import graph as gr


def random_graphs(seed):
    """Trees, graphs with several supers, chains with shortcuts and graphs with cycles."""
    rnd, out = random.Random(seed), {}
    for k in range(24):
        n, kind, arcs = rnd.randint(3, 25), k % 4, set()
        for i in range(1, n):
            if kind == 0:
                arcs.add((i, rnd.randrange(i)))
            elif kind == 1:
                arcs |= {(i, rnd.randrange(i)) for _ in range(rnd.randint(1, 3))}
            elif kind == 2:
                arcs.add((i, i - 1))
            elif (a := rnd.randrange(n)) != (b := rnd.randrange(n)):
                arcs.add((a, b))
        extra = 3 if kind == 2 or k % 8 == 1 else 0
        for _ in range(extra):
            a, b = rnd.sample(range(n), 2)
            arcs.add((max(a, b), min(a, b)) if kind == 2 else (a, b))
        if arcs:
            out[k] = {(f"n{a}", f"n{b}") for a, b in arcs}
    return out


def walked(arcs):
    """(component of each node, content, max depth, mean shortest depth)."""
    nodes = {x for a in arcs for x in a}
    up = {n: {b for a, b in arcs if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(up[n])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += up[x]
        reach[n] = seen
    part = {n: min([n, *[m for m in reach[n] if n in reach[m]]]) for n in nodes}
    dag = {(part[a], part[b]) for a, b in arcs if part[a] != part[b]}
    over = {p: [b for a, b in dag if a == p] for p in part.values()}
    short = cache(lambda p: 1 + min(map(short, over[p])) if over[p] else 0)
    long = cache(lambda p: 1 + max(map(long, over[p])) if over[p] else 0)
    leaves = set(over) - {b for _, b in dag}
    return (part, sum(len(r - {n}) for n, r in reach.items()), max(long(p) for p in leaves),
            sum(short(part[n]) for n in nodes) / len(nodes))


@pytest.mark.parametrize("seed", [11, 12])
def test_measures_against_walks(spark, seed):
    graphs = random_graphs(seed)
    df = spark.createDataFrame([(k, a, b) for k, arcs in graphs.items() for a, b in arcs], "g int, sub string, super string")
    want = {k: walked(arcs) for k, arcs in graphs.items()}
    parts = {}
    for r in gr.strongly_connected(df, ["g"]).collect():
        parts.setdefault(r.g, {})[r.node] = r.component
    assert parts == {k: w[0] for k, w in want.items()}
    got = {r.g: r for r in gr.hierarchy_metrics(df, ["g"]).collect()}
    for k, (part, content, depth, mean) in want.items():
        r = got[k]
        assert (r.semantic_content, r.max_depth, r.node_count, r.direct_edge_count) == (content, depth, len(part), len(graphs[k]))
        assert r.avg_depth == pytest.approx(mean)


def test_a_deep_tree_stores_few_rows(spark, monkeypatch):
    """A chain of 10,000 nodes with a leaf on each: no pairs, and no table beyond a few times the arcs."""
    n, rows = 10_000, []
    plain = gr.cut_lineage, gr.cut_and_count

    def stored(df, tag, **more):
        out = plain[1](df, tag, **more) if more else plain[0](df, tag)
        rows.append((out[0] if more else out).count())
        return out
    monkeypatch.setattr(gr, "cut_lineage", stored)
    monkeypatch.setattr(gr, "cut_and_count", lambda df, tag, **c: stored(df, tag, **c) if c else plain[1](df, tag))
    monkeypatch.setattr(gr, "closure_pairs", lambda dag: pytest.fail("a tree needs no pairs"))
    chain = spark.range(1, n).select(F.col("id").alias("sub"), (F.col("id") - 1).alias("super"))
    arcs = chain.unionByName(spark.range(n).select((F.col("id") + n).alias("sub"), F.col("id").alias("super")))
    sizes = spark.range(2 * n).select(F.col("id").alias("component_id"), F.lit(1).cast("bigint").alias("size"))
    r = gr.upward_measures(sizes, arcs).agg(F.sum("above"), F.max("longest"), F.sum("shortest")).first()
    above = n * (n - 1) // 2 + n * (n + 1) // 2
    assert tuple(r) == (above, n, above) and max(rows) <= 2 * n and len(rows) <= 20


def test_a_hub_under_many_shared_nodes(spark):
    """Each of 300 nodes hangs under two of a chain: stretches, not nodes, are paired."""
    arcs = [(i, i - 1) for i in range(1, 400)] + [(1000 + i, 20 * (i % 5) + 10) for i in range(300)] + [(1000 + i, 399) for i in range(300)]
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in arcs], "sub string, super string").withColumn("g", F.lit(1))
    r = gr.hierarchy_metrics(df, ["g"]).first()
    assert (r.semantic_content, r.max_depth) == (400 * 399 // 2 + 300 * 400, 400)


def test_closure_joins_a_pair_with_few_others(spark, monkeypatch):
    """A chain of n arcs has n * n / 2 pairs; joining pairs with pairs would look at n ** 3 / 6 ways."""
    n, joined, plain = 64, [], scale.salt_hot_keys

    def watched(*args, **options):
        out = plain(*args, **options)
        joined.append(out.count())
        return out

    monkeypatch.setattr(scale, "salt_hot_keys", watched)
    monkeypatch.setattr(gr, "salt_hot_keys", watched)
    pairs = gr.closure_pairs(spark.range(n).select(F.col("id").alias("sub"), (F.col("id") + 1).alias("super")))
    got = pairs.agg(F.count("*"), F.sum("steps"), F.sum("longest")).first()
    whole = sum(k * (n + 1 - k) for k in range(1, n + 1))
    assert tuple(got) == (n * (n + 1) // 2, whole, whole)
    assert 0 < sum(joined) < 2 * n * n
