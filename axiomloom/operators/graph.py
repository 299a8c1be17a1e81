"""Hierarchy measurement: components, depth and transitive closure.

Edges: (graph keys..., sub, super). Every algorithm runs for all graphs at
once in keyed frames. Loops cut their lineage with tables in the shared
folder. Cycles are collapsed first, so a large component is one node and its
members are never paired with each other; trees are measured by pointer jumping,
and only nodes with several supers keep sets of what is above them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_token
from ..scale import find_hot_keys, salt_hot_keys
from ..session import cut_and_count, cut_lineage

KEYS = ("method", "domain", "axiom_type")
ALL_DOMAINS = "all"


def collect_edges(records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    rows = records.select(*keys, strip_token("sub").alias("sub"), strip_token("super").alias("super"))
    return rows.filter((F.col("sub") != "") & (F.col("super") != "") & (F.col("sub") != F.col("super"))).dropDuplicates()


def merge_edges_by_method(edges: DataFrame) -> DataFrame:
    """Union of the edges over domains, under the domain name 'all'."""
    return edges.select("method", F.lit(ALL_DOMAINS).alias("domain"), "axiom_type", "sub", "super").dropDuplicates()


def graph_nodes(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return edges.select(*keys, F.explode(F.array("sub", "super")).alias("node")).distinct()


def node_edge_counts(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    nodes = graph_nodes(edges, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("node_count"))
    links = edges.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("direct_edge_count"))
    return nodes.join(links, list(keys))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _join_ends(edges: DataFrame, subs: DataFrame, supers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges joined with a table about each end; hub nodes are salted."""
    hot = {end: find_hot_keys(edges, [*keys, end]) for end in ("sub", "super")}
    out = salt_hot_keys(edges, subs, [*keys, "sub"], hot["sub"])
    return salt_hot_keys(out, supers, [*keys, "super"], hot["super"])


def number_nodes(edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes with a number ``id`` over all graphs, arcs as (src, dst) numbers).

    The loops below then move two integers per row instead of graph keys and
    names, and nodes of different graphs can never be confused. Numbers follow
    the hash partitions that the distinct nodes were dealt to.
    """
    keys = list(keys)
    nodes = cut_lineage(graph_nodes(edges, keys).withColumn("id", F.monotonically_increasing_id()), "nodes")
    a = nodes.select(*keys, F.col("node").alias("sub"), F.col("id").alias("src"))
    b = nodes.select(*keys, F.col("node").alias("super"), F.col("id").alias("dst"))
    arcs = _join_ends(edges, a, b, keys).select("src", "dst")
    return nodes, cut_lineage(arcs.filter("src <> dst").distinct(), "arcs")


def _smallest_reaching(arcs: DataFrame) -> DataFrame:
    """(node, label): the smallest number from which each node can be reached.

    Every node starts with itself. A round hands labels over one arc, reduced
    before the shuffle, and then jumps: a node takes the label of its label,
    which also reaches it. Numbers follow a hash, so a label lies about halfway
    down the stretch it is the smallest of, and the stretch grows by half per
    round: rounds grow with the logarithm of the longest path.
    """
    hot = find_hot_keys(arcs.select(F.col("src").alias("node")), ["node"])
    out = arcs.select(F.col("src").alias("node"), "dst")
    start = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = cut_lineage(start.withColumn("label", F.col("node")), "labels")
    while True:
        sent = salt_hot_keys(out, labels, ["node"], hot).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("_new"))
        stepped = labels.join(sent, "node", "left").select(
            "node", F.least("label", F.coalesce("_new", "label")).alias("_to"), F.col("label").alias("_was"))
        beyond = labels.select(F.col("node").alias("_to"), F.col("label").alias("_far"))
        jumped = stepped.join(beyond, "_to").select("node", F.least("_to", "_far").alias("label"), "_was")
        labels, seen = cut_and_count(jumped, "labels", moved=F.col("label") < F.col("_was"))
        labels = labels.select("node", "label")
        if not seen["moved"]:
            return labels


#: A round of peeling or merging is worth another while it removes this share of the arcs.
WORTH = 1 / 8


def _peeled(live: DataFrame) -> tuple[DataFrame, int]:
    """Arcs that may lie on a cycle: another leads to where they begin, another on from where they end."""
    onward = live.select(F.col("src").alias("dst")).distinct()
    into = live.select(F.col("dst").alias("src")).distinct()
    live, seen = cut_and_count(live.join(onward, "dst", "left_semi").join(into, "src", "left_semi").select("src", "dst"), "live")
    return live, seen["rows"]


def _merge_mutual(live: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(arcs between merged nodes, (node, label) of merged nodes), merging nodes that point at each other; None if none do."""
    back = live.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual, seen = cut_and_count(live.join(back, ["src", "dst"], "left_semi"), "mutual")
    if not seen["rows"]:
        return None
    labels = cut_lineage(_smallest_reaching(mutual), "merged")
    return _relabelled(live, labels), labels


def _relabelled(live: DataFrame, labels: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        names = labels.select(F.col("node").alias(end), F.col("label").alias("_to"))
        live = live.join(names, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return cut_lineage(live.filter("src <> dst").distinct(), "live")


def _label_pass(live: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(components found, arcs left, their number): the smallest number that reaches each node and the smallest
    it reaches, in the same rounds, as two copies of the graph. If the two are one node, that node and this
    one reach each other. Nodes of one component agree on both labels, so arcs whose ends differ leave.
    """
    both_ways = F.array(
        F.struct((F.col("src") * 2).alias("src"), (F.col("dst") * 2).alias("dst")),
        F.struct((F.col("dst") * 2 + 1).alias("src"), (F.col("src") * 2 + 1).alias("dst")))
    doubled = cut_lineage(live.select(F.explode(both_ways).alias("a")).select("a.*"), "doubled")
    labels = _smallest_reaching(doubled)
    back, plain = F.col("node") % 2 == 1, lambda c: F.floor(F.col(c) / 2).cast("bigint")
    both = cut_lineage(labels.groupBy(plain("node").alias("id")).agg(
        F.max(F.when(~back, plain("label"))).alias("low"), F.max(F.when(back, plain("label"))).alias("high")), "both")
    open_ = both.filter("low <> high")
    a = open_.select(F.col("id").alias("src"), F.col("low").alias("_al"), F.col("high").alias("_ah"))
    b = open_.select(F.col("id").alias("dst"), F.col("low").alias("_bl"), F.col("high").alias("_bh"))
    live, seen = cut_and_count(
        live.join(a, "src").join(b, "dst").filter("_al = _bl and _ah = _bh").select("src", "dst"), "live")
    return both.filter("low = high and id <> low").select(F.col("id").alias("node"), F.col("low").alias("label")), live, seen["rows"]


def strongly_connected(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node, component, size, component_id); a component is named by its
    smallest node name.

    Nodes that point at each other are merged and arcs that cannot lie on a cycle
    peeled off, as long as a round removes its share of the arcs; a forest ends
    there. What is left goes through label passes, whose rounds grow with the
    logarithm of the longest path. Members of a component are never paired with
    each other.
    """
    keys = list(keys)
    members = _with_components(*number_nodes(edges.select(*keys, "sub", "super").distinct(), keys))
    named = members.groupBy("component_id").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size"))
    return cut_lineage(members.join(named, "component_id").select(*keys, "node", "component", "size", "component_id"), "scc")


def _with_components(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """The nodes with component_id, the number of one member of their component."""
    left, merged, look = live.count(), [], True
    while left:
        before = left
        if look and (mutual := _merge_mutual(live)) is not None:
            live, labels = mutual
            merged.append(labels)
        else:
            look = False  # peeling brings no new ones
        live, left = _peeled(live)
        if before - left < WORTH * before and left:
            found, live, left = _label_pass(live)
            merged.append(found)
    members = nodes.withColumn("component_id", F.col("id"))
    for labels in merged:
        members = members.join(labels.select(F.col("node").alias("component_id"), F.col("label").alias("_to")), "component_id", "left").withColumn(
            "component_id", F.coalesce("_to", "component_id")).drop("_to")
    return cut_lineage(members, "members")


def numbered_components(edges: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(nodes with component_id, arcs (sub, super) between different components): as strongly_connected
    and condensed_edges have them, without names and without another pass over the edges."""
    nodes, arcs = number_nodes(edges, list(keys))
    members = _with_components(nodes, arcs)
    dag = arcs
    for end in ("src", "dst"):
        dag = dag.join(members.select(F.col("id").alias(end), F.col("component_id").alias(f"_{end}")), end)
    return members, cut_lineage(dag.filter("_src <> _dst").select(F.col("_src").alias("sub"), F.col("_dst").alias("super")).distinct(), "dag")


def named_parts(members: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, component_id, component, size) of numbered_components' nodes; a component is named by its smallest node name."""
    return cut_lineage(members.groupBy(*keys, "component_id").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")), "parts")


def condensed_edges(edges: DataFrame, components: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct edges between different components, (keys, sub, super) by
    number: an acyclic graph."""
    keys = list(keys)
    a = components.select(*keys, F.col("node").alias("sub"), F.col("component_id").alias("_a"))
    b = components.select(*keys, F.col("node").alias("super"), F.col("component_id").alias("_b"))
    joined = _join_ends(edges, a, b, keys)
    return cut_lineage(joined.filter("_a <> _b").select(
        *keys, F.col("_a").alias("sub"), F.col("_b").alias("super")).distinct(), "dag")


def _climb(steps: DataFrame, stops: DataFrame | None = None) -> list[DataFrame]:
    """Pointer jumping. ``steps``: (node, at, steps, above) leads from each node to the one over it; without
    ``stops`` to the top of its tree, else to the nearest node of ``stops`` (node) over it.

    Returns the stored table of every round: the last leads all the way, the
    k-th 2**k steps or to the end. Each has a row per node, and rounds grow with
    the logarithm of the height.
    """
    ends = steps.select(F.col("at").alias("node")).distinct().join(steps.select("node"), "node", "left_anti")
    if stops is not None:
        ends = ends.unionByName(stops.select("node")).distinct()
    ends = ends.select(F.col("node").alias("at"), F.lit(True).alias("done"))
    done = F.coalesce("done", F.lit(False))
    now, seen = cut_and_count(steps.join(ends, "at", "left").select("node", "at", "steps", "above", done.alias("done")), "climb", open=~done)
    rounds = [now]
    while seen["open"]:
        beyond = now.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_s"), F.col("above").alias("_w"), F.col("done").alias("_d"))
        jumped = now.filter("not done").join(beyond, "at").select(
            "node", F.col("_at").alias("at"), (F.col("steps") + F.col("_s")).alias("steps"), (F.col("above") + F.col("_w")).alias("above"), F.col("_d").alias("done"))
        now, seen = cut_and_count(now.filter("done").unionByName(jumped), "climb", open=~F.col("done"))
        rounds.append(now)
    return rounds


def upward_measures(sizes: DataFrame, dag: DataFrame) -> DataFrame:
    """(component_id, shortest, longest, above): steps to the nearest and along the longest way to a node
    without supers, and the sizes of all nodes above added up.

    ``sizes``: (component_id, size); ``dag``: (sub, super), distinct and acyclic. A
    node with one super hangs in a tree whose top has none or several; inside its
    tree, what is above a node is one path. Only tops with several supers
    (joints) need sets: paths are cut where a joint enters them or two such ways
    meet, and the closure of joints and these stretches is stored. A forest has none.
    """
    size = sizes.select(F.col("component_id").alias("super"), F.col("size").alias("above"))
    arcs = cut_lineage(dag.select("sub", "super").join(size, "super"), "weighted")
    single = arcs.groupBy("sub").agg(F.count(F.lit(1)).alias("_n"), F.min("super").alias("at"), F.min("above").alias("above"))
    trees = single.filter("_n = 1").select(F.col("sub").alias("node"), "at", F.lit(1).alias("steps"), "above")
    rounds = _climb(cut_lineage(trees, "trees"))
    joints, seen = cut_and_count(single.filter("_n > 1").select(F.col("sub").alias("node")), "joints")
    whole = sizes.join(rounds[-1].withColumnRenamed("node", "component_id"), "component_id", "left").select(
        "component_id", "size", F.coalesce("at", "component_id").alias("top"), F.coalesce("steps", F.lit(0)).alias("steps"),
        F.coalesce("above", F.lit(0)).cast("bigint").alias("above"))
    if not seen["rows"]:
        return whole.select("component_id", F.col("steps").alias("shortest"), F.col("steps").alias("longest"), "above")
    whole = cut_lineage(whole, "in-trees")
    of_joints = _joint_measures(whole, arcs.join(joints.withColumnRenamed("node", "sub"), "sub", "left_semi"), rounds, joints)
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.join(of_joints, "top", "left").select(
        "component_id", (F.col("steps") + more("_shortest")).alias("shortest"), (F.col("steps") + more("_longest")).alias("longest"),
        (F.col("above") + more("_above")).alias("above"))


def _joint_measures(whole: DataFrame, entries: DataFrame, rounds: list[DataFrame], joints: DataFrame) -> DataFrame:
    """(top, _shortest, _longest, _above) of the joints; ``entries``: (sub, super), their arcs."""
    entered = entries.select(F.col("super").alias("node")).distinct()
    marked = entered
    for hops in reversed(rounds):  # 2**k steps, k falling: every node over an entered one
        up = hops.select("node", F.col("at").alias("_up"))
        marked = marked.join(up, "node", "left").select(F.explode(F.array_compact(F.array("node", "_up"))).alias("node")).distinct()
    marked = cut_lineage(marked, "marked")
    # A marked node is the lower end of a stretch unless its only way in is from one marked node below.
    below = marked.join(rounds[0], "node").groupBy(F.col("at").alias("node")).agg(F.count(F.lit(1)).alias("_below"))
    ends = marked.join(entered.withColumn("_in", F.lit(True)), "node", "left").join(below, "node", "left").filter(
        "_in or coalesce(_below, 0) <> 1").select("node")
    ends = cut_lineage(ends, "ends")
    over = _climb(cut_lineage(rounds[0].select("node", "at", "steps", "above").join(marked, "node", "left_semi"), "marked-steps"), ends)[-1]
    path = (F.col("size") + F.col("above")).alias("path")
    placed = whole.select(F.col("component_id").alias("node"), "top", "steps", path)
    next_end = ends.join(placed.select("node", F.col("path").alias("_next_path")), "node").withColumnRenamed("node", "at")
    stretches = cut_lineage(
        ends.join(placed, "node").join(over.join(ends, "node", "left_semi").join(next_end, "at").select(
            "node", F.col("at").alias("next"), F.col("steps").alias("hop"), "_next_path"), "node", "left").join(
            joints.select(F.col("node").alias("top"), F.lit(True).alias("joint")), "top", "left").select(
            "node", "top", "steps", "next", "hop", F.coalesce("joint", F.lit(False)).alias("joint"),
            (F.col("path") - F.coalesce("_next_path", F.lit(0))).alias("weight")), "stretches")
    step = lambda sub, over_, n: (sub.alias("sub"), over_.alias("super"), n.cast("int").alias("steps"))
    enter = entries.select(F.col("sub").alias("top"), F.col("super").alias("_entry"))
    ways = enter.select(*step(F.col("top"), F.col("_entry"), F.lit(1))).unionByName(
        stretches.filter("next is not null").select(*step(F.col("node"), F.col("next"), F.col("hop")))).unionByName(
        stretches.filter("next is null and joint").join(enter, "top").select(*step(F.col("node"), F.col("_entry"), F.col("steps") + 1)))
    pairs = closure_pairs(cut_lineage(ways.distinct().withColumn("longest", F.col("steps")), "ways"))
    reached = pairs.join(joints.withColumnRenamed("node", "sub"), "sub", "left_semi").join(
        stretches.select(F.col("node").alias("super"), F.when(~F.col("joint"), F.col("steps")).alias("_rest"), "weight"), "super")
    return reached.groupBy(F.col("sub").alias("top")).agg(
        F.min(F.col("steps") + F.col("_rest")).alias("_shortest"), F.max(F.col("longest") + F.col("_rest")).alias("_longest"),
        F.sum("weight").alias("_above"))


def component_depths(components: DataFrame, dag: DataFrame, keys: Sequence[str] = KEYS,
                     measures: DataFrame | None = None) -> DataFrame:
    """(keys, component, component_id, size, shortest, longest) below the top.

    ``measures`` are those of upward_measures, made here if not given.
    """
    parts = cut_lineage(components.select(*keys, "component", "component_id", "size").distinct(), "parts")
    measures = upward_measures(parts.select("component_id", "size"), dag) if measures is None else measures
    return parts.join(measures.select("component_id", "shortest", "longest"), "component_id")


def depth_metrics(depths: DataFrame, dag: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Longest path to a leaf, and size-weighted mean of the shortest depth."""
    parents = dag.select(F.col("super").alias("component_id")).distinct().withColumn("_parent", F.lit(True))
    return depths.join(parents, "component_id", "left").groupBy(*keys).agg(
        F.max(F.when(F.col("_parent").isNull(), F.col("longest"))).alias("max_depth"),
        (F.sum(F.col("shortest") * F.col("size")).cast("double") / F.sum("size")).alias("avg_depth"))


def closure_pairs(dag: DataFrame) -> DataFrame:
    """(sub, super, steps, longest): all connected pairs of an acyclic graph of
    numbered nodes, with their shortest and longest distance. Arcs that stand for
    several steps say so in ``steps`` and ``longest``.

    Round k knows the pairs of up to 2**k arcs and the leaps, pairs of exactly
    2**k; a longer path is a leap and what is left of it (min-plus and max-plus at
    once). Only leaps are joined, of which a node has as many as the graph is wide
    there, and rounds grow with the logarithm of the depth.
    """
    best = [F.min("steps").alias("steps"), F.max("longest").alias("longest")]
    measured = {c: F.col(c) if c in dag.columns else F.lit(1) for c in ("steps", "longest")}
    leaps, left_over = _measured(dag.withColumns(measured).groupBy("sub", "super").agg(*best))
    pairs = leaps
    while left_over:
        left = leaps.select("sub", F.col("super").alias("middle"), F.col("steps").alias("_s"), F.col("longest").alias("_l"))
        hot = find_hot_keys(left, ["middle"])
        onward = lambda rest: salt_hot_keys(left, rest.withColumnRenamed("sub", "middle"), ["middle"], hot).select(
            "sub", "super", (F.col("_s") + F.col("steps")).alias("steps"), (F.col("_l") + F.col("longest")).alias("longest"))
        longer = pairs.select("sub", "super", "steps", "longest").unionByName(onward(pairs))
        leaps, left_over = _measured(onward(leaps).groupBy("sub", "super").agg(*best))
        pairs = cut_lineage(longer.groupBy("sub", "super").agg(*best), "closure")
    return pairs


def _measured(leaps: DataFrame) -> tuple[DataFrame, int]:
    table, seen = cut_and_count(leaps, "leaps")
    return table, seen["rows"]


def semantic_content(components: DataFrame, dag: DataFrame, keys: Sequence[str] = KEYS,
                     measures: DataFrame | None = None) -> DataFrame:
    """Number of ordered node pairs joined by a path, source and target distinct.

    A component reaches what is above it and each of its members the others, so
    members are counted, not enumerated.
    """
    keys = list(keys)
    sizes = components.select(*keys, "component_id", "size").distinct()
    measures = upward_measures(sizes.select("component_id", "size"), dag) if measures is None else measures
    reached = F.col("size") * (F.col("above") + F.col("size") - 1)
    return sizes.join(measures, "component_id").groupBy(*keys).agg(F.sum(reached).alias("semantic_content"))


def hierarchy_metrics(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts, depths and content of each graph, from one set of components and measures."""
    keys = list(keys)
    edges = cut_lineage(edges.select(*keys, "sub", "super").distinct(), "edges")
    members, dag = numbered_components(edges, keys)
    parts = cut_lineage(members.groupBy(*keys, "component_id").agg(F.count(F.lit(1)).alias("size")), "parts")
    measured = parts.join(upward_measures(parts, dag), "component_id")
    parents = dag.select(F.col("super").alias("component_id")).distinct().withColumn("_parent", F.lit(True))
    whole = measured.join(parents, "component_id", "left").groupBy(*keys).agg(
        F.sum("size").alias("node_count"), F.max(F.when(F.col("_parent").isNull(), F.col("longest"))).alias("max_depth"),
        (F.sum(F.col("shortest") * F.col("size")).cast("double") / F.sum("size")).alias("avg_depth"),
        F.sum(F.col("size") * (F.col("above") + F.col("size") - 1)).alias("semantic_content"))
    links = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("direct_edge_count"))
    return links.join(whole, keys).select(*keys, *MEASURES)


MEASURES = ("node_count", "direct_edge_count", "max_depth", "avg_depth", "semantic_content")


def semantic_summary(records: DataFrame) -> DataFrame:
    """Both hierarchies side by side per (method, domain) and per method."""
    by_domain = cut_lineage(collect_edges(records), "records")
    metrics = hierarchy_metrics(by_domain.unionByName(merge_edges_by_method(by_domain)))
    sides = {"class": "subClassOf", "property": "subPropertyOf"}
    zero = lambda c: F.coalesce(c, F.lit(0))
    return metrics.groupBy("method", "domain").agg(*[
        zero(F.max(F.when(F.col("axiom_type") == kind, F.col(m)))).alias(f"{side}_{m}")
        for side, kind in sides.items() for m in MEASURES])
