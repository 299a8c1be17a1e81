"""Hierarchy, scoring and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import scoring as sc
from ..session import cut_lineage, scratch_path
from ..streaming import progress as sp
from ..streaming import status as st
from .registry import query

K = "method, domain, axiom_type"
TOK = "trim({0}, ' ;')"
EDGES = f"(select distinct {K}, {TOK.format('sub')} as sub, {TOK.format('super')} as super from v_hierarchy where {TOK.format('sub')} <> '' and {TOK.format('super')} <> '' and {TOK.format('sub')} <> {TOK.format('super')})"
MERGED = f"(select distinct method, 'all' as domain, axiom_type, sub, super from {EDGES})"
BOTH = f"(select * from {EDGES} union all select * from {MERGED})"


def edges(t, merged: bool = True):
    by_domain = cut_lineage(gr.collect_edges(t.v_hierarchy), "edges")
    return by_domain.unionByName(gr.merge_edges_by_method(by_domain)) if merged else by_domain


@query("G01_collect_edges", f"select * from {EDGES}")
def _(t):
    return gr.collect_edges(t.v_hierarchy)


@query("G02_merge_edges_by_method", f"select * from {MERGED}")
def _(t):
    return gr.merge_edges_by_method(gr.collect_edges(t.v_hierarchy))


D_COUNTS = f"(select {K}, node_count, direct_edge_count from (select {K}, count(distinct node) as node_count from (select {K}, sub as node from {BOTH} union all select {K}, super from {BOTH}) group by {K}) join (select {K}, count(*) as direct_edge_count from {BOTH} group by {K}) using ({K}))"


@query("G03_node_edge_counts", f"select * from {D_COUNTS}")
def _(t):
    return gr.node_edge_counts(edges(t))


# Plain reachability over the raw graph; components are mutual reachability.
JOIN_K = "{0}.method = {1}.method and {0}.domain = {1}.domain and {0}.axiom_type = {1}.axiom_type"
REACH = f"""recursive e as materialized (select * from {BOTH}),
r as (select {K}, sub, super from e union select r.method, r.domain, r.axiom_type, r.sub, e.super from r join e on {JOIN_K.format('r', 'e')} and r.super = e.sub),
n as (select {K}, sub as node from e union select {K}, super from e),
c as (select n.method, n.domain, n.axiom_type, n.node, least(n.node, min(b.super)) as component from n left join
 (select a.method, a.domain, a.axiom_type, a.sub, a.super from r a join r z on {JOIN_K.format('a', 'z')} and a.sub = z.super and a.super = z.sub) b
 on {JOIN_K.format('n', 'b')} and b.sub = n.node group by 1, 2, 3, 4),
s as (select {K}, component, count(*) as size from c group by 1, 2, 3, 4),
dag as (select distinct e.method, e.domain, e.axiom_type, a.component as sub, b.component as super from e join c a on {JOIN_K.format('e', 'a')} and a.node = e.sub join c b on {JOIN_K.format('e', 'b')} and b.node = e.super where a.component <> b.component),
top as (select {K}, component from s where not exists (select 1 from dag where {JOIN_K.format('dag', 's')} and dag.sub = s.component)),
walk as (select {K}, component, 0 as depth from top union select w.method, w.domain, w.axiom_type, dag.sub, w.depth + 1 from walk w join dag on {JOIN_K.format('w', 'dag')} and dag.super = w.component),
dep as (select {K}, component, min(depth) as shortest, max(depth) as longest from walk group by 1, 2, 3, 4)"""


def parts(t):
    """Named components with their sizes and the arcs between them, as stored tables."""
    members, dag = gr.numbered_components(cut_lineage(edges(t), "edges"))
    return gr.named_parts(members), dag


@query("G04_strongly_connected", f"with {REACH} select c.method, c.domain, c.axiom_type, c.node, c.component, s.size from c join s on {JOIN_K.format('c', 's')} and s.component = c.component")
def _(t):
    return gr.strongly_connected(cut_lineage(edges(t), "edges")).drop("component_id")


@query("G05_shortest_depth", f"with {REACH} select s.method, s.domain, s.axiom_type, s.component, s.size, cast(dep.shortest as int) as shortest from s join dep on {JOIN_K.format('s', 'dep')} and dep.component = s.component")
def _(t):
    components, dag = parts(t)
    return gr.component_depths(components, dag).drop("longest", "component_id")


D_DEPTH = f"""(select s.method, s.domain, s.axiom_type, max(case when p.super is null then longest end) as max_depth, cast(sum(shortest * size) as double) / sum(size) as avg_depth
 from s join dep on {JOIN_K.format('s', 'dep')} and dep.component = s.component left join (select distinct {K}, super from dag) p on {JOIN_K.format('p', 's')} and p.super = s.component group by 1, 2, 3)"""


@query("G06_depth_metrics", f"with {REACH} select method, domain, axiom_type, cast(max_depth as int) as max_depth, avg_depth from {D_DEPTH}")
def _(t):
    components, dag = parts(t)
    return gr.depth_metrics(gr.component_depths(components, dag), dag)


@query("G07_semantic_content", f"with {REACH} select {K}, count_if(sub <> super) as semantic_content from r group by 1, 2, 3")
def _(t):
    components, dag = parts(t)
    return gr.semantic_content(components, dag)


D_SIDE = lambda side, kind: ", ".join(
    f"coalesce(max(case when axiom_type = '{kind}' then {m} end), 0) as {side}_{m}" for m in gr.MEASURES)


@query("G08_semantic_summary", f"""with {REACH},
x as (select method, domain, axiom_type, count_if(sub <> super) as semantic_content from r group by 1, 2, 3),
m as (select * from {D_COUNTS} join {D_DEPTH} using ({K}) join x using ({K}))
select method, domain, {D_SIDE('class', 'subClassOf')}, {D_SIDE('property', 'subPropertyOf')} from m group by 1, 2""")
def _(t):
    return gr.semantic_summary(t.v_hierarchy)


# ---- scoring hook ----------------------------------------------------------
def make_stub():
    """A deterministic stand-in for a model client."""

    def answer(prompt: str) -> str:
        if "HOUSEHOLD" in prompt:
            raise RuntimeError("rate limit")
        if "FURNITURE" in prompt and not prompt.startswith("again"):
            return "unclear"
        return "verdict: yes" if len(prompt) % 2 == 0 else "verdict: no"

    return answer


def read_stub(text: str):
    return 1 if text.endswith("yes") else 0 if text.endswith("no") else None


@query("U01_score_batch", """
with p as (select c_custkey as id, c_mktsegment as seg, length('judge ' || c_name || ' ' || c_mktsegment || c_custkey) as n1, length('again ' || c_mktsegment || c_custkey) as n2 from customer)
select id, case when seg = 'HOUSEHOLD' then '' when seg = 'FURNITURE' then case when n2 % 2 = 0 then 'verdict: yes' else 'verdict: no' end else case when n1 % 2 = 0 then 'verdict: yes' else 'verdict: no' end end as output,
 case when seg = 'HOUSEHOLD' then null when seg = 'FURNITURE' then case when n2 % 2 = 0 then 1 else 0 end else case when n1 % 2 = 0 then 1 else 0 end end as label,
 case when seg = 'HOUSEHOLD' then 'attempt 2: rate limit | fallback failed: attempt 2: rate limit' else '' end as error from p""")
def _(t):
    prompts = t.customer.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("judge "), "c_name", F.lit(" "), "c_mktsegment", "c_custkey").alias("prompt"),
        F.concat(F.lit("again "), "c_mktsegment", "c_custkey").alias("second"))
    scored = sc.score_batch(prompts, make_stub, read_stub, fallback="second", attempts=2)
    return scored.select("id", "output", "label", "error")


# ---- streaming -------------------------------------------------------------
def result_stream(t, columns, files: int = 8):
    """The results as a folder of files that a stream picks up in batches."""
    path = scratch_path(t.spark, "arrivals")
    rows = t.v_results.select(*columns)
    rows.repartition(files).write.parquet(path)
    return sp.read_results(t.spark, path, rows.schema, 2)


@query("X01_running_task_counters", """
select task_id, count_if(run_status = 'success') as success_count, count_if(run_status <> 'success') as fail_count,
 case when count_if(run_status <> 'success') = 0 then 'success' else 'completed' end as task_status from v_results group by task_id""")
def _(t):
    stream = result_stream(t, ["task_id", "run_status"])
    return sp.run_task_counters(stream, scratch_path(t.spark, "counters"), scratch_path(t.spark, "counters-state"))


@query("X01_task_status", """
with e as (select task_id, case when id % 97 = 0 then 'stopping' when id % 101 = 0 then 'load_failed' else run_status end as s from v_results),
 c as (select task_id, count_if(s = 'success') as ok, count_if(s = 'failed') as bad, count_if(s = 'stopping') as stops, count_if(s = 'load_failed') as breaks from e group by task_id)
select c.task_id, ok as success_count, case when breaks > 0 then t.total_count * 3 else bad end as fail_count, t.total_count * 3 as total_count,
 case when breaks > 0 then 'failed' when stops > 0 then 'stopped' when ok + bad < t.total_count * 3 then 'running' when bad = 0 then 'success' else 'completed' end as task_status
from c join v_tasks t on t.id = c.task_id""")
def _(t):
    """Results and messages arriving in four batches, against the totals of the tasks."""
    said = F.when(F.col("id") % 97 == 0, "stopping").when(F.col("id") % 101 == 0, "load_failed").otherwise(F.col("run_status"))
    stream = result_stream(t, ["task_id", said.alias("run_status")])
    totals = t.v_tasks.select(F.col("id").alias("task_id"), (F.col("total_count") * 3).alias("total_count"))
    return st.run_task_status(stream, totals, scratch_path(t.spark, "status"), scratch_path(t.spark, "status-state"))


@query("X02_live_result_upsert", "select task_id, axiom_type, id, predict_label from v_results qualify row_number() over (partition by task_id, axiom_type order by id desc) = 1")
def _(t):
    stream = result_stream(t, ["task_id", "axiom_type", "id", "predict_label"])
    return sp.run_live_upsert(stream, scratch_path(t.spark, "live"), scratch_path(t.spark, "live-state"), ["task_id", "axiom_type"], "id")


@query("X02_live_result_snapshots", "select task_id, axiom_type, id, predict_label from v_results qualify row_number() over (partition by task_id, axiom_type order by id desc) = 1")
def _(t):
    """The same stream, compacted into a snapshot after every second batch."""
    stream = result_stream(t, ["task_id", "axiom_type", "id", "predict_label"])
    return sp.run_live_upsert(stream, scratch_path(t.spark, "live"), scratch_path(t.spark, "live-state"), ["task_id", "axiom_type"], "id", compact_every=2)
