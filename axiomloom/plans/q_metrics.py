"""Metric, service, window and paging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judgement as jd
from ..functions.text import norm_predicate
from ..operators import metrics as me
from ..operators import ontology as on
from ..operators import reports as rp
from ..operators import stability as st
from .registry import query
from .views import d_strip


def d_scores(total: str) -> str:
    """Scores from columns tp, fp, tn, fn, written as the operators define them."""
    p = "(case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0.0 end)"
    r = "(case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0.0 end)"
    return (f"case when {total} > 0 then cast(tp + tn as double) / {total} else 0.0 end as accuracy, {p} as precision, {r} as recall, "
            f"case when {p} + {r} > 0 then 2 * {p} * {r} / ({p} + {r}) else 0.0 end as f1")


CELLS = ("count_if({0} = 1 and {1} = 1) as tp, count_if({0} = 0 and {1} = 1) as fp, "
         "count_if({0} = 0 and {1} = 0) as tn, count_if({0} = 1 and {1} = 0) as fn")


def d_metrics(source: str, keys: str, label: str = "label", pred: str = "pred") -> str:
    head = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    return (f"select {head}samples, tp, fp, tn, fn, {d_scores('samples')} from (select {head}count(*) as samples, "
            f"{CELLS.format(label, pred)} from {source} where {label} is not null and {pred} is not null {group})")


@query("A01_stats_long", "select axiom_type, label, count(*) as count from v_judgements group by 1, 2")
def _(t):
    return me.stats_long(t.v_judgements)


@query("A02_stats_wide", "select coalesce(axiom_type, 'TOTAL') as axiom_type, count_if(label = 1) as positive_count, count_if(label = 0) as negative_count, count(*) as total from v_judgements group by rollup(axiom_type)")
def _(t):
    return me.stats_wide(t.v_judgements)


@query("A03_binary_metrics", d_metrics("v_judgements", "model"))
def _(t):
    return me.binary_metrics(t.v_judgements, ["model"])


@query("A03_quality_labels", d_metrics("v_quality_judgements", "model"))
def _(t):
    return me.binary_metrics(t.v_quality_judgements, ["model"])


PARSED = """(select axiom_type, label, case when regexp_matches(raw, '判断结果[ ]*[:：][ ]*\\[?正确') then 1
 when regexp_matches(raw, '判断结果[ ]*[:：][ ]*\\[?错误') then 0 when regexp_matches(raw, '(?i)judgment result[:：] *\\[?correct') then 1
 when regexp_matches(raw, '(?i)judgment result[:：] *\\[?incorrect') then 0 end as pred from v_raw)"""


@query("A04_metrics_by_type", d_metrics(PARSED, "axiom_type"))
def _(t):
    rows = t.v_raw.select("axiom_type", "label", jd.parse_judgement_bilingual("raw")["label"].alias("pred"))
    return me.binary_metrics(rows, ["axiom_type"]).orderBy("axiom_type")


@query("A05_accuracy_by_label", "select label, count(*) as samples, cast(count_if(label = pred) as double) / count(*) as accuracy, case when label = 1 then 'positive' else 'negative' end as label_name from v_judgements where pred is not null group by label")
def _(t):
    return me.accuracy_by_label(t.v_judgements)


@query("A06_parsed_vs_total", "select model, count(*) as total_samples, count(pred) as parsed_samples from v_judgements group by model")
def _(t):
    return me.parsed_vs_total(t.v_judgements, ["model"])


NORM = """(select {2}, case when try_cast({0} as double) = 1 or lower(trim({0})) in ('correct', 'true', 'yes') then 1
 when try_cast({0} as double) = 0 or lower(trim({0})) in ('incorrect', 'false', 'no') then 0 else -1 end as y,
 case when try_cast({1} as double) = 1 or lower(trim({1})) in ('correct', 'true', 'yes') then 1
 when try_cast({1} as double) = 0 or lower(trim({1})) in ('incorrect', 'false', 'no') then 0 else -1 end as p from {3} where {0} is not null and {1} is not null)"""


@query("A07_service_metrics", f"select model, axiom_type, total, {d_scores('total')} from (select model, axiom_type, count(*) as total, {CELLS.format('y', 'p')} from {NORM.format('label', 'pred', 'model, axiom_type', 'v_label_text')} group by 1, 2)")
def _(t):
    return me.service_metrics(t.v_label_text, ["model", "axiom_type"])


D_RATES = """select {0}, total_annotations, correct_count, hallucination_count, cast(correct_count as double) / total_annotations as explanation_accuracy,
 cast(hallucination_count as double) / total_annotations as hallucination_rate from (select {1}, count(*) as total_annotations,
 count_if(explanation_label = 'correct') as correct_count, count_if(explanation_label = 'hallucination') as hallucination_count from {2})"""


@query("A08_explanation_rates_all", D_RATES.format("model, is_overall", "model, cast(grouping(model) as tinyint) as is_overall", "(select 'm' || (task_id % 5) as model, explanation_label from v_annotations) group by rollup(model)"))
def _(t):
    return me.explanation_rates_all(t.v_annotations.withColumn("model", F.concat(F.lit("m"), (F.col("task_id") % 5).cast("string"))))


CORRECT = "run_status = 'success' and true_label = predict_label"
D_EXPL = f"""(select task_id, cases as correct_case_count, annotated as annotated_count, good as explanation_correct_count, bad as hallucination_count,
 cast(good as double) / cases as explanation_accuracy, cast(bad as double) / cases as hallucination_rate from (
 select r.task_id, count(*) as cases, count_if(coalesce(annotation_status, '') = 'completed') as annotated, count_if(coalesce(explanation_correct_label, 0) = 1) as good,
  count_if(coalesce(hallucination_label, 0) = 1) as bad from v_results r left join v_annotations a on a.result_id = r.id and a.task_id = r.task_id where {CORRECT} group by r.task_id))"""


@query("A09_explanation_rates_correct", f"select * from {D_EXPL}")
def _(t):
    return me.explanation_rates_correct(rp.annotations_outer(t.v_results, t.v_annotations))


@query("A10_hard_consistency", """
select task_id, count(*) as originals, cast(count_if(hard) as double) / count(*) as hard_consistency from (
 select task_id, original_id, bool_and(run_status = 'success' and pred is not null and pred = original_pred) as hard from v_variants group by 1, 2) group by task_id""")
def _(t):
    return st.consistency(t.v_variants, ["task_id"]).select("task_id", "originals", "hard_consistency")


@query("A11_soft_consistency", """
select task_id, count(*) as originals, round(avg(v), 9) as soft_consistency from (
 select task_id, original_id, var_pop(coalesce(pred, 0)) as v from v_variants group by 1, 2) group by task_id""")
def _(t):
    return st.consistency(t.v_variants, ["task_id"]).select("task_id", "originals", F.round("soft_consistency", 9).alias("soft_consistency"))


@query("A12_macro_average", f"select model, axiom_type, count(*) as datasets, round(avg(accuracy), 9) as macro_accuracy from ({d_metrics('v_judgements', 'dataset, model, axiom_type')}) group by 1, 2")
def _(t):
    m = me.binary_metrics(t.v_judgements, ["dataset", "model", "axiom_type"])
    return me.macro_average(m, ["model", "axiom_type"]).withColumn("macro_accuracy", F.round("macro_accuracy", 9))


D_SUMMARY = """select {0}, samples, case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0.0 end as positive_accuracy,
 case when tn + fp > 0 then cast(tn as double) / (tn + fp) else 0.0 end as negative_accuracy, accuracy as overall_accuracy, precision, recall, f1 from ({1})"""


@query("A13_dataset_model_summary", D_SUMMARY.format("dataset, model", d_metrics("v_judgements", "dataset, model")))
def _(t):
    return me.summary(t.v_judgements, ["dataset", "model"])


@query("A13_prompt_summary", D_SUMMARY.format("model, prompt", d_metrics("v_judgements", "model, prompt")))
def _(t):
    return me.summary(t.v_judgements, ["model", "prompt"])


@query("A24_dashboard_counts", "select (select count(*) from supplier) as models, (select count(*) from nation) as datasets, (select count(*) from customer) as tasks, (select count(*) from v_annotations) as annotations")
def _(t):
    return rp.dashboard_counts(models=t.v_model_dim, datasets=t.v_dataset_dim, tasks=t.v_tasks, annotations=t.v_annotations)


@query("A26_value_distribution", "select lower(trim(trim(predicate), '\"')) as value, count(*) as count from v_triples group by 1 order by 2 desc, 1 limit 5")
def _(t):
    return me.value_distribution(t.v_triples, norm_predicate("predicate"), 5)


@query("W08_leaderboard", f"select *, dense_rank() over (order by accuracy desc) as rank from ({d_metrics('v_judgements', 'model')})")
def _(t):
    return me.leaderboard(me.binary_metrics(t.v_judgements, ["model"]))


D_M = d_metrics("v_judgements", "model, axiom_type")


@query("W09_pivot_ordered", f"""
select axiom_type, case axiom_type when 'subClassOf' then 1 when 'subPropertyOf' then 2 when 'domain' then 3 else 4 end as row_order,
 max(case when model = 'model-2' then accuracy end) as "model-2", max(case when model = 'model-0' then accuracy end) as "model-0", max(case when model = 'model-1' then accuracy end) as "model-1"
from ({D_M}) group by axiom_type""")
def _(t):
    m = me.binary_metrics(t.v_judgements, ["model", "axiom_type"])
    return me.pivot_ordered(m, "axiom_type", "model", "accuracy",
                            ["subClassOf", "subPropertyOf", "domain", "range"], ["model-2", "model-0", "model-1"])


@query("W11_error_cases", "select record_id, line_no, model, axiom_type, label, pred from v_judgements where label <> pred")
def _(t):
    return me.error_cases(t.v_judgements).select("record_id", "line_no", "model", "axiom_type", "label", "pred")


# ---- service joins ---------------------------------------------------------
@query("J06_annotations_outer", f"""
select r.id, r.task_id, annotation_status, explanation_correct_label, hallucination_label from v_results r
 left join v_annotations a on a.result_id = r.id and a.task_id = r.task_id where {CORRECT} and (annotation_status is null or annotation_status = 'pending')""")
def _(t):
    return rp.annotations_outer(t.v_results, t.v_annotations, "pending").select(
        "id", "task_id", "annotation_status", "explanation_correct_label", "hallucination_label")


JOINED = "(select a.axiom_type, trim(a.label) as label, cast(r.predict_label as varchar) as pred from v_axioms a join v_results r on r.record_id = a.id)"


@query("J07_eval_metrics_join", f"select axiom_type, total, {d_scores('total')} from (select axiom_type, count(*) as total, {CELLS.format('y', 'p')} from {NORM.format('label', 'pred', 'axiom_type', JOINED)} group by 1)")
def _(t):
    results = t.v_results.select("record_id", F.col("predict_label").cast("string").alias("pred"))
    return rp.eval_metrics_join(t.v_axioms, results)


@query("J08_explanation_by_model", D_RATES.format("model, is_overall", "model, cast(grouping(model) as tinyint) as is_overall", """(select m.name as model, explanation_label from v_model_dim m
 join v_tasks t on t.model_id = m.id join v_results r on r.task_id = t.id join v_annotations a on a.result_id = r.id) group by rollup(model)"""))
def _(t):
    return rp.explanation_by_model(t.v_model_dim, t.v_tasks, t.v_results, t.v_annotations)


@query("J09_task_report", f"""
select t.id as task_id, task_name, d.name as dataset_name, m.name as model_name, p.name as prompt_name, total_count,
 coalesce(accuracy, 0) as accuracy, coalesce(f1, 0) as f1, coalesce(correct_case_count, 0) as correct_case_count,
 coalesce(hallucination_rate, 0) as hallucination_rate, s.hard_consistency, s.soft_consistency
from v_tasks t left join v_dataset_dim d on d.id = t.dataset_id left join v_model_dim m on m.id = t.model_id left join v_prompt_dim p on p.id = t.prompt_id
left join ({d_metrics('v_results', 'task_id', 'true_label', 'predict_label')}) c on c.task_id = t.id
left join {D_EXPL} e on e.task_id = t.id
left join (select * from v_stability_tasks qualify row_number() over (partition by base_task_id order by created_time desc, id desc) = 1) s on s.base_task_id = t.id""")
def _(t):
    report = rp.task_report(t.v_tasks, t.v_dataset_dim, t.v_model_dim, t.v_prompt_dim, t.v_results, t.v_annotations, t.v_stability_tasks)
    return report.select(
        "task_info.task_id", "task_info.task_name", "task_info.dataset_name", "task_info.model_name", "task_info.prompt_name",
        "classification.total_count", "classification.accuracy", "classification.f1", "explanation.correct_case_count",
        "explanation.hallucination_rate", "stability.hard_consistency", "stability.soft_consistency")


@query("J10_task_listing", """
select t.id, task_name, d.name as dataset_name, m.name as model_name, p.name as prompt_name from v_tasks t
left join v_dataset_dim d on d.id = t.dataset_id left join v_model_dim m on m.id = t.model_id left join v_prompt_dim p on p.id = t.prompt_id""")
def _(t):
    return rp.task_listing(t.v_tasks, t.v_dataset_dim, t.v_model_dim, t.v_prompt_dim).select(
        "id", "task_name", "dataset_name", "model_name", "prompt_name")


@query("J11_resume_pending", """
select d.doc_id from documents d where not exists (select 1 from conversations c where c.conv_id = d.doc_id and c.role = 'assistant' and length(c.text) > 200)""")
def _(t):
    outputs = t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", F.lit("Expecting value")).otherwise(F.lit("")).alias("error"),
        F.when(F.col("role") == "assistant", F.array("text")).alias("normalized_terms"),
        F.when(F.length("text") > 200, F.array("text")).alias("updated_triples"))
    return rp.resume_pending(t.documents.select("doc_id"), outputs, ["normalized_terms", "updated_triples"])


@query("J14_method_intersection", """
select distinct doc_id, axiom_type, item1, item2 from v_doc_axioms where method = 'three_layer'
intersect select doc_id, axiom_type, item1, item2 from v_chunk_axioms""")
def _(t):
    return rp.method_intersection(t.v_doc_axioms.filter("method = 'three_layer'"), t.v_chunk_axioms)


@query("W01_page", "select id, task_id, (select count(*) from v_results) as total from v_results order by id limit 20 offset 60")
def _(t):
    rows, total = rp.page(t.v_results.select("id", "task_id"), 4, 20)
    return rows.withColumn("total", F.lit(total).cast("bigint"))


@query("W01_deep_page", "select id, task_id, (select count(*) from v_results) as total from v_results order by id limit 500 offset 14000")
def _(t):
    rows, total = rp.page(t.v_results.select("id", "task_id"), 29, 500)
    return rows.withColumn("total", F.lit(total).cast("bigint"))


@query("W01_indexed_pages", """
select id, task_id, true_label, predict_label, cast((row_number() over (order by id) - 1) // 700 + 1 as bigint) as page, count(*) over () as total
from v_results qualify page in (1, 2, 21)""")
def _(t):
    """Three pages of one stored index, each reading its own ranges."""
    index = rp.build_page_index(t.v_results.select("id", "task_id", "true_label", "predict_label"), rows_per_range=10_000)
    pages = [index.page(n, 700).withColumn("page", F.lit(n).cast("bigint")) for n in (1, 2, 21)]
    whole = pages[0].unionByName(pages[1]).unionByName(pages[2])
    return whole.withColumn("total", F.lit(index.total).cast("bigint"))


@query("W02_preview", "select id, axiom_type, source from v_axioms order by id limit 20")
def _(t):
    return rp.preview(t.v_axioms.select("id", "axiom_type", "source"))


@query("W03_latest_per_key", "select * from v_stability_tasks qualify row_number() over (partition by base_task_id order by created_time desc, id desc) = 1")
def _(t):
    return rp.latest_per_key(t.v_stability_tasks, ["base_task_id"], ["created_time", "id"])


# Later events of a user replace the earlier annotation of the same user and kind.
CHANGES = "select user_id, event_type, event_id as seq, case when event_id % 4 = 0 then null else cast(event_id % 2 as int) end as explanation_correct_label, case when event_id % 3 = 0 then null else 0 end as hallucination_label from {0}"


@query("W04_upsert_latest", f"""
select user_id, event_type, seq, explanation_correct_label, hallucination_label,
 case when explanation_correct_label is not null and hallucination_label is not null then 'completed' else 'pending' end as annotation_status
from ({CHANGES.format('events')}) qualify row_number() over (partition by user_id, event_type order by seq desc) = 1""")
def _(t):
    rows = t.spark.sql(CHANGES.format("{events}"), events=t.events)
    base, changes = rows.filter("seq % 2 = 0"), rows.filter("seq % 2 <> 0")
    return rp.annotation_status(rp.upsert_latest(base, changes, ["user_id", "event_type"]))


@query("W05_preferred_layer_result", """
select task_id, chunk_record_id, id, layer_name from (select task_id % 50 as task_id, id % 300 as chunk_record_id, id, layer_name from v_results)
qualify row_number() over (partition by task_id, chunk_record_id order by (layer_name = 'concept_modeling') desc, case when layer_name = 'concept_modeling' then -id else id end) = 1""")
def _(t):
    rows = t.v_results.select((F.col("task_id") % 50).alias("task_id"), (F.col("id") % 300).alias("chunk_record_id"), "id", "layer_name")
    return rp.preferred_layer_result(rows, "concept_modeling")


@query("W06_distinct_first_seen", f"""
select doc_id, string_agg(w, '|' order by p) as terms from (
 select doc_id, w, min(p) as p from (select doc_id, unnest(range(len(a))) as p, {d_strip('unnest(a)')} as w from (select doc_id, string_split(text, ' ') as a from documents))
 where w <> '' group by doc_id, w) group by doc_id""")
def _(t):
    return t.documents.select("doc_id", F.array_join(on.distinct_first_seen(F.split("text", " ")), "|").alias("terms"))


@query("D14_expand_templates", """
with e as (select id, axiom_type, context_info, label, axiom_text,
  case axiom_type when 'subClassOf' then trim(split_part(axiom_text, '⊑', 1)) when 'subPropertyOf' then trim(split_part(axiom_text, '⊑p', 1)) else trim(regexp_extract(axiom_text, '\\((.*?)\\)', 1)) end as a,
  case axiom_type when 'subClassOf' then trim(split_part(axiom_text, '⊑', 2)) when 'subPropertyOf' then trim(split_part(axiom_text, '⊑p', 2)) else trim(regexp_extract(axiom_text, '= *(.*)', 1)) end as b
 from v_axioms where (axiom_type = 'subClassOf' and contains(axiom_text, '⊑')) or (axiom_type = 'subPropertyOf' and contains(axiom_text, '⊑p'))
  or (axiom_type = 'domain' and starts_with(axiom_text, 'domain(')) or (axiom_type = 'range' and starts_with(axiom_text, 'range('))),
x as (select *, unnest([axiom_text,
  case axiom_type when 'subClassOf' then a || ' is a subclass of ' || b || '.' when 'subPropertyOf' then a || ' is a subproperty of ' || b || '.' else 'The domain of ' || a || ' is ' || b || '.' end,
  case axiom_type when 'subClassOf' then 'Every instance of ' || a || ' is also an instance of ' || b || '.' when 'subPropertyOf' then 'If two resources are related by ' || a || ', then they are also related by ' || b || '.' else 'If a resource uses property ' || a || ' as subject, then it should belong to class ' || b || '.' end,
  case axiom_type when 'subClassOf' then 'If an entity belongs to class ' || a || ', then it also belongs to class ' || b || '.' when 'subPropertyOf' then 'For any x and y, if x ' || a || ' y holds, then x ' || b || ' y also holds.' else 'For any x and y, if x ' || a || ' y holds, then x is an instance of ' || b || '.' end,
  case axiom_type when 'subClassOf' then 'The class ' || a || ' is included in the class ' || b || '.' when 'subPropertyOf' then 'The property ' || a || ' is more specific than the property ' || b || '.' else 'Property ' || a || ' can only be applied to subjects of class ' || b || '.' end]) as text,
 unnest([1, 2, 3, 4, 5]) as template_id from e)
select id as original_id, template_id, id || '_t' || template_id as variant_id, axiom_type, text as axiom_text, context_info, label from x""")
def _(t):
    return st.expand_templates(t.v_axioms)


@query("D14_rejects", """
select id, axiom_type, axiom_text from (select id, case id % 3 when 0 then 'range' else axiom_type end as axiom_type, axiom_text from v_axioms)
where not coalesce((axiom_type = 'subClassOf' and contains(axiom_text, '⊑')) or (axiom_type = 'subPropertyOf' and contains(axiom_text, '⊑p'))
  or (axiom_type = 'domain' and starts_with(axiom_text, 'domain(')) or (axiom_type = 'range' and starts_with(axiom_text, 'range(')), false)""")
def _(t):
    mixed = t.v_axioms.withColumn("axiom_type", F.expr("case id % 3 when 0 then 'range' else axiom_type end"))
    return st.template_rejects(mixed).select("id", "axiom_type", "axiom_text")


@query("D15_perturb_results", """
select id as original_id, axiom_type, predict_label as original_predict_label, template_id, id || '_tpl' || template_id as variant_id, perturbed_text from (
 select *, unnest([1, 2, 3, 4, 5]) as template_id, unnest(case axiom_type
  when 'subClassOf' then [s || ' ⊑ ' || o, s || ' is a subclass of ' || o, 'Every instance of ' || s || ' is also an instance of ' || o, 'If x is a ' || s || ', then x is also an ' || o, 'The class ' || s || ' is included in the class ' || o]
  when 'subPropertyOf' then [s || ' ⊑ ' || o, s || ' is a subproperty of ' || o, 'If two entities are related by ' || s || ', they are also related by ' || o, 'If x ' || s || ' y, then x ' || o || ' y', 'The property ' || s || ' is included in the property ' || o]
  when 'domain' then ['domain(' || s || ') = ' || o, 'The domain of ' || s || ' is ' || o, 'If an entity uses the property ' || s || ' as subject, it should belong to ' || o, 'If x ' || s || ' y, then x is an instance of ' || o, 'The subject of property ' || s || ' must belong to class ' || o]
  else ['range(' || s || ') = ' || o, 'The range of ' || s || ' is ' || o, 'If an entity appears as the object of ' || s || ', it should belong to ' || o, 'If x ' || s || ' y, then y is an instance of ' || o, 'The object of property ' || s || ' must belong to class ' || o] end) as perturbed_text
 from (select *, subject as s, object as o from v_results where run_status = 'success' and axiom_type <> 'related'))""")
def _(t):
    return st.perturb_results(t.v_results)
