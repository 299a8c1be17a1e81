"""Text, identifier, parsing, prompt and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import axioms as ax
from ..functions import judgement as jd
from ..functions import prompts as pr
from ..functions import text as tx
from ..operators import validation as va
from .registry import query
from .views import WS, d_collapse, d_strip

# DuckDB spellings of shared scalars.
SEG = "regexp_replace({0}, '/+$', '')"


def d_last(x: str, sep: str) -> str:
    return f"list_extract(string_split({x}, '{sep}'), -1)"


def d_short_name(x: str) -> str:
    s = d_strip(x)
    return (f"case when contains({s}, ':') then {d_last(s, ':')} "
            f"when contains({s}, '/') then {d_last(SEG.format(s), '/')} else {s} end")


def d_short_uri(x: str) -> str:
    return f"case when contains({x}, '#') then {d_last(x, '#')} else {d_last(SEG.format(x), '/')} end"


def d_words(x: str) -> str:
    step = f"regexp_replace({x}, '[_\\\\-]+', ' ', 'g')"
    step = f"regexp_replace({step}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    step = f"regexp_replace({step}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower({step}), '{WS}+'), lambda t: t <> '')"


def d_contains_term(text: str, term: str, leading: str = ", 1, 3") -> str:
    hay, words = f"lower({d_collapse(text)})", d_words(term)
    return (f"({hay} <> '' and len({words}) > 0 and (contains({hay}, array_to_string({words}, ' ')) or "
            f"len(list_filter({f'list_slice({words}{leading})' if leading else words}, lambda w: not contains({hay}, w))) = 0))")


def d_clip(x: str, n: int) -> str:
    c = d_collapse(x)
    return f"case when length({c}) > {n} then regexp_replace(substr({c}, 1, {n}), '{WS}+$', '') || '...' else {c} end"


@query("T01_clip_text", f"select doc_id, {d_clip('text', 240)} as clipped from documents")
def _(t):
    return t.documents.select("doc_id", tx.clip_text("text", 240).alias("clipped"))


@query("T02_shorten", f"select doc_id, case when length(t) > 220 then substr(t, 1, 217) || '...' else t end as short from (select doc_id, {d_collapse('text')} as t from documents)")
def _(t):
    return t.documents.select("doc_id", tx.shorten("text").alias("short"))


@query("T03_preview_text", "select page_id, case when length(html) > 120 then substr(html, 1, 120) || '...' else html end as preview from pages")
def _(t):
    return t.pages.select("page_id", tx.preview_text("html", 120).alias("preview"))


@query("T04_short_uri", f"select id, {d_short_uri('subject')} as s, {d_short_uri('object')} as o from v_axioms")
def _(t):
    return t.v_axioms.select("id", tx.short_uri("subject").alias("s"), tx.short_uri("object").alias("o"))


@query("T05_short_name", f"select id, {d_short_name('subject')} as s, {d_short_name('object')} as o from v_axioms")
def _(t):
    return t.v_axioms.select("id", tx.short_name("subject").alias("s"), tx.short_name("object").alias("o"))


@query("T06_norm_predicate", "select lower(trim(trim(lower(trim(predicate)), '\"'), '''')) as predicate, count(*) as n from v_triples group by 1")
def _(t):
    return t.v_triples.groupBy(tx.norm_predicate("predicate").alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


@query("T07_normalize_schema_uri", f"""
select id, case when s = '' then '' when starts_with(s, 'https://schema.org/') then replace(s, 'https://schema.org/', 'http://schema.org/')
 when starts_with(s, 'http://schema.org/') then s when starts_with(s, 'schema:') then 'http://schema.org/' || {d_last('s', 'schema:')}
 when starts_with(s, 'http://') or starts_with(s, 'https://') then s else 'http://schema.org/' || s end as uri
from (select id, {d_strip('subject')} as s from v_axioms)""")
def _(t):
    return t.v_axioms.select("id", tx.normalize_schema_uri("subject").alias("uri"))


@query("T08_infer_kind", f"""
select case when starts_with(s, 'concept:') then 'Class' when starts_with(s, 'relation:') then 'Property' else 'Unknown' end as kind,
 case when contains(s, 'schema.org') then 'Property' else 'Class' end as kind_by_namespace,
 case when id % 3 = 0 and id % 2 = 0 then 'Property' when id % 3 = 0 then 'Property' when id % 2 = 0 then 'Class' else 'Unknown' end as kind_by_types,
 count(*) as n from (select id, {d_strip('subject')} as s from v_axioms) group by 1, 2, 3""")
def _(t):
    types = F.filter(F.array(
        F.when(F.col("id") % 3 == 0, F.lit(tx.PROPERTY_TYPES[1])), F.when(F.col("id") % 2 == 0, F.lit(tx.CLASS_TYPES[0]))),
        lambda x: x.isNotNull())
    return t.v_axioms.groupBy(
        tx.infer_kind("subject").alias("kind"), tx.infer_kind_by_namespace("subject").alias("kind_by_namespace"),
        tx.classify_types(types).alias("kind_by_types")).agg(F.count(F.lit(1)).alias("n"))


@query("T09_render_axiom", f"""
select id, case axiom_type when 'subClassOf' then s || ' ⊑ ' || o when 'subPropertyOf' then s || ' ⊑p ' || o
 when 'domain' then 'domain(' || s || ') = ' || o when 'range' then 'range(' || s || ') = ' || o
 else s || ' ' || predicate || ' ' || o end as rendered
from (select *, {d_short_name('subject')} as s, {d_short_name('object')} as o from v_axioms)""")
def _(t):
    return t.v_axioms.select("id", ax.render_axiom("axiom_type", "subject", "predicate", "object").alias("rendered"))


D_CALL = "'^" + "{0}" + r"\((.*?)\)\s*=\s*(.*)'"


@query("T10_parse_axiom", rf"""
select id, coalesce(ok, false) as parsed, case when ok then trim(l) end as left_end, case when ok then trim(r) end as right_end from (
 select id,
  case axiom_type when 'subClassOf' then len(string_split(axiom_text, '⊑')) = 2 when 'subPropertyOf' then len(string_split(axiom_text, '⊑p')) = 2
   when 'domain' then regexp_matches(axiom_text, {D_CALL.format('domain')}) when 'range' then regexp_matches(axiom_text, {D_CALL.format('range')}) else false end as ok,
  case axiom_type when 'subClassOf' then string_split(axiom_text, '⊑')[1] when 'subPropertyOf' then string_split(axiom_text, '⊑p')[1]
   when 'domain' then regexp_extract(axiom_text, {D_CALL.format('domain')}, 1) else regexp_extract(axiom_text, {D_CALL.format('range')}, 1) end as l,
  case axiom_type when 'subClassOf' then string_split(axiom_text, '⊑')[2] when 'subPropertyOf' then string_split(axiom_text, '⊑p')[2]
   when 'domain' then regexp_extract(axiom_text, {D_CALL.format('domain')}, 2) else regexp_extract(axiom_text, {D_CALL.format('range')}, 2) end as r
 from v_axioms)""")
def _(t):
    p = ax.parse_axiom("axiom_text", "axiom_type")
    return t.v_axioms.select("id", p.isNotNull().alias("parsed"), p["left"].alias("left_end"), p["right"].alias("right_end"))


@query("T11_parse_axiom_loose", rf"""
select id, case when contains(x, '⊑') then trim(split_part(x, '⊑', 1)) when c then trim(regexp_extract(x, '(?i)(?:domain|range)\(([^)]+)\)\s*=\s*(.+)', 1))
  when len(w) >= 3 then w[1] else trim(x) end as left_end,
 case when contains(x, '⊑') then trim(substr(x, position('⊑' in x) + 1)) when c then trim(regexp_extract(x, '(?i)(?:domain|range)\(([^)]+)\)\s*=\s*(.+)', 2))
  when len(w) >= 3 then w[-1] else '' end as right_end
from (select id, axiom_text as x, regexp_matches(axiom_text, '(?i)(?:domain|range)\(([^)]+)\)\s*=\s*(.+)') as c,
 string_split_regex(trim(axiom_text), '\s+') as w from v_axioms)""")
def _(t):
    p = ax.parse_axiom_loose("axiom_text")
    return t.v_axioms.select("id", p["left"].alias("left_end"), p["right"].alias("right_end"))


TOKEN = "trim({0}, chr(96) || '''\" ' || chr(9) || chr(10) || chr(13) || ',.;')"


@query("T12_parse_functional", rf"""
with x as (select id, axiom_type as kind, {TOKEN.format('axiom_text')} as t from v_axioms),
y as (select id, kind, {TOKEN.format("regexp_extract(t, '(?i)' || kind || '\\s*\\(\\s*(.+?)\\s+(.+?)\\s*\\)', 1)")} as a1,
 {TOKEN.format("regexp_extract(t, '(?i)' || kind || '\\s*\\(\\s*(.+?)\\s+(.+?)\\s*\\)', 2)")} as b1,
 {TOKEN.format("regexp_extract(t, '(?i)([^\\s()]+)\\s+' || kind || '\\s+([^\\s()]+)', 1)")} as a2,
 {TOKEN.format("regexp_extract(t, '(?i)([^\\s()]+)\\s+' || kind || '\\s+([^\\s()]+)', 2)")} as b2 from x)
select id, case when kind not in ('subClassOf', 'subPropertyOf') then null when a1 <> '' and b1 <> '' and a1 <> b1 then a1 when a2 <> '' and b2 <> '' and a2 <> b2 then a2 end as left_end,
 case when kind not in ('subClassOf', 'subPropertyOf') then null when a1 <> '' and b1 <> '' and a1 <> b1 then b1 when a2 <> '' and b2 <> '' and a2 <> b2 then b2 end as right_end from y""")
def _(t):
    p = ax.parse_functional("axiom_text", "axiom_type")
    return t.v_axioms.select("id", p["left"].alias("left_end"), p["right"].alias("right_end"))


@query("T13_strip_token", f"select doc_id, pos, {TOKEN.format(d_strip('line'))} as token from v_lines")
def _(t):
    return t.v_lines.select("doc_id", "pos", tx.strip_token("line").alias("token"))


@query("T14_split_identifier", f"select id, array_to_string({d_words('subject')}, '|') as words from v_axioms")
def _(t):
    return t.v_axioms.select("id", F.array_join(tx.split_identifier("subject"), "|").alias("words"))


@query("T15_contains_term", f"select doc_id, axiom_type, pos, {d_contains_term('context', 'item1')} as mentioned from (select a.*, c.context from v_chunk_axioms a join v_doc_triples c on a.doc_id = c.doc_id and a.pos = c.pos)")
def _(t):
    rows = t.v_chunk_axioms.join(t.v_doc_triples.select("doc_id", "pos", "context"), ["doc_id", "pos"])
    return rows.select("doc_id", "axiom_type", "pos", tx.contains_term("context", "item1").alias("mentioned"))


@query("T15_contains_all_words", f"select doc_id, axiom_type, pos, {d_contains_term('context', 'item1', '')} as mentioned from (select a.*, c.context from v_chunk_axioms a join v_doc_triples c on a.doc_id = c.doc_id and a.pos = c.pos)")
def _(t):
    rows = t.v_chunk_axioms.join(t.v_doc_triples.select("doc_id", "pos", "context"), ["doc_id", "pos"])
    return rows.select("doc_id", "axiom_type", "pos", tx.contains_term("context", "item1", None).alias("mentioned"))


D_ZH = rf"regexp_extract(x, '判断结果{WS}*[:：]{WS}*\[?{WS}*(正确|错误)', 1)"
D_EN = rf"lower(regexp_extract(x, '(?i)Judgment Result{WS}*[:：]{WS}*\[?{WS}*(Correct|Incorrect)', 1))"


@query("T18_parse_judgement", f"""
select record_id, line_no, raw, case {D_ZH} when '正确' then 1 when '错误' then 0 else
 case when contains(x, '判断结果') and contains(x, '正确') and not contains(x, '错误') then 1
      when contains(x, '判断结果') and contains(x, '错误') and not contains(x, '正确') then 0 end end as parsed
from (select *, raw as x from v_raw)""")
def _(t):
    return t.v_raw.select("record_id", "line_no", "raw", jd.parse_judgement("raw").alias("parsed"))


@query("T19_parse_judgement_bilingual", f"""
select record_id, line_no, case label when 1 then '正确' when 0 then '错误' end as judgment, label, explanation from (
 select record_id, line_no, case {D_ZH} when '正确' then 1 when '错误' then 0 else case {D_EN} when 'correct' then 1 when 'incorrect' then 0 end end as label,
  case when regexp_matches(x, '(?s)解释{WS}*[:：]{WS}*(.+)') then {d_strip(f"regexp_extract(x, '(?s)解释{WS}*[:：]{WS}*(.+)', 1)")}
       when regexp_matches(x, '(?is)Explanation{WS}*[:：]{WS}*(.+)') then {d_strip(f"regexp_extract(x, '(?is)Explanation{WS}*[:：]{WS}*(.+)', 1)")} end as explanation
 from (select record_id, line_no, raw as x from v_raw))""")
def _(t):
    p = jd.parse_judgement_bilingual("raw")
    return t.v_raw.select("record_id", "line_no", p["judgment"].alias("judgment"), p["label"].alias("label"), p["explanation"].alias("explanation"))


# Answers around the events' JSON: plain, fenced, wrapped in words, cut, a list.
ANSWER = """case event_id % 5 when 0 then props when 1 then '```json' || chr(10) || props || chr(10) || '```'
 when 2 then 'Here it is: ' || props || ' done.' when 3 then substr(props, 2) else '[' || props || ']' end"""


@query("T20_parse_fenced_json", f"""
with a as (select event_id, trim({ANSWER}) as r from events),
c as (select event_id, trim(case when starts_with(r, '```') then regexp_replace(regexp_replace(r, '^```[a-zA-Z0-9_-]*\\n?', ''), '\\n?```$', '') else r end) as t from a),
s as (select event_id, case when json_valid(t) then t when contains(t, chr(123)) and contains(t, chr(125))
  and length(t) - position(chr(125) in reverse(t)) + 1 > position(chr(123) in t)
  then substr(t, position(chr(123) in t), length(t) - position(chr(125) in reverse(t)) + 1 - position(chr(123) in t) + 1) end as j from c)
select event_id, case when json_valid(j) and json_type(j) = 'OBJECT' then cast(json_extract(j, '$.k') as int) end as k from s""")
def _(t):
    doc = pr.parse_fenced_json("answer", "k int")
    return t.events.select("event_id", F.expr(ANSWER).alias("answer")).select("event_id", doc["k"].alias("k"))


@query("T21_safe_term", "select id, case when coalesce(subject_term, '') = '' then 'Unnamed' else regexp_replace(trim(subject_term), '[^a-zA-Z0-9_]', '_', 'g') end as s, case when coalesce(object_term, '') = '' then 'Unnamed' else regexp_replace(trim(object_term), '[^a-zA-Z0-9_]', '_', 'g') end as o from v_service_axioms")
def _(t):
    return t.v_service_axioms.select("id", tx.safe_term("subject_term").alias("s"), tx.safe_term("object_term").alias("o"))


@query("T22_slug_title_id", rf"""
select doc_id, pos, lower(trim(regexp_replace(title, '[^a-zA-Z0-9]+', '_', 'g'), '_')) as slug,
 regexp_replace(lower({d_collapse(f"regexp_replace(title, '^[0-9.]+{WS}*', '')")}), '[^a-z0-9]', '', 'g') as title_id from v_headings""")
def _(t):
    return t.v_headings.select("doc_id", "pos", tx.slug("title").alias("slug"), tx.title_id("title").alias("title_id"))


@query("T23_title_candidates", f"""
select id, b || case when c <> b then '|' || c else '' end || case when s <> b and s <> c and s <> '' then '|' || s else '' end as candidates from (
 select id, b, upper(substr(b, 1, 1)) || substr(b, 2) as c,
  trim(replace(substr(n, 1, 1) || regexp_replace(substr(n, 2), '([A-Z])', ' \\1', 'g'), '_', ' ')) as s
 from (select id, n, trim(replace(n, '_', ' ')) as b from (select id, {d_strip('subject')} as n from v_axioms)))""")
def _(t):
    return t.v_axioms.select("id", F.array_join(tx.title_candidates("subject"), "|").alias("candidates"))


@query("T24_page_range", "select doc_id, chunk_id, case when page_start <> page_end then page_start || '-' || page_end else cast(page_start as varchar) end as pages from v_chunks")
def _(t):
    return t.v_chunks.select("doc_id", "chunk_id", tx.page_range("page_start", "page_end").alias("pages"))


@query("T25_context_card", f"""
select id, '- 名称：' || coalesce(nullif({d_strip('label')}, ''), 'Unknown') || chr(10) || '- 类型：' || coalesce(nullif({d_strip('id')}, ''), 'Unknown') || chr(10)
 || '- 简介：' || coalesce(nullif({d_clip('comment', 240)}, ''), nullif({d_clip('label', 240)}, ''), 'No additional description is available.')
 || case when {d_clip('rangeIncludes', 180)} <> '' then chr(10) || '- 补充信息：' || {d_clip('rangeIncludes', 180)} else '' end as card from v_properties""")
def _(t):
    return t.v_properties.select("id", pr.context_card("label", "id", ["comment", "label"], "rangeIncludes").alias("card"))


PROMPT_A = "Judge {axiom_text} / {{SUBJECT}} / {OBJECT} given {context_info}"
PROMPT_B = " Is it true? "
FIELDS = {k: k for k in ("axiom_text", "context_info", "subject", "predicate", "object")}


@query("T26_render_prompt", """
select id, case when id % 2 = 0 then 'Judge ' || axiom_text || ' / {' || subject || '} / ' || object || ' given ' || coalesce(context_info, '')
 else 'Is it true?' || chr(10) || chr(10) || '待判断公理：' || chr(10) || chr(10) || axiom_text || chr(10) || chr(10) || '上下文信息：' || chr(10) || chr(10) || coalesce(context_info, '') end as prompt,
 case when id % 2 = 0 then 'A: ' || axiom_text || ' C: ' || coalesce(context_info, '无') else 'A: ' || axiom_text || case when coalesce(context_info, '') <> '' then chr(10) || chr(10) || '上下文信息：' || chr(10) || context_info else '' end end as two_field
from v_axioms""")
def _(t):
    even = F.col("id") % 2 == 0
    template = F.when(even, F.lit(PROMPT_A)).otherwise(F.lit(PROMPT_B))
    simple = F.when(even, F.lit("A: {axiom_text} C: {context_info}")).otherwise(F.lit("A: {axiom_text}"))
    return t.v_axioms.withColumns({"template": template, "simple": simple}).select(
        "id", pr.render_prompt("template", FIELDS).alias("prompt"),
        pr.render_two_field_prompt("simple", "axiom_text", "context_info").alias("two_field"))


# The five cumulative switch settings of the ablation.
SWITCHES = ("count", "domain", "naming", "entity")
CONFIGS = {
    "baseline": (), "round1": ("count",), "round2": ("count", "domain"),
    "round3": ("count", "domain", "naming"), "round4": SWITCHES,
}


def ablation_grid(docs):
    """Every document with each switch setting: an explode, not a join."""
    grid = F.array(*[
        F.struct(F.lit(name).alias("config"), *[F.lit(s in on).alias(s) for s in SWITCHES])
        for name, on in CONFIGS.items()])
    return docs.withColumn("_c", F.explode(grid)).select(
        *docs.columns, "_c.config", *[F.col(f"_c.{s}").alias(f"use_{s}") for s in SWITCHES])


D_GRID = "(values ('baseline', false, false, false, false), ('round1', true, false, false, false), ('round2', true, true, false, false), ('round3', true, true, true, false), ('round4', true, true, true, true)) g(config, use_count, use_domain, use_naming, use_entity)"


@query("T27_assemble_prompt", f"""
select doc_id, config, 'Domain: ' || case when use_domain then 'hint for ' || lang else '' end || ' Count: ' || case when use_count then 'at most 20' else '' end
 || ' Entity: ' || case when use_entity then 'define' else '' end || ' Naming: {{' || case when use_naming then 'CamelCase' else '' end || '}}'
 || case when doc_id % 2 = 0 then ' T=' || {d_strip('text')} else chr(10) || chr(10) || '**INPUT TEXT:**' || chr(10) || {d_strip('text')} end as prompt
from documents, {D_GRID}""")
def _(t):
    head = "Domain: {DOMAIN_HINT} Count: {COUNT_CONSTRAINT} Entity: {ENTITY_DEFINITION} Naming: {{NAMING_RULES}}"
    template = F.when(F.col("doc_id") % 2 == 0, F.lit(head + " T={text}")).otherwise(F.lit(head))
    rows = ablation_grid(t.documents.select("doc_id", "lang", "text"))
    modules = {
        "COUNT_CONSTRAINT": (F.col("use_count"), F.lit("at most 20")),
        "DOMAIN_HINT": (F.col("use_domain"), F.concat(F.lit("hint for "), "lang")),
        "NAMING_RULES": (F.col("use_naming"), F.lit("CamelCase")),
        "ENTITY_DEFINITION": (F.col("use_entity"), F.lit("define")),
    }
    return rows.select("doc_id", "config", pr.assemble_prompt(template, modules, "text").alias("prompt"))


@query("T28_ablation_grid", f"select doc_id, config, use_count, use_domain, use_naming, use_entity from documents, {D_GRID}")
def _(t):
    return ablation_grid(t.documents.select("doc_id"))


# ---- validation and filters ------------------------------------------------
@query("V01_require_columns", "select id, axiom_type, subject from v_axioms")
def _(t):
    return va.require_columns(t.v_axioms, ["id", "axiom_type", "subject"]).select("id", "axiom_type", "subject")


@query("V02_drop_blank_rows", f"select doc_id, pos, line from v_lines where {d_strip('line')} <> ''")
def _(t):
    return va.drop_blank_rows(t.v_lines, ["line"])


D_ERROR = """coalesce({blank}, case when nullif(trim(label), '') is null then '第 ' || (id + 2) || ' 行字段 label 不能为空' end,
 case when trim(label) not in ('0', '1') then '第 ' || (id + 2) || ' 行字段 label 只能为 0 或 1' end)""".format(
    blank=", ".join(f"case when nullif(trim({c}), '') is null then '第 ' || (id + 2) || ' 行字段 {c} 不能为空' end" for c in va.REQUIRED))


@query("V03_validate_axioms", f"select id as pos, trim(axiom_type) as axiom_type, trim(subject) as subject, cast(trim(label) as int) as label, nullif(trim(negative_strategy), '') as negative_strategy from v_axioms where {D_ERROR} is null")
def _(t):
    valid, _rejects = va.validate_axioms(t.v_axioms.withColumnRenamed("id", "pos"), "pos")
    return valid.select("pos", "axiom_type", "subject", "label", "negative_strategy")


@query("V03_reject_report", f"""
with e as (select id + 2 as row_number, {D_ERROR} as error from v_axioms)
select row_number, error, greatest((select count(*) from e where error is not null) - 20, 0) as more from e where error is not null order by row_number limit 20""")
def _(t):
    _valid, rejects = va.validate_axioms(t.v_axioms.withColumnRenamed("id", "pos"), "pos")
    return va.reject_report(rejects)


@query("V04_nullable_trim", f"select id, nullif({d_strip('negative_strategy')}, '') as negative_strategy, nullif({d_strip('source')}, '') as source from v_axioms")
def _(t):
    return t.v_axioms.select("id", *[tx.nullable_trim(c).alias(c) for c in ("negative_strategy", "source")])


@query("V05_assign_sample_ids", "select o_orderkey, 'sample_' || lpad(cast(row_number() over (order by o_orderkey) as varchar), cast(greatest(4, length(cast(row_number() over (order by o_orderkey) as varchar))) as int), '0') as id from orders")
def _(t):
    return va.assign_sample_ids(t.orders.select("o_orderkey"), "o_orderkey")


D_LABEL = """case when try_cast({0} as double) = 1 then 1 when try_cast({0} as double) = 0 then 0 when try_cast({0} as double) is not null then null
 when lower(trim({0})) in ('correct', 'true', 'yes') then 1 when lower(trim({0})) in ('incorrect', 'false', 'no') then 0 end"""


@query("V06_normalize_binary_label", f"select label, pred, {D_LABEL.format('trim(label)')} as label01, {D_LABEL.format('trim(pred)')} as pred01, count(*) as n from v_label_text group by 1, 2, 3, 4")
def _(t):
    return t.v_label_text.groupBy(
        "label", "pred", jd.normalize_binary_label("label").alias("label01"), jd.normalize_binary_label("pred").alias("pred01")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("V07_filter_records", "select id, axiom_type, source from v_axioms where axiom_type = 'domain' and contains(source, 'HIGH')")
def _(t):
    return va.filter_records(t.v_axioms, axiom_type="domain", source="HIGH").select("id", "axiom_type", "source")


@query("V08_filter_results", "select id, task_id from v_results where axiom_type = 'range' and true_label = 1 and predict_label = 0 and run_status = 'success'")
def _(t):
    return va.filter_results(t.v_results, "range ", 1, 0, "success").select("id", "task_id")


@query("V09_search_tasks", "select id, task_name, task_status from v_tasks where task_name like '%BUILDING%' and task_status = 'success'")
def _(t):
    return va.search_tasks(t.v_tasks, " BUILDING ", "success").select("id", "task_name", "task_status")


D_FULL = " and ".join(f"{d_strip(c)} <> ''" for c in ("subject", "relation", "object"))


@query("V10_count_valid_triples", f"select doc_id, count(*) as triples, count_if({D_FULL} and {d_strip('chunk')} <> '' and {d_strip('context')} <> '') as valid_triples from v_doc_triples group by doc_id")
def _(t):
    return va.count_valid_triples(t.v_doc_triples, ["doc_id"], ["subject", "relation", "object", "chunk", "context"])


@query("V11_count_valid_axioms", f"""
with t as (select doc_id, {d_strip('subject')} as term from v_doc_triples union all select doc_id, {d_strip('object')} from v_doc_triples)
select d.doc_id, axioms, valid_axioms, coalesce(terms, 0) as terms from
 (select doc_id, count(*) as axioms, count_if({D_FULL} and {d_strip('context')} <> '') as valid_axioms from v_doc_triples group by doc_id) d
 left join (select doc_id, count(distinct term) as terms from t where term <> '' group by doc_id) x on d.doc_id = x.doc_id""")
def _(t):
    return va.count_valid_axioms(t.v_doc_triples.withColumn("evidence", F.col("context")), ["doc_id"])


CLASS_RE, PROP_RE = "'^[A-Z][A-Za-z0-9]*$'", "'^[a-z][A-Za-z0-9]*$'"


def d_naming(kind: str, a: str, b: str) -> str:
    c, p = (lambda x: f"regexp_matches({x}, {CLASS_RE})"), (lambda x: f"regexp_matches({x}, {PROP_RE})")
    return (f"case {kind} when 'Class' then {c(a)} when 'Property' then {p(a)} when 'subPropertyOf' then {p(a)} and {p(b)} "
            f"when 'domain' then {p(a)} and {c(b)} when 'range' then {p(a)} and {c(b)} else {c(a)} and {c(b)} end")


@query("V12_naming_ok", f"select axiom_type, {d_naming('axiom_type', 'item1', 'item2')} as ok, count(*) as n from v_doc_axioms group by 1, 2")
def _(t):
    return t.v_doc_axioms.groupBy("axiom_type", ax.naming_ok("axiom_type", "item1", "item2").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


ERROR_TEXT = "case event_id % 5 when 0 then 'Read TIMEOUT after ' || value when 1 then 'Rate limit: ' || user_id when 2 then 'Expecting value: line 1' when 3 then 'bad request ' || event_type else 'connection reset' end"


@query("V13_tag_retryable", f"select event_type, case when regexp_matches(lower(e), 'timeout|timed out|connection|network|temporarily unavailable|server error|rate limit|empty response|expecting value') then true else false end as retry, count(*) as n from (select event_type, {ERROR_TEXT} as e from events) group by 1, 2")
def _(t):
    rows = t.events.select("event_type", tx.tag_retryable(F.expr(ERROR_TEXT)).alias("retry"))
    return rows.groupBy("event_type", "retry").agg(F.count(F.lit(1)).alias("n"))


FILES = """select page_id || '.pdf' as file_name, page_id % 4 = 0 as success,
 case page_id % 4 when 1 then '没有找到书签结构' when 2 then '书签数量过多: 12 > 10' else case when page_id % 4 = 3 then 'broken file' end end as error from {0}"""


@query("V14_batch_outcome_stats", f"""
select count(*) as total, count_if(success) as ok, count_if(not success and contains(error, '没有找到书签结构')) as no_outline,
 count_if(not success and contains(error, '书签数量过多')) as too_many,
 count_if(not success and not contains(error, '书签数量过多') and not contains(error, '没有找到书签结构')) as failed from ({FILES.format('pages')})""")
def _(t):
    stats, _skipped = va.batch_outcome_stats(t.spark.sql(FILES.format("{pages}"), pages=t.pages))
    return stats


@query("V14_skip_reasons", f"""
select file_name, case when contains(error, '没有找到书签结构') then 'no_outline' when contains(error, '书签数量过多') then 'too_many' else 'failed' end as outcome,
 case when contains(error, '没有找到书签结构') then file_name || ': 无书签结构' else file_name || ': ' || error end as reason from ({FILES.format('pages')}) where not success""")
def _(t):
    _stats, skipped = va.batch_outcome_stats(t.spark.sql(FILES.format("{pages}"), pages=t.pages))
    return skipped


@query("V13_tag_retryable_concepts", f"select event_type, case when regexp_matches(lower(e), '{'|'.join(tx.CONCEPT_RETRY_MARKERS)}') then true else false end as retry, count(*) as n from (select event_type, {ERROR_TEXT} as e from events) group by 1, 2")
def _(t):
    rows = t.events.select("event_type", tx.tag_retryable(F.expr(ERROR_TEXT), tx.CONCEPT_RETRY_MARKERS).alias("retry"))
    return rows.groupBy("event_type", "retry").agg(F.count(F.lit(1)).alias("n"))
