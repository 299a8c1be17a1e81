"""Dataset construction, context, sampling, reader and export queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import context as cx
from ..operators import datasets as ds
from ..operators import ontology as on
from ..operators import sampling as sa
from ..session import cut_lineage, scratch_path
from ..sources import exports, readers, writers
from .q_text import TOKEN, d_clip, d_short_name, d_short_uri
from .registry import query
from .views import d_strip

# ---- axioms from triples ---------------------------------------------------
NORM_P = "lower(trim(trim(predicate), '\"'))"


def d_axioms(kind: str, predicate: str) -> str:
    return (f"(select distinct '{kind}' as axiom_type, trim(subject) as subject, 'rdfs:{kind}' as predicate, trim(object) as object, 1 as label, "
            f"'NELL' as source, '' as negative_strategy from v_triples where {NORM_P} = '{predicate}' and trim(subject) <> '' and trim(object) <> '' and trim(subject) <> trim(object))")


GEN, DOM, RAN = d_axioms("subClassOf", "generalizations"), d_axioms("domain", "domain"), d_axioms("range", "range")
REL = f"(select subject from {DOM} union select subject from {RAN})"
SUBP = f"(select 'subPropertyOf' as axiom_type, subject, 'rdfs:subPropertyOf' as predicate, object, label, source, negative_strategy from {GEN} where subject in {REL} and object in {REL})"
SUBC = f"(select * from {GEN} where subject not in {REL} and object not in {REL})"
ALL_POSITIVES = f"(select * from {SUBC} union all select * from {SUBP} union all select * from {DOM} union all select * from {RAN})"


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def positives(t) -> dict[str, DataFrame]:
    return ds.positives_from_triples(readers.clean_triples(t.v_triples))


@query("D01_extract_axioms", f"select * from {GEN} union all select * from {DOM} union all select * from {RAN}")
def _(t):
    triples = readers.clean_triples(t.v_triples)
    return ds.extract_all(triples)


D_URI = """(case when {0} = '' then '' when starts_with({0}, 'https://schema.org/') then replace({0}, 'https://schema.org/', 'http://schema.org/')
 when starts_with({0}, 'http://schema.org/') then {0} when starts_with({0}, 'schema:') then 'http://schema.org/' || list_extract(string_split({0}, 'schema:'), -1)
 when starts_with({0}, 'http://') or starts_with({0}, 'https://') then {0} else 'http://schema.org/' || {0} end)"""


def d_props(kind: str, column: str) -> str:
    return (f"select '{kind}' as axiom_type, s as subject, 'rdfs:{kind}' as predicate, o as object, 1 as label, 'schema.org' as source, '' as negative_strategy from "
            f"(select {D_URI.format('trim(id)')} as s, {D_URI.format('v')} as o from (select id, trim(unnest(string_split(coalesce({column}, ''), ','))) as v from v_properties) where v <> '') where s <> o")


@query("D02_explode_property_axioms", " union all ".join([d_props("subPropertyOf", "subPropertyOf"), d_props("domain", "domainIncludes"), d_props("range", "rangeIncludes")]))
def _(t):
    props = t.v_properties.na.fill("")
    return union([ds.explode_property_axioms(props, k) for k in ("subPropertyOf", "domain", "range")])


@query("D03_clean_positives", "select distinct axiom_type, subject, predicate, object from v_axioms where subject <> object")
def _(t):
    return ds.clean_positives(t.v_axioms).select(*ds.AXIOM_KEY)


@query("J02_subproperty_axioms", f"select * from {SUBP}")
def _(t):
    return positives(t)["subPropertyOf"]


@query("J03_refine_subclass", f"select * from {SUBC}")
def _(t):
    return positives(t)["subClassOf"]


CAP = 120


def d_capped(n: int = CAP, seed: str = "7") -> str:
    return (f"(select * from {ALL_POSITIVES} qualify row_number() over (partition by axiom_type "
            f"order by md5('{seed}' || '|' || subject || '|' || predicate || '|' || object), subject, predicate, object) <= {n})")


@query("D04_cap_per_type", f"select * from {d_capped()}")
def _(t):
    return sa.cap_per_type(union(positives(t).values()), CAP, "7")


@query("D05_inverse_negatives", f"select axiom_type, object as subject, predicate, subject as object, 0 as label, source, 'direction_inversion' as negative_strategy from {SUBC}")
def _(t):
    return ds.inverse_negatives(positives(t)["subClassOf"])


def d_replacements(base: str) -> str:
    """Ordered pool per type; the first free slot from a hashed start."""
    return f"""
pool as (select axiom_type, object as cand, row_number() over (partition by axiom_type order by cast('0x' || substr(md5('pool|' || object), 1, 15) as bigint), object) - 1 as slot,
  count(*) over (partition by axiom_type) as size from (select distinct axiom_type, object from {base})),
tries as (select b.axiom_type, b.subject, b.predicate, b.object, b.source, p.cand,
  (p.slot - cast('0x' || substr(md5('42|' || b.axiom_type || '|' || b.subject || '|' || b.object), 1, 8) as bigint) % p.size + p.size) % p.size as try
  from {base} b join pool p on p.axiom_type = b.axiom_type where p.cand <> b.object),
free as (select * from tries t where not exists (select 1 from {base} k where k.axiom_type = t.axiom_type and k.subject = t.subject and k.object = t.cand)),
negs as (select axiom_type, subject, predicate, arg_min(cand, try) as object, 0 as label, source, 'constraint_replacement' as negative_strategy
  from (select *, object as own from free) group by axiom_type, subject, predicate, own, source)"""


@query("D06_replacement_negatives", f"with base as (select * from {DOM} union all select * from {RAN}), {d_replacements('base')} select * from negs")
def _(t):
    p = positives(t)
    return ds.replacement_negatives(p["domain"].unionByName(p["range"]))


@query("J13_exclude_existing_pairs", f"select c.* from (select axiom_type, object as subject, predicate, subject as object, 0 as label, source, 'direction_inversion' as negative_strategy from {SUBC}) c where not exists (select 1 from {SUBC} k where k.subject = c.subject and k.object = c.object)")
def _(t):
    p = positives(t)["subClassOf"]
    return ds.exclude_existing_pairs(ds.inverse_negatives(p), p)


D07_SQL = """
with capped as (select * from {positives}), base as (select * from capped where axiom_type in ('domain', 'range')), {replacements},
inv as (select axiom_type, object as subject, predicate, subject as object, 0 as label, source, 'direction_inversion' as negative_strategy from capped where axiom_type not in ('domain', 'range')),
u as (select distinct * from (select * from capped union all select * from inv union all select * from negs))
select * exclude (s, o), case axiom_type when 'subClassOf' then s || ' ⊑ ' || o when 'subPropertyOf' then s || ' ⊑p ' || o else axiom_type || '(' || s || ') = ' || o end as axiom_text
 from (select *, {s} as s, {o} as o from u)"""


def d07_sql(positives: str) -> str:
    return D07_SQL.format(positives=positives, replacements=d_replacements("base"), s=d_short_name("subject"), o=d_short_name("object"))


def assembled(parts: dict[str, DataFrame]) -> DataFrame:
    negatives = [
        ds.inverse_negatives(parts["subClassOf"]), ds.inverse_negatives(parts["subPropertyOf"]),
        ds.replacement_negatives(parts["domain"].unionByName(parts["range"])),
    ]
    return ds.assemble_dataset(list(parts.values()), negatives)


@query("D07_assemble_dataset", d07_sql(ALL_POSITIVES))
def _(t):
    rows = cut_lineage(union(positives(t).values()), "positives")
    return assembled({k: rows.filter(F.col("axiom_type") == k) for k in ("subClassOf", "subPropertyOf", "domain", "range")})


@query("D07_assemble_capped", d07_sql(d_capped()))
def _(t):
    sample = cut_lineage(sa.cap_per_type(union(positives(t).values()), CAP, "7"), "capped")
    return assembled({k: sample.filter(F.col("axiom_type") == k) for k in ("subClassOf", "subPropertyOf", "domain", "range")})


@query("D08_distinct_uris", "select distinct uri, kind from (select unnest([subject, object]) as uri, 'any' as kind from v_axioms union all select * from (select unnest([subject, object]) as uri, 'http' as kind from v_axioms) where starts_with(uri, 'http')) where trim(uri) <> ''")
def _(t):
    both = [cx.distinct_uris(t.v_axioms, http).withColumn("kind", F.lit(k)) for http, k in ((False, "any"), (True, "http"))]
    return union(both)


@query("D09_metadata_index", f"select subject, {NORM_P} as field, pos, trim(object) as value from v_triples where {NORM_P} in ('description', 'humanformat', 'generalizations', 'domain', 'range') and trim(object) <> ''")
def _(t):
    return cx.metadata_index(readers.clean_triples(t.v_triples))


@query("D10_context_mapping", f"""
with ix as (select subject as uri, {NORM_P} as field, pos, trim(object) as value from v_triples where trim(object) <> ''),
u as (select distinct unnest([subject, object]) as uri from v_triples where trim(object) <> ''),
d as (select uri, arg_min({d_clip('value', 240)}, pos) filter (where field = 'description') as de, arg_min({d_clip('value', 240)}, pos) filter (where field = 'humanformat') as hf from ix group by uri),
r as (select uri, field, {d_short_name('value')} as v, pos from ix where field in ('generalizations', 'domain', 'range') qualify row_number() over (partition by uri, field order by pos) <= 3),
x as (select uri, field, field || ': ' || string_agg(v, ', ' order by pos) as e from r group by uri, field),
y as (select uri, string_agg(e, ' | ' order by case field when 'generalizations' then 1 when 'domain' then 2 else 3 end) as extra from x group by uri),
z as (select u.uri, {d_short_name('u.uri')} as name, case when starts_with(u.uri, 'concept:') then 'Class' when starts_with(u.uri, 'relation:') then 'Property' else 'Unknown' end as kind, de, hf, extra
 from u left join d on d.uri = u.uri left join y on y.uri = u.uri)
select uri, name, kind, name as label_en, coalesce(de, hf, name || case kind when 'Property' then ' is a property' when 'Class' then ' is a class' else ' is an entity' end || ' in the NELL knowledge base.') as description,
 {d_clip('extra', 180)} as extra_info, 'NELL_ontology' as source, case when de is not null then 'ok' when hf is not null then 'partial' else 'fallback' end as status from z""")
def _(t):
    triples = readers.clean_triples(t.v_triples.filter("trim(object) <> ''"))
    uris = t.v_triples.filter("trim(object) <> ''").select(F.explode(F.array("subject", "object")).alias("uri")).distinct()
    return cx.context_mapping(uris, cx.metadata_index(t.v_triples))


STRUCTURED = f"select {D_URI.format('trim(id)')} as uri, label as label_en, comment as description, coalesce(rangeIncludes, '') as extra_info from v_properties"


@query("D11_description_chain", f"""
with st as ({STRUCTURED}), u as (select uri, {d_short_uri('uri')} as name from (select distinct uri from (select uri from st union all select 'http://ex.org/a#' || p_partkey from part union all select 'http://schema.org/x' || s_suppkey from supplier))),
l1 as (select cast(c_custkey as varchar) as name, case when c_custkey % 3 = 0 then '' else c_name end as description from customer),
l2 as (select 'x' || s_suppkey as name, s_name as description from supplier union all select cast(p_partkey as varchar), p_name from part),
j as (select u.uri, u.name, st.uri is not null as known, st.label_en, st.description as own, st.extra_info as ex, nullif(l1.description, '') as d1, l2.description as d2,
 case when st.uri is not null or contains(u.uri, 'schema.org') then 'Property' else 'Class' end as kind
 from u left join st on st.uri = u.uri left join l1 on l1.name = u.name left join l2 on l2.name = u.name)
select uri, name, kind, case when known then coalesce(nullif(label_en, ''), name) else name end as label_en,
 case when known then coalesce(nullif(own, ''), name || ' is a property in the knowledge base.') else coalesce(d1, d2, name || case kind when 'Property' then ' is a property' else ' is a class' end || ' in the knowledge base.') end as description,
 case when known then ex else '' end as extra_info, case when known then 'schema.org' when d1 is not null then 'encyclopedia' when d2 is not null then 'second' else 'fallback' end as source,
 case when known then case when own <> '' then 'ok' else 'partial' end when coalesce(d1, d2) is not null then 'ok' else 'fallback' end as status from j""")
def _(t):
    from ..functions.text import normalize_schema_uri
    structured = t.v_properties.select(
        normalize_schema_uri("id").alias("uri"), F.col("label").alias("label_en"), F.col("comment").alias("description"),
        F.coalesce("rangeIncludes", F.lit("")).alias("extra_info"))
    uris = structured.select("uri").union(t.part.select(F.concat(F.lit("http://ex.org/a#"), "p_partkey"))).union(
        t.supplier.select(F.concat(F.lit("http://schema.org/x"), "s_suppkey"))).distinct()
    first = t.customer.select(
        F.col("c_custkey").cast("string").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_name")).alias("description"),
        F.lit("encyclopedia").alias("source"))
    second = t.supplier.select(F.concat(F.lit("x"), "s_suppkey").alias("name"), F.col("s_name").alias("description")).union(
        t.part.select(F.col("p_partkey").cast("string"), "p_name")).withColumn("source", F.lit("second"))
    return cx.description_chain(uris, structured, [first, second])


BIND = """select 'http://ex.org/onto#E' || (event_id % 700) as uri, event_id as pos, case when event_id % 3 = 0 then ' ' else event_type || ' ' || user_id end as label,
 case when event_id % 5 = 0 then 'abstract  of ' || event_type else '' end as abstract, case when event_id % 1400 < 700 and event_id % 7 = 0 then 'c' || event_id else null end as comment,
 case event_id % 4 when 0 then 'http://www.w3.org/2002/07/owl#Class' when 1 then 'http://www.w3.org/2002/07/owl#ObjectProperty' else '' end as type from {0}"""


@query("D12_first_english_values", f"""
with b as (select * from ({BIND.format('events')})),
g as (select uri, coalesce(arg_min(trim(label), pos) filter (where trim(label) <> ''), '') as l, coalesce(arg_min(trim(abstract), pos) filter (where abstract <> ''), '') as a,
 coalesce(arg_min(comment, pos) filter (where comment is not null), '') as c, bool_or(type like '%ObjectProperty') as p, bool_or(type like '%Class') as k from b group by uri)
select uri, substr(uri, 20) as name, case when p then 'Property' when k then 'Class' else 'Unknown' end as kind, l as label_en, replace(a, '  ', ' ') as abstract_en, c as comment_en,
 'DBpedia_SPARQL' as source, case when a <> '' or c <> '' then 'ok' when l <> '' then 'partial' else 'missing' end as status from g""")
def _(t):
    return cx.first_english_values(t.spark.sql(BIND.format("{events}"), events=t.events))


DUP_MAP = "select 'http://ex.org/m/' || user_id as uri, event_id as pos, event_type as name, 'Class' as kind from {0}"


@query("D13_dedupe_mapping", f"""
select 'first' as policy, * from ({DUP_MAP.format('events')}) qualify row_number() over (partition by uri order by pos) = 1
union all select 'last', * from ({DUP_MAP.format('events')}) qualify row_number() over (partition by uri order by pos desc) = 1""")
def _(t):
    rows = t.spark.sql(DUP_MAP.format("{events}"), events=t.events)
    return union([cx.dedupe_mapping(rows, "pos", p).withColumn("policy", F.lit(p)) for p in ("first", "last")])


MAPPING = """select case when c_acctbal > 0 then 'http://ex.org/onto#Cust' else 'http://ex.org/gone#Cust' end || c_custkey as uri, c_name as name, case when c_custkey % 4 = 0 then '' else 'Class' end as kind, c_mktsegment as label_en,
 case when c_custkey % 2 = 0 then 'long  text of ' || c_name else '' end as abstract_en, case when c_custkey % 3 = 0 then 'comment ' || c_custkey else '' end as comment_en
 from {0}"""


def d_card(side: str) -> str:
    return (f"case when m{side}.uri is not null then '- 名称：' || m{side}.name || chr(10) || '- 类型：' || coalesce(nullif(m{side}.kind, ''), 'Unknown') || chr(10) || '- 简介：' || "
            f"coalesce(nullif({d_clip(f'm{side}.abstract_en', 240)}, ''), nullif(m{side}.comment_en, ''), m{side}.label_en) else "
            f"'- 名称：' || coalesce(nullif({d_strip(d_short_uri('a.' + side))}, ''), 'Unknown') || chr(10) || '- 类型：Unknown' || chr(10) || '- 简介：' || "
            f"coalesce(nullif({d_clip(d_short_uri('a.' + side), 240)}, ''), 'No additional description is available.') end")


ATTACHED = f"""(select a.id, ms.uri is not null as subject_hit, mo.uri is not null as object_hit, {d_card('subject').replace('msubject', 'ms')} as subject_context, {d_card('object').replace('mobject', 'mo')} as object_context
 from v_axioms a left join ({MAPPING.format('customer')}) ms on ms.uri = a.subject left join ({MAPPING.format('customer')}) mo on mo.uri = a.object)"""


def attached(t, **options) -> DataFrame:
    return cx.attach_context(t.v_axioms.drop("context_info"), t.spark.sql(MAPPING.format("{customer}"), customer=t.customer), **options)


ATTACHED_CARDS = f"select *, '背景知识：' || chr(10) || '条目1：' || chr(10) || subject_context || chr(10) || chr(10) || '条目2：' || chr(10) || object_context as context_info from {ATTACHED}"


@query("J01_attach_context", ATTACHED_CARDS)
def _(t):
    return attached(t).select("id", "subject_hit", "object_hit", "subject_context", "object_context", "context_info")


@query("J01_attach_context_salted", ATTACHED_CARDS)
def _(t):
    """The same join with every end of 20 rows and more salted.""".replace("20", "20")
    return attached(t, min_rows=20).select("id", "subject_hit", "object_hit", "subject_context", "object_context", "context_info")


@query("J01_context_hits", f"select count(*) as total, count_if(subject_hit) as subject_hits, count_if(object_hit) as object_hits from {ATTACHED}")
def _(t):
    return cx.context_hits(attached(t))


LAYERS = ("select doc_id as file_key, 'a' || doc_id as body from {0} where n_chars < 2000", "select doc_id as file_key, 'b' || doc_id as body from {0} where lang = 'fr'",
          "select doc_id as file_key, 'c' || doc_id as body from {0} where n_chars > 1000")


@query("J12_overlay_sources", "select file_key, body from (" + " union all ".join(f"select *, {i} as p from ({x.format('documents')})" for i, x in enumerate(LAYERS)) + ") qualify row_number() over (partition by file_key order by p desc) = 1")
def _(t):
    return ds.overlay_sources([t.spark.sql(x.format("{documents}"), documents=t.documents) for x in LAYERS], ["file_key"])


# ---- samples ---------------------------------------------------------------
RELATIONS = """select o_orderkey as id, case when o_orderstatus = 'P' and o_orderpriority like '1%' then 'rdfs:range' when o_orderpriority like '1%' then 'rdfs:subClassOf'
 when o_orderpriority like '2%' then ' owl:subObjectPropertyOf' when o_orderpriority like '3%' then 'rdfs:domain' else 'other' end as relation from {0}"""


@query("D16_balanced_sample", f"""
with k as (select id, relation, case trim(relation) when 'rdfs:subClassOf' then 'subClassOf' when 'owl:subObjectPropertyOf' then 'subPropertyOf' when 'rdfs:domain' then 'domain' when 'rdfs:range' then 'range' end as kind from ({RELATIONS.format('orders')})),
r as (select *, row_number() over (partition by kind order by md5('9|' || id), id) as rk, count(*) over (partition by kind) as n from k where kind is not null),
level as (select sum(least(n, 25)) as s from (select distinct kind, n from r))
select id, relation, kind from r where rk <= 25""")
def _(t):
    return sa.balanced_sample(t.spark.sql(RELATIONS.format("{orders}"), orders=t.orders), "9", ["id"])


@query("D17_fair_per_paper_sample", """
with a as (select *, row_number() over (partition by doc_id, axiom_type order by md5('20260417|' || doc_id || '|' || axiom_type || '|' || item1 || '|' || item2), doc_id, axiom_type, item1, item2) as r,
 md5('20260417|' || doc_id || '|' || axiom_type || '|' || item1 || '|' || item2) as h from (select distinct doc_id, axiom_type, item1, item2 from v_doc_axioms))
select doc_id, axiom_type, item1, item2 from a qualify row_number() over (partition by doc_id order by r, h, doc_id, axiom_type, item1, item2) <= 10""")
def _(t):
    rows = t.v_doc_axioms.select("doc_id", "axiom_type", "item1", "item2").distinct()
    return sa.fair_per_paper_sample(rows, ["doc_id", "axiom_type", "item1", "item2"])


@query("D17_fair_total_sample", """
with a as (select *, md5('20260417|' || doc_id || '|' || axiom_type || '|' || item1 || '|' || item2) as h from (select distinct doc_id, axiom_type, item1, item2 from v_doc_axioms)),
r as (select *, row_number() over (partition by doc_id, axiom_type order by h, axiom_type, item1, item2) as k from a),
p as (select doc_id, count(*) as n, count_if(k <= 1) as c, md5('20260417|' || doc_id) as ph from r group by 1),
s as (select sum(n) as n, sum(c) as c from p),
g as (select doc_id, ph, case when s.c >= 5000 then 0 else p.c end as base, case when s.c >= 5000 then p.c else p.n - p.c end as room, least(5000, s.n) - case when s.c >= 5000 then 0 else s.c end as rest from p, s),
l as (select max(level) as level from (select level, sum(least(room, level)) as used, any_value(rest) as rest from g, range(0, (select max(room)::bigint + 1 from g)) t(level) group by 1) where used <= rest),
q as (select doc_id, base + least(room, level) + case when room > level and row_number() over (partition by room > level order by ph, doc_id)
  <= rest - (select sum(least(room, level)) from g, l) then 1 else 0 end as quota from g, l),
o as (select r.*, row_number() over (partition by r.doc_id order by (k > 1), k, h, axiom_type, item1, item2) as place from r)
select o.doc_id, axiom_type, item1, item2 from o join q on q.doc_id = o.doc_id where place <= quota""")
def _(t):
    rows = t.v_doc_axioms.select("doc_id", "axiom_type", "item1", "item2").distinct()
    return sa.fair_total_sample(rows, ["doc_id", "axiom_type", "item1", "item2"], 5000, type_cap=1)


# ---- ontology documents ----------------------------------------------------
KIND_NO = "case axiom_type when 'Class' then 0 when 'Property' then 1 when 'subClassOf' then 2 when 'subPropertyOf' then 3 when 'domain' then 4 else 5 end"


def rest(line, k: int):
    """What follows the first k - 1 words of a line, whole; as REST3 and REST4 in the views."""
    before = sum((F.length(F.split_part(line, F.lit(" "), F.lit(i))) for i in range(1, k)), F.lit(k))
    return F.substr(line, before, F.length(line))


def layer3_docs(t, key: str = "doc_id") -> DataFrame:
    """Documents with their six lists, built from their own lines."""
    line = F.transform(F.split("text", "\n"), lambda l, i: F.struct(i.alias("i"), F.split_part(l, F.lit(" "), F.lit(1)).alias("a"),
                       F.split_part(l, F.lit(" "), F.lit(2)).alias("b"), rest(l, 3).alias("c")))
    rows = t.documents.select("doc_id", line.alias("w")).join(t.v_domains, "doc_id")
    full = F.filter("w", lambda x: (x["a"] != "") & (x["b"] != "") & (x["c"] != ""))
    rows = rows.withColumn("w", full)
    of = lambda k: F.filter("w", lambda x: x["i"] % 6 == k)
    pair = lambda k, l, r, n1, n2: F.transform(of(k), lambda x: F.struct(x[l].alias(n1), x[r].alias(n2)))
    return rows.select(
        F.col("doc_id").alias(key), F.col("domain").alias("domain_name"),
        F.transform(of(0), lambda x: x["a"]).alias("classes"), F.transform(of(1), lambda x: x["b"]).alias("properties"),
        pair(2, "a", "c", "sub", "super").alias("subClassOf"), pair(3, "b", "c", "sub", "super").alias("subPropertyOf"),
        pair(4, "b", "a", "property", "class").alias("domain_axioms"), pair(5, "b", "c", "property", "class").alias("range_axioms"))


def document_form(t) -> DataFrame:
    return layer3_docs(t).withColumnRenamed("domain_name", "domain")


def service_form(t, key: str) -> DataFrame:
    return layer3_docs(t, key).drop("domain_name").withColumnsRenamed({"domain_axioms": "domain", "range_axioms": "range"})


D_PRED = "case axiom_type when 'Class' then 'declare_class' when 'Property' then 'declare_property' else axiom_type end"


@query("D18_flatten_axioms", f"""
select a.doc_id, d.domain, row_number() over (partition by a.doc_id order by {KIND_NO}, pos) as axiom_no, axiom_type, item1 as subject, {D_PRED} as predicate, item2 as object,
 trim(item1 || ' ' || {D_PRED} || ' ' || item2) as axiom_text from v_chunk_axioms a join v_domains d on d.doc_id = a.doc_id""")
def _(t):
    return on.flatten_axioms(document_form(t))


ESC = "replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
D_PAYLOAD = f"""case when axiom_type in ('Class', 'Property') then '"' || {ESC.format('item1')} || '"' when axiom_type in ('subClassOf', 'subPropertyOf')
 then chr(123) || '"sub": "' || {ESC.format('item1')} || '", "super": "' || {ESC.format('item2')} || '"' || chr(125)
 else chr(123) || '"property": "' || {ESC.format('item1')} || '", "class": "' || {ESC.format('item2')} || '"' || chr(125) end"""


@query("D19_service_axiom_rows", f"""
select doc_id as task_id, row_number() over (partition by doc_id order by {KIND_NO}, pos) as row_no, 'layered' as execution_mode, 'concept_modeling' as source_layer,
 case axiom_type when 'Class' then 'class' when 'Property' then 'property' else axiom_type end as axiom_type, item1 as subject_term, nullif(item2, '') as object_term,
 case axiom_type when 'Class' then 'Class(' || item1 || ')' when 'Property' then 'Property(' || item1 || ')' else item1 || ' rdfs:' || axiom_type || ' ' || item2 end as axiom_text,
 {D_PAYLOAD} as payload_json from v_chunk_axioms""")
def _(t):
    return on.service_axiom_rows(service_form(t, "task_id"), "layered", "concept_modeling")


@query("D20_annotation_rows", f"""
select 'm' as model, case when doc_id % 5 = 0 then 'folder' else lang end as domain, doc_id, 'round1' as config, pos + 1 as axiom_no, subject, relation, object,
 case when trim(chunk) <> '' and {d_strip('context')} <> '' then chunk || ': ' || {d_strip('context')} when {d_strip('context')} <> '' then {d_strip('context')} else trim(chunk) end as evidence,
 '' as is_correct, '' as error_type, '' as remark
from (select t.*, d.lang from v_doc_triples t join documents d on d.doc_id = t.doc_id)""")
def _(t):
    part = lambda l, k: F.split_part(l, F.lit(" "), F.lit(k))
    axiom = lambda l, i: F.struct(
        part(l, 1).alias("subject"), part(l, 2).alias("relation"), rest(l, 3).alias("object"),
        F.when(i % 9 == 8, F.lit("")).otherwise(F.concat(F.lit("c"), F.floor(i / 4).cast("string"))).alias("chunk"),
        F.when(i % 9 == 8, F.lit(" ")).otherwise(l).alias("evidence"))
    docs = t.documents.select("doc_id", F.lit("folder").alias("folder"), F.transform(F.split("text", "\n"), axiom).alias("axioms"))
    known = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).otherwise(-1 - F.col("doc_id"))  # misses by another key
    domains = t.documents.select(known.alias("doc_id"), F.col("lang").alias("domain"))
    return on.annotation_rows(docs, domains, "m", "round1")


PAYLOAD = """case c_custkey % 6
 when 0 then '{{{{"method": "own.", "domain": "medical", "subClassOf": [{{{{"sub": "C' || c_custkey || '", "super": "D' || c_nationkey || '"}}}}, {{{{"child": "same", "parent": "same"}}}}, {{{{"child": "k' || c_custkey || '", "parent": "p;"}}}}], "subPropertyOf": [{{{{"axiom_text": "SubPropertyOf(a' || c_custkey || ' b)"}}}}]}}}}'
 when 1 then '[{{{{"axiomType": "subClassOf", "subjectTerm": "C' || c_custkey || '", "objectTerm": "D"}}}}, {{{{"type": "other", "axiom_text": "x' || c_custkey || ' subPropertyOf y"}}}}, 5]'
 when 2 then '{{{{"axiom_type": "subPropertyOf", "subject": "s' || c_custkey || '", "object": "o", "domain": "geo"}}}}'
 when 3 then '[{{{{"method": "m' || c_nationkey || '", "axiom_text": "SubClassOf ( A' || c_custkey || ' B )"}}}}]'
 when 4 then '{{{{"subPropertyOf": [], "note": "none"}}}}'
 else '{{{{"axiom_type": "range", "subject": "a", "object": "b"}}}}' end"""
PAYLOADS = "select 'default' as method, case when c_nationkey % 2 = 0 then 'unknown' else 'transportation' end as domain, " + PAYLOAD.format() + " as payload from {customer}"
D_DOMAIN = "case when c_nationkey % 2 = 0 then 'unknown' else 'transportation' end"


@query("D21_heterogeneous_axioms", f"""
select 'own' as method, 'medical' as domain, 'subClassOf' as axiom_type, 'C' || c_custkey as sub, 'D' || c_nationkey as super from customer where c_custkey % 6 = 0
union all select 'own', 'medical', 'subClassOf', 'k' || c_custkey, 'p' from customer where c_custkey % 6 = 0
union all select 'own', 'medical', 'subPropertyOf', 'a' || c_custkey, 'b' from customer where c_custkey % 6 = 0
union all select 'default', {D_DOMAIN}, 'subClassOf', 'C' || c_custkey, 'D' from customer where c_custkey % 6 = 1
union all select 'default', {D_DOMAIN}, 'subPropertyOf', 'x' || c_custkey, 'y' from customer where c_custkey % 6 = 1
union all select 'default', 'geo', 'subPropertyOf', 's' || c_custkey, 'o' from customer where c_custkey % 6 = 2
union all select 'm' || c_nationkey, {D_DOMAIN}, 'subClassOf', 'A' || c_custkey, 'B' from customer where c_custkey % 6 = 3""")
def _(t):
    return on.heterogeneous_axioms(t.spark.sql(PAYLOADS, customer=t.customer))


# ---- readers and writers: derive files from the tables, then read them -----
@query("S01_scan_axiom_csv", "select cast(id as varchar) as id, axiom_type, subject, predicate, object, label, source, negative_strategy, axiom_text, coalesce(context_info || chr(10) || '\"q\", second line', '') as context_info from v_axioms")
def _(t):
    path = scratch_path(t.spark, "axiom-csv")
    rows = t.v_axioms.select(*[
        F.col(f.name).cast("string").alias(f.name) for f in schemas.AXIOM_CSV.fields
    ]).withColumn("context_info", F.concat("context_info", F.lit('\n"q", second line')))
    writers.write_table(rows, path, "csv")
    return readers.scan_axiom_csv(t.spark, path).na.fill("")


@query("S02_scan_triples_tsv", "select subject, trim(predicate, '\"') as predicate, object from v_triples where trim(subject) <> '' and trim(object) <> '' and not (subject = 'Entity' and predicate = 'Relation')")
def _(t):
    path = scratch_path(t.spark, "triples")
    good = F.concat_ws("\t", "subject", "predicate", "object")
    bad = F.concat_ws("\t", "subject", "predicate")
    lines = t.v_triples.select(good.alias("value")).union(t.v_triples.select(bad)).union(
        t.v_triples.select(F.concat_ws("\t", "subject", "predicate", "object", "object")))
    lines.write.option("compression", "gzip").text(path)
    return readers.scan_triples_tsv(t.spark, path, 8)


@query("S03_scan_property_csv", "select id, coalesce(rangeIncludes, '') as \"RangeIncludes\", label, 'RangeIncludes' as resolved from v_properties")
def _(t):
    path = scratch_path(t.spark, "props")
    columns = ["id", "RangeIncludes", "label"]
    writers.write_table(t.v_properties.select("id", F.col("rangeIncludes").alias("RangeIncludes"), "label"), path)
    props = readers.scan_property_csv(t.spark, path, columns)
    return props.withColumn("resolved", F.lit(readers.resolve_column(props, "rangeincludes")))


TREE_COUNTS = "select 'baseline' as method, case c_custkey % 4 when 0 then 'medical' when 1 then 'geography' when 2 then 'transportation' else 'unknown' end as domain, count(*) as axioms from customer group by 1, 2"


@query("S04_scan_results_tree", TREE_COUNTS)
def _(t):
    root = scratch_path(t.spark, "tree")
    folder = F.when(F.col("c_custkey") % 4 == 0, F.lit("Medical")).when(F.col("c_custkey") % 4 == 1, F.lit("geography")).when(
        F.col("c_custkey") % 4 == 2, F.lit("transportation")).otherwise(F.lit("other"))
    pairs = F.collect_list(F.struct(F.col("c_name").alias("sub"), F.lit("Top").alias("super")))
    files = t.customer.groupBy(folder.alias("folder"), F.floor(F.col("c_custkey") / 512).alias("file")).agg(pairs.alias("subClassOf"))
    for name in ("Medical", "geography", "transportation", "other"):
        files.filter(F.col("folder") == name).select("subClassOf").write.option("maxRecordsPerFile", 1).json(f"{root}/{name}")
    tree = readers.scan_results_tree(t.spark, {"baseline": root}).drop("path")
    return on.heterogeneous_axioms(tree).groupBy("method", "domain").agg(F.count(F.lit(1)).alias("axioms"))


@query("S04_scan_results_items", TREE_COUNTS)
def _(t):
    """The same tree as indented files, read an element a row."""
    root = scratch_path(t.spark, "items")
    row = F.format_string('    {\n      "sub": "%s",\n      "super": "Top"\n    }', "c_name")
    pages = t.customer.groupBy((F.col("c_custkey") % 4).alias("kind"), F.floor(F.col("c_custkey") / 512).alias("file")).agg(
        F.array_join(F.collect_list(row), ",\n").alias("rows"))
    files = pages.select("kind", F.concat(F.lit('{\n  "subClassOf": [\n'), "rows", F.lit("\n  ]\n}")).alias("value"))
    for kind, name in enumerate(("Medical", "geography", "transportation", "other")):
        files.filter(F.col("kind") == kind).select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/{name}")
    items = readers.scan_json_items(t.spark, root, "*.txt").select(
        F.lit("baseline").alias("method"), readers.domain_of_path(F.col("path")).alias("domain"), "payload")
    return on.heterogeneous_axioms(items).groupBy("method", "domain").agg(F.count(F.lit(1)).alias("axioms"))


@query("S04_scan_results_csv", """
select 'baseline' as method, case c_custkey % 2 when 0 then 'geography' else 'unknown' end as domain, case c_custkey % 3 when 0 then 'subPropertyOf' else 'subClassOf' end as axiom_type,
 c_name || case when c_custkey % 5 = 0 then ', "x"' || chr(10) || 'y' else '' end as sub, 'Top' as super from customer where c_custkey % 2 = 0 or c_custkey % 3 > 0""")
def _(t):
    """Two spellings of the columns in one tree, cells with commas, quotes and line breaks."""
    root = scratch_path(t.spark, "csv-tree")
    name = F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, F.lit(', "x"\ny')).otherwise(F.lit("")))
    kind = F.when(F.col("c_custkey") % 3 == 0, F.lit("subPropertyOf")).otherwise(F.lit("subClassOf"))
    options = {"header": True, "quoteAll": True, "escape": '"'}
    t.customer.filter("c_custkey % 2 = 0").select(kind.alias("axiomType"), name.alias("child"), F.lit("Top").alias("parent")).write.csv(
        f"{root}/Geography", **options)
    t.customer.filter("c_custkey % 2 = 1 and c_custkey % 3 > 0").select(
        "c_custkey", F.lit("Top").alias("object"), name.alias("subject"), F.lit("subClassOf").alias("type")).write.csv(f"{root}/other", **options)
    return on.heterogeneous_axioms(readers.scan_results_tree(t.spark, {"baseline": root}).drop("path"))


@query("S05_scan_doc_domain_map", "select distinct 'part-' || lang as prefix, lang as domain from documents")
def _(t):
    root = scratch_path(t.spark, "doc-domains")
    t.documents.select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(root)
    found = readers.scan_doc_domain_map(t.spark, root)
    lang = F.regexp_replace("domain", "^lang=", "")
    return found.select(F.concat(F.regexp_extract("doc_id", "^(part-)", 1), lang).alias("prefix"), lang.alias("domain")).distinct()


@query("S07_write_table", "select fmt, cast(doc_id as varchar) as doc_id, lang, text from documents, (values ('csv'), ('json'), ('parquet')) f(fmt)")
def _(t):
    rows = t.documents.select(F.col("doc_id").cast("string"), "lang", "text")
    out = []
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(t.spark, fmt)
        writers.write_table(rows, path, fmt)
        reader = t.spark.read.schema(rows.schema)
        back = reader.csv(path, header=True, multiLine=True, quote='"', escape='"') if fmt == "csv" else reader.format(fmt).load(path)
        out.append(back.withColumn("fmt", F.lit(fmt)))
    return union(out)


@query("S07_one_document", "select 'csv' as fmt, cast(doc_id as varchar) as doc_id, lang, nullif(text, '') as text from documents union all select 'json', cast(doc_id as varchar), lang, text from documents")
def _(t):
    rows = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("name"), "lang", "text")
    schema = "name string, lang string, text string"
    as_csv, as_json = scratch_path(t.spark, "csv-document"), scratch_path(t.spark, "json-document")
    exports.write_lines(exports.csv_document(rows, "doc_id"), as_csv)
    exports.write_lines(exports.json_document(rows, "doc_id"), as_json)
    back = t.spark.read.csv(f"{as_csv}/parts", schema=schema, multiLine=True, quote='"', escape='"').filter(
        "name not in ('name', '\ufeffname')")
    records = t.spark.read.text(f"{as_json}/parts", lineSep="\n  }").select(
        F.from_json(F.concat(F.regexp_extract("value", r"(?s)\{.*", 0), F.lit("}")), schema).alias("r")).filter("r.name is not null")
    return union([d.select(F.lit(fmt).alias("fmt"), F.col("name").alias("doc_id"), "lang", "text")
                  for fmt, d in (("csv", back), ("json", records.select("r.*")))])


@query("S08_append_run_record", "select cast(doc_id as varchar) as doc_id, lang, note from (select doc_id, lang, 'first' as note from documents union all select doc_id, source, 'second, \"quoted\"' from documents)")
def _(t):
    path = scratch_path(t.spark, "runlog")
    for column, note in (("lang", "first"), ("source", 'second, "quoted"')):
        writers.append_run_record(t.documents.select(F.col("doc_id").cast("string"), F.col(column).alias("lang"), F.lit(note).alias("note")), path)
    return t.spark.read.csv(path, schema="doc_id string, lang string, note string", header=True, quote='"', escape='"')


# ---- exports ---------------------------------------------------------------
def d_safe(x: str) -> str:
    return f"case when coalesce({x}, '') = '' then 'Unnamed' else regexp_replace(trim({x}), '[^a-zA-Z0-9_]', '_', 'g') end"


EXPORT = f"(select id, axiom_type as k, {d_safe('subject_term')} as s, {d_safe('object_term')} as o from v_service_axioms)"


def d_lines(cases: dict[str, str], head=(), tail=()) -> str:
    body = f"select id as seq, case k {' '.join(f'when {chr(39)}{k}{chr(39)} then {v}' for k, v in cases.items())} end as line from {EXPORT}"
    extra = "".join(f" union all select {i - len(head)}, '{line}'" for i, line in enumerate(head))
    extra += "".join(f" union all select {2 ** 62 + i}, '{line}'" for i, line in enumerate(tail))
    return body + extra


NS = "http://example.org/ontology#"
RDF = lambda e, p: f"'  <owl:{e} rdf:about=\"{NS}' || s || '\"><rdfs:{p} rdf:resource=\"{NS}' || o || '\" /></owl:{e}>'"


@query("S09_export_turtle", d_lines({
    "class": "':' || s || ' a owl:Class .'", "property": "':' || s || ' a owl:ObjectProperty .'", "subClassOf": "':' || s || ' rdfs:subClassOf :' || o || ' .'",
    "subPropertyOf": "':' || s || ' rdfs:subPropertyOf :' || o || ' .'", "domain": "':' || s || ' rdfs:domain :' || o || ' .'", "range": "':' || s || ' rdfs:range :' || o || ' .'",
}, [f"@prefix : <{NS}> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", "@prefix owl: <http://www.w3.org/2002/07/owl#> .", ""]))
def _(t):
    return exports.export_turtle(t.v_service_axioms)


@query("S10_export_rdfxml", d_lines({
    "class": f"'  <owl:Class rdf:about=\"{NS}' || s || '\" />'", "property": f"'  <owl:ObjectProperty rdf:about=\"{NS}' || s || '\" />'",
    "subClassOf": RDF("Class", "subClassOf"), **{p: RDF("ObjectProperty", p) for p in ("subPropertyOf", "domain", "range")},
}, ['<?xml version="1.0" encoding="UTF-8"?>', '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"', '         xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"',
    '         xmlns:owl="http://www.w3.org/2002/07/owl#"', f'         xmlns:ex="{NS}">'], ["</rdf:RDF>"]))
def _(t):
    return exports.export_rdfxml(t.v_service_axioms)


@query("S11_export_owl_functional", d_lines({
    "class": "'Declaration(Class(:' || s || '))'", "property": "'Declaration(ObjectProperty(:' || s || '))'", "subClassOf": "'SubClassOf(:' || s || ' :' || o || ')'",
    "subPropertyOf": "'SubObjectPropertyOf(:' || s || ' :' || o || ')'", "domain": "'ObjectPropertyDomain(:' || s || ' :' || o || ')'", "range": "'ObjectPropertyRange(:' || s || ' :' || o || ')'",
}))
def _(t):
    return exports.export_owl_functional(t.v_service_axioms)


@query("S12_export_axiom_json", """
select id as seq, chr(123) || '"id":' || id || ',"taskId":' || task_id || ',"executionMode":"layered","sourceLayer":"concept_modeling","axiomType":"' || axiom_type || '","subjectTerm":"' || subject_term || '","objectTerm":'
 || coalesce('"' || object_term || '"', 'null') || ',"axiomText":"' || axiom_text || '","payloadJson":' || case when json_valid(payload_json) then replace(payload_json, ': ', ':') else 'null' end || chr(125) as line from v_service_axioms""")
def _(t):
    return exports.export_axiom_json(t.v_service_axioms)
