"""Views that shape the driver tables as the operators' inputs.

Each view reads whole tables. Most are one statement that Spark and DuckDB
both accept; ``{name}`` stands for a table or another view. Where the dialects
differ (exploding text) both forms are given.
"""

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Tables whose queries do much work per row (long text, many patterns).
TEXT_TABLES = ("documents", "pages", "conversations", "orders")

VIEWS: dict[str, dict[str, str]] = {}


def _view(name: str, sql: str, duck: str | None = None) -> None:
    VIEWS[name] = {"spark": sql, "duck": duck or sql}


# White space as one character class for DuckDB's regular expressions.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def d_strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def d_collapse(x: str) -> str:
    return d_strip(f"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')")


TYPE4 = "case {0} % 4 when 0 then 'subClassOf' when 1 then 'subPropertyOf' when 2 then 'domain' else 'range' end"
TYPE5 = (
    "case {0} % 5 when 0 then 'subClassOf' when 1 then 'subPropertyOf' when 2 then 'domain' "
    "when 3 then 'range' else 'related' end"
)

# ---- triple dump -----------------------------------------------------------
_view("v_triples", """
select c_custkey * 8 as pos, 'concept:customer' || c_custkey as subject, 'generalizations' as predicate,
       'concept:nation' || c_nationkey as object from {customer}
union all select c_custkey * 8 + 1, 'concept:customer' || c_custkey, ' Description ',
       case when c_custkey % 4 = 0 then '  ' else c_mktsegment || '  customer' end from {customer}
union all select c_custkey * 8 + 2, 'concept:customer' || c_custkey, 'humanFormat',
       case when c_custkey % 3 = 0 then '' else c_name end from {customer}
union all select 1000000000000 + n_nationkey, 'concept:nation' || n_nationkey, ' Generalizations ',
       'concept:region' || n_regionkey from {nation}
union all select 2000000000000 + r_regionkey, 'concept:region' || r_regionkey, 'generalizations',
       'concept:region' || r_regionkey from {region}
union all select 2100000000000 + r_regionkey, 'Entity', 'Relation', 'Value' from {region}
union all select 3000000000000 + p_partkey, 'relation:part' || p_partkey, '"generalizations"',
       'relation:' || lower(replace(p_brand, '#', '')) from {part}
union all select 4000000000000 + p_partkey, 'relation:part' || p_partkey, 'domain',
       'concept:' || lower(p_type) from {part}
union all select 5000000000000 + p_partkey, 'relation:part' || p_partkey, 'Range',
       'concept:size' || p_size from {part}
union all select 6000000000000 + p_partkey, 'relation:' || lower(replace(p_brand, '#', '')), 'domain',
       'concept:' || lower(p_type) from {part}
union all select 7000000000000 + o_orderkey, 'concept:customer' || o_custkey, 'generalizations',
       'concept:nation' || (o_custkey % 25) from {orders}
""")

# ---- property table --------------------------------------------------------
_view("v_properties", """
select case p_partkey % 4 when 0 then 'https://schema.org/p' || p_partkey when 1 then 'schema:p' || p_partkey
            when 2 then ' p' || p_partkey else 'http://other.org/p' || p_partkey end as id,
       case when p_partkey % 3 = 0 then p_brand || ', ' || p_type || ',, p' || p_partkey else '' end as subPropertyOf,
       p_type || ' , schema:' || replace(p_brand, '#', '') as domainIncludes,
       case when p_size % 5 = 0 then null else 'http://schema.org/Size' || p_size end as rangeIncludes,
       p_name as label, case when p_partkey % 2 = 0 then p_name || ' of ' || p_type else '' end as comment
from {part}
""")

# ---- axioms with every URI style ------------------------------------------
_view("v_axioms", f"""
select o_orderkey as id, {TYPE5.format('o_orderkey')} as axiom_type,
       case o_orderkey % 7 when 0 then 'concept:cust' || o_custkey when 1 then 'http://ex.org/onto#Cust' || o_custkey
            when 2 then 'http://ex.org/path/Cust' || o_custkey || '/' when 3 then ' relation:cust' || o_custkey
            when 4 then 'https://schema.org/cust' || o_custkey when 5 then 'schema:cust_' || o_custkey
            else 'plainCust' || o_custkey end as subject,
       'rdfs:' || {TYPE5.format('o_orderkey')} as predicate,
       case o_orderkey % 3 when 0 then 'concept:nation' || (o_custkey % 25)
            when 1 then 'http://ex.org/onto#Nation' || (o_custkey % 25) else 'Nation' || (o_custkey % 25) end as object,
       case o_orderstatus when 'O' then '1' when 'F' then ' 0 ' else case when o_orderkey % 2 = 0 then 'x' else '' end end as label,
       case when o_orderkey % 11 = 0 then ' ' else o_orderpriority end as source,
       case o_orderkey % 6
            when 0 then 'Cust' || o_custkey || ' ⊑ Nation' || (o_custkey % 25)
            when 1 then 'cust' || o_custkey || ' ⊑p nation' || (o_custkey % 25)
            when 2 then 'domain(has' || o_custkey || ') = Nation' || (o_custkey % 25)
            when 3 then 'Range( has' || o_custkey || ' ) = Nation' || (o_custkey % 25)
            when 4 then 'SubClassOf( Cust' || o_custkey || ' Nation' || (o_custkey % 25) || ' )'
            else 'cust' || o_custkey || '  subPropertyOf  nation' || (o_custkey % 25) || '.' end as axiom_text,
       case when o_orderkey % 4 = 0 then '  ' else 'swap' end as negative_strategy,
       case when o_orderkey % 5 = 0 then null else 'about ' || o_orderpriority end as context_info
from {{orders}}
""")

# ---- judgements ------------------------------------------------------------
_view("v_judgements", f"""
select l_orderkey as record_id, l_linenumber as line_no, l_suppkey as supp_id,
       case l_partkey % 3 when 0 then 'dbpedia' when 1 then 'nell' else 'yago' end as dataset,
       'model-' || (l_suppkey % 3) as model,
       case l_linenumber % 3 when 0 then 'basic' when 1 then 'context' else 'instruction' end as prompt,
       {TYPE4.format('l_linenumber')} as axiom_type,
       case when l_returnflag = 'R' or (l_returnflag = 'N' and l_linestatus = 'O') then 1 else 0 end as label,
       case when l_quantity > 47 then null when l_discount < 0.045 then 1 else 0 end as pred
from {{lineitem}}
""")
_view("v_raw", """
select record_id, line_no, model, axiom_type, label, pred,
       case (record_id + line_no) % 8
         when 0 then '判断结果：[' || case pred when 1 then '正确' else '错误' end || ']'
         when 1 then 'x 判断结果 : ' || case pred when 1 then '正确' else '错误' end
         when 2 then '判断结果 ' || case pred when 1 then '正确' else '错误' end
         when 3 then 'Judgment Result: ' || case pred when 1 then 'Correct' else 'Incorrect' end || chr(10)
              || 'Explanation: seen in ' || record_id || chr(10) || 'and more '
         when 4 then 'judgment result： [' || case pred when 1 then 'correct' else 'incorrect' end || ']'
         when 5 then '判断结果：错误' || chr(10) || '解释： 因为 ' || record_id
         when 6 then '判断结果 正确 错误' else 'no verdict' end as raw
from {v_judgements}
""")
_view("v_label_text", """
select model, axiom_type,
       case when label = 1 then case line_no % 4 when 0 then '1' when 1 then ' 1.0 ' when 2 then 'True' else 'YES' end
            else case line_no % 4 when 0 then '0' when 1 then 'incorrect' when 2 then 'no' else 'maybe' end end as label,
       case when pred is null then null when pred = 1 then case record_id % 3 when 0 then 'correct' when 1 then '1' else '2' end
            else case record_id % 2 when 0 then 'False' else '0.0' end end as pred
from {v_judgements}
""")
_view("v_variants", """
select l_orderkey as original_id, l_suppkey % 5 as task_id,
       case when l_orderkey % 2 = 0 then 1 else 0 end as original_pred,
       case when l_quantity > 49 then 'failed' else 'success' end as run_status,
       case when l_quantity > 49 then null when l_discount < 0.085 then cast(l_orderkey % 2 = 0 as int)
            else cast(l_orderkey % 2 = 1 as int) end as pred
from {lineitem}
""")
_view("v_quality_judgements", """
select d.lang as model, l.quality as label, case when d.n_chars > 800 then 1 else 0 end as pred
from {labels} l join {documents} d on l.doc_id = d.doc_id
""")

# ---- service tables --------------------------------------------------------
_view("v_tasks", """
select c_custkey as id, 'run ' || c_mktsegment || ' ' || c_custkey as task_name, c_nationkey as dataset_id,
       c_custkey % 100 as model_id, c_custkey % 7 as prompt_id,
       case c_custkey % 4 when 0 then 'success' when 1 then 'completed' when 2 then 'running' else 'pending' end as task_status,
       c_custkey % 10 as total_count, cast('2024-01-01' as timestamp) as created_time
from {customer}
""")
_view("v_dataset_dim", "select n_nationkey as id, n_name as name from {nation}")
_view("v_model_dim", "select s_suppkey as id, s_name as name from {supplier}")
_view("v_prompt_dim", "select r_regionkey as id, r_name as name from {region}")
_view("v_results", f"""
select o_orderkey as id, o_custkey as task_id, o_orderkey as record_id, {TYPE5.format('o_orderkey')} as axiom_type,
       'Cust' || o_custkey as subject, 'Nation' || (o_custkey % 25) as object,
       case o_orderstatus when 'O' then 1 when 'F' then 0 else case when o_orderkey % 3 = 0 then null else 1 end end as true_label,
       case cast(floor(o_totalprice) as bigint) % 3 when 0 then 0 when 1 then 1 else null end as predict_label,
       case when cast(floor(o_totalprice) as bigint) % 3 = 2 then 'failed' else 'success' end as run_status,
       o_orderdate as created_time,
       case o_orderkey % 3 when 0 then 'concept_modeling' when 1 then 'semantic_network' else 'term_refinement' end as layer_name
from {{orders}}
""")
_view("v_annotations", """
select case when axiom_type = 'range' then -id - 1 else id end as result_id, task_id, id * 2 as seq,
       case when id % 4 = 0 then null when id % 3 = 0 then 1 else 0 end as explanation_correct_label,
       case when id % 5 = 0 then null when id % 7 = 0 then 1 else 0 end as hallucination_label,
       case when id % 4 = 0 or id % 5 = 0 then 'pending' else 'completed' end as annotation_status,
       case id % 3 when 0 then 'correct' when 1 then 'wrong' else 'hallucination' end as explanation_label
from {v_results}
""")
_view("v_stability_tasks", """
select o_orderkey as id, o_custkey as base_task_id, o_orderdate as created_time,
       cast(o_orderkey % 100 as double) / 100 as hard_consistency,
       cast(o_orderkey % 25 as double) / 100 as soft_consistency
from {orders}
""")

# ---- documents as lines, terms, triples, axioms ---------------------------
_view(
    "v_lines",
    r"select doc_id, cast(pos as bigint) as pos, line from (select doc_id, posexplode(split(text, '\n')) as (pos, line) from {documents})",
    "select doc_id, unnest(range(len(a))) as pos, unnest(a) as line from "
    "(select doc_id, string_split(text, chr(10)) as a from {documents})",
)
# What follows the second and the third word of a line, whole.
REST3 = "substr(line, length(split_part(line, ' ', 1)) + length(split_part(line, ' ', 2)) + 3)"
REST4 = "substr(line, length(split_part(line, ' ', 1)) + length(split_part(line, ' ', 2)) + length(split_part(line, ' ', 3)) + 4)"
_view("v_doc_triples", f"""
select doc_id, pos, split_part(line, ' ', 1) as subject, split_part(line, ' ', 2) as relation,
       {REST3} as object,
       case when pos % 9 = 8 then '' else 'c' || cast(floor(pos / 4.0) as bigint) end as chunk,
       case when pos % 9 = 8 then ' ' else line end as context
from {{v_lines}}
""")
_view("v_doc_terms", f"""
select doc_id, pos * 2 as pos, {REST4} as term from {{v_lines}}
union all select doc_id, pos * 2 + 1, split_part(line, ' ', 1) || ' ' from {{v_lines}}
""")
_view("v_votes", """
select doc_id, subject as original, case pos % 3 when 0 then 'N' || subject when 1 then '' else lower(subject) end as normalized,
       case pos % 4 when 0 then 'Class' when 1 then 'Instance' when 2 then '' else 'Property' end as type
from {v_doc_triples}
union all select doc_id, object, case pos % 2 when 0 then object || 'x' else lower(object) end, 'Class' from {v_doc_triples}
union all select doc_id, 'unlisted' || pos, 'never', 'Class' from {v_doc_triples}
""")
_CHUNK_ROWS = """
select doc_id, 'c' || cast(floor(pos / 4.0) as bigint) as chunk_id, %s as text,
       min(cast(floor(pos / 8.0) as bigint)) + 1 as page_start,
       min(cast(floor(pos / 8.0) as bigint)) + 1 + min(cast(floor(pos / 4.0) as bigint)) %% 2 as page_end
from {v_lines} group by doc_id, 'c' || cast(floor(pos / 4.0) as bigint)
"""
_view("v_chunks", _CHUNK_ROWS % "listagg(line, chr(10)) within group (order by pos)",
      _CHUNK_ROWS % "string_agg(line, chr(10) order by pos)")
_view("v_chunk_axioms", """
select doc_id, pos, chunk,
       case pos % 6 when 0 then 'Class' when 1 then 'Property' when 2 then 'subClassOf' when 3 then 'subPropertyOf'
            when 4 then 'domain' else 'range' end as axiom_type,
       case pos % 6 when 0 then subject when 2 then subject else relation end as item1,
       case pos % 6 when 0 then '' when 1 then '' when 4 then subject else object end as item2
from {v_doc_triples} where subject <> '' and relation <> '' and object <> ''
""")
_view("v_doc_axioms", """
select distinct doc_id, case when doc_id % 3 = 0 then 'baseline' else 'three_layer' end as method, axiom_type,
       case when pos % 13 = 12 then 'Zz' || item1 else item1 end as item1, item2
from {v_chunk_axioms}
""")
_view("v_domains", """
select doc_id, case doc_id % 3 when 0 then 'medical' when 1 then 'geography' else 'transportation' end as domain from {documents}
""")

# ---- sections, headings, pages --------------------------------------------
_view("v_sections", """
select doc_id, case doc_id % 3 when 0 then '2.1 Main  Results' when 1 then 'Abstract' else '4. ' || lang || '-Part' end as title, text
from {documents}
""")
_view("v_doc_pages", "select source as doc_id, doc_id as page_no, text from {documents}")
_view("v_headings", """
select doc_id, pos,
       case pos % 5 when 0 then cast(pos + 1 as string) || '. ' || line when 1 then 'abstract ' || pos
            when 2 then lower(line) when 3 then line
            else case when doc_id % 4 = 0 and pos > 6 then 'References' else line end end as title,
       cast(pos % 3 as int) + 1 as level, cast(floor(pos / 3.0) as bigint) as page
from {v_lines}
""")
_view("v_page_totals", """
select doc_id, max(cast(floor(pos / 3.0) as bigint)) + 2 as total_pages from {v_lines} group by doc_id
""")

# ---- service axioms and hierarchy edges -----------------------------------
_view("v_service_axioms", """
select o_orderkey as id, o_custkey % 50 as task_id, 'layered' as execution_mode, 'concept_modeling' as source_layer,
       case o_orderkey % 6 when 0 then 'class' when 1 then 'property' when 2 then 'subClassOf' when 3 then 'subPropertyOf'
            when 4 then 'domain' else 'range' end as axiom_type,
       case when o_orderkey % 97 = 0 then '' else 'term ' || (o_custkey % 211) end as subject_term,
       case when o_orderkey % 6 < 2 then null else 't-' || (o_orderkey % 61) end as object_term,
       'axiom ' || o_orderkey as axiom_text,
       case when o_orderkey % 6 < 2 then null when o_orderkey % 19 = 0 then 'broken'
            else '{{"sub": "a' || o_orderkey || '"}}' end as payload_json
from {orders}
""")
_view("v_hierarchy", """
select 'three_layer' as method, case c_custkey % 3 when 0 then 'medical' when 1 then 'geography' else 'transportation' end as domain,
       'subClassOf' as axiom_type, ' C' || c_custkey as sub, 'C' || cast(floor(c_custkey / 2.0) as bigint) || ';' as super
from {customer}
union all select 'baseline', case c_custkey % 3 when 0 then 'medical' when 1 then 'geography' else 'transportation' end,
       'subClassOf', 'C' || c_custkey, 'C' || cast(floor(c_custkey / 3.0) as bigint) from {customer}
union all select 'three_layer', 'medical', 'subClassOf', 'C' || c_custkey, 'C' || (c_custkey + 1) from {customer} where c_mktsegment = 'BUILDING'
union all select 'three_layer', 'medical', 'subClassOf', 'C' || (c_custkey + 1), 'C' || c_custkey from {customer} where c_mktsegment = 'BUILDING'
union all select 'three_layer', 'geography', 'subClassOf', 'C' || c_custkey, ' ' from {customer} where c_mktsegment = 'FURNITURE'
union all select 'three_layer', 'geography', 'subPropertyOf', 'p' || s_suppkey,
       'p' || cast(floor(s_suppkey / 3.0) as bigint) from {supplier}
""")
