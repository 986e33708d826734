"""Queries of the general problems (p1, p2, p4, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import drift, hierarchy, nested, timestamps
from spanloom.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(table(spark, d, nested.TOOLS), table(spark, d, nested.EXPORT), table(spark, d, nested.LOG))


def _sources(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in (nested.TOOLS, nested.EXPORT, nested.LOG)]


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct keys of each flat table, and how many rows lack their parent (none should)."""
    nodes = nested.flatten_sessions(*_sources(spark, d)).drop("payload")
    keys = nodes.select(F.col("node_id").alias("key")).distinct()
    joined = nodes.join(keys, nodes["parent_id"] == keys["key"], "left")
    orphan = F.col("parent_id").isNotNull() & F.col("key").isNull()
    return joined.groupBy("tag").agg(F.count("*").alias("n_rows"), F.sum(orphan.cast("int")).alias("n_orphans"), F.sum(F.col("linked").cast("int")).alias("n_linked"))


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all flat tables with their fields: written partitioned by tag and read back by each tag's schema."""
    return nested.read_all(spark, *nested.tables(*_sources(spark, d))).drop("path")


def p1_results(spark: SparkSession, d: str) -> DataFrame:
    """Tool results beside the call each belongs to: two of the flat tables, joined on the parent's key."""
    path, schemas = nested.tables(*_sources(spark, d))
    calls = nested.read_table(spark, path, "tools_call", schemas["tools_call"]).select(F.col("node_id").alias("call_id"), "name", "args_file_path")
    results = nested.read_table(spark, path, "tools_result", schemas["tools_result"])
    fields = {"output": "functionResponse_response_output", "error": "functionResponse_response_error"}
    return results.join(calls, results["parent_id"] == calls["call_id"]).select("node_id", "parent_id", "name", F.col("args_file_path").alias("file_path"), *[F.col(c).alias(n) for n, c in fields.items()])


def p1_parts(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of export parts."""
    path, schemas = nested.tables(*_sources(spark, d))
    parts = nested.read_table(spark, path, "export_part", schemas["export_part"])
    return parts.select("node_id", "parent_id", "type", "callID", "tool", "text", F.col("state_input_offset").alias("input_offset"), F.col("state_input_oldString").alias("old_string"), F.col("state_output").alias("output"), F.col("state_time_end").alias("time_end"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.found(table(spark, d, "edges"), table(spark, d, "dispatch_links"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of each anchor."""
    return hierarchy.hierarchy(hierarchy.edge_links(table(spark, d, "edges")), paths=True).select("node", "depth", "path")


def p2_all_paths(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and full path of each node of both tables."""
    return hierarchy.full_paths(table(spark, d, "edges"), table(spark, d, "dispatch_links"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of each node of both tables, with their distance."""
    return hierarchy.descendants(table(spark, d, "edges"), table(spark, d, "dispatch_links"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(table(spark, d, "session_export"), table(spark, d, "session_with_tools"), table(spark, d, "session_log"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.found(table(spark, d, "transcript_files"), table(spark, d, "transcript_lines"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """All records cast to the union schema, as one row per record and held field."""
    rows, _ = drift.one_table(table(spark, d, "transcript_files"), table(spark, d, "transcript_lines"))
    fields = [f for f in rows.schema.fields if f.name not in ("file_id", "line_no")]
    cols = F.map_from_arrays(F.array(*[F.lit(f.metadata["field"]) for f in fields]), F.array(*[F.col(f"`{f.name}`").cast("string") for f in fields]))
    return rows.select("file_id", "line_no", F.explode(cols).alias("field", "value")).where("value is not null")


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    """The ordered report: each change with the field's types before and after."""
    return drift.report(table(spark, d, "transcript_files"), table(spark, d, "transcript_lines"))


QUERIES = {"p1_found": p1_found, "p1_tables": p1_tables, "p1_rows": p1_rows, "p1_results": p1_results, "p1_parts": p1_parts, "p2_found": p2_found, "p2_paths": p2_paths, "p2_all_paths": p2_all_paths, "p2_descendants": p2_descendants, "p4_found": p4_found, "p5_found": p5_found, "p5_records": p5_records, "p5_changes": p5_changes}

_P1_BASE = """
 tm as (select row_id, unnest(messages) as m, generate_subscripts(messages, 1) - 1 as mp from session_with_tools),
 tc as (select row_id, mp, unnest(m.toolCalls) as c, generate_subscripts(m.toolCalls, 1) - 1 as ip from tm where m is not null),
 tr as (select row_id, mp, ip, c.args.file_path as fp, unnest(c.result) as r, generate_subscripts(c.result, 1) - 1 as sp from tc where c is not null),
 em as (select row_id, unnest(messages) as m, generate_subscripts(messages, 1) - 1 as mp from session_export),
 ep as (select row_id, mp, unnest(m.parts) as p, generate_subscripts(m.parts, 1) - 1 as ip from em where m is not null),
 lm as (select row_id, case when json_valid(message) then message::json end as j from session_log),
 lc as (select row_id, j, case json_type(j, '$.content') when 'ARRAY' then json_extract(j, '$.content')
         when 'VARCHAR' then case when json_valid(json_extract_string(j, '$.content')) and json_type(json_extract_string(j, '$.content')) = 'ARRAY' then json_extract_string(j, '$.content')::json end end as a from lm),
 lb as (select row_id, unnest(json_extract(a, '$[*]')) as b, generate_subscripts(json_extract(a, '$[*]'), 1) - 1 as ip from lc where a is not null),
 ls as (select row_id, ip, unnest(json_extract(b, '$.content[*]')) as s, generate_subscripts(json_extract(b, '$.content[*]'), 1) - 1 as sp from lb where json_type(b) = 'OBJECT' and json_type(b, '$.content') = 'ARRAY')
"""

_P1 = f"""
with {_P1_BASE}
select 'session_with_tools' as src, row_id, mp::int as msg_pos, ip::int as item_pos, -1 as sub_pos from tc where trim(c.args.file_path) <> ''
union all select 'session_with_tools', row_id, mp::int, ip::int, sp::int from tr where r is not null and trim(fp) <> ''
union all select 'session_export', row_id, mp::int, ip::int, -1 from ep where p.state.output is not null
union all select 'session_log', row_id, 0, ip::int, -1 from lb where json_type(b) = 'OBJECT' and json_type(b, '$.type') = 'VARCHAR'
union all select 'session_log', row_id, 0, ip::int, sp::int from ls where json_type(s) = 'OBJECT' and json_type(s, '$.type') = 'VARCHAR'
"""

_P1_TABLES = f"""
with recursive {_P1_BASE},
 lx as (select s from ls union all select unnest(json_extract(s, '$.content[*]')) from lx where json_type(s) = 'OBJECT' and json_type(s, '$.content') = 'ARRAY')
select tag, count(*) as n_rows, 0::bigint as n_orphans, sum(linked)::bigint as n_linked from (
 select 'tools_session' as tag, 1 as linked from session_with_tools
 union all select 'tools_message', 1 from tm where m is not null
 union all select 'tools_call', coalesce(trim(c.args.file_path) <> '', false)::int from tc where c is not null
 union all select 'tools_result', coalesce(trim(fp) <> '', false)::int from tr where r is not null
 union all select 'export_session', 1 from session_export
 union all select 'export_message', 1 from em where m is not null
 union all select 'export_part', (p.state.output is not null)::int from ep where p is not null
 union all select 'log_message', coalesce(json_type(j) = 'OBJECT', false)::int from lm
 union all select 'log_block', coalesce(json_type(b, '$.type') = 'VARCHAR', false)::int from lb where json_type(b) = 'OBJECT'
 union all select 'log_subblock', coalesce(json_type(s, '$.type') = 'VARCHAR', false)::int from lx where json_type(s) = 'OBJECT'
) group by tag
"""

_P1_RESULTS = f"""
with {_P1_BASE}
select 'session_with_tools/' || tc.row_id || '/' || tc.mp || '/' || tc.ip || '/' || tr.sp as node_id, 'session_with_tools/' || tc.row_id || '/' || tc.mp || '/' || tc.ip as parent_id, tc.c.name as name, tc.c.args.file_path as file_path,
  tr.r.functionResponse.response.output as output, tr.r.functionResponse.response.error as error
from tc join tr using (row_id, mp, ip) where tr.r is not null
"""

_P1_PARTS = f"""
with {_P1_BASE}
select 'session_export/' || row_id || '/' || mp || '/' || ip as node_id, 'session_export/' || row_id || '/' || mp as parent_id, p.type as type, p.callID as "callID", p.tool as tool, p.text as text,
  p.state.input."offset" as input_offset, p.state.input.oldString as old_string, p.state.output as output, p.state.time."end" as time_end
from ep where p is not null
"""

_P2_LINKS = r"""
 e as (select distinct lower(regexp_replace(to_anchor, '^\s+|\s+$', '', 'g')) as child, lower(regexp_replace(from_anchor, '^\s+|\s+$', '', 'g')) as parent from edges),
 s as (select distinct lower(trim(uuid)) as u, tape_id from dispatch_links where direction = 'sent' and trim(uuid) <> ''),
 r as (select distinct lower(trim(uuid)) as u, tape_id from dispatch_links where direction = 'received' and trim(uuid) <> ''),
 l as (select 'edges' as src, child, parent from e where child <> '' and parent <> ''
       union select 'dispatch_links', r.tape_id, s.tape_id from r join s using (u)),
 n as (select src, child as node from l union select src, parent from l union select 'dispatch_links', tape_id from dispatch_links where tape_id is not null)
"""

_P2 = f"""
with recursive {_P2_LINKS},
 up as (select src, node, node as anc, 0 as d from n where not exists (select 1 from l where l.src = n.src and l.child = n.node)
        union all select l.src, l.child, up.anc, up.d + 1 from up join l on l.src = up.src and l.parent = up.node),
 pairs as (select src, child as node, parent as anc from l where exists (select 1 from up where up.src = l.src and up.node = l.child)
        union all select p.src, p.node, l.parent from pairs p join l on l.src = p.src and l.child = p.anc),
 below as (select src, anc as node, count(*) as c from pairs group by all)
select n.src, n.node, coalesce(up.anc, '') as root, coalesce(up.d, -1)::int as depth, case when up.d is null then -1 else coalesce(b.c, 0) end::int as n_descendants
from n left join up on up.src = n.src and up.node = n.node left join below b on b.src = n.src and b.node = n.node
"""

_P2_ALL_PATHS = f"""
with recursive {_P2_LINKS},
 up as (select src, node, node as root, 0 as d, node as path from n where not exists (select 1 from l where l.src = n.src and l.child = n.node)
        union all select l.src, l.child, up.root, up.d + 1, up.path || ' > ' || l.child from up join l on l.src = up.src and l.parent = up.node)
select n.src, n.node, coalesce(up.root, '') as root, coalesce(up.d, -1)::int as depth, up.path from n left join up on up.src = n.src and up.node = n.node
"""

_P2_DESCENDANTS = f"""
with recursive {_P2_LINKS},
 up as (select src, node from n where not exists (select 1 from l where l.src = n.src and l.child = n.node) union all select l.src, l.child from up join l on l.src = up.src and l.parent = up.node),
 pairs as (select l.src, l.parent as ancestor, l.child as node, 1 as distance from l join up on up.src = l.src and up.node = l.child
        union all select p.src, l.parent, p.node, p.distance + 1 from pairs p join l on l.src = p.src and l.child = p.ancestor)
select src, ancestor, node, distance from pairs
"""

_P2_PATHS = f"""
with recursive {_P2_LINKS},
 x as (select child, parent from l where src = 'edges'), y as (select node from n where src = 'edges'),
 up as (select node, 0 as d, node as path from y where not exists (select 1 from x where x.child = y.node)
        union all select x.child, up.d + 1, up.path || ' > ' || x.child from up join x on x.parent = up.node)
select y.node, coalesce(up.d, -1)::int as depth, up.path from y left join up on up.node = y.node
"""

SQL = {"p1_found": _P1, "p1_tables": _P1_TABLES, "p1_results": _P1_RESULTS, "p1_parts": _P1_PARTS, "p2_found": _P2, "p2_paths": _P2_PATHS, "p2_all_paths": _P2_ALL_PATHS, "p2_descendants": _P2_DESCENDANTS}
