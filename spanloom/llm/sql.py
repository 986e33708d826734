"""SQL of the queries for training data, where SQL can say it."""

from __future__ import annotations

_P7 = r"""
with a as (
  select 'claude_adapter_input' as src, min(row_id) as row_id, session_id, timestamp as ts, message.role as role, message.content as c
    from claude_adapter_input where type in ('user', 'assistant') and trim(session_id) <> '' and message is not null group by type, session_id, timestamp, message, file_name
  union all
  select 'supported_paths', min(row_id), session_id, timestamp, message.role, message.content
    from supported_paths where dialect = 'cursor' and type in ('user', 'assistant') and trim(session_id) <> '' and message is not null group by timestamp, type, subtype, session_id, model, payload, message, call_id, tool_call),
b as (select *, coalesce(regexp_matches(c, '^\s*\[\s*([\[{"\]]|$)'), false) as arr from a),
v as (select *, arr and not coalesce(json_valid(c) and json_type(case when json_valid(c) then c else '[]' end) = 'ARRAY', false) as cut, case when arr and json_valid(c) then c else '[]' end as j from b),
t as (select *, case when cut then null when arr then (select string_agg(json_extract_string(x, '$.text'), chr(10)) from (select unnest(json_extract(j, '$[*]')) as x) where json_extract_string(x, '$.type') = 'text' and json_type(x, '$.text') = 'VARCHAR') else c end as tx from v),
r as (select src, session_id, row_id, cut, regexp_replace(coalesce(tx, ''), '\s', '', 'g') <> '' as has, lower(trim(role)) as role, epoch_us(try_cast(ts as timestamptz)) as us from t),
bad as (select distinct src, session_id from r where cut or (has and (coalesce(role not in ('user', 'assistant'), true) or us is null))),
o as (select src, session_id, row_id, role, row_number() over w as turn_no, lag(role) over w as pb, lead(role) over w as pn from r where has and (src, session_id) not in (select (src, session_id) from bad) window w as (partition by src, session_id order by us, row_id)),
k as (select src, session_id from o group by all having not bool_or(role = 'user' and pb = 'user') and not bool_or(pb is null and role <> 'user') and not bool_or(pn is null and role <> 'assistant'))
select src, session_id, turn_no::int as turn_no, row_id from o join k using (src, session_id)
"""

SQL: dict[str, str] = {"p7_found": _P7}
