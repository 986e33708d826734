"""Queries of detection and normalisation over the transcript tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.dialects.normalise import content_ids, normalise, to_lines
from spanloom.operators import dispatch, events
from spanloom.sources.detect import detect
from spanloom.runtime import materialize, table


def _rows(df: DataFrame, tape, line, *cols: str) -> DataFrame:
    return df.select(tape.alias("tape_id"), line.cast("bigint").alias("line_no"), F.to_json(F.struct(*cols)).alias("raw")).where("tape_id is not null")


def claude_lines(spark: SparkSession, d: str) -> DataFrame:
    return _rows(table(spark, d, "claude_adapter_input"), F.col("file_name"), F.col("row_id"), "type", "session_id", "timestamp", "message")


def codex_lines(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supported_paths").where("dialect = 'codex'")
    return _rows(df, F.coalesce("session_id", F.lit("none")), F.col("row_id"), "timestamp", "type", "session_id", "payload")


def cursor_lines(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supported_paths").where("dialect = 'cursor'")
    return _rows(df, F.coalesce("session_id", F.lit("none")), F.col("row_id"), "timestamp", "type", "subtype", "session_id", "model", "message", "call_id", "tool_call")


def gemini_lines(spark: SparkSession, d: str) -> DataFrame:
    return _rows(table(spark, d, "session_with_tools"), F.concat(F.lit("gemini/"), F.col("row_id").cast("string")), F.lit(0), "sessionId", "projectHash", "startTime", "lastUpdated", "messages")


def opencode_lines(spark: SparkSession, d: str) -> DataFrame:
    return _rows(table(spark, d, "session_export"), F.concat(F.lit("opencode/"), F.col("row_id").cast("string")), F.lit(0), "info", "messages")


def openclaw_lines(spark: SparkSession, d: str) -> DataFrame:
    return _rows(table(spark, d, "session_log"), F.col("session_id"), F.col("row_id"), "type", "id", "timestamp", "session_id", "message")


LINES = {"claude": claude_lines, "codex": codex_lines, "cursor": cursor_lines, "gemini": gemini_lines, "opencode": opencode_lines, "openclaw": openclaw_lines}


def _counts(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return normalise(LINES[name](spark, d), name).groupBy("tape_id", "k").agg(F.count("*").alias("n"))

    run.__doc__ = f"Events of each kind of each {name} session."
    return run


_CONTENT = ("content", "args", "stdout", "stderr", "text", "before_text", "after_text")


def _content(name: str, *kinds: str, columns: tuple[str, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        events_ = normalise(LINES[name](spark, d), name).where(F.col("k").isin(*kinds))
        at = {"first": F.col("range")[0], "last": F.col("range")[1]}
        return events_.select("tape_id", "k", *[F.md5(c).alias(f"{c}_md5") if c in _CONTENT else at[c].alias(c) if c in at else F.col(c) for c in columns])

    run.__doc__ = f"What the {name} sessions' events hold: {', '.join(columns)} of {', '.join(kinds)}."
    return run


def dialect_gemini_log(spark: SparkSession, d: str) -> DataFrame:
    """The messages of sessions written as logs, which are arrays of messages without tools."""
    m = F.transform("messages", lambda m, i: F.struct(F.col("sessionId"), i.alias("messageId"), m["type"].alias("type"), m["content"].alias("message"), m["timestamp"].alias("timestamp")))
    rows = table(spark, d, "session_with_tools").where("size(messages) > 0")
    lines = rows.select(F.concat(F.lit("log/"), F.col("row_id").cast("string")).alias("tape_id"), F.lit(0).cast("bigint").alias("line_no"), F.to_json(m).alias("raw"))
    return normalise(lines, "gemini").where("k <> 'meta'").select("tape_id", "k", F.md5("content").alias("content_md5"))


def marker_links_deep(spark: SparkSession, d: str) -> DataFrame:
    """Hand-off links of messages with a marker each: on the surface of even rows, three levels deep in a tool call of odd ones."""
    h = F.md5(F.col("row_id").cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    rows = table(spark, d, "session_log").where("session_id is not null").select("session_id", "row_id", F.concat(F.lit('go on <dispatch-src id="'), uuid, F.lit('"/>')).alias("mark"))
    surface = F.to_json(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("mark").alias("text"))).alias("content")))
    prompt = F.struct(F.array(F.struct(F.col("mark").alias("prompt"))).alias("tasks"))
    deep = F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("toolCall").alias("type"), prompt.alias("arguments"))).alias("content")))
    return dispatch.dispatch_links(rows.select(F.col("session_id").alias("tape_id"), F.col("row_id").alias("line_no"), F.when(F.col("row_id") % 2 == 0, surface).otherwise(deep).alias("raw")))


def detect_dialects(spark: SparkSession, d: str) -> DataFrame:
    """The dialect of each transcript file; the cut lines of some files leave them unclaimed."""
    files = table(spark, d, "transcript_files")
    lines = table(spark, d, "transcript_lines").join(files.select("file_id", "file_name"), "file_id")
    found = detect(lines.select(F.col("file_name").alias("tape_id"), "line_no", "raw"))
    return found.groupBy("dialect").agg(F.count("*").alias("n_files"))


def complete_prefix(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "transcript_lines").select(F.col("file_id").alias("tape_id"), "line_no", F.coalesce("raw", F.lit("")).alias("raw"))
    return events.complete_prefix(lines).groupBy("tape_id").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"))


def tape_identity(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each transcript file's lines."""
    lines = table(spark, d, "transcript_lines").where("raw is not null").select(F.col("file_id").alias("tape_id"), "line_no", "raw")
    return content_ids(lines)


def marker_links(spark: SparkSession, d: str) -> DataFrame:
    """Hand-off links of messages into which markers were written: each log message tells its session's name hashed to an id."""
    h = F.md5("session_id")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    rows = table(spark, d, "session_log").where("session_id is not null").select("session_id", "row_id", uuid.alias("uuid"))
    text = F.concat(F.lit('take over <dispatch-src id="'), F.col("uuid"), F.lit('"/> now'))
    raw = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.lit("user").alias("role"), text.alias("content")).alias("message")))
    return dispatch.dispatch_links(rows.select(F.col("session_id").alias("tape_id"), F.col("row_id").alias("line_no"), raw.alias("raw")))


def normalised_lines(spark: SparkSession, d: str) -> DataFrame:
    """The normalised logs of all dialects as text, read back strictly: events of each kind and dialect."""
    out = None
    for name, lines in LINES.items():
        text, _ = materialize(to_lines(normalise(lines(spark, d), name)), "normal")  # a plan for each dialect instead of one for all
        rows = events.parse_strict(text).groupBy("k").agg(F.count("*").alias("n")).select(F.lit(name).alias("dialect"), "k", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


_MESSAGES = ("msg.in", "msg.out")
_WHOLE = ("tool", "call_id", "file", "exit", "content", "stdout", "stderr", "text", "before_text", "after_text")
CONTENTS = {
    "gemini_content": _content("gemini", *_MESSAGES, "tool.call", "tool.result", "code.read", "code.edit", columns=_WHOLE),
    "opencode_content": _content("opencode", *_MESSAGES, "tool.call", "tool.result", "code.read", columns=("tool", "call_id", "file", "first", "last", "exit", "content", "stdout", "stderr", "text")),
    "claude_content": _content("claude", *_MESSAGES, "tool.call", columns=("tool", "call_id", "content")),
    "codex_content": _content("codex", *_MESSAGES, "tool.call", "tool.result", columns=("call_id", "exit", "content", "args", "stdout")),
    "cursor_content": _content("cursor", *_MESSAGES, "tool.call", columns=("call_id", "content")),
    "openclaw_content": _content("openclaw", *_MESSAGES, "tool.call", "tool.result", columns=("call_id", "exit", "content", "stdout", "stderr")),
}
QUERIES = {f"dialect_{n}": _counts(n) for n in LINES} | CONTENTS | {f.__name__: f for f in (dialect_gemini_log, detect_dialects, complete_prefix, tape_identity, marker_links, marker_links_deep, normalised_lines)}

_GEM = """ m as (select row_id, unnest(messages) as m from session_with_tools), c as (select row_id, unnest(m.toolCalls) as c from m where m is not null),
 ev as (select row_id, 'meta' as k from session_with_tools
   union all select row_id, case when m.type = 'user' then 'msg.in' else 'msg.out' end from m where m.content <> ''
   union all select row_id, unnest(['tool.call', 'tool.result']) from c where c is not null
   union all select row_id, 'code.read' from c where c.name = 'read_file' and c.args.file_path <> ''
   union all select row_id, 'code.edit' from c where c.name in ('write_file', 'replace') and c.args.file_path <> '')"""
#: A JSON array's elements that are text, or the first text of those that are objects, as one text with a line each.
_TEXT_OF = "(select string_agg(t, chr(10) order by i) from (select i, case json_type(x) when 'VARCHAR' then x->>'$' when 'OBJECT' then coalesce(case when json_type(x, '$.text') = 'VARCHAR' then x->>'$.text' end, case when json_type(x, '$.input_text') = 'VARCHAR' then x->>'$.input_text' end, case when json_type(x, '$.output_text') = 'VARCHAR' then x->>'$.output_text' end) end as t from (select unnest(json_extract({a}, '$[*]')) as x, generate_subscripts(json_extract({a}, '$[*]'), 1) as i)) where t is not null)"
_IS_ARRAY = r"(regexp_matches({c}, '^\s*\[') and json_valid({c}) and json_type(case when json_valid({c}) then {c} else '[]' end) = 'ARRAY')"


def _is_array(c: str) -> str:
    return f"coalesce({_IS_ARRAY.format(c=c)}, false)"


_GEMINI_CONTENT = """with m as (select row_id, unnest(messages) as m from session_with_tools), c as (select row_id, unnest(m.toolCalls) as c from m where m is not null),
 r as (select row_id, c, coalesce(nullif(c.name, ''), 'unknown') as name, coalesce(array_to_string(list_filter(list_transform(c.result, lambda x: x.functionResponse.response.output), lambda x: x is not null), chr(10)), '') as o,
   coalesce(array_to_string(list_filter(list_transform(c.result, lambda x: x.functionResponse.response.error), lambda x: x is not null), chr(10)), '') as err from c where c is not null),
 s as (select *, case when o <> '' then o when err <> '' then '' else coalesce(c.resultDisplay, '') end as out from r)
 select 'gemini/' || row_id as tape_id, case when m.type = 'user' then 'msg.in' else 'msg.out' end as k, null as tool, null as call_id, null as file, null::int as exit, md5(m.content) as content_md5, null as stdout_md5, null as stderr_md5, null as text_md5, null as before_text_md5, null as after_text_md5 from m where m.content <> ''
 union all select 'gemini/' || row_id, 'tool.call', name, c.id, null, null, null, null, null, null, null, null from s
 union all select 'gemini/' || row_id, 'tool.result', name, c.id, null, (c.status is distinct from 'success' or err <> '')::int, null, md5(out), md5(nullif(err, '')), null, null, null from s
 union all select 'gemini/' || row_id, 'code.read', null, null, c.args.file_path, null, null, null, null, md5(nullif(out, '')), null, null from s where name = 'read_file' and c.args.file_path <> ''
 union all select 'gemini/' || row_id, 'code.edit', null, null, c.args.file_path, null, null, null, null, null, case when name = 'replace' then md5(c.args.old_string) end, md5(case when name = 'replace' then c.args.new_string else c.args.content end) from s where name in ('write_file', 'replace') and c.args.file_path <> ''"""
_OPENCODE_CONTENT = """with m as (select row_id, unnest(messages) as m from session_export), p as (select row_id, m.info.role as role, unnest(m.parts) as p from m where m is not null),
 t as (select row_id, p, coalesce(nullif(p.tool, ''), 'unknown') as name, p.state.input.filePath as f, coalesce(p.state.input."offset", 0) + 1 as a, p.state.input."limit" as n from p where p.type = 'tool')
 select 'opencode/' || row_id as tape_id, case when role = 'assistant' then 'msg.out' else 'msg.in' end as k, null as tool, null as call_id, null as file, null::int as first, null::int as last, null::int as exit, md5(p.text) as content_md5, null as stdout_md5, null as stderr_md5, null as text_md5 from p where p.type = 'text' and p.text <> ''
 union all select 'opencode/' || row_id, 'tool.call', name, p.callID, null, null, null, null, null, null, null, null from t
 union all select 'opencode/' || row_id, 'tool.result', name, p.callID, null, null, null, (p.state.status = 'error')::int, null, md5(p.state.output), md5(p.state.error), null from t where p.state.status in ('completed', 'error')
 union all select 'opencode/' || row_id, 'code.read', null, null, f, a::int, greatest(a, coalesce(a + n - 1, a))::int, null, null, null, null, md5(p.state.output) from t where name = 'read' and f <> ''"""
_CLAUDE_CONTENT = f"""with r as (select file_name as tape_id, type, message.content as c, {_is_array("message.content")} as arr from claude_adapter_input where file_name is not null and message is not null),
 b as (select tape_id, unnest(json_extract(c, '$[*]')) as b from r where arr and type = 'assistant')
 select tape_id, 'msg.in' as k, null as tool, null as call_id, md5(c) as content_md5 from r where type = 'user' and not arr and c is not null
 union all select tape_id, 'msg.out', null, null, md5(c) from r where type = 'assistant' and not arr and c <> ''
 union all select tape_id, 'msg.out', null, null, md5(b->>'$.text') from b where b->>'$.type' = 'text' and json_type(b, '$.text') = 'VARCHAR' and b->>'$.text' <> ''
 union all select tape_id, 'tool.call', coalesce(nullif(b->>'$.name', ''), 'unknown'), b->>'$.id', null from b where b->>'$.type' = 'tool_use'"""
_CODEX_CONTENT = rf"""with r as (select coalesce(session_id, 'none') as tape_id, payload as p, {_is_array("payload.content")} as arr from supported_paths where dialect = 'codex' and type = 'response_item'),
 m as (select tape_id, p.role as role, case when arr then {_TEXT_OF.format(a="p.content")} else p.content end as t from r where p.type = 'message')
 select tape_id, case when role = 'assistant' then 'msg.out' else 'msg.in' end as k, null as call_id, null::int as exit, md5(t) as content_md5, null as args_md5, null as stdout_md5 from m where t <> ''
 union all select tape_id, 'tool.call', p.call_id, null, null, md5(coalesce(p.arguments, p.input, 'null')), null from r where p.type in ('function_call', 'custom_tool_call')
 union all select tape_id, 'tool.result', p.call_id, try_cast(nullif(regexp_extract(coalesce(p.output, ''), '(?m)^\s*Process exited with code (-?\d+)\s*$', 1), '') as int), null, null, md5(coalesce(p.output, '')) from r where p.type in ('function_call_output', 'custom_tool_call_output')"""
_CURSOR_CONTENT = """select coalesce(session_id, 'none') as tape_id, case when type = 'user' then 'msg.in' else 'msg.out' end as k, null as call_id, md5(message.content) as content_md5 from supported_paths where dialect = 'cursor' and type in ('user', 'assistant') and message.content <> ''
 union all select coalesce(session_id, 'none'), 'tool.call', call_id, null from supported_paths where dialect = 'cursor' and type = 'tool_call' and subtype = 'started'"""
_OPENCLAW_CONTENT = f"""with r as (select session_id as tape_id, case when json_valid(message) then message::json end as j from session_log where session_id is not null and type = 'message'),
 q as (select tape_id, j, j->>'$.role' as role, case json_type(j, '$.content') when 'ARRAY' then json_extract(j, '$.content') when 'VARCHAR' then case when {_is_array("(j->>'$.content')")} then (j->>'$.content')::json end end as a, case json_type(j, '$.content') when 'VARCHAR' then j->>'$.content' end as s from r where json_type(j) = 'OBJECT'),
 b as (select tape_id, unnest(json_extract(a, '$[*]')) as b from q where role in ('user', 'assistant') and a is not null),
 m as (select tape_id, role, case when a is null then s else (select string_agg(x->>'$.text', chr(10) order by i) from (select unnest(json_extract(a, '$[*]')) as x, generate_subscripts(json_extract(a, '$[*]'), 1) as i) where x->>'$.type' = 'text' and json_type(x, '$.text') = 'VARCHAR') end as t from q where role in ('user', 'assistant')),
 t as (select tape_id, j, coalesce(case when a is null then s else {_TEXT_OF.format(a="a")} end, '') as o, coalesce(json_type(j, '$.isError') = 'BOOLEAN' and (j->>'$.isError') = 'true', false) as bad from q where role = 'toolResult')
 select tape_id, case when role = 'user' then 'msg.in' else 'msg.out' end as k, null as call_id, null::int as exit, md5(t) as content_md5, null as stdout_md5, null as stderr_md5 from m where t <> ''
 union all select tape_id, 'tool.call', case when json_type(b, '$.id') = 'VARCHAR' then b->>'$.id' end, null, null, null, null from b where json_type(b) = 'OBJECT' and b->>'$.type' = 'toolCall'
 union all select tape_id, 'tool.result', case when json_type(j, '$.toolCallId') = 'VARCHAR' then j->>'$.toolCallId' end, bad::int, null, case when not bad then md5(o) end, case when bad then md5(o) end from t"""

SQL = {
    "gemini_content": _GEMINI_CONTENT, "opencode_content": _OPENCODE_CONTENT, "claude_content": _CLAUDE_CONTENT, "codex_content": _CODEX_CONTENT, "cursor_content": _CURSOR_CONTENT, "openclaw_content": _OPENCLAW_CONTENT,
    "dialect_gemini_log": """select 'log/' || row_id as tape_id, case when m.type = 'user' then 'msg.in' else 'msg.out' end as k, md5(m.content) as content_md5 from (select row_id, unnest(messages) as m from session_with_tools) where m.content is not null and m.type in ('user', 'gemini')""",
    "marker_links_deep": """with h as (select session_id, row_id, md5(row_id::varchar) as h from session_log where session_id is not null)
      select session_id as tape_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as uuid, row_number() over (partition by session_id order by row_id) - 1 as first_turn_index, case when row_id % 2 = 0 then 'received' else 'sent' end as direction from h""",
    "detect_dialects": r"""with l as (select file_name, case when json_valid(raw) then raw::json end as j from transcript_lines join transcript_files using (file_id) where trim(raw) <> ''),
      s as (select file_name, bool_and(j is not null) as all_json, coalesce(bool_or(j->>'$.type' in ('user', 'assistant') and json_type(j, '$.message') = 'OBJECT'), false) as claude, coalesce(bool_or(j->>'$.type' in ('user', 'assistant') and json_type(j, '$.session_id') = 'VARCHAR' and json_type(j, '$.message.content') = 'VARCHAR'), false) as cursor from l group by 1)
      select case when all_json and claude then 'claude' when all_json and cursor then 'cursor' end as dialect, count(*) as n_files from s group by 1""",
    "dialect_gemini": f"with {_GEM} select 'gemini/' || row_id as tape_id, k, count(*) as n from ev group by all",
    "complete_prefix": """with l as (select file_id, line_no, coalesce(raw, '') as raw from transcript_lines), b as (select file_id, min(line_no) as bad from l where trim(raw) <> '' and not json_valid(raw) group by 1)
      select l.file_id as tape_id, count(*) as n_lines, max(line_no) as last_line from l left join b using (file_id) where bad is null or line_no < bad group by 1""",
    "tape_identity": "select file_id as tape_id, sha256(string_agg(raw || chr(10), '' order by line_no, raw)) as content_id from transcript_lines where raw is not null group by 1",
    "marker_links": """with h as (select session_id, row_id, md5(session_id) as h from session_log where session_id is not null)
      select session_id as tape_id, any_value(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) as uuid, 0::bigint as first_turn_index, 'received' as direction from h group by 1""",
}
