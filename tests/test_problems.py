"""Nested records, hierarchies, timestamps and drifting schemas: edge cases and brute force."""

import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import drift, hierarchy, nested, timestamps
from spanloom.queries import problems

TOOLS = (
    "row_id BIGINT, sessionId STRING, projectHash STRING, host_tz STRING, startTime STRING, lastUpdated STRING, messages ARRAY<STRUCT<id: STRING, timestamp: STRING, type: STRING, model: STRING, content: STRING, "
    "toolCalls: ARRAY<STRUCT<id: STRING, name: STRING, args: STRUCT<file_path: STRING, content: STRING, old_string: STRING, new_string: STRING, command: STRING, pattern: STRING>, status: STRING, timestamp: STRING, "
    "result: ARRAY<STRUCT<functionResponse: STRUCT<id: STRING, name: STRING, response: STRUCT<output: STRING, error: STRING>>>>, resultDisplay: STRING>>>>"
)
EXPORT = (
    "row_id BIGINT, host_tz STRING, info STRUCT<id: STRING, title: STRING, time: STRUCT<created: STRING>>, messages ARRAY<STRUCT<info: STRUCT<id: STRING, role: STRING, time: STRUCT<created: STRING>>, parts: ARRAY<STRUCT<id: STRING, type: STRING, "
    "text: STRING, callID: STRING, tool: STRING, state: STRUCT<status: STRING, input: STRUCT<filePath: STRING, offset: BIGINT, limit: BIGINT, oldString: STRING, newString: STRING, content: STRING, patchText: STRING>, output: STRING, error: STRING, "
    "time: STRUCT<start: BIGINT, end: BIGINT>>>>>>"
)
LOG = "row_id BIGINT, session_id STRING, line_no BIGINT, host_tz STRING, type STRING, id STRING, timestamp STRING, message STRING, model STRING, level STRING"


def call(path, results):
    return ("c", "read", (path, None, None, None, None, None), "ok", None, results, None)


RESULT = (("f", "read", ("out", None)),)


@pytest.fixture(scope="module")
def sessions(spark):
    messages = [("m0", "t", "user", None, "x", None), None, ("m2", None, "gemini", None, None, [None, call(" a.rs ", [RESULT, None, RESULT]), call("  ", [RESULT]), call("b", None), ("n", None, None, None, None, [RESULT], None)])]
    tools = spark.createDataFrame([(1, "s", None, None, None, None, messages), (2, None, None, None, None, None, None), (3, "s", None, None, None, None, [])], TOOLS).withColumn("tag", F.lit("clash")).withColumn("node_id", F.lit(7))
    state = lambda out: ("completed", None, out, None, None)
    export = spark.createDataFrame([(1, None, None, [(None, [("p", "tool", None, None, None, state("")), None, ("q", "tool", None, None, None, None), ("r", "tool", None, None, None, state(None))]), None]), (2, None, ("i", None, None), None)], EXPORT)
    log = [
        None, "", "{", "3", "[]", '{"content": NaN}', '{"content": "plain"}', '{"content": null}', json.dumps({"content": json.dumps([{"type": "text"}])}),
        json.dumps({"content": [None, {"type": "a", "content": [{"type": "x"}, None, 3, {"type": 4}, {"type": "y"}]}, {"content": [{"type": "z"}]}, "s", {"type": None}]}),
        '{"content": [{"type": "\\ud800"}]}', "[" * 100_000,
    ]
    rows = spark.createDataFrame([(i, "s", i, None, "message", None, None, m, None, None) for i, m in enumerate(log)], LOG)
    return tools, export, rows


def test_nested_found(sessions):
    got = {tuple(r) for r in nested.found(*sessions).collect()}
    want = {("session_with_tools", 1, 2, 1, -1), ("session_with_tools", 1, 2, 1, 0), ("session_with_tools", 1, 2, 1, 2), ("session_with_tools", 1, 2, 3, -1), ("session_export", 1, 0, 0, -1)}
    want |= {("session_log", 8, 0, 0, -1), ("session_log", 9, 0, 1, -1), ("session_log", 9, 0, 1, 0), ("session_log", 9, 0, 1, 4), ("session_log", 9, 0, 2, 0), ("session_log", 10, 0, 0, -1)}
    assert got == want


def test_nested_tables_keep_links(sessions, spark, tmp_path):
    nodes = nested.flatten_sessions(*sessions)
    keys = {r["node_id"] for r in nodes.collect()}
    assert len(keys) == nodes.count() and all(r["parent_id"] in keys for r in nodes.collect() if r["parent_id"])
    nested.write_tables(nodes, str(tmp_path / "t"))
    schemas = nested.schemas_of(*sessions)
    calls = nested.read_table(spark, str(tmp_path / "t"), "tools_call", schemas["tools_call"])
    assert {(r["path"][1], r["args_file_path"]) for r in calls.collect()} == {(1, " a.rs "), (2, "  "), (3, "b"), (4, None)}
    assert nested.read_table(spark, str(tmp_path / "t"), "log_block", schemas["log_block"]).where("type = 'a'").count() == 1
    top = nested.read_table(spark, str(tmp_path / "t"), "tools_session", schemas["tools_session"]).where("row_id = 1").first()
    assert (top["sessionId"], top["tag"], top["tools_session_node_id"]) == ("s", "clash", 7)


def test_shape_of_any_schema(spark):
    """Three levels of arrays, structs between them, arrays of scalars and maps as fields."""
    kind = "id BIGINT, a STRUCT<x: INT, list: ARRAY<STRUCT<y: STRING, deep: STRUCT<more: ARRAY<STRUCT<z: ARRAY<INT>, last: ARRAY<STRUCT<w: DOUBLE>>>>>>>>, m MAP<STRING, INT>"
    df = spark.createDataFrame([(5, (1, [None, ("q", ([([1, None], [(0.5,), None, (1.5,)])],))]), {"k": 3}), (6, None, None)], kind)
    shape = nested.Shape("t", df.schema, key="id")
    assert shape.parents == {"t": None, "t_a_list": "t", "t_a_list_deep_more": "t_a_list", "t_a_list_deep_more_last": "t_a_list_deep_more"}
    got = {(r["tag"], r["node_id"], r["parent_id"], r["payload"]) for r in nested.with_keys(shape.nodes(df)).collect()}
    assert got == {
        ("t", "t/5", None, '{"a_x":1,"m":{"k":3}}'), ("t", "t/6", None, "{}"), ("t_a_list", "t/5/1", "t/5", '{"y":"q"}'), ("t_a_list_deep_more", "t/5/1/0", "t/5/1", '{"z":[1,null]}'),
        ("t_a_list_deep_more_last", "t/5/1/0/0", "t/5/1/0", '{"w":0.5}'), ("t_a_list_deep_more_last", "t/5/1/0/2", "t/5/1/0", '{"w":1.5}'),
    }
    assert shape.schemas["t_a_list_deep_more"].simpleString() == "struct<z:array<int>>"


def test_blocks_of_any_depth(spark):
    block = {"type": "leaf"}
    for _ in range(30):
        block = {"type": "box", "content": [None, block]}
    rows = spark.createDataFrame([(1, "s", 1, None, "message", None, None, json.dumps({"content": [block]}), None, None)], LOG)
    nodes = nested.flatten_sessions(log=rows).collect()
    assert len(nodes) == 32 and max(len(r["path"]) for r in nodes) == 31 and all(r["parent_id"] == r["node_id"].rpartition("/")[0] for r in nodes if r["path"])


def test_nested_rows_hold_all_fields(spark, tmp_path):
    """The registered query gives every field of each entity back."""
    state = ("done", ("f.rs", 3, 40, "old", "new", "text", "patch"), "out", None, (5, 9))
    export = spark.createDataFrame([(1, "UTC", ("i", "t", ("c",)), [(("m", "user", ("c2",)), [("p", "tool", None, "k", "edit", state)])])], EXPORT)
    tools = spark.createDataFrame([(1, "s", "h", "UTC", "a", "b", [])], TOOLS)
    blocks = [{"type": "toolCall", "arguments": {"x": [1]}, "n": 7}, {"type": "image", "source": {"kind": "b"}, "content": [None, {"type": 4, "size": 2.5}]}]
    log = spark.createDataFrame([(1, "s", 8, "UTC", "message", "e", "t", json.dumps({"role": "r", "usage": {"in": 3}, "cost": 0.5, "content": blocks}), "mo", "info"), (2, "s", 9, None, None, None, None, "{bad", None, None)], LOG)
    for name, df in (("session_with_tools", tools), ("session_export", export), ("session_log", log)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    last = lambda key: int(key.split("/")[2 if "log" in key else 3]) if key.count("/") > (1 if "log" in key else 2) else -1
    got = {(r["tag"], r["row_id"], last(r["node_id"])): json.loads(r["fields"]) for r in problems.p1_rows(spark, str(tmp_path)).collect()}
    assert len(got) == 9 and got["tools_session", 1, -1]["host_tz"] == "UTC"
    part = {"input_filePath": "f.rs", "input_offset": 3, "input_limit": 40, "input_oldString": "old", "input_newString": "new", "input_content": "text", "input_patchText": "patch", "time_start": 5, "time_end": 9, "output": "out", "status": "done"}
    assert got["export_part", 1, 0] == {f"state_{k}": v for k, v in part.items()} | {"id": "p", "type": "tool", "callID": "k", "tool": "edit"}
    top = got["log_message", 1, -1]
    assert (top["line_no"], json.loads(top["usage"]), json.loads(top["other"]), "content" in top) == (8, {"in": 3}, {"cost": 0.5}, False)
    assert got["log_message", 2, -1] == {"session_id": "s", "line_no": 9, "raw": "{bad"}
    first, second, sub = got["log_block", 1, 0], got["log_block", 1, 1], got["log_subblock", 1, 1]
    assert json.loads(first["arguments"]) == {"x": [1]} and json.loads(first["other"]) == {"n": 7}
    assert json.loads(second["source"]) == {"kind": "b"} and json.loads(second["content"]) == blocks[1]["content"] and json.loads(sub["other"]) == {"type": 4, "size": 2.5}


def test_nested_empty(spark):
    empty = [spark.createDataFrame([], s) for s in (TOOLS, EXPORT, LOG)]
    assert nested.found(*empty).count() == 0
    with pytest.raises(ValueError):
        nested.flatten_sessions()


def brute(links):
    parent = {}
    for c, p in links:
        parent[c] = min(p, parent.get(c, p))
    out, below = {}, Counter()
    for n in {x for link in links for x in link}:
        seen, x = [n], n
        while x in parent and parent[x] not in seen:
            x = parent[x]
            seen.append(x)
        out[n] = ("", -1) if x in parent else (x, len(seen) - 1)
        if out[n][1] > 0:
            below.update(seen[1:])
    return {n: (r, d, below[n] if d >= 0 else -1) for n, (r, d) in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{i}", f"n{rng.randrange(max(1, i - 3), i) if seed else i - 1}") for i in range(2, 40)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e")] + [(f"k{i}", "hot") for i in range(30)]
    df = spark.createDataFrame(links * 2, "child STRING, parent STRING")
    got = {r["node"]: (r["root"], r["depth"], r["n_descendants"]) for r in hierarchy.hierarchy(df).collect()}
    assert got == brute(links)


def test_hierarchy_paths_closure_and_empty(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "x")], "child STRING, parent STRING")
    got = {r["node"]: r["path"] for r in hierarchy.hierarchy(df, paths=True).collect()}
    assert got == {"a": "a", "b": "a > b", "c": "a > b > c", "d": "a > b > c > d", "x": None}
    pairs = {tuple(r) for r in hierarchy.closure(df).collect()}
    assert pairs == {("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "c", 2), ("b", "d", 2), ("a", "d", 3)}
    assert hierarchy.hierarchy(df.limit(0)).count() == 0


def test_paths_and_descendants_of_both_tables(spark, tmp_path):
    """The same names stand in both tables; their forests stay apart, and of two parents the least counts."""
    spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("c", "d"), ("x", "x")], "from_anchor STRING, to_anchor STRING").write.parquet(str(tmp_path / "edges.parquet"))
    rows = [("a", "u1", 1, "sent"), ("c", "u1", 2, "received"), ("c", "u2", 3, "sent"), ("b", "u2", 1, "received"), ("alone", None, 0, "sent")]
    spark.createDataFrame(rows, "tape_id STRING, uuid STRING, first_turn_index BIGINT, direction STRING").write.parquet(str(tmp_path / "dispatch_links.parquet"))
    got = {(r["src"], r["node"]): (r["root"], r["depth"], r["path"]) for r in problems.p2_all_paths(spark, str(tmp_path)).collect()}
    assert got == {
        ("edges", "a"): ("a", 0, "a"), ("edges", "b"): ("a", 1, "a > b"), ("edges", "c"): ("a", 2, "a > b > c"), ("edges", "d"): ("a", 2, "a > b > d"), ("edges", "x"): ("", -1, None),
        ("dispatch_links", "a"): ("a", 0, "a"), ("dispatch_links", "c"): ("a", 1, "a > c"), ("dispatch_links", "b"): ("a", 2, "a > c > b"), ("dispatch_links", "alone"): ("alone", 0, "alone"),
    }
    pairs = sorted(tuple(r) for r in problems.p2_descendants(spark, str(tmp_path)).collect())
    edges = [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]
    assert pairs == sorted([("edges", *x) for x in edges] + [("dispatch_links", *x) for x in [("a", "c", 1), ("c", "b", 1), ("a", "b", 2)]])


def test_hierarchy_found_spellings(spark):
    edges = spark.createDataFrame([(" A", "b "), ("a", "B"), ("b", "C"), (None, "z"), ("  ", "z"), ("a", None)], "from_anchor STRING, to_anchor STRING").withColumn("node", F.lit("clash"))
    links = spark.createDataFrame([("t1", " U1", 1, "sent"), ("t2", "u1", 2, "received"), ("t2", "u1", 2, "received"), ("t3", None, 0, "received"), ("t4", "u9", 0, "sent")], "tape_id STRING, uuid STRING, first_turn_index BIGINT, direction STRING")
    got = {tuple(r) for r in hierarchy.found(edges, links).collect()}
    assert got == {("edges", "a", "a", 0, 2), ("edges", "b", "a", 1, 1), ("edges", "c", "a", 2, 0), ("dispatch_links", "t1", "t1", 0, 1), ("dispatch_links", "t2", "t1", 1, 0), ("dispatch_links", "t3", "t3", 0, 0), ("dispatch_links", "t4", "t4", 0, 0)}


@pytest.mark.parametrize(
    "raw, zone, want",
    [
        ("2025-03-01T00:00:00Z", None, 1740787200000000), (" 2025-03-01t00:00:00z ", "Asia/Tokyo", 1740787200000000), ("20250301T000000Z", None, 1740787200000000), ("2025-03-01T09:00:00+0900", None, 1740787200000000),
        ("2025-03-01 00:00:00,123456789 UTC", None, 1740787200123456), ("1740787200", None, 1740787200000000), ("1740787200.0000019", None, 1740787200000001), ("1740787200123", None, 1740787200123000),
        ("1740787200123456", None, 1740787200123456), ("1740787200123456789", None, 1740787200123456), ("Sat, 01 Mar 2025 05:30:00 +0530", None, 1740787200000000), ("Mar 1, 2025 12:00:00 AM", "UTC", 1740787200000000),
        ("01-Mar-2025 01:00:00", "Europe/Berlin", 1740787200000000), ("2025-03-01T01:00:00+01:00[Europe/Berlin]", None, 1740787200000000), ("2025-03-01 01:00:00 CET", None, 1740787200000000), ("2025/03/01 00:00:00", "UTC", 1740787200000000),
        ("2025-03-01T00:00Z", None, 1740787200000000),
        ("2025-10-26 02:30:00", "Europe/Berlin", 1761438600000000), ("2025-03-30 02:30:00", "Europe/Berlin", 1743298200000000),  # twice: the earlier; skipped: offset before
        ("2025-03-01 00:00:00", None, None), ("2025-03-01 00:00:00", " ", None), ("2025-03-01 00:00:00", "No/Zone", None), ("2025-02-30 10:00:00 UTC", None, None), ("", None, None), (None, "UTC", None), ("yesterday", "UTC", None), ("0", None, None),
        ("2019-12-31T23:59:59Z", None, None), ("2030-01-01T00:00:00Z", None, None), ("2029-12-31T23:59:59.9999999Z", None, 1893455999999999), ("13:00:00 PM", "UTC", None), ("2025-03-01T25:00:00Z", None, None), ("x" * 100_000, "UTC", None),
    ],
)
def test_parse_instant(raw, zone, want):
    assert timestamps.parse_instant(raw, zone) == want


def test_dictionary_grows(spark, tmp_path):
    path = str(tmp_path / "dict")
    rows = spark.createDataFrame([(1, "2025-03-01 00:00:00", "UTC"), (2, "2025-03-01 00:00:00", "UTC"), (3, "2025-03-01 00:00:00", None), (4, None, "UTC")], "utc BIGINT, raw STRING, zone STRING")
    got = {r["utc"]: r["utc_us"] for r in timestamps.normalise(rows, path).collect()}
    assert got == {1: 1740787200000000, 2: 1740787200000000, 3: None, 4: None} and spark.read.parquet(path).count() == 2
    timestamps.normalise(rows.unionByName(spark.createDataFrame([(5, "1740787200", "")], rows.schema)), path).count()
    assert spark.read.parquet(path).count() == 3


FILES = "file_id BIGINT, stream STRING, dialect STRING, seq INT, file_name STRING, written_at TIMESTAMP"


def drift_of(spark, *files, dialect="logs"):
    meta = spark.createDataFrame([(i, "s", dialect, i, None, None) for i in range(len(files))], FILES)
    lines = [(i, n, x if isinstance(x, (str, type(None))) else json.dumps(x)) for i, f in enumerate(files) for n, x in enumerate(f)]
    return [tuple(r) for r in drift.found(meta, spark.createDataFrame(lines, "file_id BIGINT, line_no BIGINT, raw STRING")).orderBy("file_id", "change", "old_field").collect()]


def test_drift_changes(spark):
    a = [{"sessionId": "s-1", "timestamp": "2025-01-01T00:00:00Z", "messageId": n, "message": f"this is some longer text number {n}", "flag": True, "gone": "x"} for n in range(5)]
    b = [{"sid": "s-1", "ts": "2025-01-01T00:01:00Z", "seq": n + 6, "text": f"and another rather long text number {n}", "flag": "yes", "fresh": 1.5} for n in range(5)]
    got = drift_of(spark, [*a, None, "", "{", "[1]", "3"], b)
    assert set(got) == {(1, "renamed", "sessionId", "sid"), (1, "renamed", "timestamp", "ts"), (1, "renamed", "messageId", "seq"), (1, "renamed", "message", "text"), (1, "removed", "gone", ""), (1, "added", "", "fresh"), (1, "retyped", "flag", "flag")}


def test_drift_nulls_order_and_members(spark):
    one = [{"type": "user", "message": {"role": "user", "content": "x", "model": "m-1"}}, {"message": None, "type": "user", "extra": None}]
    two = [{"message": {"modelName": "m-1", "content": ["y"], "role": "user"}, "type": "user"}]
    assert drift_of(spark, one, two, dialect="claude_adapter_input") == [(1, "renamed", "message.model", "message.modelName")]
    assert drift_of(spark, one, [], two, dialect="logs") == [(1, "removed", "message", ""), (1, "removed", "type", ""), (2, "added", "", "message"), (2, "added", "", "type")]


def test_drift_rename_into_many_more_values(spark):
    """The old values are a tenth of the new ones, both far more than a few dozen."""
    old = [{"host": f"{n}-q"} for n in range(300)]
    new = [{"label": f"{n}-q"} for n in range(3000)]
    assert drift_of(spark, old, new) == [(1, "renamed", "host", "label")]
    assert set(drift_of(spark, old, [{"label": f"{n}-q"} for n in range(280, 3000)])) == {(1, "removed", "host", ""), (1, "added", "", "label")}


def test_drift_shapes_of_all_values(spark):
    """One object of another shape among hundreds; names without a common word."""
    old = [{"opts": {"a": n}} for n in range(300)]
    new = [{"extra": {"a": n + 1000}} for n in range(300)]
    odd = [{"extra": {"b": 4}}]
    assert drift_of(spark, old, new) == [(1, "renamed", "opts", "extra")]
    assert set(drift_of(spark, old, new + odd)) == {(1, "removed", "opts", ""), (1, "added", "", "extra")}


def test_drift_union_table(spark):
    files = spark.createDataFrame([(0, "s", "logs", 0, None, None), (1, "s", "logs", 1, None, None)], FILES)
    lines = spark.createDataFrame([(0, 0, '{"a": 1, "Id": "x"}'), (1, 0, '{"a": "2", "ID": true, "o": {"k": 1}}'), (1, 1, "bad")], "file_id BIGINT, line_no BIGINT, raw STRING")
    schema = drift.union_schema(drift.headers(files, lines))
    rows = {r["file_id"]: r.asDict() for r in drift.consistent(files, lines, schema).collect()}
    names = {f.metadata["field"]: f.name for f in schema.fields}
    assert rows[0][names["a"]] == "1" and rows[1][names["a"]] == "2" and rows[0][names["Id"]] == "x" and rows[1][names["ID"]] is True and json.loads(rows[1][names["o"]]) == {"k": 1}


def test_drift_name_added_again_beside_its_successor(spark):
    """a goes on as b, then a new a comes: no value is lost, and each life has its own column. A name that only paused keeps its column."""
    content = [[{"a": "k-17", "p": 1}], [{"b": "k-17"}], [{"b": "k-17", "a": [1], "p": 2}], [{"b": "k-17", "c": [1], "p": 3}], [{"b": "k-17", "c": [1], "a": {"z": 0}, "a#2": True}]]
    files = spark.createDataFrame([(i, "s", "logs", i, None, None) for i in range(len(content))], FILES)
    lines = spark.createDataFrame([(i, n, json.dumps(x)) for i, f in enumerate(content) for n, x in enumerate(f)], "file_id BIGINT, line_no BIGINT, raw STRING")
    rows, differences = drift.one_table(files, lines)
    assert {tuple(r)[:1] + tuple(r)[2:5] for r in differences.where("change = 'renamed'").collect()} == {(1, "renamed", "a", "b"), (3, "renamed", "a", "c")}
    names = {f.name: f.metadata["field"] for f in rows.schema.fields[2:]}
    got = {r["file_id"]: {names[k]: v for k, v in r.asDict().items() if k in names and v is not None} for r in rows.collect()}
    assert got == {
        0: {"a": "k-17", "p": 1.0}, 1: {"a": "k-17"}, 2: {"a": "k-17", "a#2": "[1]", "p": 2.0}, 3: {"a": "k-17", "a#2": "[1]", "p": 3.0},
        4: {"a": "k-17", "a#2": "[1]", "a#3": '{"z": 0}', "a#2#1": True},
    }


@given(st.sets(st.sampled_from(["string", "number", "boolean", "array", "object"]), min_size=1))
@settings(max_examples=40)
def test_promotion_is_a_lattice(types):
    joined = drift.promote(types)
    assert joined == drift.promote(set(types)) and drift.promote({joined}) == joined


def test_dictionary_grows_and_tolerates_two_writers(spark, tmp_path):
    place = str(tmp_path / "d")
    rows = lambda *x: spark.createDataFrame(x, "raw STRING, zone STRING")
    first = rows(("2025-01-01T00:00:00Z", None), ("2025-01-01 00:00:00", "Europe/Berlin"), (None, "UTC"))
    assert timestamps.update_dictionary(first, place).count() == 2
    assert timestamps.update_dictionary(first.unionByName(rows(("bad", ""))), place).count() == 3
    stored = spark.read.parquet(timestamps.dictionary_place(place, timestamps.LOW_YEAR, timestamps.HIGH_YEAR))
    assert stored.count() == 3
    stored.limit(2).write.mode("append").parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("append").parquet(timestamps.dictionary_place(place, timestamps.LOW_YEAR, timestamps.HIGH_YEAR))
    assert timestamps.normalise(first, place).count() == 3


def test_shapes_see_whole_values():
    long = "a/" * 60
    assert drift.shape(long + "x-1.9.h-1_" * 10) != drift.shape(long + "x-1.9.h-1_" * 11) and len(drift.shape(long)) <= 40
    assert drift.describe({f"k{i}": 1 for i in range(90)})[3] != drift.describe({f"k{i}": 1 for i in range(91)})[3]
    assert drift.describe(10**400)[1] == float("inf")
