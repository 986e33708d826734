"""Fingerprints, events, index, hand-offs, traversal, windows, dialects and sources on small fixtures."""

import json
import random
from collections import defaultdict, deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.dialects.normalise import content_ids, normalise, to_lines
from spanloom.functions import fingerprint as fp
from spanloom.functions import scalar
from spanloom.operators import dispatch, events, graph, index, joins, lookup, running, windows
from spanloom.params import DEFAULT, Params
from spanloom.sources import append, discovery, tapes
from spanloom.sources.detect import detect

LONG = "\n".join(f"fn line_{i}(value_{i}: u64) -> u64 {{ value_{i} + {i} }}" for i in range(140))


@given(st.text(alphabet="aB_9 É²漢🙂\n\t.,-", max_size=200))
@settings(max_examples=60, deadline=None)
def test_windows_of_python_cover_all_tokens(text):
    toks = fp.tokens_py(text)
    assert all(t.strip() for t in toks) and fp.tokens_py(text.upper().lower() if text.isascii() else text) == (fp.tokens_py(text.lower()) if text.isascii() else toks)
    if len(toks) < 5:
        assert fp.features_py(text) == []


def test_native_and_arrow_anchors_agree(spark):
    texts = [LONG, "one two three four five", "one two three four", "", None, "É É É é é 🙂 漢字 a_b 9²", LONG + "\n", "a\n" * 60, "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").withColumn("features", F.lit("clash"))
    native = {(r["doc_id"], r["anchor"]) for r in fp.token_anchors_native(df, ["doc_id"]).collect()}
    arrow = {(r["doc_id"], a) for r in df.select("doc_id", fp.token_anchors(F.col("text")).alias("a")).collect() for a in r["a"] or []}
    assert native == arrow and {d for d, _ in native} == {0, 1, 5, 6, 7}
    assert 10 < len(fp.window_features_py(LONG)) == 11


def test_similarity_and_sampling(spark):
    near, far = LONG.replace("value_7 ", "other "), "\n".join(f"quite different words {i} here again" for i in range(50))
    df = spark.createDataFrame([(LONG, near, far, "abc", "winnow:zz", "winnow:,")], "a STRING, b STRING, c STRING, d STRING, e STRING, f STRING")
    for c in "abc":
        df = fp.with_features(df, c, f"f{c}")
    r = df.select(fp.jaccard(F.col("fa"), F.col("fb")).alias("ab"), fp.jaccard(F.col("fa"), F.col("fc")).alias("ac"), fp.parsed_features(F.col("d")).alias("d"), fp.parsed_features(F.col("e")).alias("e"), fp.parsed_features(F.col("f")).alias("f"), fp.expand_anchor(F.col("d")).alias("x")).collect()[0]
    assert 0.8 < r["ab"] < 1 and r["ac"] == 0 and r["d"] is r["e"] is r["f"] is None and r["x"] == []
    q = fp.query_anchors([LONG])
    assert len(q) == 16 and q[0] == fp.token_anchors_py(LONG)[0] and q[-1] == fp.token_anchors_py(LONG)[-1]


EVENT = "tape_id STRING, event_offset BIGINT, t STRING, k STRING, file STRING, range ARRAY<INT>, text STRING, content STRING, args STRING, stdout STRING, stderr STRING, before_text STRING, after_text STRING, before_anchor_hashes ARRAY<STRING>, after_anchor_hashes ARRAY<STRING>, anchor_hashes ARRAY<STRING>, similarity FLOAT, before_range ARRAY<INT>, after_range ARRAY<INT>, from_file STRING, from_range ARRAY<INT>, to_file STRING, to_range ARRAY<INT>, note STRING"


def event(spark, *rows):
    names = [x.split()[0] for x in EVENT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVENT)


def test_index_policies(spark):
    rows = event(
        spark,
        {"tape_id": "a", "event_offset": 0, "k": "msg.in", "content": "one two three four five six", "t": "1"},
        {"tape_id": "a", "event_offset": 1, "k": "code.edit", "file": "f", "before_text": LONG, "after_text": "", "before_range": [3, 9], "t": "2"},
        {"tape_id": "a", "event_offset": 2, "k": "code.edit", "file": "f", "before_anchor_hashes": ["winnow:a,b", "span:x"], "after_anchor_hashes": ["winnow:c"], "similarity": 0.29, "t": "3"},
        {"tape_id": "a", "event_offset": 3, "k": "code.read", "file": "f", "t": "4", "anchor_hashes": ["winnow:z"]},
        {"tape_id": "a", "event_offset": 4, "k": "code.read", "file": "f", "range": [1, 2], "text": "short", "anchor_hashes": ["winnow:z"], "t": "5"},
        {"tape_id": "a", "event_offset": 5, "k": "tool.result", "stderr": "only errors were written here today", "t": "6"},
        {"tape_id": "a", "event_offset": 6, "k": "span.link", "from_file": "x", "from_range": [1, 2], "to_file": "y", "to_range": [3, 4], "t": "7"},
        {"tape_id": "bad", "event_offset": 0, "k": "code.read", "file": "f", "range": [1, 1], "anchor_hashes": ["", "winnow:q"]},
        {"tape_id": "bad2", "event_offset": 0, "k": "code.edit", "file": "f", "before_anchor_hashes": ["p"], "after_anchor_hashes": ["q"], "similarity": 1.5},
    )
    t = index.build(rows)
    ev = {(r["anchor"], r["event_offset"], r["kind"]) for r in t["evidence"].collect()}
    assert {("winnow:a", 2, "edit"), ("winnow:b", 2, "edit"), ("span:x", 2, "edit"), ("winnow:c", 2, "edit")} <= ev and not any(o in (3, 4, 6) for _, o, _ in ev) and any(o == 5 and k == "tool" for _, o, k in ev)
    edges = {(r["from_anchor"], r["to_anchor"], r["agent_link"], r["stored_class"]) for r in index.with_class(t["edges"]).collect()}
    assert edges == {("winnow:a", "winnow:c", False, "location_only"), ("winnow:b", "winnow:c", False, "location_only"), ("span:x", "winnow:c", False, "location_only"), ("span:x:1-2", "span:y:3-4", True, "lineage")}
    dead = t["tombstones"].collect()
    assert {r["event_offset"] for r in dead} == {1} and {(r["range_start"], r["range_end"]) for r in dead} == {(3, 9)} and len(dead) == len(fp.token_anchors_py(LONG))
    assert [r["tape_id"] for r in t["tapes"].collect()] == ["a"]
    assert index.build(rows.limit(0))["evidence"].count() == 0


@pytest.mark.parametrize("c, link, want", [(0.29, False, "location_only"), (0.30, False, "lineage"), (0.1, True, "lineage")])
def test_thresholds_are_inclusive(spark, c, link, want):
    df = spark.createDataFrame([(c, link)], "confidence FLOAT, agent_link BOOLEAN")
    assert index.with_class(df).collect()[0]["stored_class"] == want


def test_strict_and_lossy_reading(spark):
    good = json.dumps({"t": "1", "k": "code.edit", "file": "f", "similarity": 1, "before_range": [1, 2]})
    raws = [("a", 0, good), ("a", 1, ""), ("a", 2, '{"t": "1", "k": "msg.in", "content": {"x": 1}}'), ("b", 0, good), ("b", 1, "not json"), ("c", 0, '{"t": 1, "k": "meta"}'), ("d", 0, '{"t": "1", "k": "code.read", "file": "f", "range": [1]}'), ("e", 0, '{"t": "1", "k": "code.read", "file": 3}')]
    lines = spark.createDataFrame(raws, "tape_id STRING, line_no BIGINT, raw STRING")
    rows = events.typed(events.parse_strict(lines)).collect()
    assert sorted((r["tape_id"], r["event_offset"], r["kind"], r["payload"]) for r in rows) == [("a", 0, "code.edit", None), ("a", 2, "msg.in", None)]
    ok, issues = events.parse_lossy(lines)
    assert ok.count() == 3 and {(r["tape_id"], r["line"]) for r in issues.collect()} == {("b", 2), ("c", 1), ("d", 1), ("e", 1)}
    assert events.complete_prefix(lines).groupBy("tape_id").count().where("tape_id = 'b'").collect()[0]["count"] == 1


def bfs_brute(edges, seeds, p):
    taken, seen, visited, queue = [], set(), set(), deque((s, 0) for s in seeds)
    while queue and len(taken) < p.max_edges:
        node, depth = queue.popleft()
        if node in visited or depth >= p.max_depth:
            continue
        visited.add(node)
        near = [(0, e) for e in edges if e[1] == node] + [(1, e) for e in edges if e[0] == node]
        near.sort(key=lambda x: (-x[1][2], x[0], x[1][0], x[1][1], x[1][6]))
        n = 0
        for side, e in near:
            if e in seen:
                continue
            if n == p.max_fanout or len(taken) == p.max_edges:
                break
            seen.add(e)
            n += 1
            taken.append(e)
            queue.append((e[0] if side == 0 else e[1], depth + 1))
    return taken


@pytest.mark.parametrize("fanout, most, depth", [(50, 500, 10), (2, 500, 10), (3, 17, 10), (50, 500, 2)])
def test_bounded_bfs_matches_sequential(spark, fanout, most, depth):
    rng = random.Random(fanout * most)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice([0.5, 0.625, 0.75, 1.0]), "same", "1:1", False, "") for _ in range(120)} | {("n1", "n1", 0.75, "same", "1:1", False, "")}
    df = spark.createDataFrame([*edges, ("n1", "n2", 0.25, "same", "1:1", False, "weak")], "from_anchor STRING, to_anchor STRING, confidence FLOAT, location_delta STRING, cardinality STRING, agent_link BOOLEAN, note STRING")
    p = Params(max_fanout=fanout, max_edges=most, max_depth=depth)
    assert [tuple(e.values()) for e in graph.bounded_bfs(df, ["n1", "n5"], p)] == bfs_brute(list(edges), ["n1", "n5"], p)


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("a", "a"), ("x", "y")], "from_anchor STRING, to_anchor STRING")
    got = {(r["anchor"], r["depth"]) for r in graph.reach(edges, spark.createDataFrame([("a",)], "anchor STRING"), 9).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_climb_and_chains(spark):
    u = [f"{i}0000000-0000-0000-0000-000000000000" for i in range(4)]
    links = spark.createDataFrame([("A", u[0], 1, "sent"), ("B", u[0], 0, "received"), ("B", u[1], 3, "sent"), ("C", u[1], 1, "received"), ("S", u[0], 0, "received"), ("C", u[2], 5, "received"), ("B", u[2], 9, "sent")], "tape_id STRING, uuid STRING, first_turn_index BIGINT, direction STRING")
    hops = dispatch.climb(spark.createDataFrame([("C", 4), ("C", 1)], "tape_id STRING, turn BIGINT"), links).orderBy("hop").collect()
    assert [(r["tape_id"], r["turn"], r["parent_tape"], r["sent_turn"]) for r in hops] == [("C", 4, "B", 3), ("B", 3, "A", 1)]
    loop = spark.createDataFrame([("X", u[3], 0, "received"), ("X", u[3], 2, "sent")], links.schema)
    assert dispatch.climb(spark.createDataFrame([("X", 1)], "tape_id STRING, turn BIGINT"), loop).count() == 2
    sessions = spark.createDataFrame([(x,) for x in "ABCDE"], "session_id STRING")
    c = {r["session_id"]: r for r in graph.chains(sessions, spark.createDataFrame([("A", "B", 1), ("B", "C", 2), ("A", "C", 1), ("Z", "D", 1), ("E", "E", 1)], "parent STRING, child STRING, position INT")).collect()}
    assert (c["C"]["root"], c["C"]["depth"], c["C"]["chain_length"], c["A"]["n_children"], c["D"]["depth"], c["E"]["root"]) == ("A", 2, 3, 2, 0, "E")


def test_climb_of_a_long_chain(spark):
    """More hand-offs than any number of rounds that was once allowed."""
    n = 300
    u = lambda i: f"{i:08d}-0000-0000-0000-000000000000"
    rows = [x for i in range(n) for x in ((f"t{i + 1}", u(i), 5, "sent"), (f"t{i}", u(i), 1, "received"))]
    links = spark.createDataFrame(rows, "tape_id STRING, uuid STRING, first_turn_index BIGINT, direction STRING").coalesce(1)
    hops = dispatch.climb(spark.createDataFrame([("t0", 3)], "tape_id STRING, turn BIGINT"), links)
    got = {r["hop"]: (r["tape_id"], r["parent_tape"]) for r in hops.select("hop", "tape_id", "parent_tape").collect()}
    assert got == {i: (f"t{i}", f"t{i + 1}") for i in range(n)}


def test_markers(spark):
    u, v = "0f8fad5b-d9cb-469f-a165-70867728950e", "1f8fad5b-d9cb-469f-a165-70867728950e"
    tag = lambda x: f'<{DEFAULT.marker_tag} id="{x}"/>'
    lines = [
        ("a", 0, json.dumps({"type": "message", "message": {"role": "user", "content": "hello"}})), ("a", 1, "no json"),
        ("a", 2, json.dumps({"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": tag(u)}, {"type": "toolCall", "arguments": {"prompt": "run " + json.dumps(tag(v))}}]}})),
        ("a", 3, json.dumps({"k": "msg.in", "content": tag(v) + tag("not-a-uuid")})),
    ]
    got = {tuple(r) for r in dispatch.dispatch_links(spark.createDataFrame(lines, "tape_id STRING, line_no BIGINT, raw STRING")).collect()}
    assert got == {("a", u, 1, "received"), ("a", v, 1, "sent")}


def test_running_values_do_not_depend_on_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "cold", None]), i, rng.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "k STRING, at INT, v INT")
    for bits in (2, 30):
        b = running.position_bucket(F.col("at"), bits)
        last = {r["at"]: r["x"] for r in running.running_last(df, ["k"], ["at"], b, "v", "x").collect()}
        total = {r["at"]: r["x"] for r in running.running_sum(df, ["k"], ["at"], b, F.lit(1), "x", before=True).collect()}
        seen, n = {}, defaultdict(int)
        for k, at, v in rows:
            seen[k] = v if v is not None else seen.get(k)
            assert last[at] == seen[k] and total[at] == n[k]
            n[k] += 1


def test_asof_ties_nulls_and_strictness(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, None, 5), (4, "a", None), (5, "b", 9)], "id INT, g STRING, at BIGINT")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y"), ("a", 3, "z"), (None, 1, "n"), ("a", None, "m")], "g STRING, r BIGINT, v STRING")
    get = lambda strict: {r["id"]: r["v"] for r in joins.asof_backward(left, right, ["g"], "at", "r", ["v"], strict=strict, ties=F.col("v")).collect()}
    assert get(True) == {1: "z", 2: None, 3: None, 4: None, 5: None} and get(False)[1] == "x"


def test_windows_and_context(spark):
    rows = spark.createDataFrame([("a", i, "" if i == 3 else f"row {i}{' needle' if i in (0, 4, 14) else ''}") for i in range(15)], "tape_id STRING, line_no BIGINT, raw STRING")
    near = windows.neighbourhood(rows, spark.createDataFrame([("a", 4), ("a", 3)], "tape_id STRING, touch_offset BIGINT"))
    assert sorted(r["line_no"] for r in near.collect()) == [1, 2, 4, 5, 6]
    hits = windows.matches(rows, "needle").select("tape_id", (F.col("line_no") + 1).alias("line"))
    spans = windows.merged_context(hits, rows.groupBy("tape_id").agg((F.max("line_no") + 1).alias("total")), 2)
    assert sorted((r["start"], r["end"]) for r in spans.collect()) == [(1, 7), (13, 15)]
    assert windows.slice_lines(rows, spans).count() == 10


def test_prefix_relation(spark):
    a = spark.createDataFrame([("/r/a/b",), ("/r/ab",), ("/r",), ("/x",)], "path STRING")
    assert sorted(r["path"] for r in lookup.prefix_related(a, spark.createDataFrame([("/r/a/",)], "path STRING")).collect()) == ["/r", "/r/a/b"]


def test_detection_needs_all_lines_and_takes_hints(spark):
    row = json.dumps({"type": "user", "session_id": "s", "message": {"role": "user", "content": "x"}})
    rows = [("x.jsonl", 0, row), ("my-cursor/x.jsonl", 0, row), ("cut.jsonl", 0, row), ("cut.jsonl", 1, '{"a'), ("foreign", 0, '{"customer": 1}'), ("doc", 0, json.dumps({"info": {}, "messages": [{"info": {"role": "user"}, "parts": []}]}))]
    got = {r["tape_id"]: r["dialect"] for r in detect(spark.createDataFrame(rows, "tape_id STRING, line_no BIGINT, raw STRING")).collect()}
    assert got == {"x.jsonl": "claude", "my-cursor/x.jsonl": "cursor", "cut.jsonl": None, "foreign": None, "doc": "opencode"}


def test_dialects_pair_results(spark):
    lines = spark.createDataFrame(
        [
            ("t", 0, json.dumps({"type": "assistant", "timestamp": "T0", "message": {"content": [{"type": "tool_use", "id": "c", "name": "Read", "input": {"file_path": "f", "offset": 3, "limit": 2}}, {"type": "tool_use", "id": "m", "name": "MultiEdit", "input": {"file_path": "f", "edits": [{"old_string": "a", "new_string": "b"}, {"old_string": "c", "new_string": "d"}]}}]}})),
            ("t", 1, json.dumps({"type": "user", "timestamp": "T1", "message": {"content": [{"type": "tool_result", "tool_use_id": "c", "content": [{"text": "body"}]}, {"type": "tool_result", "tool_use_id": "c", "content": "again", "is_error": True}]}})),
        ],
        "tape_id STRING, line_no BIGINT, raw STRING",
    )
    out = normalise(lines, "claude")
    got = [(r["k"], r["tool"], r["range"], r["exit"]) for r in out.orderBy("event_offset").collect()]
    assert got == [("meta", None, None, None), ("tool.call", "Read", None, None), ("tool.call", "MultiEdit", None, None), ("code.edit", None, None, None), ("code.edit", None, None, None), ("tool.result", "Read", None, 0), ("code.read", None, [3, 4], None), ("tool.result", "unknown", None, 1)]
    assert content_ids(to_lines(out)).collect() == content_ids(to_lines(normalise(lines.repartition(3), "claude"))).collect()


def test_scalars(spark):
    df = spark.createDataFrame([("*** Update File: a\n+++ b/c\n--- /dev/null\n*** Add File: a", "x\nProcess exited with code 7\ny", 1735689600000, "2025-06-30T23:59:59Z")], "p STRING, o STRING, ms BIGINT, ts STRING")
    r = df.select(scalar.patch_files(F.col("p")).alias("p"), scalar.exit_code(F.col("o")).alias("e"), scalar.epoch_ms_to_rfc3339(F.col("ms")).alias("t"), scalar.in_dates(F.col("ts"), "2025-06-01", "2025-06-30").alias("d"), scalar.in_dates(F.lit("?"), "2025-06-01", None).alias("n"), scalar.read_range(F.lit(0), F.lit(3)).alias("r"), scalar.tool_class(F.lit("ReadFile")).alias("c"), scalar.is_uuid(F.lit("x")).alias("u")).collect()[0]
    assert (r["p"], r["e"], r["t"], r["d"], r["n"], r["r"], r["c"], r["u"]) == (["a", "c"], 7, "2025-01-01T00:00:00Z", True, True, [1, 3], "read", False)
    import re

    g = re.compile(scalar.glob_to_regex("src/**/*.rs"))
    assert g.match("src/a/b.rs") and g.match("src/b.rs") and not g.match("x/src/b.rs") and not re.match(scalar.glob_to_regex("*.rs"), "a/b.rs")
    assert scalar.canonical_json('{"b": 1, "a": [2.50, {"d": 1, "c": null}]}') == '{"a":[2.5,{"c":null,"d":1}],"b":1}'


def test_cursor_states(tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_bytes(b'{"a": 1}\n\n{"b": 2}\n{"c"')
    now = append.state_of(str(f))
    assert append.new_part(str(f), None, now) == (0, 19) and append.new_part(str(f), now, now) is None
    f.write_bytes(b'{"a": 1}\n\n{"b": 2}\n{"c": 3}')
    later = append.state_of(str(f), now)
    assert append.new_part(str(f), now, later) == (19, 27)
    f.write_bytes(b'{"z": 1}\n\n{"b": 2}\n{"c": 3}\n')
    assert append.new_part(str(f), later, append.state_of(str(f), later))[0] == 0
    f.write_bytes(b'{"z": 1}\n')
    assert append.new_part(str(f), later, append.state_of(str(f), later)) == (0, 9)


def test_tapes_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("a", 0, '{"k": "x"}'), ("a", 1, ""), ("a", 2, '{"k": "é"}')], "tape_id STRING, line_no BIGINT, raw STRING")
    one, two = str(tmp_path / "1"), str(tmp_path / "2")
    wrote = tapes.export_tapes(lines, one).collect()
    assert wrote[0]["written"] and not tapes.export_tapes(lines, one).collect()[0]["written"]
    tapes.export_tapes(lines, two).collect()
    back = tapes.read_tapes(spark, [two, one]).collect()
    assert sorted((r["line_no"], r["raw"]) for r in back) == [(0, '{"k": "x"}'), (1, ""), (2, '{"k": "é"}')] and {r["tape_id"] for r in back} == {wrote[0]["content_id"]}
    f = tmp_path / "s.txt"
    f.write_text("one\ntwo\r\nthree\n")
    assert tapes.span_variants(str(f), 1, 2) == ["one\ntwo", "one\ntwo\r\n"]
    with pytest.raises(ValueError):
        tapes.span_variants(str(f), 2, 9)


def test_discovery(tmp_path):
    repo, home = tmp_path / "repo", tmp_path / "home"
    for p in (repo / "a.jsonl", repo / "b.JSON", repo / "c.txt", repo / ".spanloom" / "d.json"):
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("{}")
    files, failures = discovery.scoped(str(repo), ["a.jsonl", "c.txt", "none", "../home", "."])
    assert [f.rsplit("/", 1)[-1] for f in files] == ["a.jsonl", "b.JSON"] and len(failures) == 3
    key = str(repo.resolve()).replace("/", "-")
    put = lambda p, t="{}": (p.parent.mkdir(parents=True, exist_ok=True), p.write_text(t))
    put(home / ".claude" / "projects" / key / "s.jsonl")
    put(home / ".claude" / "projects" / key / "s" / "subagents" / "t.jsonl")
    put(home / ".codex" / "sessions" / "1.jsonl", json.dumps({"type": "session_meta", "payload": {"cwd": str(repo / "sub")}}))
    put(home / ".codex" / "sessions" / "2.jsonl", json.dumps({"type": "session_meta", "payload": {"cwd": "/else"}}))
    put(home / ".openclaw" / "sessions" / "1.jsonl", json.dumps({"x": {"cwd": str(repo)}}))
    put(home / ".config" / "Cursor" / "User" / "workspaceStorage" / "w" / "workspace.json", json.dumps({"folder": f"file://{repo.resolve()}"}))
    put(home / ".config" / "Cursor" / "User" / "workspaceStorage" / "w" / "state.vscdb")
    names = lambda f: [p.rsplit("/", 1)[-1] for p in f(str(repo), str(home))]
    assert names(discovery.claude) == ["t.jsonl", "s.jsonl"] or sorted(names(discovery.claude)) == ["s.jsonl", "t.jsonl"]
    assert names(discovery.codex) == ["1.jsonl"] and names(discovery.openclaw) == ["1.jsonl"] and names(discovery.cursor) == ["state.vscdb"] and names(discovery.gemini) == []


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_salted_join_gives_every_pair(spark, most):
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("rare", 3), ("none", 4), (None, 5)], "k STRING, q INT")
    many = spark.createDataFrame([("hot", i) for i in range(40)] + [("rare", 100), ("other", 101), (None, 102)], "k STRING, d INT")
    got = sorted((r["q"], r["d"]) for r in lookup.salted_join(few, many, "k", "d", most).collect())
    assert got == sorted([(q, d) for q in (1, 2) for d in range(40)] + [(3, 100)])


def test_sessions_are_counts_and_files_are_rows(spark):
    rows = [("a", "t", i % 5, "edit", f"f{i % 3}", f"2025-0{i % 9 + 1}") for i in range(60)] + [("a", "u", 3, "tool", "", "")]
    touches = lookup.touches_of(spark.createDataFrame(rows, "anchor STRING, tape_id STRING, event_offset BIGINT, kind STRING, file_path STRING, timestamp STRING"))
    got = {r["tape_id"]: tuple(r)[1:] for r in lookup.sessions(touches).collect()}
    assert got == {"t": (touches.where("tape_id = 't'").count(), 3, "2025-09", 0), "u": (1, 0, "", 3)}
    log = spark.createDataFrame([("u", "x", None, "y"), ("t", "z", None, None)], "tape_id STRING, file STRING, from_file STRING, to_file STRING")
    assert sorted(map(tuple, lookup.files_touched(touches, log).collect())) == [("t", "f0"), ("t", "f1"), ("t", "f2"), ("u", "x"), ("u", "y")]
