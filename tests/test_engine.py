"""The whole path: transcripts of invented sessions are ingested, explained, searched, shown, rated and watched."""

import json

import pytest

from spanloom.api import Config, Engine, main
from spanloom.params import SCHEMA_VERSION, TABLES
from spanloom.plans.explain import NoResults, SessionNotFound, target_anchors
from spanloom.runtime import Folder
from spanloom.sources import append, files
from spanloom.sources.stores import Store, rebuild, union_stores

CODE = "\n".join(f"fn step_{i}(value: u64) -> u64 {{ value + {i} }}" for i in range(60))
UUID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def line(**x):
    return json.dumps(x)


def claude(t, role, content, session="s-1"):
    return line(type=role, session_id=session, timestamp=t, message={"role": role, "content": content, **({"model": "m-1"} if role == "assistant" else {})})


def claude_file(session="s-1", day="2025-03-01"):
    return "\n".join(
        [
            claude(f"{day}T10:00:00Z", "user", "please add the steps", session),
            claude(f"{day}T10:00:01Z", "assistant", [{"type": "text", "text": "I will write the file of steps now."}, {"type": "tool_use", "id": "c1", "name": "Write", "input": {"file_path": "src/steps.rs", "content": CODE}}], session),
            claude(f"{day}T10:00:02Z", "user", [{"type": "tool_result", "tool_use_id": "c1", "content": "written"}], session),
        ]
    ) + "\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "a.jsonl").write_text(claude_file())
    (root / "later.jsonl").write_text(
        "\n".join(
            [
                claude("2025-03-05T09:00:00Z", "assistant", [{"type": "tool_use", "id": "c9", "name": "Edit", "input": {"file_path": "src/steps.rs", "old_string": CODE, "new_string": CODE.replace("step_7(", "stride_7(")}}], "s-2"),
                claude("2025-03-05T09:00:02Z", "user", [{"type": "tool_result", "tool_use_id": "c9", "content": "edited"}], "s-2"),
            ]
        )
        + "\n"
    )
    (root / "foreign.jsonl").write_text('{"customer": 1, "total": 2.5}\n')
    home = tmp_path_factory.mktemp("home")
    e = Engine(spark, str(root), str(home), Config(store=str(root / ".spanloom" / "store"), metrics=True)).init()
    e.first = e.ingest()
    return e


def test_ingest_counts_and_is_idempotent(engine):
    assert engine.first["imported"] == 2 and engine.first["skipped_unknown"] == 1 and engine.first["status"] == "ok"
    again = engine.ingest()
    assert again["imported"] == 0 and again["skipped_unchanged"] == 3


def test_explain_finds_both_sessions_newest_chain_first(engine):
    out = engine.explain(CODE.split("\n")[20] + "\n" + CODE.split("\n")[21])
    assert out["total"] == 2 and all(s["confidence"] > 0.9 for s in out["sessions"])
    assert out["sessions"][0]["timestamp"] >= out["sessions"][1]["timestamp"]
    assert out["sessions"][0]["files_touched"] == ["src/steps.rs"] and out["lineage"] and out["result_id"].startswith("result_")
    engine.rate(out["result_id"], "found_answer", "good")
    engine.rate(out["result_id"], "noise")
    assert [(r["outcome"], r["note"]) for r in engine.store.feedback().collect()] in ([("noise", None)], [("found_answer", "good")])
    with pytest.raises(KeyError):
        engine.rate("result_none", "noise")
    with pytest.raises(ValueError):
        engine.rate(out["result_id"], "fine")


def test_explain_without_result(engine):
    with pytest.raises(NoResults):
        engine.explain("nothing at all was ever written like this sentence here")


def test_explain_dates_and_paging(engine):
    one = engine.explain(CODE, since="2025-03-04")
    assert one["total"] == 1 and one["sessions"][0]["timestamp"].startswith("2025-03-05")
    page = engine.explain(CODE, limit=1, offset=1)
    assert page["returned"] == 1 and page["total"] == 2 and page["truncated"]


def test_grep_ranks_and_counts(engine):
    out = engine.grep("stride_7")
    assert out["total"] == 1 and out["sessions"][0]["match_count"] >= 1
    assert engine.grep("steps.rs", count=True)["sessions"] == []
    with pytest.raises(NoResults):
        engine.grep("no such literal")


def test_peek_show_tapes_gc(engine):
    tape = engine.grep("stride_7")["sessions"][0]["session_id"]
    out = engine.peek(tape, start=1, lines=2)
    assert [x["line"] for x in out["session"]["content"]] == [1, 2] and out["session"]["total_lines"] == 4
    assert [x["line"] for x in engine.peek(tape, literal="edited", context=1)["session"]["content"]] == [3, 4]
    assert engine.show(tape)[0]["k"] == "meta" and len(engine.show(tape, raw=True)) == 4
    assert engine.tapes().count() == 2 and engine.gc() == {"kept": 2, "deleted": 0}
    with pytest.raises(SessionNotFound):
        engine.peek("none")


def test_record_and_lines_appended(engine, spark, tmp_path):
    assert engine.record(command=["echo", "a quite unusual output of this command"])["imported"] == 1
    assert engine.grep("quite unusual output")["total"] == 1
    # a growing file: only what was appended is read, half a line waits
    from pathlib import Path

    f = Path(engine.cwd, "a.jsonl")
    more = claude("2025-03-01T11:00:00Z", "user", "a question that came afterwards, about zebras")
    f.write_text(f.read_text() + more[:40])
    assert engine.ingest()["imported"] == 0
    f.write_text(f.read_text()[: -len(more[:40])] + more + "\n")
    assert engine.ingest()["imported"] == 1
    assert engine.grep("about zebras")["total"] == 1


def test_watch_streams_new_lines(engine, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "w.jsonl").write_text(claude("2025-04-01T00:00:00Z", "user", "first watched words of giraffes", "w") + "\n")
    check = str(tmp_path / "check")
    engine.watch(str(folder), check, once=True).awaitTermination(90)
    assert engine.grep("watched words of giraffes")["total"] == 1
    n = engine.gc()["kept"]
    engine.watch(str(folder), check, once=True).awaitTermination(90)
    assert engine.gc()["kept"] == n
    (folder / "w.jsonl").write_text((folder / "w.jsonl").read_text() + claude("2025-04-01T00:01:00Z", "user", "second watched words of okapis", "w") + "\n")
    engine.watch(str(folder), check, once=True).awaitTermination(90)
    assert engine.gc()["kept"] == n + 1 and engine.grep("words of okapis")["total"] == 1


def test_two_stores_and_rebuild(engine, spark, tmp_path):
    other = Store(spark, str(tmp_path / "other")).create()
    other.commit({n: engine.store.read(n) for n in ("tape_lines", "evidence", "edges", "tombstones", "dispatch_links", "tapes")})
    both = union_stores([engine.store, other, Store(spark, str(tmp_path / "none"))], "evidence")
    assert both.count() == engine.store.read("evidence").count()
    n = other.read("evidence").count()

    def build(fresh):
        fresh.commit({x: spark.createDataFrame(other.read(x).collect(), other.read(x).schema) for x in ("evidence", "tapes")})

    def validate(a, b):
        assert b.read("evidence").count() == n

    assert rebuild(other, build, validate).read("evidence").count() == n


def test_fingerprint_folder_of_tapes(engine, spark, tmp_path):
    from spanloom.sources import tapes

    folder = str(tmp_path / "tapes")
    tapes.export_tapes(engine.store.read("tape_lines"), folder).collect()
    other = Engine(spark, str(tmp_path), str(tmp_path), Config(store=str(tmp_path / "s"))).init()
    n = engine.gc()["kept"]
    assert other.fingerprint(folder) == {"imported": n, "skipped_existing": 0}
    assert other.fingerprint(folder) == {"imported": 0, "skipped_existing": n}
    assert other.explain(CODE)["total"] == engine.explain(CODE)["total"]


def test_hand_offs_are_climbed(spark, tmp_path):
    """A tells B by a marker, B edits: explaining B's edit shows A upstream; a sibling of B stays out."""
    root = tmp_path / "r"
    root.mkdir()
    tag = f'<dispatch-src id="{UUID}"/>'
    msg = lambda t, role, content: line(type="message", timestamp=t, message={"role": role, "content": content})
    head = lambda s: line(type="session", id=s, timestamp="2025-01-01T00:00:00Z")
    text = lambda x: [{"type": "text", "text": x}]
    (root / "a.jsonl").write_text("\n".join([head("A"), msg("2025-01-01T00:00:01Z", "user", text("start the work")), msg("2025-01-01T00:00:02Z", "assistant", [{"type": "toolCall", "id": "x", "name": "spawn", "arguments": {"prompt": "do it " + tag}}])]) + "\n")
    edit = {"type": "toolCall", "id": "w", "name": "write", "arguments": {"file_path": "f.rs", "content": CODE}}
    done = line(type="message", timestamp="2025-01-01T00:01:03Z", message={"role": "toolResult", "toolCallId": "w", "toolName": "write", "content": text("ok")})
    (root / "b.jsonl").write_text("\n".join([head("B"), msg("2025-01-01T00:01:01Z", "user", text("please " + tag)), msg("2025-01-01T00:01:02Z", "assistant", [edit]), done]) + "\n")
    (root / "c.jsonl").write_text("\n".join([head("C"), msg("2025-01-01T00:02:01Z", "user", text("also " + tag)), msg("2025-01-01T00:02:02Z", "assistant", text("nothing to do here"))]) + "\n")
    e = Engine(spark, str(root), str(tmp_path), Config(store=str(tmp_path / "s"))).init()
    assert e.ingest()["imported"] == 3
    assert {(r["direction"], r["first_turn_index"]) for r in e.store.read("dispatch_links").collect()} == {("sent", 1), ("received", 0)}
    out = e.explain(CODE)
    assert out["total"] == 2 and [s["depth"] for s in out["sessions"]] == [0, 1]
    a, b = out["sessions"]
    assert a["touches"] == [] and a["refs_down"] == 1 and b["parent"] == a["session_id"] and b["refs_up"] == 1 and b["chain_length"] == 2 and a["children"] == [b["session_id"]]
    assert len(out["dispatch_lineage"]) == 1 and out["chains"] == [{"root": a["session_id"], "sessions": [a["session_id"], b["session_id"]], "length": 2}]


def test_explain_gives_every_hop_and_deletions_upstream(engine, spark, tmp_path):
    """Hops of sessions that aren't on the page, and tombstones of an anchor that only the lineage reaches."""
    from spanloom.plans import explain

    read, anchor = engine.store.read, explain.target_anchors(CODE, False, explain.Options().params())[1][0]
    other = Store(spark, str(tmp_path / "other")).create()
    edge = {"from_anchor": "upstream", "to_anchor": anchor, "confidence": 0.9, "location_delta": "same", "cardinality": "1:1", "agent_link": True, "note": "", "stored_class": "lineage"}
    edges = spark.createDataFrame([tuple(edge[f.name] for f in read("edges").schema.fields)], read("edges").schema)
    dead = spark.createDataFrame([("upstream", "gone", 3, "f.rs", 1, 2, "2025-01-01T00:00:00Z")], read("tombstones").schema)
    tape = read("evidence").where("kind = 'edit'").agg({"tape_id": "min"}).collect()[0][0]
    links = [(tape, "u0", -1, "received"), ("p1", "u0", 5, "sent"), ("p1", "u1", 1, "received"), ("p2", "u1", 5, "sent")]
    other.commit({n: read(n) for n in ("tape_lines", "evidence", "tapes")} | {"edges": edges, "tombstones": dead, "dispatch_links": spark.createDataFrame(links, read("dispatch_links").schema)})
    assert not explain.explain([other], CODE, explain.Options(limit=1))["tombstones"]
    out = explain.explain([other], CODE, explain.Options(limit=1, include_deleted=True))
    assert out["returned"] == 1 and {(h["tape_id"], h["parent_tape"]) for h in out["dispatch_lineage"]} == {(tape, "p1"), ("p1", "p2")}
    assert [(t["anchor"], t["tape_id"]) for t in out["tombstones"]] == [("upstream", "gone")]


def test_configuration_cascade(tmp_path):
    from spanloom.api import error_payload

    home, repo = tmp_path, tmp_path / "x" / "repo"
    for folder, value in ((home, {"store": "far", "metrics": True, "peek": {"lines": 5, "before": 2}}), (repo, {"peek": {"lines": 9}})):
        (folder / ".spanloom").mkdir(parents=True)
        (folder / ".spanloom" / "config.json").write_text(json.dumps(value))
    c = Config.load(str(repo), str(home))
    assert c.store == str(home / ".spanloom" / "far") and c.metrics and c.peek == {"lines": 9}
    (repo / ".spanloom" / "config.json").write_text('{"odd": 1}')
    with pytest.raises(ValueError):
        Config.load(str(repo), str(home))
    assert error_payload(NoResults("x"))["error"]["code"] == "no_results"


EV = [("a1", "t1", 0, "edit", "f", "2025"), ("a2", "t1", 1, "read", "g", "2025"), ("a1", "t2", 0, "tool", "", "2024")]


def test_store_commits_all_or_nothing(spark, tmp_path):
    """On an address instead of a path; what was never marked isn't read, and many commits become one."""
    store = Store(spark, f"file://{tmp_path}/s").create()
    rows = spark.createDataFrame(EV, TABLES["evidence"][0])
    assert store.read("evidence").count() == 0 and not Store(spark, f"file://{tmp_path}/none").exists()
    store.files.delete(f"commits/{store.commit({'evidence': rows})}.json")
    assert store.read("evidence").count() == 0
    store.commit({"evidence": rows.where("tape_id = 't1'"), "tapes": spark.createDataFrame([("t1",), ("t1",)], "tape_id STRING")})
    store.commit({"evidence": rows.where("tape_id = 't2'")})
    assert store.read("evidence").count() == 3 and store.read("tapes").count() == 1 and store.has_tape("t1") and not store.has_tape("t2")
    store.compact()
    assert len(store.commits()) == 1 and sorted(map(tuple, store.read("evidence").collect())) == sorted(EV)
    store.put_result("r", "grep", "{}", "2025-01-01")
    store.put_result("r", "grep", "{1}", "2025-01-02")
    assert [r["payload_json"] for r in store.results().collect()] == ["{1}"]


def test_older_store_is_migrated(spark, tmp_path):
    root = tmp_path / "old"
    root.mkdir()
    (root / "schema_version.json").write_text('{"version": 3}')
    (root / "cursors.json").write_text('{"/x/a.jsonl": [12, "g"]}')
    spark.createDataFrame(EV, TABLES["evidence"][0]).write.parquet(str(root / "evidence"))
    with pytest.raises(ValueError):
        Store(spark, str(root)).check()
    store = Store(spark, str(root)).create()
    assert store.version() == SCHEMA_VERSION and store.read("evidence").count() == 3
    assert [tuple(r) for r in store.cursors().select("path", "cursor", "guard").collect()] == [("/x/a.jsonl", 12, "g")]
    Folder(spark, str(root)).write("schema_version.json", '{"version": 99}')
    with pytest.raises(ValueError):
        store.create()


def test_tape_comes_whole_from_the_first_store_that_has_it(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / n)).create() for n in "ab")
    one.commit({"evidence": spark.createDataFrame(EV[:1], TABLES["evidence"][0])})
    two.commit({"evidence": spark.createDataFrame(EV, TABLES["evidence"][0])})
    got = {(r["anchor"], r["tape_id"], r["store_rank"]) for r in union_stores([one, two], "evidence").collect()}
    assert got == {("a1", "t1", 0), ("a1", "t2", 1)}


def test_ranges_of_files(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BLOCK", 7)
    f = tmp_path / "d" / "x.jsonl"
    f.parent.mkdir()
    f.write_bytes("é one\n\ntwo two two two\nend".encode())
    for path in (str(f), f"file://{f}"):
        assert [x.decode() for x in files.lines(path, 0, 99)] == ["é one\n", "\n", "two two two two\n", "end"]
        assert b"".join(files.lines(path, 8, 12)) == b"two " and files.stat(path).size == 27
    assert [s.path for s in files.listed(str(tmp_path))] == [str(f)] and files.listed(str(tmp_path / "none")) == [] and files.stat(str(tmp_path)) is None
    assert files.listed(f"file://{tmp_path}")[0].path == f"file://{f}"


def test_reader_takes_changed_files_after_their_debounce(tmp_path, monkeypatch):
    now, opened = [0.0], []
    monkeypatch.setattr(append.time, "monotonic", lambda: now[0])
    read = files.read_range
    monkeypatch.setattr(files, "read_range", lambda p, a, b: (opened.append(p), read(p, a, b))[1])
    (tmp_path / "in").mkdir()
    for n in ("a.jsonl", "b.txt", "in/c.jsonl"):
        (tmp_path / n).write_text('{"a": 1}\n')
    r = append.AppendedReader(str(tmp_path), "*.jsonl", "in/*.jsonl", debounce=5)
    c = str(tmp_path / "in" / "c.jsonl")
    assert r.latestOffset() == {}
    now[0] = 6
    first = r.latestOffset()
    assert list(first) == [c] and [(p.start, p.end) for p in r.partitions({}, first)] == [(0, 9)]
    opened.clear()
    assert r.latestOffset() == first and opened == []  # nothing changed: nothing is read
    (tmp_path / "in" / "c.jsonl").write_text('{"a": 1}\n{"b": 2}\n{"c"')
    assert r.latestOffset() == first
    now[0] = 12
    assert [(p.start, p.end) for p in r.partitions(first, r.latestOffset())] == [(9, 18)]


def test_targets_are_relative_to_the_engine(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.rs").write_text(CODE)
    span = target_anchors("src/x.rs:1-30", cwd=str(tmp_path))
    assert span[0] == "span" and span == target_anchors(f"{tmp_path}/src/x.rs:1-30") and target_anchors("src/x.rs", cwd=str(tmp_path))[0] == "file" and target_anchors("src/x.rs:1-30")[0] == "text"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    """Every command, by its flags; answers and errors are JSON."""
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    (repo / "w").mkdir()
    (repo / "src" / "steps.rs").write_text(CODE)
    (repo / "a.jsonl").write_text(claude_file())
    (repo / ".spanloom").mkdir()
    (repo / "watch.json").write_text(json.dumps({"store": "../.spanloom/store", "watch": {"sources": [{"path": "w", "pattern": "*.jsonl", "glob": "in/*.jsonl"}, {"path": "missing"}], "debounce": 0.1}}))

    def call(*argv, code=0):
        assert main([*argv], spark, str(repo), str(tmp_path)) == code
        told = capsys.readouterr()
        return told.err if code else told.out

    assert json.loads(call("ingest", "a.jsonl"))["imported"] == 1
    tape = json.loads(call("tapes"))[0]["tape_id"]
    out = json.loads(call("explain", "src/steps.rs:10-40", "--limit", "3", "--min-confidence", "0.6", "--depth", "2", "--include-deleted", "--forensics", "--max-fanout", "5", "--max-edges", "50"))
    assert out["total"] == 1 and out["query"]["include_deleted"] and out["query"]["depth"] == 2 and out["sessions"][0]["session_id"] == tape
    assert call("explain", "src/steps.rs", "--pretty").startswith("1 of 1 sessions")
    assert json.loads(call("explain", "no such thing was ever written here at all", code=1))["error"]["code"] == "no_results"
    assert json.loads(call("grep", "step_3", "--count", "--since", "2025-01-01"))["total"] == 1
    shown = json.loads(call("peek", tape, "--start", "2", "--lines", "2"))["session"]["content"]
    assert [x["line"] for x in shown] == [2, 3] and json.loads(call("peek", tape, "--grep-filter", "please add"))["session"]["content"]
    call("rate", out["result_id"], "--outcome", "noise", "--note", "n")
    assert json.loads(call("rate", "none", "--outcome", "noise", code=1))["error"]
    assert call("show", tape, "--raw").count("\n") == len(json.loads(call("show", tape))) and json.loads(call("gc"))["kept"] == 1
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO('{"t": "2025-01-01T00:00:00Z", "k": "msg.in", "content": "words that came by standard input alone"}\n'))
    assert json.loads(call("record", "--stdin"))["imported"] == 1
    assert json.loads(call("record", code=1))["error"]["message"].startswith("record takes")
    (repo / "w" / "in").mkdir()
    (repo / "w" / "in" / "x.jsonl").write_text(claude("2025-04-01T00:00:00Z", "user", "watched by the command line", "w") + "\n")
    (repo / "w" / "out.jsonl").write_text(claude("2025-04-01T00:00:00Z", "user", "outside of the glob", "w") + "\n")
    assert json.loads(call("watch", "--config", "watch.json", "--once"))["watched"] == 1
    assert json.loads(call("gc"))["kept"] == 3 and "skipped missing_dir" in (repo / ".spanloom" / "watch.log").read_text()
    with pytest.raises(SystemExit):
        main(["--help"], spark, str(repo), str(tmp_path))


def test_package_offers_its_parts():
    import spanloom

    assert spanloom.Engine is Engine and set(spanloom.__all__) >= {"Store", "normalise", "detect"} and spanloom.DIALECTS
    with pytest.raises(AttributeError):
        spanloom.nothing
