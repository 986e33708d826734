"""explain, grep and peek over stores: which sessions made or mention a text, and what stands in them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import fingerprint as fp
from spanloom.functions.scalar import in_dates, result_id, tier_of
from spanloom.operators import dispatch, events, graph, lookup, windows
from spanloom.operators.running import position_bucket, running_sum
from spanloom.params import DEFAULT, Params
from spanloom.sources.stores import Store, union_stores
from spanloom.sources.tapes import span_variants


class NoResults(LookupError):
    code = "no_results"


class SessionNotFound(LookupError):
    code = "session_not_found"


class InvalidSpan(ValueError):
    code = "invalid_span"


@dataclass(frozen=True)
class Options:
    limit: int = DEFAULT.default_limit
    offset: int = 0
    since: str | None = None
    until: str | None = None
    grep_filter: str | None = None
    min_confidence: float = DEFAULT.min_confidence
    max_fanout: int = DEFAULT.max_fanout
    max_edges: int = DEFAULT.max_edges
    max_depth: int = DEFAULT.max_depth
    forensics: bool = False
    count: bool = False
    anchor: bool = False
    include_deleted: bool = False

    def params(self) -> Params:
        return replace(DEFAULT, min_confidence=self.min_confidence, max_fanout=self.max_fanout, max_edges=self.max_edges, max_depth=self.max_depth)


def target_anchors(target: str, as_anchor: bool = False, p: Params = DEFAULT, cwd: str = ".") -> tuple[str, list[str]]:
    """(kind, anchors) of a target: an anchor itself, lines of a file (``path:first-last``), a whole file, or the text given.

    Paths are relative to ``cwd``. Kinds are anchor, span, file and text.
    """
    if as_anchor:
        expanded = [fp.PREFIX + x for x in target[len(fp.PREFIX) :].split(",") if x] if target.startswith(fp.PREFIX) else []
        return "anchor", expanded or [target]
    m = re.fullmatch(r"(.+):([^:]*-[^:]*)", target, re.DOTALL)
    if m and "\n" not in m[2]:
        span = re.fullmatch(r"(\d+)-(\d+)", m[2])
        if not span and (" " not in m[2] and re.fullmatch(r"[\w.\-]+", m[2])) and _is_file(cwd, m[1]):
            raise InvalidSpan(target)
        if span and _is_file(cwd, m[1]):
            try:
                return "span", fp.query_anchors(span_variants(str(Path(cwd, m[1])), int(span[1]), int(span[2])), p)
            except ValueError as e:
                raise InvalidSpan(str(e)) from e
    if "\n" not in target and _is_file(cwd, target):
        return "file", fp.query_anchors([Path(cwd, target).read_text(encoding="utf-8")], p)
    return "text", fp.query_anchors([target], p)


def _is_file(cwd: str, path: str) -> bool:
    return len(path) < 4096 and Path(cwd, path).is_file()


def _page(rows: DataFrame, order: list, o: Options, p: Params) -> tuple[list, dict]:
    """The page's rows and what it tells of all sessions; only the page and one row of counts come to the driver."""
    t = F.when(F.col("timestamp") != "", F.col("timestamp"))
    all_of = rows.agg(F.count("*").alias("n"), F.min(t).alias("start"), F.max(t).alias("end")).collect()[0]
    page = lookup.page(rows, order, o.offset, o.limit, p.max_sessions).collect()
    return page, {"returned": len(page), "total": all_of["n"], "time_range": {"start": all_of["start"], "end": all_of["end"]}, "truncated": o.offset > 0 or o.offset + len(page) < all_of["n"]}


def _windowed(sessions: DataFrame, lines: DataFrame, anchor: DataFrame, o: Options, p: Params) -> DataFrame:
    """Adds total_lines, window_start and window_end; with a filter only sessions whose window holds the literal stay."""
    totals = lines.groupBy("tape_id").agg((F.max("line_no") + 1).alias("total_lines"))
    s = sessions.join(totals, "tape_id", "left").join(anchor, "tape_id", "left").fillna({"total_lines": 0})
    s = s.withColumn("_w", windows.display_window(F.coalesce(F.col("anchor_offset") + 1, F.lit(1)), F.col("total_lines"), p.peek_lines, p)).withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.col("_w.end")).drop("_w", "anchor_offset")
    if o.grep_filter is None:
        return s
    spans = s.select("tape_id", F.col("window_start").alias("start"), F.col("window_end").alias("end")).where("end >= start")
    return s.join(windows.matches(windows.slice_lines(lines, spans), o.grep_filter).select("tape_id").distinct(), "tape_id", "left_semi")


def explain(stores: list[Store], target: str, o: Options = Options(), cwd: str = ".") -> dict:
    """Sessions that hold the target's anchors or lie upstream of them, with lineage, hand-offs and (asked for) deletions."""
    p = o.params()
    kind, anchors = target_anchors(target, o.anchor, p, cwd)
    table = lambda name: union_stores(stores, name)
    evidence, lines = table("evidence"), table("tape_lines").drop("store_rank")
    direct = lookup.evidence_for(evidence, anchors)
    lineage: list[dict] = []
    seen: set[tuple] = set()
    for s in (x for x in stores if x.exists()):
        for e in graph.bounded_bfs(s.read("edges"), anchors, p, o.forensics):
            key = tuple(round(v, 6) if isinstance(v, float) else v for v in e.values())
            if key not in seen:
                seen.add(key)
                lineage.append(e)
    touched = graph.touched(anchors, lineage)
    touches = lookup.touches_of(lookup.evidence_for(evidence, touched))
    found = lookup.sessions(touches)
    scored = found.join(lookup.scores(direct, max(1, len(anchors))), "tape_id", "left").fillna({"score": 0.0})
    links = stores[0].read("dispatch_links")
    typed = events.message_turns(lines.select("tape_id", F.col("line_no").alias("event_offset"), F.get_json_object("raw", "$.k").alias("k")))
    edits = touches.where("kind = 'edit'").select("tape_id", "event_offset").distinct().join(typed, ["tape_id", "event_offset"]).select("tape_id", "turn")
    hops = dispatch.climb(edits, links)
    extra = hops.where("parent_tape is not null").select(F.col("parent_tape").alias("tape_id")).distinct().join(found.select("tape_id"), "tape_id", "left_anti")
    stamps = lines.join(extra, "tape_id", "left_semi").groupBy("tape_id").agg(F.coalesce(F.max(F.get_json_object("raw", "$.t")), F.lit("")).alias("timestamp"))
    none = F.lit(0).cast("bigint")
    extra = extra.join(stamps, "tape_id", "left").select("tape_id", none.alias("touch_count"), none.alias("n_files"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.lit(None).cast("bigint").alias("first_touch"), F.lit(0.0).cast("float").alias("score"))
    sessions = scored.unionByName(extra).where(in_dates(F.col("timestamp"), o.since, o.until))
    sessions = sessions.join(dispatch.reference_counts(links), "tape_id", "left").fillna(0, ["refs_up", "refs_down"])
    chain_links = hops.where("parent_tape is not null").select(F.col("parent_tape").alias("parent"), F.col("tape_id").alias("child"), F.struct("turn", "received_turn").alias("position"))
    chained = graph.chains(sessions.withColumnRenamed("tape_id", "session_id"), chain_links).withColumnRenamed("session_id", "tape_id")
    at = sessions.select("tape_id", F.col("first_touch").alias("anchor_offset"))
    chained = _windowed(chained, lines, at, o, p)
    page, told = _page(chained, [F.asc("depth"), F.desc("score"), F.desc("timestamp"), F.desc("touch_count"), F.asc("tape_id")], o, p)
    if not page:
        raise NoResults(target)
    roots: dict[str, list] = {}
    for i, r in enumerate(page):
        roots.setdefault(r["root"], []).append((r["depth"], i, r["tape_id"]))
    shown = [r["tape_id"] for r in page]
    details = {t: {"touches": [], "files": set(), "children": set()} for t in shown}
    for r in touches.where(F.col("tape_id").isin(shown)).orderBy("tape_id", "event_offset", "kind", "file_path").toLocalIterator():
        mine = details[r["tape_id"]]
        mine["touches"].append({k: r[k] for k in ("event_offset", "kind", "file_path", "timestamp")})
        mine["files"] |= {r["file_path"]} - {""}
    if any(r["n_children"] for r in page):
        for r in chain_links.where(F.col("parent").isin(shown)).join(sessions.select(F.col("tape_id").alias("child")), "child", "left_semi").select("parent", "child").distinct().toLocalIterator():
            details[r["parent"]]["children"].add(r["child"])
    dead = lookup.evidence_for(table("tombstones"), touched).orderBy("anchor", "event_offset", "tape_id").toLocalIterator() if o.include_deleted and kind != "file" else []
    payload = {
        "query": {"target": target, "anchors": anchors, "limit": o.limit, "offset": o.offset, "since": o.since, "until": o.until, "grep_filter": o.grep_filter, "min_confidence": o.min_confidence, "forensics": o.forensics, "count": o.count, "include_deleted": o.include_deleted, "max_fanout": o.max_fanout, "max_edges": o.max_edges, "depth": o.max_depth},
        "sessions": [_session(r, details[r["tape_id"]]) for r in page],
        "chains": [{"root": root, "sessions": [x[2] for x in sorted(v)], "length": len(v)} for root, v in roots.items()],
        "lineage": [{**e, "stored_class": "location_only" if not e["agent_link"] and e["confidence"] < p.link_threshold else "lineage"} for e in lineage],
        "dispatch_lineage": [r.asDict() for r in hops.orderBy("hop", "tape_id", "turn").toLocalIterator()],
        "tombstones": [{k: v for k, v in r.asDict().items() if k != "store_rank"} for r in dead],
        "stores_queried": sum(s.exists() for s in stores),
        **told,
    }
    return payload


def _session(r, detail: dict | None = None) -> dict:
    d = r.asDict(recursive=True) | {k: v if k == "touches" else sorted(v) for k, v in (detail or {}).items()}
    return {
        "session_id": d["tape_id"], "timestamp": d["timestamp"], "window_start": d["window_start"], "window_end": d["window_end"], "total_lines": d["total_lines"], "confidence": d.get("score", 0.0),
        "refs_up": d.get("refs_up", 0), "refs_down": d.get("refs_down", 0), "files_touched": d.get("files") or [], "touches": d.get("touches") or [],
        **{k: d[k] for k in ("depth", "parent", "children", "chain_length") if k in d},
    }


def grep(stores: list[Store], literal: str, o: Options = Options()) -> dict:
    """Sessions whose stored lines contain the literal, those first in which it touches code."""
    p = o.params()
    lines = union_stores(stores, "tape_lines").drop("store_rank")
    rows = lines.select("*", F.get_json_object("raw", "$.k").alias("k"), F.get_json_object("raw", "$.t").alias("t"))
    stats = lookup.grep_stats(rows, literal).where(in_dates(F.col("timestamp"), o.since, o.until))
    stats = stats.join(dispatch.reference_counts(stores[0].read("dispatch_links")), "tape_id", "left").fillna(0, ["refs_up", "refs_down"])
    stats = _windowed(stats, lines, stats.select("tape_id", "anchor_offset"), o, p) if "anchor_offset" not in stats.columns else _windowed(stats.drop("anchor_offset"), lines, stats.select("tape_id", "anchor_offset"), o, p)
    page, told = _page(stats, lookup.grep_order(), o, p)
    if not page:
        raise NoResults(literal)
    return {"query": {"pattern": literal, "limit": o.limit, "offset": o.offset}, "sessions": [] if o.count else [{**_session(r), "match_count": r["match_count"]} for r in page], "lineage": [], "dispatch_lineage": [], "tombstones": [], "stores_queried": sum(s.exists() for s in stores), **told}


def peek(stores: list[Store], session_id: str, start: int | None = None, lines: int | None = None, before: int | None = None, after: int | None = None, literal: str | None = None, context: int | None = None, p: Params = DEFAULT) -> dict:
    """Lines of a session: from a line on, around the place where it was dispatched, or around each match of a literal."""
    rows = union_stores(stores, "tape_lines").drop("store_rank").where(F.col("tape_id") == session_id)
    found = rows.agg((F.max("line_no") + 1).alias("total"), F.max(F.get_json_object("raw", "$.t")).alias("t")).collect()[0]
    total = found["total"]
    if total is None:
        raise SessionNotFound(session_id)
    if literal is not None:
        hits = windows.matches(rows, literal).select("tape_id", (F.col("line_no") + 1).alias("line"))
        spans = windows.merged_context(hits, rows.groupBy("tape_id").agg((F.max("line_no") + 1).alias("total")), max(1, p.grep_context if context is None else context))
    else:
        if start is not None:
            first, last = start, start + (lines or p.peek_lines) - 1
        else:
            at = _dispatch_line(stores, rows, session_id)
            first, last = at - (p.peek_before if before is None else before), at + (p.peek_after if after is None else after)
        spans = rows.sparkSession.createDataFrame([(session_id, max(1, first), min(total, last))], "tape_id STRING, start BIGINT, end BIGINT").where("end >= start")
    shown = windows.slice_lines(rows, spans).orderBy("line").collect()
    if not shown and literal is not None:
        raise NoResults(literal)
    return {
        "query": {"session": session_id, "start": start, "lines": lines, "before": before, "after": after, "grep": literal},
        "session": {"session_id": session_id, "timestamp": found["t"] or "", "window_start": shown[0]["line"] if shown else 0, "window_end": shown[-1]["line"] if shown else 0, "total_lines": total, "content": [{"line": r["line"], "text": r["raw"]} for r in shown]},
    }


def _dispatch_line(stores: list[Store], rows: DataFrame, session_id: str) -> int:
    """Line of the message by which the session was dispatched: its position among the non-blank lines, from 1; else 1."""
    links = stores[0].read("dispatch_links").where((F.col("tape_id") == session_id) & (F.col("direction") == "received"))
    turn = links.agg(F.min("first_turn_index").alias("turn")).collect()[0]["turn"]
    if turn is None:
        return 1
    placed = windows.positions(rows).where(F.get_json_object("raw", "$.k").isin("msg.in", "msg.out"))
    placed = running_sum(placed, ["tape_id"], ["line_no"], position_bucket(F.col("line_no")), F.lit(1), "turn", before=True)
    at = placed.where(F.col("turn") == turn).select("position").limit(1).collect()
    return at[0]["position"] + 1 if at else 1


def with_result_id(command: str, payload: dict) -> dict:
    text = json.dumps(payload, ensure_ascii=False, default=str)
    return {**json.loads(text), "result_id": result_id(command, text), "rating_hint": "rate this result with its result_id"}


def pretty(payload: dict) -> str:
    """A payload as text: the sessions, one a line, then lineage by the tier of its confidence and deletions."""
    out = [f"{len(payload['sessions'])} of {payload['total']} sessions for {payload['query'].get('target') or payload['query'].get('pattern')}"]
    out += [f"{s['session_id'][:16]}  {s['timestamp']}  confidence {s['confidence']:.2f}  lines {s['window_start']}-{s['window_end']}  {', '.join(s['files_touched'][:3])}" for s in payload["sessions"]]
    for e in payload["lineage"]:
        tier = tier_of(e["confidence"], e["location_delta"] == "moved", e["stored_class"] == "location_only")
        out.append(f"[{tier}] {e['from_anchor']} -> {e['to_anchor']} ({e['confidence']:.2f})")
    out += [f"deleted {t['anchor']}  {t['tape_id'][:16]}:{t['event_offset']}  {t['file_path']}  {t['timestamp']}" for t in payload["tombstones"]]
    return "\n".join(out)
