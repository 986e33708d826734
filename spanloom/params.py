"""Parameters of fingerprints, the index and queries, and the schemas of the stored tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Fixed values of the data model; each can be set."""

    kgram: int = 5
    winnow: int = 4
    window_lines: int = 24
    overlap_lines: int = 12
    link_threshold: float = 0.30
    reinsertion_threshold: float = 0.90
    min_confidence: float = 0.50
    max_fanout: int = 50
    max_edges: int = 500
    max_depth: int = 10
    max_anchors: int = 16
    before_ratio: tuple[int, int] = (3, 4)
    max_sessions: int = 25
    transcript_radius: int = 2
    guard_bytes: int = 512
    default_limit: int = 10
    peek_lines: int = 30
    peek_before: int = 30
    peek_after: int = 10
    grep_context: int = 5
    debounce_s: float = 5.0
    ingest_timeout_s: float = 120.0
    #: Name of the tag that marks a hand-off to another session in message texts.
    marker_tag: str = "dispatch-src"

    @property
    def step(self) -> int:
        return self.window_lines - self.overlap_lines


DEFAULT = Params()

EVENT_SCHEMA = (
    "t STRING, k STRING, model STRING, repo_head STRING, label STRING, `coverage.read` STRING, `coverage.edit` STRING, `coverage.tool` STRING, "
    "file STRING, range ARRAY<INT>, before_range ARRAY<INT>, after_range ARRAY<INT>, before_hash STRING, after_hash STRING, text STRING, before_text STRING, after_text STRING, "
    "before_anchor_hashes ARRAY<STRING>, after_anchor_hashes ARRAY<STRING>, similarity FLOAT, anchor_hashes ARRAY<STRING>, from_file STRING, from_range ARRAY<INT>, "
    "to_file STRING, to_range ARRAY<INT>, note STRING, content STRING, args STRING, stdout STRING, stderr STRING, tool STRING, call_id STRING, role STRING, cwd STRING, exit INT"
)
EVIDENCE = "anchor STRING, tape_id STRING, event_offset BIGINT, kind STRING, file_path STRING, timestamp STRING"
EDGES = "from_anchor STRING, to_anchor STRING, confidence FLOAT, location_delta STRING, cardinality STRING, agent_link BOOLEAN, note STRING"
TOMBSTONES = "anchor STRING, tape_id STRING, event_offset BIGINT, file_path STRING, range_start INT, range_end INT, timestamp STRING"
TAPES = "tape_id STRING"
DISPATCH = "tape_id STRING, uuid STRING, first_turn_index BIGINT, direction STRING"
RESULTS = "result_id STRING, command STRING, payload_json STRING, created_at STRING"
FEEDBACK = "result_id STRING, outcome STRING, note STRING, rated_at STRING"
TAPE_LINES = "tape_id STRING, line_no BIGINT, raw STRING"
CURSORS = "path STRING, cursor BIGINT, guard STRING, read_at STRING"
TABLES = {
    "cursors": (CURSORS, ["path"]),
    "evidence": (EVIDENCE, ["anchor", "tape_id", "event_offset", "kind"]),
    "edges": (EDGES, ["from_anchor", "to_anchor", "confidence", "location_delta", "cardinality", "agent_link", "note"]),
    "tombstones": (TOMBSTONES, ["anchor", "tape_id", "event_offset"]),
    "tapes": (TAPES, ["tape_id"]),
    "dispatch_links": (DISPATCH, ["tape_id", "uuid"]),
    "query_results": (RESULTS, ["result_id"]),
    "result_feedback": (FEEDBACK, ["result_id"]),
    "tape_lines": (TAPE_LINES, ["tape_id", "line_no"]),
}
SCHEMA_VERSION = 4

#: The names of the enumerations and what an unknown name is read as.
EVENT_KINDS = ("meta", "msg.in", "msg.out", "tool.call", "tool.result", "code.read", "code.edit", "span.link")
EVIDENCE_KINDS = (("edit", "read", "tool", "message"), "read")
LOCATION_DELTAS = (("same", "adjacent", "moved", "absent"), "absent")
CARDINALITIES = (("1:1", "1:N", "N:1"), "1:1")
DIRECTIONS = (("received", "sent"), "received")
OUTCOMES = ("found_answer", "partially_helped", "noise", "misleading", "not_used")
