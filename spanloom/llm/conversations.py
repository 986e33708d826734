"""Message rows to ordered conversations without the broken ones.

Turns are sorted within their session by instant and row_id. The sort is one range partitioning by session, instant and
row, so a session with a third of all rows spreads over many tasks. Each task reads its sorted turns through a
finite-state automaton; what a stretch of turns does to each state is a small table, and the tables of a session's
stretches are composed in order to one verdict, as are the counts of turns before each stretch.

States: 0 start, 1 after a user turn, 2 after an assistant turn, 3 rejected. A user turn after a user turn rejects, and
so does an assistant turn at the start; a session is kept if it ends in state 2.

Defined results
* Rows of other types, without session_id (null or blank) or without message are left out.
* Rows equal in all columns but row_id count once, as the smallest row_id.
* Content is an array if it begins like one (a bracket, then an object, a string, another bracket or its end); text is
  then that of its text blocks. Null or blank text is no turn.
* A session is dropped if an array can't be parsed, or a row with text has another role or no readable timestamp.
* Timestamps without zone are read as UTC. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.nested import parse_json
from spanloom.operators.timestamps import parse_instant
from spanloom.runtime import materialize

CLAUDE, CURSOR = "claude_adapter_input", "supported_paths"
ROLES = {"user": 0, "assistant": 1}
NO_TURN, TURN, BROKEN = 0, 1, 2
#: Next state by role (rows) and state (columns).
STEP = ((1, 3, 1, 3), (3, 2, 2, 3))
ACCEPT = 2
#: A table of next states is one number of two bits a state.
SAME = 0b11_10_01_00
#: The table after one more turn, by role and table before.
AFTER = tuple([sum(STEP[who][table >> 2 * s & 3] << 2 * s for s in range(4)) for table in range(256)] for who in range(2))
_ARRAY = re.compile(r"\s*\[\s*([\[{\"\]]|$)")


def message_text(content: str | None) -> tuple[bool, str | None]:
    """(whether it can be read, text) of a message's content."""
    if content is None or not _ARRAY.match(content):
        return True, content
    blocks = parse_json(content)
    if not isinstance(blocks, list):
        return False, None
    texts = [b["text"] for b in blocks if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)]
    return True, "\n".join(texts)


def classify(role: str | None, content: str | None, timestamp: str | None) -> tuple[int, int | None, int | None]:
    """(status, role, instant) of a row."""
    readable, text = message_text(content)
    if not readable:
        return BROKEN, None, None
    if text is None or not text.strip():
        return NO_TURN, None, None
    who, at = ROLES.get((role or "").strip().lower()), parse_instant(timestamp, "UTC", 1971, 2099)
    return (BROKEN if who is None or at is None else TURN), who, at


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [classify(*x) for x in zip(*[b.column(c).to_pylist() for c in ("role", "content", "timestamp")], strict=True)]
        status, who, at = zip(*rows, strict=True) if rows else ((), (), ())
        keep = [b.column(c) for c in ("src", "session_id", "row_id", "print1", "print2")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(status, pa.int8()), pa.array(who, pa.int8()), pa.array(at, pa.int64())], names=["src", "session_id", "row_id", "print1", "print2", "status", "who", "at"])


def message_rows(df: DataFrame, src: str) -> DataFrame:
    """The rows taken, with a 128-bit print of all columns but row_id."""
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "row_id"]))
    taken = df.where(F.col("type").isin("user", "assistant") & (F.trim("session_id") != "") & F.col("message").isNotNull())
    return taken.select(
        F.lit(src).alias("src"), "session_id", "row_id", "timestamp", F.col("message.role").alias("role"), F.col("message.content").alias("content"),
        F.xxhash64(rest).alias("print1"), F.xxhash64(F.lit("second"), rest).alias("print2"),
    )


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted turns of each session within the task and follows the automaton from every state."""
    part, at, n, table = TaskContext.get().partitionId(), None, 0, SAME
    for b in batches:
        nos, codes = [], []
        for key, who in zip(zip(b.column("src").to_pylist(), b.column("session_id").to_pylist(), strict=True), b.column("who").to_pylist(), strict=True):
            if key != at:
                at, n, table = key, 0, SAME
            n, table = n + 1, AFTER[who][table]
            nos.append(n), codes.append(table)
        yield pa.RecordBatch.from_arrays(
            [b.column("src"), b.column("session_id"), b.column("row_id"), pa.array([part] * len(nos), pa.int32()), pa.array(nos, pa.int64()), pa.array(codes, pa.int32())],
            names=["src", "session_id", "row_id", "part", "no", "table"],
        )


def conversations(rows: DataFrame) -> DataFrame:
    """(src, session_id, turn_no, row_id) of the kept sessions, from ``message_rows``."""
    read = rows.mapInArrow(_classify, "src STRING, session_id STRING, row_id BIGINT, print1 BIGINT, print2 BIGINT, status TINYINT, who TINYINT, at BIGINT")
    once = read.groupBy("src", "session_id", "print1", "print2").agg(F.min("row_id").alias("row_id"), *[F.min(c).alias(c) for c in ("status", "who", "at")])
    once, _ = materialize(once.where(F.col("status") != NO_TURN).select("src", "session_id", "row_id", "status", "who", "at"), "turns")
    broken = once.where(F.col("status") == BROKEN).groupBy("src", "session_id").agg(F.count("*").alias("n")).drop("n")
    turns = once.where(F.col("status") == TURN).join(broken, ["src", "session_id"], "left_anti")
    order = ["src", "session_id", "at", "row_id"]
    sorted_turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("src", "session_id", "row_id", "who")
    numbered, _ = materialize(sorted_turns.mapInArrow(_number, "src STRING, session_id STRING, row_id BIGINT, part INT, no BIGINT, table INT"), "numbered")
    # a session has at most as many stretches as there are partitions
    stretches = numbered.groupBy("src", "session_id", "part").agg(F.max("no").alias("n"), F.max_by("table", "no").alias("table"))
    before = F.sum("n").over(W.partitionBy("src", "session_id").orderBy("part")) - F.col("n")
    state = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "table"))), F.lit(0), lambda s, x: F.call_function("shiftright", x["table"], s * 2).bitwiseAND(3))
    kept = stretches.groupBy("src", "session_id").agg(state.alias("state")).where(F.col("state") == ACCEPT).drop("state")
    offsets = stretches.withColumn("before", before).select("src", "session_id", "part", "before").join(kept, ["src", "session_id"], "left_semi")
    return numbered.join(offsets, ["src", "session_id", "part"]).select("src", "session_id", (F.col("no") + F.col("before")).cast("int").alias("turn_no"), "row_id")


def found(claude: DataFrame, paths: DataFrame) -> DataFrame:
    return conversations(message_rows(claude, CLAUDE).unionByName(message_rows(paths.where("dialect = 'cursor'"), CURSOR)))
