"""Hand-offs between sessions: markers in messages, and climbing from a session to those it was dispatched from."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanloom.functions.scalar import UUID
from spanloom.operators.joins import asof_backward
from spanloom.operators.nested import parse_json
from spanloom.operators.running import position_bucket, running_sum
from spanloom.params import DEFAULT, Params
from spanloom.runtime import drop_path, materialize


def marker_pattern(p: Params = DEFAULT) -> str:
    return rf'<{p.marker_tag} id="({UUID})"/>'


def marker_uuids(text: Column, p: Params = DEFAULT) -> Column:
    """The ids of all markers of a text; quotes may be escaped once."""
    return F.regexp_extract_all(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit(marker_pattern(p)), F.lit(1))


def messages_of(row: object) -> list[dict]:
    """The message objects of a transcript row."""
    if not isinstance(row, dict):
        return []
    out = []
    if row.get("type") == "message" and isinstance(row.get("message"), dict):
        out.append(row["message"])
    payload = row.get("payload")
    if row.get("type") == "response_item" and isinstance(payload, dict) and payload.get("type") == "message":
        out.append(payload)
    if row.get("k") in ("msg.in", "msg.out") or ("role" in row and "content" in row):
        out.append(row)
    return out


def _strings(value: object) -> Iterator[str]:
    """All string values at any depth, keys left out."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            stack += v.values()
        elif isinstance(v, list):
            stack += v


def _surface(message: dict) -> Iterator[str]:
    """The strings a reader of the message sees."""
    content = message.get("content")
    for item in content if isinstance(content, list) else [content]:
        if isinstance(item, str):
            yield item
        elif isinstance(item, dict):
            yield from (item[k] for k in ("text", "input_text", "output_text") if isinstance(item.get(k), str))
    if isinstance(message.get("text"), str):
        yield message["text"]


def message_markers(raw: str, pattern) -> list[tuple[int, dict[str, str]]]:
    """For each message of a line its position and the markers with their direction: on the surface received, deeper sent."""
    out = []
    for i, m in enumerate(messages_of(parse_json(raw))):
        ids = lambda texts: {u for t in texts for u in pattern.findall(t.replace('\\"', '"'))}
        surface = ids(_surface(m))
        out.append((i, {u: "received" if u in surface else "sent" for u in surface | ids(_strings(m))}))
    return out


def dispatch_links(lines: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(tape_id, uuid, first_turn_index, direction) of transcript lines (tape_id, line_no, raw).

    Turns count message objects. Of several places the earliest turn stays, and of one turn the received direction.
    """
    pattern = marker_pattern(p)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        found = re.compile(pattern)
        for b in batches:
            out = []
            for tape, no, raw in zip(*[b.column(c).to_pylist() for c in ("tape_id", "line_no", "raw")], strict=True):
                out += [(tape, no, i, json.dumps(marks)) for i, marks in message_markers(raw, found)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["tape_id", "line_no", "i", "marks"])

    rows = lines.select("tape_id", "line_no", "raw").mapInArrow(walk, "tape_id STRING, line_no BIGINT, i INT, marks STRING")
    turns = running_sum(rows, ["tape_id"], ["line_no", "i"], position_bucket(F.col("line_no")), F.lit(1), "turn", before=True)
    marks = turns.select("tape_id", "turn", F.explode(F.from_json("marks", "map<string,string>")).alias("uuid", "direction"))
    return marks.groupBy("tape_id", "uuid").agg(F.min("turn").cast("bigint").alias("first_turn_index"), F.min_by("direction", F.struct("turn", "direction")).alias("direction"))


def latest_received(touches: DataFrame, links: DataFrame) -> DataFrame:
    """As-of join: for each touch (tape_id, turn) the last marker received strictly before it; of one turn the least uuid.

    The touches' other columns stay; ``uuid`` and ``received_turn`` are null where nothing was received. Links of a tape and
    its touches are merged by sorting, not by pairs.
    """
    best = links.where("direction = 'received'").groupBy("tape_id", "first_turn_index").agg(F.min("uuid").alias("uuid")).withColumn("received_turn", F.col("first_turn_index"))
    return asof_backward(touches, best, ["tape_id"], "turn", "first_turn_index", ["uuid", "received_turn"], bucket=lambda c: position_bucket(c, 10))


def sent_marker(uuids: DataFrame, links: DataFrame) -> DataFrame:
    """For each uuid the tape that sent it: at the greatest turn, of those the least tape."""
    sent = links.where("direction = 'sent'")
    best = sent.groupBy("uuid").agg(F.max("first_turn_index").alias("first_turn_index"))
    top = sent.join(best, ["uuid", "first_turn_index"]).groupBy("uuid").agg(F.min("tape_id").alias("parent_tape"), F.min("first_turn_index").alias("sent_turn"))
    return uuids.join(top, "uuid", "left")


_HOPS = "tape_id STRING, turn BIGINT, uuid STRING, received_turn BIGINT, parent_tape STRING, sent_turn BIGINT, hop INT"


def climb(touches: DataFrame, links: DataFrame) -> DataFrame:
    """All hops upstream from touches (tape_id, turn): tape, turn, uuid, received_turn, parent_tape, sent_turn and the hop's number.

    Each place (tape, turn) has one place it was dispatched from, so hops are pointers. They are found once, for all places
    that any marker was sent from, by one as-of join; the places above the touches are then reached by pointer doubling, so a
    chain of n hops takes log2(n) rounds. A place counts at the least number of hops, and loops end.
    """
    if links.isEmpty():
        return touches.sparkSession.createDataFrame([], _HOPS)
    links, links_path = materialize(links.select("tape_id", "uuid", "first_turn_index", "direction"), "links")
    starts = touches.select("tape_id", "turn").distinct()
    sent = sent_marker(links.where("direction = 'received'").select("uuid").distinct(), links).where("parent_tape is not null")
    places = starts.union(sent.select("parent_tape", "sent_turn")).distinct()
    hops = latest_received(places, links).where("uuid is not null").join(sent, "uuid", "left")
    hops, _ = materialize(hops.select("tape_id", "turn", "uuid", "received_turn", "parent_tape", "sent_turn"), "hops")
    jump = hops.where("parent_tape is not null").select("tape_id", "turn", F.col("parent_tape").alias("to_tape"), F.col("sent_turn").alias("to_turn"))
    reached, path = materialize(starts.withColumn("hop", F.lit(0)), "reached")
    before, jump_path, step, spark = -1, None, 1, links.sparkSession
    while True:
        far = reached.join(jump, ["tape_id", "turn"]).select(F.col("to_tape").alias("tape_id"), F.col("to_turn").alias("turn"), (F.col("hop") + step).alias("hop"))
        seen = Observation()
        grown, newer = materialize(reached.unionByName(far).groupBy("tape_id", "turn").agg(F.min("hop").alias("hop")).observe(seen, F.count("*").alias("n")), "reached")
        drop_path(spark, path)
        reached, path = grown, newer
        if seen.get["n"] == before:
            break
        before = seen.get["n"]
        twice = jump.alias("a").join(jump.alias("b"), (F.col("a.to_tape") == F.col("b.tape_id")) & (F.col("a.to_turn") == F.col("b.turn"))).select("a.tape_id", "a.turn", "b.to_tape", "b.to_turn")
        jump, newer = materialize(twice, "jumps")
        if jump_path:
            drop_path(spark, jump_path)
        jump_path, step = newer, step * 2
    drop_path(spark, links_path)
    return hops.join(reached, ["tape_id", "turn"])


def reference_counts(links: DataFrame) -> DataFrame:
    """(tape_id, refs_up, refs_down): how many markers a tape received and sent."""
    return links.groupBy("tape_id").agg(F.count_if(F.col("direction") == "received").alias("refs_up"), F.count_if(F.col("direction") == "sent").alias("refs_down"))
