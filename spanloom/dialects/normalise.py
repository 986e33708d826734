"""Acts to normalised events, and events to the lines and identity of a tape."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.dialects.registry import DIALECTS, Dialect
from spanloom.operators.joins import pair_latest
from spanloom.operators.nested import parse_json
from spanloom.operators.running import position_bucket, running_sum

_ACT = (
    "tape_id STRING, line_no BIGINT, item INT, act STRING, t STRING, session_id STRING, model STRING, repo_head STRING, text STRING, tool STRING, call_id STRING, args STRING, error BOOLEAN, exit INT, "
    "stdout STRING, stderr STRING, reads ARRAY<STRUCT<file: STRING, start: INT, end: INT, text: STRING>>, edits ARRAY<STRUCT<file: STRING, before: STRING, after: STRING>>"
)
_READ = pa.list_(pa.struct([("file", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
_EDIT = pa.list_(pa.struct([("file", pa.string()), ("before", pa.string()), ("after", pa.string())]))
_ARROW = pa.schema(
    [("tape_id", pa.string()), ("line_no", pa.int64()), ("item", pa.int32())]
    + [(n, pa.string()) for n in ("act", "t", "session_id", "model", "repo_head", "text", "tool", "call_id", "args")]
    + [("error", pa.bool_()), ("exit", pa.int32()), ("stdout", pa.string()), ("stderr", pa.string()), ("reads", _READ), ("edits", _EDIT)]
)
EVENT = ["t", "k", "model", "repo_head", "role", "content", "tool", "call_id", "args", "exit", "stdout", "stderr", "file", "range", "text", "before_text", "after_text", "coverage.read", "coverage.edit", "coverage.tool"]


def _clean(v):
    if isinstance(v, str):
        return v.encode("utf-8", "replace").decode()
    if isinstance(v, list):
        return [{k: _clean(x) for k, x in d.items()} for d in v]
    return v


def read_acts(lines: DataFrame, dialect: Dialect) -> DataFrame:
    """Acts of raw lines (tape_id, line_no, raw); of documents the line is the whole file. Lines that are no JSON give none."""
    read = dialect.read

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tape, no, raw in zip(*[b.column(c).to_pylist() for c in ("tape_id", "line_no", "raw")], strict=True):
                value = parse_json(raw)
                if value is not None:
                    out += [{"tape_id": tape, "line_no": no, "item": i} | {k: _clean(v) for k, v in a.row().items()} for i, a in enumerate(read(value))]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return lines.select("tape_id", "line_no", "raw").mapInArrow(walk, _ACT)


def to_events(acts: DataFrame, dialect: Dialect) -> DataFrame:
    """Normalised events (tape_id, event_offset, event columns and source) of acts, each tape with its meta event first.

    Results are paired with the latest earlier call of their id by one sorted window.
    """
    acts = acts.withColumn("pos", F.struct("line_no", "item"))
    of_line = lambda c: position_bucket(c["line_no"])
    calls = acts.where("act = 'call' and call_id is not null").select("tape_id", "call_id", "pos", F.col("tool").alias("call_tool"), F.col("reads").alias("call_reads"), F.col("edits").alias("call_edits"))
    results = acts.where("act = 'result'").drop("reads", "edits")
    paired = pair_latest(calls.select("tape_id", "call_id", "pos"), results, ["tape_id", "call_id"], "pos", consume=dialect.one_shot, bucket=of_line)
    paired = paired.join(calls.withColumnRenamed("pos", "call_at"), ["tape_id", "call_id", "call_at"], "left")
    none = lambda *names: [F.lit(None).cast("int" if n == "exit" else "array<int>" if n == "range" else "string").alias(n) for n in names]

    def event(df: DataFrame, k: str, rank: int, **cols) -> DataFrame:
        given = [c.alias(n) for n, c in cols.items()]
        return df.select("tape_id", "pos", F.lit(rank).alias("rank"), *([F.col("sub")] if "sub" in df.columns else [F.lit(0).alias("sub")]), "t", F.lit(k).alias("k"), "session_id", *given, *none(*[n for n in EVENT if n not in ("t", "k") and n not in cols]))

    def reads(df: DataFrame, col: str, text) -> DataFrame:
        rows = df.select("tape_id", "pos", "t", "session_id", *(["stdout"] if "stdout" in df.columns else []), F.posexplode(col).alias("sub", "r"))
        return event(rows, "code.read", 2, file=F.col("r.file"), range=F.array("r.start", "r.end"), text=text)

    def edits(df: DataFrame, col: str, rank: int) -> DataFrame:
        rows = df.select("tape_id", "pos", "t", "session_id", F.posexplode(col).alias("sub", "e"))
        return event(rows, "code.edit", rank, file=F.col("e.file"), before_text=F.col("e.before"), after_text=F.col("e.after"))

    text_or_null = F.when(F.col("stdout") != "", F.col("stdout"))
    parts = [
        event(acts.where("act = 'in'"), "msg.in", 0, role=F.lit("user"), content=F.col("text")),
        event(acts.where("act = 'out'"), "msg.out", 0, role=F.lit("assistant"), content=F.col("text")),
        event(acts.where("act = 'call'"), "tool.call", 0, tool=F.col("tool"), call_id=F.col("call_id"), args=F.col("args")),
        event(paired, "tool.result", 1, tool=F.coalesce("tool", "call_tool", F.lit("unknown")), call_id=F.col("call_id"), exit=F.col("exit"), stdout=F.col("stdout"), stderr=F.col("stderr")),
        reads(acts.where("act = 'call'"), "reads", F.col("r.text")) if dialect.reads_at == "call" else reads(paired, "call_reads", text_or_null),
        edits(acts.where("act = 'call'"), "edits", 3) if dialect.edits_at == "call" else edits(paired, "call_edits", 3),
    ]
    body = parts[0]
    for p in parts[1:]:
        body = body.unionByName(p)
    wanted = acts.groupBy("tape_id").agg(F.sum(F.size("reads")).alias("want_reads"), F.sum(F.size("edits")).alias("want_edits"))
    told = body.groupBy("tape_id").agg(F.count_if(F.col("k") == "code.read").alias("got_reads"), F.count_if(F.col("k") == "code.edit").alias("got_edits"))
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("pos")))
    facts = acts.groupBy("tape_id").agg(first("t").alias("t"), first("session_id").alias("session_id"), first("model").alias("model"), first("repo_head").alias("repo_head"))
    counted = lambda want, got: F.when(F.coalesce(want, F.lit(0)) == F.coalesce(got, F.lit(0)), "full").otherwise("partial")
    read, edit, tool = dialect.coverage
    stats = facts.join(wanted, "tape_id").join(told, "tape_id", "left").withColumn("pos", F.struct(F.lit(-1).cast("bigint").alias("line_no"), F.lit(0).alias("item"))).withColumn("t", F.coalesce("t", F.lit("1970-01-01T00:00:00Z")))
    meta = event(
        stats, "meta", 0, model=F.col("model"), repo_head=F.col("repo_head"),
        **{
            "coverage.read": F.lit(read) if read else counted(F.col("want_reads"), F.col("got_reads")),
            "coverage.edit": F.lit(edit) if edit else counted(F.col("want_edits"), F.col("got_edits")),
            "coverage.tool": F.lit(tool),
        },
    )
    known = facts.select("tape_id", F.col("session_id").alias("_session"))
    rows = meta.unionByName(body).join(known, "tape_id", "left")
    source = F.struct(F.lit(dialect.harness).alias("harness"), F.col("_session").alias("session_id"))
    numbered = running_sum(rows, ["tape_id"], ["pos", "rank", "sub"], of_line(F.col("pos")), F.lit(1), "event_offset", before=True)
    return numbered.withColumn("event_offset", F.col("event_offset").cast("bigint")).select("tape_id", "event_offset", *[F.col(f"`{c}`") for c in EVENT], source.alias("source"))


def normalise(lines: DataFrame, name: str) -> DataFrame:
    d = DIALECTS[name]
    return to_events(read_acts(lines, d), d)


def to_lines(events: DataFrame) -> DataFrame:
    """(tape_id, line_no, raw): each event as compact JSON with sorted keys, nulls left out."""
    cols = sorted(c for c in events.columns if c not in ("tape_id", "event_offset"))
    return events.select("tape_id", F.col("event_offset").alias("line_no"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("raw"))


def content_ids(lines: DataFrame) -> DataFrame:
    """(tape_id, content_id): SHA-256 of a tape's lines with their terminators."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: F.concat(x["raw"], F.lit("\n"))), "")
    return lines.groupBy("tape_id").agg(F.sha2(joined, 256).alias("content_id"))
