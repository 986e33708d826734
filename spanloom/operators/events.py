"""Raw lines of event logs to typed events.

An event's offset is the physical index of its line, blank lines included. Strict reading drops a whole tape for one
bad line; lossy reading keeps the good lines and lists the bad ones (by line number from 1).
A line is bad if it is no JSON object, lacks ``t`` or ``k`` as strings, or has a field of the wrong type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.running import position_bucket, running_sum

_TEXTS = [
    "t", "k", "model", "repo_head", "label", "file", "before_hash", "after_hash", "text", "before_text", "after_text", "from_file", "to_file", "note",
]
_RANGES = ["range", "before_range", "after_range", "from_range", "to_range"]
_LISTS = ["before_anchor_hashes", "after_anchor_hashes", "anchor_hashes"]
_LOOSE = ["content", "args", "stdout", "stderr", "tool", "call_id", "role", "cwd"]
COVERAGES = ["coverage.read", "coverage.edit", "coverage.tool"]


def _get(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", kind)


def _type(v: Column, name: str) -> Column:
    return F.schema_of_variant(_get(v, name, "variant"))


def _present(v: Column, name: str) -> Column:
    return F.coalesce(_type(v, name) != "VOID", F.lit(False))


def typed_columns(v: Column) -> tuple[dict[str, Column], Column]:
    """Columns of an event from its VARIANT, and whether a field has a wrong type."""
    cols: dict[str, Column] = {}
    bad = F.coalesce(~F.schema_of_variant(v).startswith("OBJECT"), F.lit(True))
    for n in _TEXTS + COVERAGES:
        cols[n] = F.when(_type(v, n) == "STRING", _get(v, n, "string"))
        bad = bad | (_present(v, n) & (_type(v, n) != "STRING"))
    for n in _RANGES:
        cols[n] = F.when(_type(v, n) == "ARRAY<BIGINT>", _get(v, n, "array<int>"))
        bad = bad | (_present(v, n) & F.coalesce((_type(v, n) != "ARRAY<BIGINT>") | (F.size(cols[n]) != 2) | (F.array_min(cols[n]) < 0), F.lit(True)))
    for n in _LISTS:
        cols[n] = F.when(_type(v, n).isin("ARRAY<STRING>", "ARRAY<VOID>"), _get(v, n, "array<string>"))
        bad = bad | (_present(v, n) & ~_type(v, n).isin("ARRAY<STRING>", "ARRAY<VOID>"))
    number = _type(v, "similarity").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    cols["similarity"] = F.when(number, _get(v, "similarity", "float"))
    bad = bad | (_present(v, "similarity") & ~number)
    for n in _LOOSE:  # of any type; only strings are read
        cols[n] = F.when(_type(v, n) == "STRING", _get(v, n, "string"))
    cols["exit"] = F.when(_type(v, "exit") == "BIGINT", _get(v, "exit", "int"))
    return cols, bad | cols["t"].isNull() | cols["k"].isNull()


def read_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines (tape_id, line_no, raw) as event columns, with ``bad``."""
    rows = lines.where(F.trim("raw") != "").select("tape_id", F.col("line_no").alias("event_offset"), "raw", F.try_parse_json("raw").alias("_v"))
    cols, bad = typed_columns(F.col("_v"))
    return rows.select("tape_id", "event_offset", "raw", *[c.alias(n) for n, c in cols.items()], F.coalesce(bad, F.lit(True)).alias("bad"))


def parse_strict(lines: DataFrame) -> DataFrame:
    """Events of the tapes without any bad line."""
    rows = read_lines(lines)
    return rows.join(rows.where("bad").select("tape_id").distinct(), "tape_id", "left_anti").drop("bad", "raw")


def parse_lossy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of good lines, issues (tape_id, line, raw))."""
    rows = read_lines(lines)
    return rows.where(~F.col("bad")).drop("bad", "raw"), rows.where("bad").select("tape_id", (F.col("event_offset") + 1).alias("line"), "raw")


def event_kind(df: DataFrame) -> Column:
    """The event's kind; structured events that lack what they need, and unknown kinds, are ``other``."""
    k, ok = F.col("k"), lambda *names: F.expr(" and ".join(f"`{n}` is not null" for n in names))
    return (
        F.when(k.isin("meta", "msg.in", "msg.out", "tool.call", "tool.result"), k)
        .when((k == "code.read") & ok("file", "range"), k)
        .when((k == "code.edit") & ok("file"), k)
        .when((k == "span.link") & ok("from_file", "from_range", "to_file", "to_range"), k)
        .otherwise("other")
    )


def payload_text(kind: Column) -> Column:
    """The text of a message, a tool call's arguments, or a tool result's output with its errors on a new line."""
    out = F.when(F.col("stdout").isNotNull() | F.col("stderr").isNotNull(), F.concat_ws("\n", "stdout", "stderr"))
    return F.when(kind.isin("msg.in", "msg.out"), F.col("content")).when(kind == "tool.call", F.col("args")).when(kind == "tool.result", out)


def typed(events: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``payload``."""
    rows = events.withColumn("kind", event_kind(events))
    return rows.withColumn("payload", payload_text(F.col("kind")))


def first_meta(events: DataFrame) -> DataFrame:
    """The first meta event of each tape."""
    m = F.struct("t", "model", "repo_head", "label")
    return events.where("k = 'meta'").groupBy("tape_id").agg(F.min_by(m, "event_offset").alias("m")).select("tape_id", "m.*")


def redelivered_once(df: DataFrame) -> DataFrame:
    """Events of a log with redeliveries: of equal (tape_id, event_offset) the first to arrive (least row_id) stays."""
    first = df.where("tape_id is not null and event_offset is not null").groupBy("tape_id", "event_offset").agg(F.min("row_id").alias("row_id"))
    return df.join(first.select("row_id"), "row_id", "left_semi")


def complete_prefix(lines: DataFrame, terminated: Column | None = None) -> DataFrame:
    """The longest prefix of each file whose lines are blank or valid JSON; an unterminated last line counts if it is valid."""
    ok = (F.trim("raw") == "") | F.try_parse_json("raw").isNotNull()
    first_bad = lines.withColumn("_ok", F.coalesce(ok, F.lit(False))).where("not _ok").groupBy("tape_id").agg(F.min("line_no").alias("_bad"))
    return lines.join(first_bad, "tape_id", "left").where("_bad is null or line_no < _bad").drop("_bad")


def conformance(events: DataFrame) -> DataFrame:
    """(tape_id, line, detail) of each rule an event of the exchange format breaks."""
    lacks = lambda k, *names: [
        F.when((F.col("k") == k) & F.expr(f"`{n}` is null"), F.lit(f"{k} lacks {n}")) for n in names
    ]
    rules = [
        F.when(F.col("t").isNull(), F.lit("lacks t")), F.when(F.col("k").isNull(), F.lit("lacks k")),
        *lacks("tool.call", "tool"), *lacks("tool.result", "tool"), *lacks("code.read", "file", "range"), *lacks("code.edit", "file"),
        *lacks("span.link", "from_file", "from_range", "to_file", "to_range"),
        *[F.when(~F.col(f"`{c}`").isin("full", "partial", "none"), F.lit(f"unknown grade of {c}")) for c in COVERAGES if c in events.columns],
        F.when((F.col("similarity") < 0) | (F.col("similarity") > 1), F.lit("similarity out of range")),
    ]
    return events.select("tape_id", (F.col("event_offset") + 1).alias("line"), F.explode(F.array_compact(F.array(*rules))).alias("detail"))


def message_turns(events: DataFrame) -> DataFrame:
    """Adds ``turn``: the number of message events before each event of its tape."""
    is_message = F.coalesce(F.col("k").isin("msg.in", "msg.out").cast("bigint"), F.lit(0))
    return running_sum(events, ["tape_id"], ["event_offset"], position_bucket(F.col("event_offset")), is_message, "turn", before=True)
