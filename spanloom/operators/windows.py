"""Windows of rows: display windows, neighbourhoods, literal matches with merged context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.running import position_bucket, running_sum
from spanloom.params import DEFAULT, Params


def positions(rows: DataFrame, key: str = "tape_id", order: str = "line_no") -> DataFrame:
    """Adds ``position``, the number of a row among the non-blank ones of its tape, from 0."""
    return running_sum(rows.where(F.trim("raw") != ""), [key], [order], position_bucket(F.col(order)), F.lit(1), "position", before=True)


def neighbourhood(rows: DataFrame, touches: DataFrame, radius: int = DEFAULT.transcript_radius) -> DataFrame:
    """Events up to ``radius`` positions around each touch (tape_id, touch_offset); touches without event give none."""
    placed = positions(rows)
    at = placed.join(touches.select("tape_id", F.col("touch_offset").alias("line_no")), ["tape_id", "line_no"]).select("tape_id", F.col("line_no").alias("touch_offset"), F.col("position").alias("_p"))
    near = at.withColumn("position", F.explode(F.sequence(F.greatest(F.col("_p") - radius, F.lit(0)), F.col("_p") + radius)))
    return near.join(placed, ["tape_id", "position"]).drop("_p")


def display_window(anchor_line: Column, total: Column, lines: int = DEFAULT.peek_lines, p: Params = DEFAULT) -> Column:
    """(start, end) of the lines shown around a line, three quarters of them before it; lines count from 1."""
    start = F.greatest(anchor_line - lines * p.before_ratio[0] // p.before_ratio[1], F.lit(1))
    return F.struct(start.alias("start"), F.when(total == 0, 0).otherwise(F.least(total, start + lines - 1)).alias("end"))


def matches(rows: DataFrame, literal: str) -> DataFrame:
    """Lines that contain the literal, as stored: case counts, and escapes of the raw text stay."""
    return rows.where(F.col("raw").contains(F.lit(literal)))


def merged_context(hits: DataFrame, totals: DataFrame, context: int = DEFAULT.grep_context) -> DataFrame:
    """(tape_id, start, end) of the lines around hits (tape_id, line from 1); windows that touch are one."""
    spans = hits.join(totals, "tape_id").select("tape_id", F.greatest(F.col("line") - context, F.lit(1)).alias("start"), F.least(F.col("line") + context, F.col("total")).alias("end"))
    lines = spans.select("tape_id", F.explode(F.sequence("start", "end")).alias("line")).distinct()
    # neighbouring lines have the same distance to their number among the lines kept
    numbered = running_sum(lines, ["tape_id"], ["line"], position_bucket(F.col("line")), F.lit(1), "n")
    return numbered.groupBy("tape_id", (F.col("line") - F.col("n")).alias("island")).agg(F.min("line").alias("start"), F.max("line").alias("end")).drop("island")


def slice_lines(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(tape_id, line, raw) of the lines within spans (tape_id, start, end)."""
    wanted = spans.select("tape_id", F.explode(F.sequence("start", "end")).alias("line")).distinct()
    return rows.withColumn("line", (F.col("line_no") + 1).cast("bigint")).join(wanted.withColumn("line", F.col("line").cast("bigint")), ["tape_id", "line"]).select("tape_id", "line", "raw")
