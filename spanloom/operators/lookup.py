"""Look-ups of evidence, scores of sessions, and literal search with ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVENANCE = ("code.edit", "code.read", "span.link")


def evidence_for(evidence: DataFrame, anchors: list[str]) -> DataFrame:
    """Evidence of a few anchors: literals, which reach the scan as a pushed filter."""
    return evidence.where(F.col("anchor").isin(anchors))


def scores(direct: DataFrame, n_anchors: int) -> DataFrame:
    """(tape_id, score): the part of the query's anchors that a tape holds."""
    return direct.groupBy("tape_id").agg((F.count_distinct("anchor") / F.lit(n_anchors)).cast("float").alias("score"))


def touches_of(evidence: DataFrame) -> DataFrame:
    """The distinct touches (tape_id, event_offset, kind, file_path, timestamp) of evidence rows, whatever their anchors."""
    return evidence.select("tape_id", "event_offset", "kind", "file_path", "timestamp").distinct()


def sessions(touches: DataFrame) -> DataFrame:
    """(tape_id, touch_count, n_files, timestamp, first_touch) of touches; a session with very many of them is one row of counts."""
    by_file = touches.groupBy("tape_id", "file_path").agg(F.count("*").alias("n"), F.max("timestamp").alias("t"), F.min("event_offset").alias("first"))
    return by_file.groupBy("tape_id").agg(
        F.sum("n").alias("touch_count"), F.count_if(F.col("file_path") != "").alias("n_files"), F.coalesce(F.max("t"), F.lit("")).alias("timestamp"), F.min("first").alias("first_touch")
    )


def files_touched(touches: DataFrame, events: DataFrame) -> DataFrame:
    """(tape_id, file), a row for each: the files of a session's touches, or else of all its events."""
    own = touches.where("file_path <> ''").select("tape_id", F.col("file_path").alias("file")).distinct()
    silent = touches.select("tape_id").distinct().join(own.select("tape_id").distinct(), "tape_id", "left_anti")
    names = events.join(silent, "tape_id", "left_semi").select("tape_id", F.explode(F.array("file", "from_file", "to_file")).alias("file")).where("file <> ''")
    return own.unionByName(names.distinct())


def salted_join(few: DataFrame, many: DataFrame, key: str, spread: str, most: int = 50_000) -> DataFrame:
    """Inner join on ``key`` in which no key's rows of ``many`` are more than about ``most`` in a task.

    The keys asked for are counted first; one with more rows is cut by the hash of ``spread``, and the rows of ``few`` meet
    each of its parts.
    """
    asked = many.join(few.select(key).distinct(), key, "left_semi")
    parts = asked.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    left = few.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    right = asked.join(parts, key).withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def grep_stats(rows: DataFrame, literal: str) -> DataFrame:
    """Per tape: matching lines, the first one, the same of provenance events, and how many of those there are.

    ``rows`` are (tape_id, line_no, raw, k, t); tapes without match are left out.
    """
    hit, prov = F.col("raw").contains(F.lit(literal)), F.coalesce(F.col("k").isin(*PROVENANCE), F.lit(False))
    out = rows.groupBy("tape_id").agg(
        F.count_if(hit).alias("match_count"), F.min(F.when(hit, F.col("line_no"))).alias("first_match"), F.count_if(hit & prov).alias("provenance_match_count"),
        F.min(F.when(hit & prov, F.col("line_no"))).alias("first_provenance_match"), F.count_if(prov).alias("provenance_event_count"), F.coalesce(F.max("t"), F.lit("")).alias("timestamp"),
    )
    return out.where("match_count > 0").withColumn("anchor_offset", F.coalesce("first_provenance_match", "first_match"))


GREP_ORDER = ["provenance_match_count", "match_count", "provenance_event_count", "timestamp"]


def grep_order() -> list:
    """Provenance matches, matches, provenance events and time descending, then the tape."""
    return [*[F.desc(c) for c in GREP_ORDER], F.asc("tape_id")]


def time_range(sessions_: DataFrame) -> DataFrame:
    """Least and greatest non-empty timestamp, by text; nulls if there is none."""
    t = F.when(F.col("timestamp") != "", F.col("timestamp"))
    return sessions_.agg(F.min(t).alias("start"), F.max(t).alias("end"))


def page(sessions_: DataFrame, order: list, offset: int = 0, limit: int = 10, most: int = 25) -> DataFrame:
    """The ordered page of at most ``most`` sessions."""
    return sessions_.orderBy(*order).offset(offset).limit(min(limit, most))


def prefix_related(a: DataFrame, b: DataFrame) -> DataFrame:
    """Semi join of paths: rows of ``a`` whose path equals, contains or lies in a path of ``b``.

    Each path is exploded to its ancestors, so both directions are equality joins on path prefixes.
    """
    trimmed = lambda c: F.regexp_replace(c, "/+$", "")
    parts = F.split(trimmed(F.col("path")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = b.select(trimmed(F.col("path")).alias("p")).distinct()
    down = b.select(F.explode(prefixes).alias("p")).distinct()
    rows = a.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in a.columns else a
    below = rows.select("*", F.explode(F.array_distinct(prefixes)).alias("p")).join(up, "p", "left_semi").drop("p")
    above = rows.select("*", trimmed(F.col("path")).alias("p")).join(down, "p", "left_semi").drop("p")
    return below.unionByName(above).dropDuplicates(["_id"]).drop("_id")
