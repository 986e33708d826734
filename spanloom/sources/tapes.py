"""Tapes: immutable logs named by the hash of their text, in folders of compressed files or in a table."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.params import TAPE_LINES
from spanloom.sources import files

SUFFIX = ".jsonl.zst"


def tape_id_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def read_text_files(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, line_no, raw) of text files, compressed or not; line numbers count blank lines, a last newline makes no line."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    parts = F.split("value", "\n", -1)
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("path", F.posexplode(lines).alias("line_no", "raw")).select("path", F.col("line_no").cast("bigint").alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("raw"))


def read_tapes(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(tape_id, line_no, raw) of the tapes of folders; of one tape in several the first folder counts."""
    out = None
    for rank, folder in enumerate(f for f in folders if any(x.path.endswith(SUFFIX) for x in files.listed(f))):
        rows = read_text_files(spark, folder, f"*{SUFFIX}").select(F.regexp_extract("path", r"([^/]+)\.jsonl\.zst$", 1).alias("tape_id"), "line_no", "raw", F.lit(rank).alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], TAPE_LINES)
    best = out.groupBy("tape_id").agg(F.min("rank").alias("rank"))
    return out.join(best, ["tape_id", "rank"]).drop("rank")


def export_tapes(lines: DataFrame, folder: str) -> DataFrame:
    """Writes each tape of (tape_id, line_no, raw) as a compressed file named by its content, if it isn't there yet.

    The folder, a path or an address, must be one that all executors share. Gives (tape_id, content_id, n_bytes, written).
    """
    where, inner = files.place(folder)
    where.create_dir(inner, recursive=True)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        text = "".join(r + "\n" for r in pdf.sort_values("line_no")["raw"])
        content, data = tape_id_of(text), zstandard.ZstdCompressor().compress(text.encode())
        target = f"{folder}/{content}{SUFFIX}"
        fresh = files.stat(target) is None
        if fresh:
            files.write_whole(target, data)
        return pd.DataFrame([(pdf["tape_id"].iloc[0], content, len(data), fresh)], columns=["tape_id", "content_id", "n_bytes", "written"])

    return lines.groupBy("tape_id").applyInPandas(write, "tape_id STRING, content_id STRING, n_bytes BIGINT, written BOOLEAN")


def list_tapes(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(tape_id, event_count, timestamp, model, repo_head, label[, n_bytes]) of tapes, newest first."""
    from spanloom.operators.events import first_meta, read_lines

    rows = read_lines(lines)
    counts = rows.groupBy("tape_id").agg(F.count("*").alias("event_count"), F.coalesce(F.max("t"), F.lit("")).alias("timestamp"))
    out = counts.join(first_meta(rows).drop("t"), "tape_id", "left")
    out = out if files is None else out.join(files.select("tape_id", "n_bytes"), "tape_id", "left")
    return out.orderBy(F.desc("timestamp"), F.desc("event_count"), "tape_id")


def span_variants(path: str, start: int, end: int) -> list[str]:
    """Two spellings of the lines start to end (from 1, inclusive) of a file: joined by newlines, and as they stand."""
    text = Path(path).read_bytes().decode("utf-8")
    raw = [x + "\n" for x in text.split("\n")]
    raw[-1] = raw[-1][:-1]
    raw = raw if raw[-1] else raw[:-1]
    if not 1 <= start <= end <= len(raw):
        raise ValueError(f"{path} has {len(raw)} lines; {start}-{end} is no span of it")
    part = raw[start - 1 : end]
    return list(dict.fromkeys(["\n".join(x.rstrip("\r\n") for x in part), "".join(part)]))
