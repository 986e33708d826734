"""Files that only grow: what is new since a cursor, in batches and as a streaming source.

The cursor of a file is the length of its complete prefix: lines that are blank or valid JSON; an unterminated last line
counts if it is valid. A guard, the hash of the last bytes before the cursor, tells a file that was rewritten from one that grew.
Only the guard's bytes and what lies behind the cursor are read, so the cost is that of the new bytes; a file whose size and guard
are unchanged costs its entry in the listing and the guard.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from spanloom.functions.scalar import glob_to_regex
from spanloom.params import DEFAULT
from spanloom.sources import files

SCHEMA = "path STRING, start BIGINT, line_no BIGINT, raw STRING"


def _valid(line: bytes) -> bool:
    if not line.strip():
        return True
    try:
        json.loads(line)
        return True
    except ValueError:
        return False


def _document(path: str) -> bool:
    return path.lower().endswith(".json")


def guard(path: str, cursor: int, size: int = DEFAULT.guard_bytes) -> str:
    return hashlib.sha256(files.read_range(path, max(0, cursor - size), cursor)).hexdigest()


def continues(path: str, known: list | None, size: int) -> bool:
    """Whether a file of that size still begins with what was read before, by its guard."""
    return known is not None and size >= known[0] and guard(path, known[0]) == known[1]


def _complete(path: str, start: int, end: int) -> Iterator[bytes]:
    """The complete lines from ``start`` on."""
    for line in files.lines(path, start, end):
        if not _valid(line):
            return
        yield line


def state_of(path: str, known: list | None = None, seen: files.Seen | None = None) -> list | None:
    """[cursor, guard] of a file now; only what lies behind a known cursor that still holds is read."""
    seen = seen or files.stat(path)
    if seen is None:
        return None
    holds = continues(path, known, seen.size)
    if _document(path):
        if holds and known[0] == seen.size:
            return known
        data = files.read_range(path, 0, seen.size)
        return [len(data), guard(path, len(data))] if _valid(data) else known
    start = known[0] if holds else 0
    if holds and start == seen.size:
        return known
    cursor = start + sum(map(len, _complete(path, start, seen.size)))
    return known if holds and cursor == start else [cursor, guard(path, cursor)]


def new_part(path: str, known: list | None, now: list) -> tuple[int, int] | None:
    """(from, to) of the bytes to read: what was appended, or all if the file was cut, rewritten or never read; None if nothing is new."""
    if known == now:
        return None
    if known is None or _document(path):
        return 0, now[0]
    start = known[0] if now[0] >= known[0] and continues(path, known, now[0]) else 0
    return (start, now[0]) if now[0] > start else None


def lines_between(path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(line_no within the part, text)."""
    if _document(path):
        data = files.read_range(path, start, end)
        if data.strip():
            yield 0, json.dumps(json.loads(data), ensure_ascii=False)
        return
    for i, line in enumerate(files.lines(path, start, end)):
        yield i, line.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r")


_NEW = "path STRING, start BIGINT, line_no BIGINT, raw STRING, cursor BIGINT, guard STRING"
_NEW_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("line_no", pa.int64()), ("raw", pa.string()), ("cursor", pa.int64()), ("guard", pa.string())])
_ROWS, _BYTES = 4096, 4 << 20


def _new_rows(path: str, known: list | None) -> Iterator[tuple]:
    now = state_of(path, known)
    part = new_part(path, known, now) if now else None
    if part is None:
        return
    yield path, part[0], -1, None, *now
    for no, raw in lines_between(path, *part):
        yield path, part[0], no, raw, None, None


def read_new(offered: DataFrame) -> DataFrame:
    """(path, start, line_no, raw, cursor, guard) of what is new in files (path, cursor, guard), read on the executors.

    A file with something new has one row with line_no -1 and its cursor and guard now, then its lines. Each file is a
    task of its own, which holds a few lines at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for path, cursor, mark in zip(*[b.column(c).to_pylist() for c in ("path", "cursor", "guard")], strict=True):
                for row in _new_rows(path, None if cursor is None else [cursor, mark]):
                    out.append(row)
                    size += len(row[3] or "")
                    if len(out) >= _ROWS or size >= _BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _NEW_ARROW.types, strict=True)], schema=_NEW_ARROW)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _NEW_ARROW.types, strict=True)], schema=_NEW_ARROW)

    return offered.select("path", "cursor", "guard").mapInArrow(read, _NEW)


class FilePart(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class AppendedReader(DataSourceStreamReader):
    """Offsets are {path: [cursor, guard]}; a batch has one partition for each file with something new.

    A file is taken up when it appears or its size or time of change differs from the last look (so what only reads or deletes
    it is no event), and ``debounce`` seconds after its change was first seen, each file by itself.
    """

    def __init__(self, folder: str, pattern: str, glob: str | None = None, debounce: float = 0.0):
        self.folder, self.debounce = folder.rstrip("/"), debounce
        self.name, self.below = re.compile(glob_to_regex(pattern)), re.compile(glob_to_regex(glob)) if glob else None
        self.last: dict[str, list] = {}
        self.looked: dict[str, files.Seen] = {}
        self.pending: dict[str, float] = {}

    def wanted(self, path: str) -> bool:
        inside = path[len(self.folder) + 1 :]
        return bool(self.name.match(files.name_of(path))) and (self.below is None or bool(self.below.match(inside)))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = time.monotonic()
        for seen in files.listed(self.folder):
            p = seen.path
            if not self.wanted(p) or self.looked.get(p) == seen:
                continue
            if now - self.pending.setdefault(p, now) < self.debounce:
                continue
            state = state_of(p, self.last.get(p), seen)
            self.looked[p] = seen
            self.pending.pop(p)
            if state is not None:
                self.last[p] = state
        return dict(self.last)

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        parts = [(p, new_part(p, start.get(p), now)) for p, now in end.items() if start.get(p) != now]
        return [FilePart(p, *x) for p, x in parts if x]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        for no, raw in lines_between(partition.path, partition.start, partition.end):
            yield partition.path, partition.start, no, raw

    def commit(self, end: dict) -> None:
        self.last.update(end)


class Appended(DataSource):
    """``spark.readStream.format("appended").option("path", folder)``; options pattern (of names), glob (of paths below it), debounce (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "appended"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> AppendedReader:
        o = self.options
        return AppendedReader(o["path"], o.get("pattern", "*.jsonl"), o.get("glob") or None, float(o.get("debounce", "0")))


def offered(spark, paths: list[str], cursors: DataFrame) -> DataFrame:
    """(path, cursor, guard): the files with what is known of them, one task each."""
    every = spark.createDataFrame([(p,) for p in paths], "path STRING")
    rows = every.join(cursors.select("path", "cursor", "guard"), "path", "left")
    return rows.repartition(max(1, min(len(paths), 10_000)), F.col("path"))
