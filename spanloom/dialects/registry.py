"""The dialects that can be normalised, their container, when reads and edits are told, and their coverage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spanloom.dialects import acts


@dataclass(frozen=True)
class Dialect:
    name: str
    harness: str
    read: Callable
    container: str  # "lines": one JSON value a line; "document": one a file
    reads_at: str  # "call" or "result"
    edits_at: str
    one_shot: bool  # a call serves its first result only
    coverage: tuple[str | None, str | None, str | None]  # of reads, edits, tools; None: counted


#: In the order in which a file is offered to them.
DIALECTS = {
    d.name: d
    for d in (
        Dialect("codex", "codex-cli", acts.codex, "lines", "result", "call", False, ("partial", "partial", "full")),
        Dialect("claude", "claude-code", acts.claude, "lines", "result", "call", True, (None, None, "full")),
        Dialect("opencode", "opencode", acts.opencode, "document", "call", "call", True, ("partial", "partial", "full")),
        Dialect("cursor", "cursor", acts.cursor, "lines", "result", "result", True, ("partial", "partial", "full")),
        Dialect("gemini", "gemini-cli", acts.gemini, "document", "call", "call", True, (None, None, "full")),
        Dialect("openclaw", "openclaw", acts.openclaw, "lines", "result", "result", True, ("partial", "partial", "partial")),
    )
}


def describe(spark: SparkSession) -> DataFrame:
    rows = [(i, d.name, d.harness, d.container, d.reads_at, d.edits_at, *d.coverage) for i, d in enumerate(DIALECTS.values())]
    return spark.createDataFrame(rows, "priority INT, name STRING, harness STRING, container STRING, reads_at STRING, edits_at STRING, coverage_read STRING, coverage_edit STRING, coverage_tool STRING")
