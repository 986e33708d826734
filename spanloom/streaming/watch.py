"""Watching folders: appended transcript lines are normalised and indexed in micro-batches.

Every appended part becomes a tape of its own, named by its content, so a batch that is run again stores nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from spanloom.params import DEFAULT, Params
from spanloom.sources import files
from spanloom.sources.append import Appended


class WatchLog(StreamingQueryListener):
    """Tells of each batch through a function."""

    def __init__(self, tell: Callable[[str], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell(f"started {event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.tell(f"{p.timestamp} batch {p.batchId}: {p.numInputRows} lines")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(f"ended {event.id} {event.exception or ''}")


@dataclass(frozen=True)
class WatchSource:
    """Files below a folder: those whose name fits the pattern and whose path below the folder fits the glob, if there is one."""

    folder: str
    pattern: str = "*.jsonl"
    glob: str | None = None


def appended(spark: SparkSession, source: WatchSource, debounce: float = 0.0) -> DataFrame:
    spark.dataSource.register(Appended)
    reader = spark.readStream.format("appended").option("path", source.folder).option("pattern", source.pattern).option("debounce", str(debounce))
    return (reader.option("glob", source.glob) if source.glob else reader).load()


def parts_as_tapes(batch: DataFrame) -> DataFrame:
    """(tape_id, line_no, raw): each file's new part is a tape of its own."""
    return batch.select(F.concat_ws("@", "path", F.col("start").cast("string")).alias("tape_id"), "line_no", "raw")


def watch(spark: SparkSession, source: WatchSource, ingest: Callable[[DataFrame], object], checkpoint: str, once: bool = False, tell: Callable[[str], None] | None = None, p: Params = DEFAULT) -> StreamingQuery:
    """Calls ``ingest`` with the new lines of each batch. A batch that takes longer than the timeout has its jobs cancelled.

    Each changed file waits for the debounce time by itself; the trigger only looks, several times in that span. ``once``
    takes what is there now and ends.
    """
    if tell is not None:
        spark.streams.addListener(WatchLog(tell))

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        import threading

        sc = batch.sparkSession.sparkContext
        sc.setJobGroup(f"watch-{number}", "indexing appended lines", interruptOnCancel=True)
        timer = threading.Timer(p.ingest_timeout_s, sc.cancelJobGroup, [f"watch-{number}"])
        timer.start()
        try:
            told = ingest(parts_as_tapes(batch))
            if tell is not None:
                tell(f"ingest ok folder={source.folder} {told}")
        except Exception as e:
            if tell is not None:
                tell(f"ingest failed folder={source.folder} {type(e).__name__}: {str(e)[:500]}")
            raise
        finally:
            timer.cancel()

    writer = appended(spark, source, 0.0 if once else p.debounce_s).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(250, int(p.debounce_s * 250))} milliseconds")
    return writer.start()


def watch_sources(spark: SparkSession, sources: list[WatchSource], ingest: Callable[[DataFrame], object], checkpoint: Callable[[WatchSource], str], once: bool = False, tell: Callable[[str], None] | None = None, p: Params = DEFAULT) -> list[StreamingQuery]:
    """One query for each source whose folder is there."""
    tell = tell or (lambda _: None)
    tell(f"watch started sources={len(sources)}")
    there = []
    for s in sources:
        where, inner = files.place(s.folder)
        if where.get_file_info(inner).type.name == "Directory":
            tell(f"watch source path={s.folder} pattern={s.pattern} glob={s.glob} debounce={p.debounce_s} timeout={p.ingest_timeout_s}")
            there.append(s)
        else:
            tell(f"watch source skipped missing_dir={s.folder}")
    if not there:
        raise ValueError("no watch source is there")
    return [watch(spark, s, ingest, checkpoint(s), once, tell, p) for s in there]
