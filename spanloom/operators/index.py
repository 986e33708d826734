"""Events to the fact tables: evidence, lineage edges, tombstones and the ledger of tapes.

A tape is indexed as a whole or not at all: an empty anchor or an edge whose confidence isn't within 0 and 1 leaves all
its facts out. Texts are fingerprinted in one Arrow pass; everything else is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import fingerprint as fp
from spanloom.functions.scalar import span_anchor, stored_class
from spanloom.operators.events import typed
from spanloom.params import DEFAULT, Params


def legacy_anchors(anchors: Column, own: Column | None = None) -> Column:
    """Composite anchors taken apart, other strings as they are; ``own`` stands in if nothing is left."""
    parts = F.array_distinct(F.flatten(F.transform(F.coalesce(anchors, fp.no_strings()), lambda a: F.when(a.startswith(fp.PREFIX), fp.expand_anchor(a)).otherwise(F.array(a)))))
    return parts if own is None else F.when((F.size(parts) == 0) & own.isNotNull(), fp.expand_anchor(own)).otherwise(parts)


def with_anchors(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds the token anchors of an event's text (``anchors``) and, of edits, of both sides and their similarity."""
    rows = typed(events)
    for c in ("before_hash", "after_hash"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    kind = F.col("kind")
    one = F.when(kind == "code.read", F.col("text")).when(kind == "code.edit", F.col("before_text")).otherwise(F.col("payload"))
    two = F.when(kind == "code.edit", F.col("after_text"))
    both = (kind == "code.edit") & F.col("before_text").isNotNull() & F.col("after_text").isNotNull()
    rows = rows.withColumn("_x", fp.both_sides(one, two, F.coalesce(both, F.lit(False)), p))
    rows = rows.select("*", F.col("_x.a1").alias("_t1"), F.col("_x.a2").alias("_t2"), F.col("_x.f1").alias("_fb"), F.col("_x.f2").alias("_fa")).drop("_x")
    side = lambda toks, hashes, own: F.when(F.size(F.coalesce(toks, fp.no_strings())) > 0, toks).otherwise(legacy_anchors(hashes, own))
    rows = rows.select(
        "*",
        F.when(kind == "code.read", F.when(F.col("text").isNotNull(), F.coalesce("_t1", fp.no_strings())).otherwise(legacy_anchors(F.col("anchor_hashes"))))
        .when(kind.isin("msg.in", "msg.out", "tool.call", "tool.result"), F.coalesce("_t1", fp.no_strings()))
        .otherwise(fp.no_strings()).alias("anchors"),
        F.when(kind == "code.edit", side(F.col("_t1"), F.col("before_anchor_hashes"), F.col("before_hash"))).otherwise(fp.no_strings()).alias("before"),
        F.when(kind == "code.edit", side(F.col("_t2"), F.col("after_anchor_hashes"), F.col("after_hash"))).otherwise(fp.no_strings()).alias("after"),
        F.coalesce(fp.jaccard(F.col("_fb"), F.col("_fa")), F.col("similarity"), F.lit(0.0).cast("float")).alias("confidence"),
    )
    return rows.drop("_t1", "_t2", "_fb", "_fa")


def valid_tapes_only(rows: DataFrame) -> DataFrame:
    """Without the tapes that have an empty anchor or an edge of impossible confidence."""
    empty = F.exists(F.concat("anchors", "before", "after"), lambda a: F.coalesce(a == "", F.lit(True)))
    edge = (F.size("before") > 0) & (F.size("after") > 0)
    impossible = edge & (F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1))
    bad = rows.where(empty | impossible).select("tape_id").distinct()
    return rows.join(bad, "tape_id", "left_anti")


def evidence(rows: DataFrame) -> DataFrame:
    """(anchor, tape_id, event_offset, kind, file_path, timestamp), once for each anchor of an event."""
    name = F.when(F.col("kind") == "code.read", "read").when(F.col("kind") == "code.edit", "edit").when(F.col("kind").startswith("msg."), "message").otherwise("tool")
    path = F.when(F.col("kind").isin("code.read", "code.edit"), F.col("file")).otherwise("")
    each = F.array_distinct(F.concat("anchors", "before", "after"))
    return rows.where("kind not in ('meta', 'span.link', 'other')").select(F.explode(each).alias("anchor"), "tape_id", "event_offset", name.alias("kind"), path.alias("file_path"), F.col("t").alias("timestamp"))


def edge_pairs(before: Column, after: Column) -> Column:
    """Both sides in proportion: as many pairs as the longer side has anchors."""
    n = F.greatest(F.size(before), F.size(after))
    at = lambda side, i: F.element_at(side, (F.floor(i * F.size(side) / n) + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(before, i).alias("from_anchor"), at(after, i).alias("to_anchor")))


def edges(rows: DataFrame) -> DataFrame:
    """Lineage edges of edits and of links set by agents."""
    edits = rows.where((F.size("before") > 0) & (F.size("after") > 0)).select(F.inline(edge_pairs(F.col("before"), F.col("after"))), "confidence")
    edits = edits.select("from_anchor", "to_anchor", "confidence", F.lit("same").alias("location_delta"), F.lit("1:1").alias("cardinality"), F.lit(False).alias("agent_link"), F.lit("").alias("note"))
    links = rows.where("kind = 'span.link'").select(
        span_anchor(F.col("from_file"), F.col("from_range")).alias("from_anchor"), span_anchor(F.col("to_file"), F.col("to_range")).alias("to_anchor"), F.lit(1.0).cast("float").alias("confidence"),
        F.lit("moved").alias("location_delta"), F.lit("1:1").alias("cardinality"), F.lit(True).alias("agent_link"), F.coalesce("note", F.lit("")).alias("note"),
    )
    return edits.unionByName(links).distinct()


def tombstones(rows: DataFrame) -> DataFrame:
    """What an edit deleted: anchors before, none after."""
    span = F.coalesce("before_range", "after_range", F.array(F.lit(0), F.lit(0)))
    gone = rows.where((F.size("after") == 0) & (F.size("before") > 0))
    return gone.select(F.explode(F.array_distinct("before")).alias("anchor"), "tape_id", "event_offset", F.col("file").alias("file_path"), span[0].alias("range_start"), span[1].alias("range_end"), F.col("t").alias("timestamp"))


def build(events: DataFrame, p: Params = DEFAULT) -> dict[str, DataFrame]:
    """All fact tables of some events. The anchored rows are computed by each table; keep them if several are written."""
    rows = valid_tapes_only(with_anchors(events, p))
    return {"evidence": evidence(rows), "edges": edges(rows), "tombstones": tombstones(rows), "tapes": rows.select("tape_id").distinct()}


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in the given total order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def latest(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """Insert-or-replace: of each key the row with the greatest ``by``."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*key, "_r.*")


def with_class(edge_table: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return edge_table.withColumn("stored_class", stored_class(F.col("confidence"), F.col("agent_link"), p))


def referenced_tapes(evidence_table: DataFrame, tombstone_table: DataFrame) -> DataFrame:
    """Tapes that any fact names."""
    return evidence_table.select("tape_id").union(tombstone_table.select("tape_id")).distinct()


def composite_stats(read_rows: DataFrame, file: str | None = None) -> DataFrame:
    """Composite anchors by file with their number of hits."""
    rows = read_rows.where(F.instr("anchor", ",") > 0)
    rows = rows if file is None else rows.where(F.col("file_path") == file)
    return rows.groupBy("file_path", "anchor").agg(F.count("*").alias("hits"))
