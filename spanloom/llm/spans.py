"""Long exact spans shared between records, by seed and extend on winnowed anchors.

1. Seeds. Every text gives winnowed anchors: hashes of SEED code points, the least of each window of anchors, so that
   two records that share MIN_SPAN code points have an anchor in common at the same place of the shared stretch, and a
   longer match one at least every REACH + 1 places.
2. Join and extend. Records are joined on anchors that up to MOST places share. Anchors of two records in one diagonal that touch
   are one match; it goes on by at most REACH code points beyond its first and last anchor, so those are all the text that
   has to be compared. Matches of MIN_SPAN and more are the maximal repeats.
3. Anchors of more places (a licence text in a third of all rows) make no pairs. Each start that such an anchor reaches is tested
   with the hash of its MIN_SPAN code points, by pre-aggregated groups: a start is shared if its stretch occurs in another
   record. A shared stretch has an anchor of the one or the other kind, so both ways together find every one.
4. The spans of a record are united, and their length is added up.

Anchors and stretches are compared by 128-bit hashes (two polynomials). Arrays of anchors are tested with runs of MIN_RUN
elements, each start, like step 3.

Defined results
* Records are rows; what recurs in the same row only isn't shared. Repeated rows share all of their texts.
* Null, empty and short texts (under MIN_SPAN) and arrays, and runs with a null element, share nothing.
* Only rows with n_shared > 0 come out; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.nested import content_blocks, parse_json
from spanloom.runtime import drop_path, materialize

CLAW, LOG = "clawline_sample", "session_log"
MIN_SPAN, MIN_RUN = 200, 6
SEED = 150
REACH = MIN_SPAN - SEED
#: Anchors of up to so many places are joined in pairs; a place then has fewer partners than this.
MOST = 32
#: Code points hashed at once.
CHUNK = 1_000_000

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class Hashes:
    """Polynomial hashes of any stretches of the concatenation of some texts."""

    def __init__(self, texts: list[str], bases=_BASES):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        n, values = len(points), _mix(points + _U(0x1234567))
        self.sums, self.back = [], []
        for base in bases:
            inverse = _U(pow(int(base), -1, 2**64))
            powers = np.cumprod(np.concatenate([[_U(1)], np.full(n, base, np.uint64)]))
            self.sums.append(np.concatenate([[_U(0)], np.cumsum(values * powers[:n])]))
            self.back.append(np.cumprod(np.concatenate([[_U(1)], np.full(n, inverse, np.uint64)])))

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Signed 64-bit hashes of the stretches from start to end, which tell lengths apart."""
        h = (self.sums[which][end] - self.sums[which][start]) * self.back[which][start]
        return _mix(h + (end - start).astype(np.uint64) * _M1).view(np.int64)


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash (the last of equal ones) of every window of ``width``."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    least, at, size = h, np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        right = least[step:] <= least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return np.unique(at)


def _chunks(lengths: list[int]) -> Iterator[slice]:
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > CHUNK:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def _batch(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, rec, no = b.column("text").to_pylist(), b.column("rec").to_numpy(), b.column("no").to_numpy()
        for s in _chunks([len(t) for t in texts]):
            hashes = Hashes(texts[s])
            first = np.arange(max(0, hashes.at[-1] - SEED + 1))
            grams = hashes.of(0, first, first + SEED)
            places = [x + winnow(grams[x : y - SEED + 1], REACH + 1) for x, y in zip(hashes.at[:-1], hashes.at[1:], strict=True)]
            n, at = [len(p) for p in places], np.concatenate(places)
            yield _batch(["h1", "h2", "rec", "no", "pos"], grams[at], hashes.of(1, at, at + SEED), np.repeat(rec[s], n), np.repeat(no[s], n), (at - np.repeat(hashes.at[:-1], n)).astype(np.int32))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each seed with the REACH code points before and after it."""
    for b in batches:
        for k in range(b.num_rows):
            text, rec, no, seeds = (b.column(c)[k].as_py() for c in ("text", "rec", "no", "seeds"))
            rows = [(x["h1"], x["h2"], rec, no, p := x["pos"], text[max(0, p - REACH) : p], text[p + SEED : p + SEED + REACH]) for x in seeds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CONTEXT_ARROW.types, strict=True)], schema=_CONTEXT_ARROW)


_CONTEXT = "h1 BIGINT, h2 BIGINT, rec BIGINT, no INT, pos INT, before STRING, after STRING"
_CONTEXT_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("rec", pa.int64()), ("no", pa.int32()), ("pos", pa.int32()), ("before", pa.string()), ("after", pa.string())])
_PAIR = ["rec", "no", "rec2", "no2", "shift"]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far the texts around two equal seeds agree, to the left and to the right."""
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("before", "before2", "after", "after2")]
        left = [len(commonprefix((x[::-1], y[::-1]))) for x, y in zip(cols[0], cols[1], strict=True)]
        right = [len(commonprefix((x, y))) for x, y in zip(cols[2], cols[3], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.select([*_PAIR, "pos"]).columns, pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=[*_PAIR, "pos", "left", "right"])


def extended(seeds: DataFrame) -> DataFrame:
    """(rec, no, a, b): the maximal repeats of MIN_SPAN and more that seeds (see ``_CONTEXT``) are extended to, on both sides."""
    other = seeds.select("h1", "h2", *[F.col(c).alias(f"{c}2") for c in ("rec", "no", "pos", "before", "after")])
    pairs = seeds.join(other, ["h1", "h2"]).where("rec < rec2").withColumn("shift", F.col("pos2") - F.col("pos"))
    pairs = pairs.select(*_PAIR, "pos", "before", "before2", "after", "after2").mapInArrow(_extend, "rec BIGINT, no INT, rec2 BIGINT, no2 INT, shift INT, pos INT, left INT, right INT")
    diagonal = W.partitionBy(*_PAIR).orderBy("pos")
    begins = F.coalesce(F.col("pos") - F.lag("pos").over(diagonal) > SEED, F.lit(True))
    runs = pairs.withColumn("_begins", begins.cast("int")).withColumn("run", F.sum("_begins").over(diagonal.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = runs.groupBy(*_PAIR, "run").agg((F.min("pos") - F.min_by("left", "pos")).alias("a"), (F.max("pos") + SEED + F.max_by("right", "pos")).alias("b")).where(F.col("b") - F.col("a") >= MIN_SPAN)
    sides = F.array(F.struct("rec", "no", "a", "b"), F.struct(F.col("rec2").alias("rec"), F.col("no2").alias("no"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b")))
    return spans.select(F.inline(sides)).distinct()


def _starts(length: int, seeds: list[int]) -> np.ndarray:
    """All starts from REACH before a seed to the seed whose stretch fits into the text."""
    mark = np.zeros(length + 2, np.int32)
    at = np.asarray(seeds, np.int64)
    np.add.at(mark, np.maximum(at - REACH, 0), 1)
    np.add.at(mark, at + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: length - MIN_SPAN + 1] > 0)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 128-bit hash of the stretch at each start."""
    for b in batches:
        texts, rec, no, seeds = b.column("text").to_pylist(), b.column("rec").to_numpy(), b.column("no").to_numpy(), b.column("seeds").to_pylist()
        for s in _chunks([len(t) for t in texts]):
            hashes = Hashes(texts[s])
            starts = [_starts(len(t), p) for t, p in zip(texts[s], seeds[s], strict=True)]
            n = [len(x) for x in starts]
            first = np.concatenate(starts)
            lo = first + np.repeat(hashes.at[:-1], n)
            yield _batch(["g1", "g2", "rec", "no", "a"], hashes.of(0, lo, lo + MIN_SPAN), hashes.of(1, lo, lo + MIN_SPAN), np.repeat(rec[s], n), np.repeat(no[s], n), first.astype(np.int32))


def in_several(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose key occurs in more than one record; the test is a pre-aggregated group, never a pair."""
    keys = rows.groupBy(*key).agg(F.min("rec").alias("low"), F.max("rec").alias("high")).where("low < high").select(*key)
    return rows.join(keys, list(key), "left_semi")


def covered(spans: DataFrame) -> DataFrame:
    """(rec, n_shared): the length of the union of each record's spans (rec, no, a, b)."""
    before = F.max("b").over(W.partitionBy("rec", "no").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(before, F.col("a"))), F.lit(0))
    return spans.withColumn("new", new).groupBy("rec").agg(F.sum("new").alias("n_shared"))


def shared_texts(pool: DataFrame, most: int = MOST) -> DataFrame:
    """(rec, n_shared) of texts (rec, no, text); ``no`` numbers the texts of a record."""
    spark = pool.sparkSession
    pool, pool_path = materialize(pool.where(F.length("text") >= MIN_SPAN), "pool")
    anchors, anchors_path = materialize(pool.mapInArrow(_seeds, "h1 BIGINT, h2 BIGINT, rec BIGINT, no INT, pos INT"), "anchors")
    groups = anchors.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("rec").alias("low"), F.max("rec").alias("high")).where("low < high").select("h1", "h2", (F.col("n") > most).alias("hot"))
    shared = anchors.join(groups, ["h1", "h2"])
    of_text = shared.groupBy("rec", "no").agg(F.collect_list(F.when(~F.col("hot"), F.struct("h1", "h2", "pos"))).alias("seeds"), F.collect_list(F.when(F.col("hot"), F.col("pos"))).alias("hot"))
    candidates, _ = materialize(pool.join(of_text, ["rec", "no"]), "candidates")
    drop_path(spark, anchors_path)
    drop_path(spark, pool_path)
    repeats = extended(candidates.where("size(seeds) > 0").select("text", "rec", "no", "seeds").mapInArrow(_contexts, _CONTEXT))
    windows = candidates.where("size(hot) > 0").select("text", "rec", "no", F.col("hot").alias("seeds")).mapInArrow(_stretches, "g1 BIGINT, g2 BIGINT, rec BIGINT, no INT, a INT")
    tested = in_several(windows, "g1", "g2").select("rec", "no", "a", (F.col("a") + MIN_SPAN).alias("b"))
    return covered(repeats.unionByName(tested))


def shared_runs(arrays: DataFrame) -> DataFrame:
    """(rec, n_shared) of arrays (rec, items): elements in runs of MIN_RUN that stand in another record."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size("items") - MIN_RUN),
        lambda i: F.when(
            F.forall(F.slice("items", i + 1, MIN_RUN), lambda x: x.isNotNull()),
            F.struct(i.cast("int").alias("a"), F.xxhash64(F.slice("items", i + 1, MIN_RUN)).alias("g1"), F.xxhash64(F.lit("second"), F.slice("items", i + 1, MIN_RUN)).alias("g2")),
        ),
    )
    rows = arrays.where(F.size("items") >= MIN_RUN).select("rec", F.inline(F.filter(runs, lambda r: r.isNotNull())))
    rows = rows.select("g1", "g2", "rec", F.lit(0).alias("no"), "a")
    return covered(in_several(rows, "g1", "g2").select("rec", "no", "a", (F.col("a") + MIN_RUN).alias("b")))


def message_texts(message: str | None) -> list[str]:
    """The texts of a log message: those of its top-level text blocks, or the content itself if it is a plain string."""
    m = parse_json(message)
    content = m.get("content") if isinstance(m, dict) else None
    if isinstance(content, str) and not isinstance(parse_json(content), list):
        return [content]
    return [b["text"] for b in content_blocks(m) if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)]


def _log_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rec, no, text = [], [], []
        for row_id, message in zip(b.column("row_id").to_pylist(), b.column("message").to_pylist(), strict=True):
            for i, t in enumerate(message_texts(message)):
                if len(t) >= MIN_SPAN:  # lone surrogates can't be stored; each is kept as one code point of its own
                    rec.append(row_id * 2 + 1), no.append(i), text.append("".join("�" if "\ud800" <= c <= "\udfff" else c for c in t) if not t.isascii() else t)
        yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(no, pa.int32()), pa.array(text, pa.string())], names=["rec", "no", "text"])


def found(claw: DataFrame, log: DataFrame) -> DataFrame:
    """A record is row_id * 2 + (0 for clawline_sample, 1 for session_log)."""
    of_claw = claw.where("content is not null").select((F.col("row_id") * 2).alias("rec"), F.lit(0).alias("no"), F.col("content").alias("text"))
    of_log = log.where("message is not null").select("row_id", "message").mapInArrow(_log_texts, "rec BIGINT, no INT, text STRING")
    texts = shared_texts(of_claw.unionByName(of_log)).withColumn("kind", F.when(F.col("rec") % 2 == 0, "content").otherwise("text"))
    runs = shared_runs(claw.select((F.col("row_id") * 2).alias("rec"), F.col("anchor_hashes").alias("items"))).withColumn("kind", F.lit("anchor_hashes"))
    src = F.when(F.col("rec") % 2 == 0, CLAW).otherwise(LOG)
    return texts.unionByName(runs).where("n_shared > 0").select(src.alias("src"), F.col("kind").alias("field"), F.shiftright("rec", 1).alias("row_id"), F.col("n_shared").cast("int").alias("n_shared"))
