"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated as often as allowed, each round shuffled anew. A
document's virtual finish time is the tokens of its source up to and with it, divided by the source's target share.
Sorting all queues by finish time and cutting at the total budget gives each source its share at any prefix of the
mixture. By default the budget is the largest at which no source runs dry.

The running sums are made in two levels: buckets of the shuffled order are summed, the few bucket totals are summed up
by source, and documents are summed inside their bucket, so no task holds a source.

Defined results
* Null and empty texts have no tokens and are no records; sources without target, or null, aren't mixed.
* Shares are taken relative to the sum of those whose source has tokens; a source without share isn't mixed.
* max_repeats counts all uses: 1 means each document at most once; below 1 the source isn't mixed.
* Ties in the shuffled order go by doc_id; empty documents or targets give an empty mixture.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.tokens import sizes
from spanloom.runtime import materialize

#: Expected records of a bucket of the shuffled order.
BUCKET_ROWS = 50_000


def _plan(totals: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], budget: float | None) -> list[tuple]:
    """(source, share, rounds, cap in tokens, buckets) of each mixed source; one entry for each row of the targets."""
    live = [(s, w, r, *totals[s]) for s, w, r in targets if s in totals and w and w > 0 and r and r >= 1 and totals[s][0] > 0]
    if not live:
        return []
    all_w = sum(x[1] for x in live)
    most = min(r * tokens / (w / all_w) for _, w, r, tokens, _ in live)
    budget = most if budget is None else float(budget)
    out = []
    for s, w, r, tokens, n in live:
        cap = float(min(budget * w / all_w * (1 + 1e-12), r * tokens))
        out.append((s, w / all_w, max(1, min(r, ceil(cap / tokens - 1e-9))), cap, max(1, ceil(n / BUCKET_ROWS))))
    return out


def mix_sizes(sized: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 17) -> DataFrame:
    """The mixture (doc_id, source, repeat, n_tokens, finish) in order, from (doc_id, source, n_tokens)."""
    spark = sized.sparkSession
    sized = sized.where("n_tokens > 0 and source is not null")
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null").collect()]
    # one total for each row of the targets comes to the driver
    known = spark.createDataFrame([(s,) for s, _, _ in wanted], "source STRING")
    totals = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).join(known, "source", "left_semi").collect()}
    plan = spark.createDataFrame(_plan(totals, wanted, budget), "source STRING, share DOUBLE, rounds INT, cap DOUBLE, buckets INT")
    rows = sized.join(F.broadcast(plan), "source").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "repeat", "doc_id"))
    rows = rows.withColumn("bucket", F.least(F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * F.col("buckets")).cast("int"), F.col("buckets") - 1))
    group = ["source", "repeat", "bucket"]
    totals_df = rows.groupBy(*group).agg(F.sum("n_tokens").alias("in_bucket"))
    before = totals_df.withColumn("before", F.sum("in_bucket").over(W.partitionBy("source").orderBy("repeat", "bucket")) - F.col("in_bucket")).drop("in_bucket")
    inside = W.partitionBy(*group).orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.withColumn("inside", F.sum("n_tokens").over(inside)).join(before, group)
    upto = F.col("before") + F.col("inside")
    kept = summed.where(upto <= F.col("cap")).select("doc_id", "source", "repeat", "n_tokens", (upto / F.col("share")).alias("finish"), "key")
    return kept.orderBy("finish", "source", "repeat", "key", "doc_id").drop("key")


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 17, path: str | None = None) -> DataFrame:
    """The mixture of documents, with sizes in tokens."""
    sized, _ = materialize(sizes(documents, path), "sizes")
    return mix_sizes(sized, targets, budget, seed)


def records(mixture: DataFrame, documents: DataFrame) -> DataFrame:
    """The mixed records with their texts, in order of finish time."""
    texts = documents.where("text <> ''").select("doc_id", "text")
    return mixture.join(texts, "doc_id").repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each source of the targets."""
    got = mixture.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("n_tokens").alias("n_tokens"), F.max("repeat").alias("repeats_used"))
    both = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(0, ["n_records", "n_tokens", "repeats_used"])
    total = got.agg(F.sum("n_tokens").alias("all_tokens"))  # one row
    return both.join(F.broadcast(total)).withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0))).drop("all_tokens")
