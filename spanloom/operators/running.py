"""Running values over sorted groups of which one may hold a third of all rows.

A window by group alone would put such a group into one task. Here the order is cut into buckets of a bounded range, rows are
windowed inside (group, bucket), and what the buckets before have given is added from a small table with one row for
each (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of a bucket, as a power of two.
BITS = 13


def position_bucket(c: Column, bits: int = BITS) -> Column:
    """Bucket of a position: neighbours share one."""
    return F.shiftright(F.coalesce(c.cast("bigint"), F.lit(-1).cast("bigint")), bits)


def day_bucket(c: Column) -> Column:
    return F.to_date(c)


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str, before: bool = False) -> DataFrame:
    """Adds the sum of ``value`` over the group's rows up to (or only before) each row."""
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    sums = sums.withColumn("_before", F.sum("_t").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_t")).drop("_t")
    w = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    inside = rows.withColumn("_in", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    joined = inside.alias("l").join(sums.alias("r"), same, "left")
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("_in") + F.coalesce("_before", F.lit(0))).alias(name))


def running_last(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """Adds the last non-null ``value`` of the group's rows up to each row."""
    rows = df.withColumn("_b", bucket)
    filled = rows.where(F.col(value).isNotNull())
    last = filled.groupBy(*keys, "_b").agg(F.max_by(value, F.struct(*order)).alias("_l"))
    every = rows.groupBy(*keys, "_b").agg(F.lit(1).alias("_one")).drop("_one").alias("e").join(last.alias("x"), [F.col(f"e.{k}").eqNullSafe(F.col(f"x.{k}")) for k in [*keys, "_b"]], "left")
    every = every.select(*[F.col(f"e.{k}") for k in [*keys, "_b"]], "_l")
    carry = every.withColumn("_carry", F.last("_l", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).drop("_l")
    w = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.withColumn("_in", F.last(value, ignorenulls=True).over(w))
    joined = inside.alias("l").join(carry.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]], "left")
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], F.coalesce("_in", "_carry").alias(name))
