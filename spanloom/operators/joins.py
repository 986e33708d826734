"""Joins that the engine lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.running import position_bucket, running_last


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str], strict: bool = True, ties: Column | None = None, bucket: Callable[[Column], Column] = position_bucket) -> DataFrame:
    """Left as-of join: each left row gets ``take`` of the last right row of its group at or (strict) only before its time.

    Both sides are united and sorted by group and time, without pairs; ``bucket`` cuts the time, so that a large group
    is no single task. Of right rows of one time the one with the greatest ``ties`` counts. Rows with a null key or time match
    nothing.
    """
    value = F.struct(*take)
    left_rows = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(left_at).alias("_at"), F.lit(1 if not strict else 0).alias("_side"), F.struct(*left.columns).alias("_row"))
    right_rows = right.where(F.col(right_at).isNotNull()).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(right_at).alias("_at"), F.lit(0 if not strict else 1).alias("_side"), value.alias("_value"), (ties if ties is not None else F.lit(0)).alias("_tie")
    )
    left_rows = left_rows.withColumn("_value", F.lit(None).cast(right_rows.schema["_value"].dataType)).withColumn("_tie", F.lit(None).cast(right_rows.schema["_tie"].dataType))
    both = left_rows.unionByName(right_rows.withColumn("_row", F.lit(None).cast(left_rows.schema["_row"].dataType)))
    keys = [f"_k{i}" for i in range(len(by))]
    matched = running_last(both, keys, ["_at", "_side", "_tie"], bucket(F.col("_at")), "_value", "_last").where("_row is not null")
    known = F.expr(" and ".join(f"{k} is not null" for k in [*keys, "_at"]))
    return matched.select("_row.*", *[F.when(known, F.col("_last")[c]).alias(c) for c in take])


def pair_latest(calls: DataFrame, results: DataFrame, by: list[str], at: str, consume: bool = False, bucket: Callable[[Column], Column] = position_bucket) -> DataFrame:
    """Each result with the latest earlier call of its group; with ``consume`` a call serves its first result only."""
    out = asof_backward(results, calls.withColumn("call_at", F.col(at)), by, at, at, ["call_at"], bucket=bucket)
    if not consume:
        return out
    first = W.partitionBy(*by, "call_at").orderBy(at)
    return out.withColumn("call_at", F.when(F.row_number().over(first) == 1, F.col("call_at")))
