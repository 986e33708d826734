"""Queries of the problems for training data (p3, p6 to p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import conversations, mixing, secrets, spam, spans, tokens
from spanloom.llm.sql import SQL  # noqa: F401
from spanloom.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.found(table(spark, d, "supported_paths"), table(spark, d, "clawline_sample"))


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    return secrets.masked(secrets.fields(table(spark, d, "supported_paths"), table(spark, d, "clawline_sample")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.found(table(spark, d, spans.CLAW), table(spark, d, spans.LOG))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.found(table(spark, d, conversations.CLAUDE), table(spark, d, conversations.CURSOR))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixture_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mixture_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p9_records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mixing.records(mixing.mix(docs, table(spark, d, "mixture_targets")), docs)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.found(table(spark, d, "documents"))


QUERIES = {"p3_found": p3_found, "p3_masked": p3_masked, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_records": p9_records, "p10_found": p10_found}
