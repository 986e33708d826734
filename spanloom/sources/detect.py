"""Which dialect a file is written in, from its rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.dialects.registry import DIALECTS


def _v(name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col("v"), f"$.{name}", kind)


def _type(name: str) -> Column:
    return F.coalesce(F.schema_of_variant(_v(name)), F.lit("VOID"))


def _text(name: str) -> Column:
    return F.when(_type(name) == "STRING", _v(name, "string"))


def signatures() -> dict[str, Column]:
    """Whether a row (column v, a VARIANT) shows that its file is of a dialect."""
    kind, obj, arr = _text("type"), lambda n: _type(n).startswith("OBJECT"), lambda n: _type(n).startswith("ARRAY")
    as_list = lambda path: F.coalesce(F.try_variant_get(F.col("v"), path, "array<variant>"), F.array().cast("array<variant>"))
    get = lambda x, path: F.try_variant_get(x, path, "string")
    return {
        "codex": kind.isin("session_meta", "response_item") & obj("payload"),
        "claude": kind.isin("user", "assistant") & obj("message"),
        "opencode": obj("info") & F.exists(as_list("$.messages"), lambda m: get(m, "$.info.role").isin("user", "assistant") & F.try_variant_get(m, "$.parts", "array<variant>").isNotNull()),
        "cursor": ((kind == "system") & (_text("subtype") == "init"))
        | ((kind == "tool_call") & _text("subtype").isin("started", "completed") & obj("tool_call"))
        | (kind.isin("user", "assistant") & _text("session_id").isNotNull() & _text("message.content").isNotNull()),
        "gemini": F.exists(F.coalesce(F.try_variant_get(F.col("v"), "$", "array<variant>"), F.array().cast("array<variant>")), lambda m: get(m, "$.sessionId").isNotNull() & get(m, "$.type").isin("user", "gemini") & get(m, "$.message").isNotNull())
        | (_text("sessionId").isNotNull() & F.exists(as_list("$.messages"), lambda m: get(m, "$.type").isin("user", "gemini") & F.try_variant_get(m, "$.content", "variant").isNotNull())),
        "openclaw": ((kind == "session") & F.coalesce(_text("id"), _text("session_id"), _text("sessionId")).isNotNull())
        | ((kind == "message") & _text("message.role").isin("user", "assistant", "toolResult") & arr("message.content")),
    }


def detect(lines: DataFrame, hint: str = "tape_id") -> DataFrame:
    """(tape_id, dialect) of files (tape_id, line_no, raw); null where none claims it.

    A dialect that the column ``hint`` (a path) names is offered the file first; it must claim it all the same.
    A file of lines is claimed if every non-blank line is JSON and one shows the dialect's signature; a document if its single
    line does. The first dialect in the registry's order wins.
    """
    rows = lines.where(F.trim("raw") != "").select("tape_id", F.lower(F.col(hint)).alias("hint"), F.try_parse_json("raw").alias("v"))
    sig = signatures()
    claims = rows.groupBy("tape_id").agg(
        F.bool_and(F.col("v").isNotNull()).alias("all_json"), F.count("*").alias("n"), F.min("hint").alias("hint"), *[F.bool_or(F.coalesce(sig[n], F.lit(False))).alias(n) for n in DIALECTS]
    )
    fits = {d.name: F.col(d.name) & F.col("all_json") & ((F.col("n") == 1) if d.container == "document" else F.lit(True)) for d in DIALECTS.values()}
    hinted = [F.when(fits[n] & F.col("hint").contains(n), n) for n in DIALECTS]
    return claims.select("tape_id", F.coalesce(*hinted, *[F.when(fits[n], n) for n in DIALECTS]).alias("dialect"))
