"""Winnowed k-gram fingerprints of text.

A text is cut into overlapping windows of lines; the tokens of a window form k-grams, whose hashes are winnowed to
the least of each few neighbours. There are two forms with the same results: Column expressions, which SQL can
check and which need no Python, and Arrow-batched functions that hash each k-gram of a text once instead of once for each
window, the faster ones for whole corpora.

Hashes are the first 16 hexadecimal digits of SHA-256, so their order as text is that of unsigned numbers.
Null texts have no tokens, no windows and no anchors; texts of fewer tokens than a k-gram have no anchors.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.params import DEFAULT, Params

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[\p{IsAlphabetic}\p{N}_]+|[^\p{IsWhite_Space}]"
PREFIX = "winnow:"
UNIT = "\x1f"
_STRINGS = "array<string>"
_TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}_]+|[^\p{White_Space}]")
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def no_strings() -> Column:
    return F.array().cast(_STRINGS)


# --- Column expressions ---


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased in ASCII only, and every other visible character."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def kgrams(toks: Column, p: Params = DEFAULT) -> Column:
    """Hashes of all k-grams, in order."""
    grams = F.transform(F.sequence(F.lit(1), F.size(toks) - (p.kgram - 1)), lambda i: short_hash(F.array_join(F.slice(toks, i, p.kgram), UNIT)))
    return F.when(F.size(toks) >= p.kgram, grams).otherwise(no_strings())


def winnowed(grams: Column, p: Params = DEFAULT) -> Column:
    """The least hash of every window of k-grams, distinct in order; all hashes if there are no more than a window."""
    least = F.transform(F.sequence(F.lit(1), F.size(grams) - (p.winnow - 1)), lambda i: F.array_min(F.slice(grams, i, p.winnow)))
    return F.array_distinct(F.when(F.size(grams) > p.winnow, least).otherwise(grams))


def lines_of(text: Column) -> Column:
    """Lines without terminators; a last newline makes no line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def window_starts(n_lines: Column, p: Params = DEFAULT) -> Column:
    """First lines of the windows of a text."""
    last = F.ceil((n_lines - p.window_lines) / p.step).cast("int")
    return F.when(n_lines > p.window_lines, F.transform(F.sequence(F.lit(0), last), lambda i: i * p.step)).otherwise(F.array(F.lit(0)))


def anchor_of(features: Column) -> Column:
    """One composite anchor of all features; null without features."""
    return F.when(F.size(features) > 0, F.concat(F.lit(PREFIX), F.array_join(features, ",")))


def expand_anchor(anchor: Column) -> Column:
    """The token anchors of a composite one; none of any other string."""
    pieces = F.filter(F.split(F.substring(anchor, len(PREFIX) + 1, 2**30), ","), lambda x: x != "")
    return F.when(anchor.startswith(PREFIX), F.transform(pieces, lambda x: F.concat(F.lit(PREFIX), x))).otherwise(no_strings())


def parsed_features(anchor: Column) -> Column:
    """The set of hashes of an anchor; null if it is none or a piece isn't hexadecimal."""
    pieces = F.transform(F.filter(F.split(F.substring(anchor, len(PREFIX) + 1, 2**30), ","), lambda x: x != ""), lambda x: F.lpad(F.lower(x), 16, "0"))
    ok = anchor.startswith(PREFIX) & F.forall(pieces, lambda x: x.rlike("^[0-9a-f]{16}$")) & (F.size(pieces) > 0)
    return F.when(ok, F.array_distinct(pieces))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets of features as FLOAT; null if one is null or empty."""
    ok = (F.size(F.coalesce(a, no_strings())) > 0) & (F.size(F.coalesce(b, no_strings())) > 0)
    return F.when(ok, (F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))).cast("float"))


def sample_anchors(anchors: Column, n: int = DEFAULT.max_anchors) -> Column:
    """Up to n anchors spread evenly over the list, first and last included."""
    last = F.size(anchors) - 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.element_at(anchors, (F.floor(s * last / (n - 1)) + 1).cast("int")))
    return F.when(F.size(anchors) > n, F.array_distinct(spread)).otherwise(anchors)


# --- over tables ---


def with_windows(df: DataFrame, text: str = "text", p: Params = DEFAULT) -> DataFrame:
    """One row for each window: window_no, start_line, n_lines and window_text."""
    rows = computed_once(df.where(F.col(text).isNotNull()), _lines=lines_of(F.col(text)))
    rows = rows.withColumn("_n", F.size("_lines")).select("*", F.posexplode(window_starts(F.col("_n"), p)).alias("window_no", "start_line"))
    piece = F.array_join(F.slice("_lines", F.col("start_line") + 1, p.window_lines), "\n")
    whole = F.col("_n") <= p.window_lines
    return (
        rows.withColumn("n_lines", F.least(F.lit(p.window_lines), F.col("_n") - F.col("start_line")))
        .withColumn("window_text", F.when(whole, F.col(text)).otherwise(piece))
        .drop("_lines", "_n")
    )


def computed_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a generator, through which filters on them aren't pushed.

    Else a pushed filter would put the whole expression in place of the column, inside of lambdas even for each element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def with_features(df: DataFrame, text: str = "text", name: str = "features", p: Params = DEFAULT) -> DataFrame:
    """Adds the winnowed features of a whole text, without windows."""
    rows = computed_once(df, _tokens=tokens(F.col(text)))
    rows = computed_once(rows, _grams=kgrams(F.col("_tokens"), p))
    return computed_once(rows, **{name: F.when(F.col(text).isNotNull(), winnowed(F.col("_grams"), p))}).drop("_tokens", "_grams")


def token_anchors_native(df: DataFrame, keys: list[str], text: str = "text", p: Params = DEFAULT) -> DataFrame:
    """Distinct (keys, anchor) by Column expressions."""
    rows = with_features(with_windows(df.select(*keys, text), text, p), "window_text", "features", p)
    return rows.select(*keys, F.explode("features").alias("h")).distinct().select(*keys, F.concat(F.lit(PREFIX), "h").alias("anchor"))


# --- the same in Python, for Arrow batches ---


def tokens_py(text: str) -> list[str]:
    return _TOKEN.findall(text.translate(_ASCII_LOWER))


def _gram_hashes(toks: list[str], p: Params) -> list[str]:
    sha = hashlib.sha256
    return [sha(UNIT.join(toks[i : i + p.kgram]).encode("utf-8", "surrogatepass")).hexdigest()[:16] for i in range(len(toks) - p.kgram + 1)]


def _winnow(grams: list[str], p: Params) -> list[str]:
    if len(grams) <= p.winnow:
        return list(dict.fromkeys(grams))
    return list(dict.fromkeys(min(grams[i : i + p.winnow]) for i in range(len(grams) - p.winnow + 1)))


def features_py(text: str | None, p: Params = DEFAULT) -> list[str]:
    """Winnowed features of a whole text."""
    return _winnow(_gram_hashes(tokens_py(text), p), p) if text else []


def _gram_lines(text: str, p: Params) -> tuple[list[str], list[int]]:
    """The k-grams of a text and the number of its first token in each line; one more for the end."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    toks: list[str] = []
    first = [0]
    for line in lines:
        toks += tokens_py(line)
        first.append(len(toks))
    return _gram_hashes(toks, p), first


def window_features_py(text: str | None, p: Params = DEFAULT) -> list[list[str]]:
    """Features of each window of lines. A token never crosses a line, so a window's k-grams are a slice of the text's."""
    return _window_features(*_gram_lines(text, p), p) if text else []


def _window_features(grams: list[str], first: list[int], p: Params) -> list[list[str]]:
    n, out, start = len(first) - 1, [], 0
    while True:
        end = min(start + p.window_lines, n)
        out.append(_winnow(grams[first[start] : max(first[start], first[end] - p.kgram + 1)], p))
        if end >= n:
            return out
        start += p.step


def token_anchors_py(text: str | None, p: Params = DEFAULT) -> list[str]:
    """Ordered distinct token anchors over all windows."""
    return [PREFIX + h for h in dict.fromkeys(h for f in window_features_py(text, p) for h in f)]


def window_anchors_py(text: str | None, p: Params = DEFAULT) -> list[str]:
    """Ordered distinct composite anchors, one for each window with features."""
    return list(dict.fromkeys(PREFIX + ",".join(f) for f in window_features_py(text, p) if f))


def _udf(f):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(t) if isinstance(t, str) else None for t in texts], dtype=object)

    return run


def token_anchors(text: Column, p: Params = DEFAULT) -> Column:
    """Array of the token anchors of a text; null for null."""
    return _udf(lambda t: token_anchors_py(t, p))(text)


def both_sides(one: Column, two: Column, compared: Column, p: Params = DEFAULT) -> Column:
    """Struct of the token anchors of two texts (a1, a2) and, where ``compared``, the features of both as wholes (f1, f2).

    One Arrow pass hashes the k-grams of a text once for both.
    """

    def of(text, whole: bool) -> tuple[list[str] | None, list[str] | None]:
        if not isinstance(text, str):
            return None, None
        if not text:
            return [], [] if whole else None
        grams, first = _gram_lines(text, p)
        anchors = [PREFIX + h for h in dict.fromkeys(h for f in _window_features(grams, first, p) for h in f)]
        return anchors, _winnow(grams, p) if whole else None

    @F.pandas_udf("a1 ARRAY<STRING>, a2 ARRAY<STRING>, f1 ARRAY<STRING>, f2 ARRAY<STRING>")
    def run(ones: pd.Series, twos: pd.Series, wholes: pd.Series) -> pd.DataFrame:
        rows = [(of(a, w), of(b, w)) for a, b, w in zip(ones, twos, wholes, strict=True)]
        return pd.DataFrame({"a1": pd.Series([x[0] for x, _ in rows], dtype=object), "a2": pd.Series([y[0] for _, y in rows], dtype=object), "f1": pd.Series([x[1] for x, _ in rows], dtype=object), "f2": pd.Series([y[1] for _, y in rows], dtype=object)})

    return run(one, two, compared)


def query_anchors(variants: list[str], p: Params = DEFAULT) -> list[str]:
    """Anchors to look a passage up by: distinct over its spellings, then at most ``max_anchors`` spread evenly."""
    every = list(dict.fromkeys(a for v in variants for a in token_anchors_py(v, p)))
    n, last = p.max_anchors, len(every) - 1
    return every if len(every) <= n else list(dict.fromkeys(every[s * last // (n - 1)] for s in range(n)))
