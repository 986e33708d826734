"""Queries of the fingerprint functions over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import fingerprint as fp
from spanloom.queries import sqltext as S
from spanloom.runtime import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def tokenize(spark, d):
    return fp.computed_once(_docs(spark, d).where("text is not null"), tk=fp.tokens(F.col("text"))).select("doc_id", F.size("tk").alias("n_tokens"), F.md5(F.array_join("tk", " ")).alias("tokens_md5"))


def kgram_hashes(spark, d):
    rows = fp.computed_once(fp.computed_once(_docs(spark, d).where("text is not null"), tk=fp.tokens(F.col("text"))), g=fp.kgrams(F.col("tk")))
    return rows.select("doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", "")).alias("grams_md5"))


def winnow_features(spark, d):
    rows = fp.with_features(_docs(spark, d)).where("size(features) > 0")
    return rows.select("doc_id", F.size("features").alias("n_features"), F.array_join("features", ",").alias("features"))


def line_windows(spark, d):
    return fp.with_windows(_docs(spark, d)).select("doc_id", "window_no", "start_line", "n_lines", F.md5("window_text").alias("window_md5"))


def token_anchors(spark, d):
    rows = _docs(spark, d).select("doc_id", F.explode(fp.token_anchors(F.col("text"))).alias("anchor"))
    return rows


def token_anchors_native(spark, d):
    return fp.token_anchors_native(_docs(spark, d), ["doc_id"])


def composite_anchors(spark, d):
    rows = fp.with_features(fp.with_windows(_docs(spark, d)), "window_text").where("size(features) > 0")
    return rows.select("doc_id", "window_no", fp.anchor_of(F.col("features")).alias("anchor"))


def anchor_sample(spark, d):
    rows = fp.computed_once(_docs(spark, d), a=fp.token_anchors(F.col("text"))).where("size(a) > 0")
    return rows.select("doc_id", F.array_join(fp.sample_anchors(F.col("a")), " ").alias("anchors"))


def expand_composite(spark, d):
    c = composite_anchors(spark, d)
    return c.select("doc_id", "window_no", F.posexplode(fp.expand_anchor(F.col("anchor"))).alias("position", "anchor"))


def edit_similarity(spark, d):
    """Jaccard similarity of the whole texts before and after each edit."""
    rows = table(spark, d, "clawline_sample").where("before_text is not null and after_text is not null").select("row_id", "before_text", "after_text")
    both = fp.with_features(fp.with_features(rows, "before_text", "fb"), "after_text", "fa")
    anchors = fp.computed_once(both, b=fp.anchor_of(F.col("fb")), a=fp.anchor_of(F.col("fa")))
    return anchors.select("row_id", F.round(fp.jaccard(fp.parsed_features(F.col("b")), fp.parsed_features(F.col("a"))).cast("double"), 5).alias("similarity"))


QUERIES = {
    "tokenize": tokenize, "kgram_hashes": kgram_hashes, "winnow_features": winnow_features, "line_windows": line_windows, "token_anchors": token_anchors, "token_anchors_native": token_anchors_native,
    "composite_anchors": composite_anchors, "anchor_sample": anchor_sample, "expand_composite": expand_composite, "edit_similarity": edit_similarity,
}

_W = S.windows("documents", "doc_id", "text")
_ANCHORS = f"with {_W} select distinct doc_id, 'winnow:' || unnest(f) as anchor from fw"
SQL = {
    "tokenize": f"select doc_id, len(tk)::int as n_tokens, md5(array_to_string(tk, ' ')) as tokens_md5 from (select doc_id, {S.tokens('text')} as tk from documents where text is not null)",
    "kgram_hashes": f"select doc_id, len(g)::int as n_grams, md5(array_to_string(g, '')) as grams_md5 from (select doc_id, {S.grams('tk')} as g from (select doc_id, {S.tokens('text')} as tk from documents where text is not null))",
    "winnow_features": f"""with a as (select doc_id, {S.tokens("text")} as tk from documents where text is not null), b as (select doc_id, {S.grams("tk")} as g from a), c as (select doc_id, {S.winnow("g")} as f from b)
      select doc_id, (length(features) - length(replace(features, ',', '')) + 1)::int as n_features, features from ({S.ordered_distinct("c", "doc_id", "f", "features")})""",
    "line_windows": f"with {_W} select doc_id, w::int as window_no, start_line::int as start_line, n_lines::int as n_lines, md5(wt) as window_md5 from fw",
    "token_anchors": _ANCHORS,
    "token_anchors_native": _ANCHORS,
    "composite_anchors": f"with {_W} select doc_id, w::int as window_no, 'winnow:' || a as anchor from ({S.ordered_distinct('fw', 'doc_id, w', 'f', 'a')})",
    "anchor_sample": f"""with {_W},
      o as (select doc_id, h, min(p) as p from (select doc_id, w * 1000000 + generate_subscripts(f, 1) as p, unnest(f) as h from fw) group by all),
      r as (select doc_id, h, row_number() over (partition by doc_id order by p) - 1 as i, count(*) over (partition by doc_id) as n from o),
      s as (select doc_id, h, i from r where n <= 16 or exists (select 1 from range(0, 16) t(k) where floor(k * (n - 1) / 15) = i))
      select doc_id, string_agg('winnow:' || h, ' ' order by i) as anchors from s group by doc_id""",
    "expand_composite": f"""with {_W}, c as ({S.ordered_distinct("fw", "doc_id, w", "f", "a")})
      select doc_id, w::int as window_no, (generate_subscripts(string_split(a, ','), 1) - 1)::int as position, 'winnow:' || unnest(string_split(a, ',')) as anchor from c""",
    "edit_similarity": f"""with e as (select row_id, before_text as b, after_text as a from clawline_sample where before_text is not null and after_text is not null),
      t as (select row_id, {S.tokens("b")} as tb, {S.tokens("a")} as ta from e), g as (select row_id, {S.grams("tb")} as gb, {S.grams("ta")} as ga from t),
      f as (select row_id, list_distinct({S.winnow("gb")}) as fb, list_distinct({S.winnow("ga")}) as fa from g)
      select row_id, case when len(fb) > 0 and len(fa) > 0 then round((len(list_intersect(fb, fa)) / len(list_distinct(list_concat(fb, fa))))::float::double, 5) end as similarity from f""",
}
