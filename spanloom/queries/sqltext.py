"""Pieces of SQL shared by the oracles."""

from __future__ import annotations

#: White space of Unicode, as a class of the other engine's regular expressions.
_SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^{_SPACE}]"


def tokens(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TOKEN}')"


def grams(tk: str) -> str:
    return f"case when len({tk}) < 5 then []::varchar[] else list_transform(range(1, len({tk}) - 3), lambda i: substr(sha256(array_to_string({tk}[i:i + 4], chr(31))), 1, 16)) end"


def winnow(g: str) -> str:
    """Not yet distinct."""
    return f"case when len({g}) <= 4 then {g} else list_transform(range(1, len({g}) - 2), lambda i: list_min({g}[i:i + 3])) end"


def windows(source: str, key: str, text: str) -> str:
    """CTEs ending in ``fw`` (key, w, start_line, n_lines, wt, tk, g, f) of ``source``."""
    return f"""
 fl as (select {key}, {text} as tx, case when {text} = '' then []::varchar[] when {text} like '%' || chr(10) then list_slice(string_split({text}, chr(10)), 1, -2) else string_split({text}, chr(10)) end as ls from {source} where {text} is not null),
 fs as (select *, unnest(case when len(ls) <= 24 then [0] else range(0, ceil((len(ls) - 24) / 12.0)::bigint + 1) end) as w from fl),
 fx as (select {key}, w, w * 12 as start_line, least(24, len(ls) - w * 12) as n_lines, case when len(ls) <= 24 then tx else array_to_string(ls[w * 12 + 1 : w * 12 + 24], chr(10)) end as wt from fs),
 ft as (select *, {tokens("wt")} as tk from fx),
 fg as (select *, {grams("tk")} as g from ft),
 fw as (select *, {winnow("g")} as f from fg)"""


def ordered_distinct(source: str, key: str, lst: str, name: str) -> str:
    """A query giving key and the distinct elements of a list column as text, joined by commas in order of first occurrence."""
    return f"""select {key}, string_agg(x, ',' order by p) as {name} from (
      select {key}, x, min(p) as p from (select {key}, unnest({lst}) as x, generate_subscripts({lst}, 1) as p from {source}) group by all) group by all"""
