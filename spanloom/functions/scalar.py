"""Scalar functions on text, JSON, times and enumerations, as Column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import params

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_json(text: str) -> str:
    """Compact JSON with sorted keys at every level; numbers keep their value and integers stay integers."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def result_id(command: str, payload: str) -> str:
    """Stable id of a query result, from the command and the canonical payload."""
    return "result_" + hashlib.sha256(f"{command}:{canonical_json(payload)}".encode()).hexdigest()


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^{UUID}$"), F.lit(False))


def span_anchor(file: Column, span: Column) -> Column:
    """Anchor of a place in a file, ``span:file:start-end``."""
    return F.concat(F.lit("span:"), file, F.lit(":"), span[0].cast("string"), F.lit("-"), span[1].cast("string"))


def epoch_ms_to_rfc3339(ms: Column) -> Column:
    """Milliseconds to seconds precision with Z, whatever the session's zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(ms).cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc3339(c: Column) -> Column:
    """Timestamp of an RFC 3339 text; null for any other."""
    ok = c.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(F.upper(c), r"(\.\d{6})\d+", "$1")))


def date_bound(value: str | None, last: bool) -> Column | None:
    """A bound given as RFC 3339 or as a day: its first second, or its last one for an upper bound."""
    if value is None:
        return None
    text = value if len(value) > 10 else value + ("T23:59:59Z" if last else "T00:00:00Z")
    return F.to_timestamp(F.lit(text))


def in_dates(ts: Column, since: str | None, until: str | None) -> Column:
    """Inclusive on both ends; a timestamp that can't be read passes."""
    at, keep = rfc3339(ts), F.lit(True)
    if since is not None:
        keep = keep & (at >= date_bound(since, False))
    if until is not None:
        keep = keep & (at <= date_bound(until, True))
    return at.isNull() | keep


def stored_class(confidence: Column, agent_link: Column, p: params.Params = params.DEFAULT) -> Column:
    """Weak edges that no agent set tell a location only; the comparison is one of FLOAT."""
    return F.when(~agent_link & (confidence < F.lit(p.link_threshold).cast("float")), "location_only").otherwise("lineage")


def confidence_tier(confidence: Column, moved: Column, location_only: Column) -> Column:
    at_least = lambda x: confidence >= F.lit(x).cast("float")
    return (
        F.when(location_only, "forensics_only").when(at_least(0.90) & ~moved, "edit").when(at_least(0.85) & moved, "move").when(at_least(params.DEFAULT.min_confidence), "related").otherwise("hidden")
    )


def tier_of(confidence: float, moved: bool, location_only: bool) -> str:
    """``confidence_tier`` of one value."""
    if location_only:
        return "forensics_only"
    c = round(confidence, 6)
    return "edit" if c >= 0.90 and not moved else "move" if c >= 0.85 and moved else "related" if c >= params.DEFAULT.min_confidence else "hidden"


def links_successor(confidence: Column, p: params.Params = params.DEFAULT) -> Column:
    return confidence >= F.lit(p.link_threshold).cast("float")


def links_reinsertion(confidence: Column, p: params.Params = params.DEFAULT) -> Column:
    return confidence >= F.lit(p.reinsertion_threshold).cast("float")


def decode_enum(c: Column, names: tuple[tuple[str, ...], str]) -> Column:
    """The name itself if it is one of the enumeration, else its default."""
    return F.when(c.isin(*names[0]), c).otherwise(names[1])


def exit_code(output: Column) -> Column:
    """The number of the first line that reports the exit of a process."""
    return F.expr("try_cast(null as int)") if output is None else F.when(output.rlike(EXIT_LINE), F.regexp_extract(output, EXIT_LINE, 1)).try_cast("int")


EXIT_LINE = r"(?m)^\s*Process exited with code (-?\d+)\s*$"
PATCH_HEADER = r"(?m)^(?:\*\*\* (?:Update|Add|Delete) File: |\+\+\+ b/|--- a/)(.+?)\s*$"


def patch_files(patch: Column) -> Column:
    """Ordered distinct files of a patch's headers."""
    files = F.transform(F.regexp_extract_all(patch, F.lit(PATCH_HEADER), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(files, lambda x: (x != "/dev/null") & (x != "")))


def read_range(offset: Column, limit: Column) -> Column:
    """First and last line of a read with optional offset and limit; lines count from 1."""
    start = F.greatest(F.coalesce(offset, F.lit(1)), F.lit(1))
    return F.array(start, F.when(limit.isNotNull(), F.greatest(start + limit - 1, start)).otherwise(start)).cast("array<int>")


def coverage(total: Column, emitted: Column) -> Column:
    return F.when((total == 0) | (emitted == total), "full").otherwise("partial")


#: Names of tools that read and that edit files.
TOOL_READS = ("read", "readfile", "read_file", "view", "cat")
TOOL_EDITS = ("edit", "write", "multiedit", "apply", "apply_patch", "patch", "write_file")


def tool_class(name: Column) -> Column:
    return F.when(F.lower(name).isin(*TOOL_READS), "read").when(F.lower(name).isin(*TOOL_EDITS), "edit").otherwise("other")


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` stay within a path's part, ``**`` crosses parts."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"
