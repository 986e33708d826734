"""Schemas that drift between the files of a stream.

1. Headers: each file's lines are read once and folded to its distinct values, and those to one row per field: its types,
   how many records hold it, the range of numbers or instants and how many values and shapes it has.
   The fold is a monoid, so it runs as partial aggregation; a huge file is no single task.
2. Lattice: the types of a field over all files are promoted to the narrowest type that holds them all
   (boolean and number to string, array and object to JSON text), which gives the union schema.
3. Changes: neighbouring files of a stream are compared; fields that went away and fields that came are matched as
   renames if the values go on: shared values, a sequence or clock that continues, or texts of the same kind. What two
   such fields share is counted over all their values, by a join on the value.
4. Cast: records are read into the union schema; a field that was renamed goes on in the column of its first name.

Defined results
* Damaged, empty and null lines and values that aren't objects hold no fields; a file without valid record has none.
* A repeated line changes nothing; null values don't count as held; key order doesn't matter.
* A field of several types in one file has all of them; it is retyped if the sets differ.
* The first file of a stream (by seq, then file_id) has no changes.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators.hierarchy import hierarchy
from spanloom.operators.joins import asof_backward
from spanloom.operators.nested import parse_json
from spanloom.operators.running import position_bucket, running_sum
from spanloom.operators.timestamps import parse_instant
from spanloom.runtime import materialize

CLAUDE = ("claude_adapter_input", "claude_adapter_multiedit_input")

_TYPES = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}
_ORDER = ["boolean", "number", "string", "array", "object"]


def promote(types: set[str]) -> str:
    """The narrowest type of the lattice that holds all given ones."""
    types = types - {"null"}
    if len(types) == 1:
        return next(iter(types))
    return "string" if types <= {"boolean", "number", "string"} else "json"


SQL_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "number": "DOUBLE", "array": "STRING", "object": "STRING", "json": "STRING"}


def fields_of(record: dict, claude: bool) -> Iterator[tuple[str, object]]:
    """The top-level fields, and the members of ``message`` but its content in the claude dialects; null values left out."""
    for name, value in record.items():
        if value is not None:
            yield name, value
            if claude and name == "message" and isinstance(value, dict):
                for member, v in value.items():
                    if member != "content" and v is not None:
                        yield f"message.{member}", v


def shape(value: str) -> str:
    """A coarse picture of a text: classes of characters, runs shortened."""
    if len(value) > 20 and " " in value.strip():
        return "prose"
    return _short(_WORDS.sub("a", _DIGITS.sub("9", _HEX.sub("h", value))))


def _short(picture: str) -> str:
    """A long picture goes by its hash."""
    return picture if len(picture) <= 40 else xxhash.xxh64_hexdigest(picture.encode("utf-8", "surrogatepass"))


_HEX, _WORDS, _DIGITS = re.compile(r"[0-9a-f]{6,}"), re.compile(r"[A-Za-z]+"), re.compile(r"\d+")
_TIMELIKE = re.compile(r"\s*(?:\d{4}|\d{1,2}[ \-/]|(?:mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))", re.IGNORECASE)
_NUMBER = re.compile(r"-?\d{1,15}(\.\d+)?$")


@lru_cache(1 << 15)
def _describe_text(value: str) -> tuple[int, float | None, float | None, str]:
    instant = parse_instant(value, "UTC") if _TIMELIKE.match(value) else None
    number = float(value) if _NUMBER.match(value) else None
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) >> 1, number, instant, shape(value)


def _double(value: float) -> float:
    """Integers beyond all doubles count as infinite."""
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


@lru_cache(1 << 15)
def _describe_number(value: float) -> tuple[int, float | None, float | None, str]:
    number = _double(value)
    return xxhash.xxh64_intdigest(repr(number)) >> 1, number, parse_instant(str(value), "UTC"), "number"


def describe(value: object) -> tuple[int | None, float | None, float | None, str]:
    """(hash, number, instant, shape) of a value."""
    if isinstance(value, bool):
        return xxhash.xxh64_intdigest(str(value)) >> 1, None, None, "bool"
    if isinstance(value, (int, float)):
        return _describe_number(value)
    if isinstance(value, str):
        return _describe_text(value)
    text = json.dumps(value, sort_keys=True)
    kind = ",".join(sorted(value)) if isinstance(value, dict) else "array"
    return xxhash.xxh64_intdigest(text) >> 1, None, None, _short(kind)


_HEADER = "file_id BIGINT, field STRING, type STRING, hash BIGINT, number DOUBLE, instant DOUBLE, shape STRING, n BIGINT"
_ARROW = pa.schema([("file_id", pa.int64()), ("field", pa.string()), ("type", pa.string()), ("hash", pa.int64()), ("number", pa.float64()), ("instant", pa.float64()), ("shape", pa.string()), ("n", pa.int64())])


def _read_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[tuple, int] = {}
        for file_id, claude, raw in zip(b.column("file_id").to_pylist(), b.column("claude").to_pylist(), b.column("raw").to_pylist(), strict=True):
            record = parse_json(raw)
            if isinstance(record, dict):
                for name, value in fields_of(record, claude):
                    k = (file_id, name.encode("utf-8", "replace").decode(), _TYPES[type(value)], *describe(value))
                    out[k] = out.get(k, 0) + 1
        cols = list(zip(*[(*k, n) for k, n in out.items()], strict=True)) or [()] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types, strict=True)], schema=_ARROW)


def distinct_values(files: DataFrame, lines: DataFrame) -> DataFrame:
    """The distinct values of each field of each file, described, with the number of records that hold them."""
    dialect = files.select("file_id", F.col("dialect").isin(*CLAUDE).alias("claude"))
    rows = lines.select("file_id", "raw").join(dialect, "file_id").select("file_id", "claude", "raw")
    values = rows.mapInArrow(_read_fields, _HEADER)
    values = values.groupBy("file_id", "field", "type", "hash").agg(F.min("number").alias("number"), F.min("instant").alias("instant"), F.min("shape").alias("shape"), F.sum("n").alias("n"))
    return materialize(values, "values")[0]


def headers_of(values: DataFrame) -> DataFrame:
    """One row per file and field: types, number of records and what holds for all of its values."""
    has = lambda t: F.max(F.col("type") == t).alias(f"is_{t}")
    shapes = values.groupBy("file_id", "field", "shape").agg(
        *[has(t) for t in _ORDER], F.sum("n").alias("n"), F.count("*").alias("n_values"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.min("instant").alias("first"), F.max("instant").alias("last"), F.count("number").alias("n_numbers"), F.count("instant").alias("n_instants"),
    )
    return shapes.groupBy("file_id", "field").agg(
        F.array_sort(F.array_compact(F.array(*[F.when(F.max(f"is_{t}"), F.lit(t)) for t in _ORDER]))).alias("types"), F.sum("n").alias("n_records"), F.sum("n_values").alias("n_values"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum("n_numbers").alias("n_numbers"), F.sum("n_instants").alias("n_instants"), F.count("*").alias("n_shapes"), F.max(F.col("shape") == "prose").alias("prose"),
    )


def headers(files: DataFrame, lines: DataFrame) -> DataFrame:
    return headers_of(distinct_values(files, lines))


def _words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name.rsplit(".", 1)[-1])}


def continues(a: dict, b: dict, common: int, common_shapes: int) -> float:
    """How well the values of field ``b`` go on those of field ``a`` of the file before: 0 (not at all) to 3.

    ``common`` and ``common_shapes`` count the distinct values and shapes that both have.
    """
    if list(a["types"]) != list(b["types"]) or a["field"].startswith("message.") != b["field"].startswith("message."):
        return 0.0
    names = _words(a["field"]), _words(b["field"])
    alike = len(names[0] & names[1]) / max(1, len(names[0] | names[1]))
    shared = common / max(1, min(a["n_values"], b["n_values"]))
    kind, all_a, all_b = list(a["types"])[0], a["n_values"], b["n_values"]
    if kind == "boolean":
        return 1 + alike if alike >= 0.5 else 0.0
    clock = a["n_instants"] == all_a and b["n_instants"] == all_b
    if clock:
        day = 86_400_000_000
        near = b["first"] <= a["last"] + 30 * day and b["last"] >= a["first"] - 30 * day
        return 2 + alike if near else 0.5 * alike
    if shared >= (0.5 if kind == "number" else 0.15):
        return 2 * min(1.0, shared) + alike + 0.5
    counting = a["n_numbers"] == all_a and b["n_numbers"] == all_b and kind in ("number", "string")
    if counting:
        whole = all(float(x[k]).is_integer() for x in (a, b) for k in ("low", "high"))
        span = max(a["high"] - a["low"], b["high"] - b["low"], 1)
        dense = whole and all(x["high"] - x["low"] <= 4 * x["n_values"] + 8 for x in (a, b))
        if dense and a["high"] <= b["low"] and b["low"] - a["high"] <= 4 * span + 50:
            return 2 + alike
        return 1 + alike if alike >= 0.5 else 0.0
    if kind == "string" and a["prose"] and b["prose"]:
        return 1.5 + alike
    if common_shapes == a["n_shapes"] == b["n_shapes"] and kind in ("array", "object"):
        return 1 + alike
    if kind == "string" and alike > 0 and common_shapes:
        return 1 + alike
    return 0.0


def compare(before: list[dict], after: list[dict], common: dict[tuple[str, str], tuple[int, int]]) -> list[tuple[str, str, str]]:
    """(change, old_field, new_field) between the headers of two files, in order of the field names.

    ``common`` has the values and shapes that a removed and an added field share, where there are any.
    """
    a, b = {x["field"]: x for x in before}, {x["field"]: x for x in after}
    gone, came = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())
    scored = sorted(((s, g, c) for g in gone for c in came if (s := continues(a[g], b[c], *common.get((g, c), (0, 0)))) >= 1), key=lambda x: (-x[0], x[1], x[2]))
    old_to_new: dict[str, str] = {}
    for _, g, c in scored:
        if g not in old_to_new and c not in old_to_new.values():
            old_to_new[g] = c
    out = [("renamed", g, c) for g, c in old_to_new.items()]
    out += [("removed", g, "") for g in gone if g not in old_to_new]
    out += [("added", "", c) for c in came if c not in old_to_new.values()]
    out += [("retyped", f, f) for f in a.keys() & b.keys() if list(a[f]["types"]) != list(b[f]["types"])]
    return sorted(out, key=lambda x: (x[1] or x[2], x[0], x[2]))


_CHANGES = "file_id BIGINT, position INT, change STRING, old_field STRING, new_field STRING, old_types STRING, new_types STRING"
_CHANGES_ARROW = pa.schema([("file_id", pa.int64()), ("position", pa.int32()), *[(n, pa.string()) for n in ("change", "old_field", "new_field", "old_types", "new_types")]])


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of files, each a row with the headers of both and what their fields share."""
    for b in batches:
        out: list[tuple] = []
        for file_id, rows, shared in zip(*[b.column(c).to_pylist() for c in ("pair", "rows", "shared")], strict=True):
            common = {(x["old_field"], x["new_field"]): (x["common"], x["common_shapes"]) for x in shared or []}
            before, after = [r for r in rows if not r["is_new"]], [r for r in rows if r["is_new"]]
            types = [{r["field"]: "|".join(r["types"]) for r in x} for x in (before, after)]
            out += [(file_id, i, c, o, n, types[0].get(o, ""), types[1].get(n, "")) for i, (c, o, n) in enumerate(compare(before, after, common))]
        cols = list(zip(*out, strict=True)) or [()] * len(_CHANGES_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CHANGES_ARROW.types, strict=True)], schema=_CHANGES_ARROW)


def _common(differing: DataFrame, values: DataFrame) -> DataFrame:
    """(pair, old_field, new_field, common, common_shapes) of the removed and added fields that share a value or a shape.

    Only fields are joined whose likeness depends on it. A value stands once for each file, field and type, so a key joins as
    many rows as two files have such fields.
    """
    one = differing.where("size(sides) = 1").select("pair", "field", F.col("sides")[0].alias("s"))
    one = one.select("pair", "field", "s.is_new", "s.file_id", "s.types", (F.col("s.n_instants") == F.col("s.n_values")).alias("clock"), F.col("field").startswith("message.").alias("member")).where("types[0] <> 'boolean'")
    side = lambda new, name: one.where(F.col("is_new") == new).select("pair", "types", "member", F.col("field").alias(name), F.col("file_id").alias(f"{name}_file"), F.col("clock").alias(f"{name}_clock"))
    candidates = side(False, "old_field").join(side(True, "new_field"), ["pair", "types", "member"]).where("not (old_field_clock and new_field_clock)")
    items = values.select("file_id", "field", "type", "hash", F.lit("").alias("shape"))
    shapes = values.groupBy("file_id", "field", "shape").agg(F.lit("shape").alias("type"), F.lit(0).cast("bigint").alias("hash"))
    items = items.unionByName(shapes)
    held = lambda name: items.withColumnsRenamed({"file_id": f"{name}_file", "field": name}).join(candidates.select("pair", f"{name}_file", name).distinct(), [f"{name}_file", name]).drop(f"{name}_file")
    shared = held("old_field").join(held("new_field"), ["pair", "type", "hash", "shape"])
    return shared.groupBy("pair", "old_field", "new_field").agg(F.count_if(F.col("type") != "shape").alias("common"), F.count_if(F.col("type") == "shape").alias("common_shapes"))


def changes(files: DataFrame, head: DataFrame, values: DataFrame) -> DataFrame:
    """The ordered differences of each file against the one before it in its stream."""
    placed = files.select("stream", "file_id", F.struct("seq", "file_id").alias("at"))
    before = placed.select("stream", F.col("at").alias("before_at"), F.col("file_id").alias("previous"))
    pairs = asof_backward(placed, before, ["stream"], "at", "before_at", ["previous"], bucket=lambda c: position_bucket(c["seq"])).where("previous is not null")
    sides = pairs.select(F.col("file_id").alias("pair"), F.explode(F.array(F.struct(F.col("previous").alias("file_id"), F.lit(False).alias("is_new")), F.struct("file_id", F.lit(True).alias("is_new")))).alias("s"))
    both = sides.select("pair", "s.*").join(head, "file_id")
    # a field that both files hold alike is no change: of a pair of files only the others are kept, each once or twice
    fields = both.groupBy("pair", "field").agg(F.collect_list(F.struct(*[c for c in both.columns if c != "pair"])).alias("sides"))
    differing, _ = materialize(fields.where("size(sides) = 1 or sides[0].types <> sides[1].types"), "differing")
    rows = differing.groupBy("pair").agg(F.flatten(F.collect_list("sides")).alias("rows"))
    shared = _common(differing, values).groupBy("pair").agg(F.collect_list(F.struct("old_field", "new_field", "common", "common_shapes")).alias("shared"))
    return rows.join(shared, "pair", "left").mapInArrow(_changes, _CHANGES)


def canonical_names(files: DataFrame, head: DataFrame, differences: DataFrame) -> DataFrame:
    """(file_id, field, name): the first name of each field of each file, found by following renames back by pointer doubling.

    A field's life begins where it was added or renamed to; each life is a node, and a rename links it to the one before.
    A name that is added again after n renames away from it begins the column ``name#n+1``, since the column of the first goes
    on under another name. A first name that itself ends so gets ``#1``, so no two names meet.
    """
    order = running_sum(files.select("file_id", "stream", "seq"), ["stream"], ["seq", "file_id"], position_bucket(F.col("seq")), F.lit(1), "at")
    changed = differences.where(F.col("change").isin("added", "renamed")).join(order.select("file_id", "stream", "at"), "file_id")
    births = changed.select("stream", F.col("new_field").alias("field"), F.col("at").alias("born_at"), F.col("at").alias("born"))
    held = head.select("file_id", "field").join(order.select("file_id", "stream", "at"), "file_id")
    node = lambda f, born: F.concat_ws("\x1f", "stream", F.coalesce(born, F.lit(0)).cast("string"), f)
    lives = asof_backward(held, births, ["stream", "field"], "at", "born_at", ["born"], strict=False, bucket=position_bucket).withColumn("node", node(F.col("field"), F.col("born")))
    renamed = changed.where("change = 'renamed'").select("stream", F.col("old_field").alias("field"), (F.col("at") - 1).alias("at"), "new_field", F.col("at").alias("new_born"))
    olds = asof_backward(renamed, births, ["stream", "field"], "at", "born_at", ["born"], strict=False, bucket=position_bucket)
    links = olds.select(node(F.col("new_field"), F.col("new_born")).alias("child"), node(F.col("field"), F.col("born")).alias("parent"))
    away = renamed.select("stream", "field", F.col("new_born").alias("left_at"))
    away = running_sum(away, ["stream", "field"], ["left_at"], position_bucket(F.col("left_at")), F.lit(1), "away")
    again = asof_backward(changed.where("change = 'added'").select("stream", F.col("new_field").alias("field"), F.col("at").alias("born")), away, ["stream", "field"], "born", "left_at", ["away"])
    again = again.where("away is not null").select(node(F.col("field"), F.col("born")).alias("root"), "away")
    roots = hierarchy(links).where("depth >= 0").select("node", "root")
    first = lives.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(again, "root", "left")
    name = F.element_at(F.split("root", "\x1f"), -1)
    number = F.coalesce("away", F.lit(0)) + 1
    return first.select("file_id", "field", F.when((number > 1) | name.rlike("#[0-9]+$"), F.concat(name, F.lit("#"), number.cast("string"))).otherwise(name).alias("name"))


def union_schema(head: DataFrame, names: DataFrame | None = None) -> T.StructType:
    """The promoted schema of all fields (by their first names, if given); its size is the number of distinct names."""
    held = head.withColumn("name", F.col("field")) if names is None else head.join(names, ["file_id", "field"])
    rows = held.select("name", F.explode("types").alias("type")).groupBy("name").agg(F.collect_set("type").alias("types")).orderBy("name").collect()
    seen: dict[str, int] = {}
    fields = []
    for r in rows:  # column names differ by more than case; the field's own name stays in the metadata
        n = seen[r["name"].lower()] = seen.get(r["name"].lower(), -1) + 1
        name = f"{r['name']}__{n}" if n else r["name"]
        fields.append(T.StructField(name, T._parse_datatype_string(SQL_TYPES[promote(set(r["types"]))]), True, {"field": r["name"]}))
    return T.StructType(fields)


def consistent(files: DataFrame, lines: DataFrame, schema: T.StructType, names: DataFrame | None = None) -> DataFrame:
    """All valid records in the union schema; values that don't fit the promoted type stand as JSON text."""
    wanted = [f.metadata.get("field", f.name) for f in schema.fields]
    dialect = files.select("file_id", F.col("dialect").isin(*CLAUDE).alias("claude"))
    if names is not None:
        renamed = names.where("name <> field").groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("names"))
        dialect = dialect.join(renamed, "file_id", "left")
    else:
        dialect = dialect.withColumn("names", F.lit(None).cast("map<string,string>"))
    rows = lines.select("file_id", "line_no", "raw").join(dialect, "file_id").select("file_id", "line_no", "claude", F.to_json("names").alias("names"), "raw")
    out = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("line_no", T.LongType()), *schema.fields])

    def cast(value: object, to: T.DataType):
        if value is None:
            return None
        if isinstance(to, T.DoubleType):
            return _double(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
        if isinstance(to, T.BooleanType):
            return value if isinstance(value, bool) else None
        return value.encode("utf-8", "replace").decode() if isinstance(value, str) else json.dumps(value)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        for b in batches:
            ids, nos, vals = [], [], []
            for file_id, no, claude, first, raw in zip(*[b.column(c).to_pylist() for c in ("file_id", "line_no", "claude", "names", "raw")], strict=True):
                record = parse_json(raw)
                if isinstance(record, dict):
                    to = json.loads(first) if first else {}
                    ids.append(file_id), nos.append(no), vals.append({to.get(k, k): v for k, v in fields_of(record, claude)})
            cols = [pa.array([cast(v.get(n), f.dataType) for v in vals], kinds[f.dataType.typeName()]) for n, f in zip(wanted, schema.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), *cols], names=["file_id", "line_no", *schema.names])

    return rows.mapInArrow(read, out)


def one_table(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the consistent table, the ordered differences)."""
    values = distinct_values(files, lines)
    head, _ = materialize(headers_of(values), "headers")
    differences, _ = materialize(changes(files, head, values), "changes")
    names, _ = materialize(canonical_names(files, head, differences), "names")
    return consistent(files, lines, union_schema(head, names), names), differences


def report(files: DataFrame, lines: DataFrame) -> DataFrame:
    """The ordered differences with the types before and after."""
    values = distinct_values(files, lines)
    return changes(files, headers_of(values), values)


def found(files: DataFrame, lines: DataFrame) -> DataFrame:
    return report(files, lines).select("file_id", "change", "old_field", "new_field")
