"""Deeply nested transcript records to related flat tables.

One pass over each source emits tagged rows: a depth-first visitor walks a record and gives, for every entity
below it, the table's tag, the path of positions that forms its primary key, the key of its parent and a payload (all of the
entity's own fields as JSON; objects as JSON text). ``write_tables`` stores the rows partitioned by tag, ``read_table`` applies
the schema of a tag.

``Shape`` is the visitor of any struct schema: it derives the flat tables from the schema alone (an array of structs is a
table below the one it stands in, structs are flattened, all else is a field) and walks records by nested higher-order functions
inside the JVM. Messages kept as JSON text are walked by one Arrow-batched visitor, to any depth.

Defined results
* Null or missing arrays, structs and elements emit nothing, but an element keeps its position.
* Empty tables give empty tables; repeated rows are separate records (the key starts with ``row_id``).
* A message that isn't valid JSON (RFC 8259, so no NaN) emits its record row only; ``raw`` holds every message that is no object.
* Of a JSON entity, fields that its schema doesn't name or has in another type stand in ``other`` as one JSON object.
  ``content`` is left out where rows below the entity hold all of it.
* Extra columns are fields of the record's row, also such that clash with names of the output; for session_log they are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.runtime import new_path

TOOLS, EXPORT, LOG = "session_with_tools", "session_export", "session_log"

#: Payload schemas of the tables below a JSON message, by tag.
LOG_SCHEMAS = {
    "log_message": "session_id STRING, line_no BIGINT, host_tz STRING, row_type STRING, row_entry STRING, timestamp STRING, row_model STRING, level STRING, raw STRING, role STRING, toolCallId STRING, toolName STRING, isError BOOLEAN, model STRING, content STRING, usage STRING, other STRING",
    "log_block": "type STRING, text STRING, thinking STRING, id STRING, name STRING, toolCallId STRING, arguments STRING, source STRING, content STRING, other STRING",
    "log_subblock": "type STRING, text STRING, mime STRING, content STRING, other STRING",
}
#: Names of the tables below struct records: the record's own and those of its arrays, by their path in the schema.
TOOLS_TAGS = {(): "tools_session", ("messages",): "tools_message", ("messages", "toolCalls"): "tools_call", ("messages", "toolCalls", "result"): "tools_result"}
EXPORT_TAGS = {(): "export_session", ("messages",): "export_message", ("messages", "parts"): "export_part"}
FOUND = ("tools_call", "tools_result", "export_part", "log_block", "log_subblock")

COLUMNS = ["tag", "src", "row_id", "path", "node_id", "parent_id", "linked", "payload"]


def filled(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (F.regexp_replace(c, r"(?U)\s+", "") != "")


class Shape:
    """The flat tables below a struct schema.

    ``tags`` names tables by the path of their array; others get the path itself, joined by ``_`` after the name of the
    source. ``linked`` gives a test for a tag: from the entities on the way down to one (the record first) to a boolean.
    """

    def __init__(self, src: str, schema: T.StructType, tags: dict[tuple[str, ...], str] | None = None, linked: dict[str, Callable[[list], Column]] | None = None, key: str = "row_id"):
        self.src, self.key, self.tags, self.linked = src, key, tags or {}, linked or {}
        self.root = T.StructType([f for f in schema.fields if f.name != key])
        self.schemas: dict[str, T.StructType] = {}
        self.parents: dict[str, str | None] = {}
        self._survey(self.root, (), None)

    def tag(self, path: tuple[str, ...]) -> str:
        return self.tags.get(path) or "_".join([self.src, *path])

    @staticmethod
    def _split(kind: T.StructType, at: tuple[str, ...] = ()) -> tuple[list[tuple[tuple[str, ...], T.DataType]], list[tuple[tuple[str, ...], T.StructType]]]:
        """(fields, arrays of structs) of a struct, those of structs inside it included, each by its path of names."""
        fields, arrays = [], []
        for f in kind.fields:
            here = (*at, f.name)
            if isinstance(f.dataType, T.StructType):
                inner = Shape._split(f.dataType, here)
                fields += inner[0]
                arrays += inner[1]
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                arrays.append((here, f.dataType.elementType))
            else:
                fields.append((here, f.dataType))
        return fields, arrays

    def _survey(self, kind: T.StructType, path: tuple[str, ...], parent: str | None) -> None:
        fields, arrays = self._split(kind)
        tag = self.tag(path)
        self.schemas[tag] = T.StructType([T.StructField("_".join(at), t) for at, t in fields])
        self.parents[tag] = parent
        for at, inner in arrays:
            self._survey(inner, (*path, *at), tag)

    def _visit(self, kind: T.StructType, path: tuple[str, ...], way: list, at: list[Column]) -> Column:
        """Array of the nodes of an entity (the last of ``way``, at the positions ``at``) and of all below it, depth first."""
        fields, arrays = self._split(kind)
        tag, entity = self.tag(path), way[-1]

        def inside(names: tuple[str, ...]) -> Column:
            c = entity[names[0]]
            for n in names[1:]:
                c = c[n]
            return c

        payload = F.to_json(F.struct(*[inside(n).alias("_".join(n)) for n, _ in fields])) if fields else F.lit("{}")
        linked = F.coalesce(self.linked[tag](way), F.lit(False)) if tag in self.linked else F.lit(True)
        steps = F.array(*at).cast("array<int>") if at else F.array().cast("array<int>")
        nodes = [F.array(F.struct(F.lit(tag).alias("tag"), steps.alias("path"), linked.alias("linked"), payload.alias("payload")))]
        def step(inner: T.StructType, names: tuple[str, ...]) -> Callable[[Column, Column], Column]:
            return lambda x, i: F.when(x.isNotNull(), self._visit(inner, (*path, *names), [*way, x], [*at, i.cast("int")]))

        for names, inner in arrays:
            below = F.transform(inside(names), step(inner, names))
            nodes.append(F.flatten(F.filter(F.coalesce(below, F.array()), lambda a: a.isNotNull())))
        return F.concat(*nodes) if len(nodes) > 1 else nodes[0]

    def nodes(self, df: DataFrame) -> DataFrame:
        """tag, src, row_id, path, linked, payload of every entity of the records."""
        record = {f.name: F.col(f"`{f.name}`") for f in self.root.fields}
        emitted = F.inline(self._visit(self.root, (), [record], []))
        return df.select(F.col(self.key).alias("row_id"), emitted).select("tag", F.lit(self.src).alias("src"), "row_id", "path", "linked", "payload")


def tools_shape(schema: T.StructType) -> Shape:
    """session_with_tools: a call is linked if it has a file path, a result if its call is."""
    has_path = lambda way: filled(way[2]["args"]["file_path"])
    return Shape(TOOLS, schema, TOOLS_TAGS, {"tools_call": has_path, "tools_result": has_path})


def export_shape(schema: T.StructType) -> Shape:
    """session_export: a part is linked if its state.output isn't null ('' counts)."""
    return Shape(EXPORT, schema, EXPORT_TAGS, {"export_part": lambda way: way[2]["state"]["output"].isNotNull()})


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def parse_json(text: str | None):
    """The value of strict JSON, or ``None`` for null, damaged or too deeply nested text."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def content_blocks(message) -> list:
    """The content array of a message; content text that holds a JSON array counts as that array."""
    content = message.get("content") if isinstance(message, dict) else None
    return _as_blocks(content)


def _as_blocks(content) -> list:
    if isinstance(content, str) and content.lstrip()[:1] == "[":
        content = parse_json(content)
    return content if isinstance(content, list) else []


def visit_message(text: str | None) -> Iterator[tuple[str, list[int], bool, dict | None]]:
    """Depth-first: (tag, path, linked, entity) of a JSON message and of all blocks below it."""
    message = parse_json(text)
    yield "log_message", [], isinstance(message, dict), message if isinstance(message, dict) else None
    todo = [([i], b) for i, b in enumerate(content_blocks(message))][::-1]
    while todo:
        path, block = todo.pop()
        if isinstance(block, dict):
            yield "log_block" if len(path) == 1 else "log_subblock", path, isinstance(block.get("type"), str), block
            todo += [([*path, i], b) for i, b in enumerate(_as_blocks(block.get("content")))][::-1]


_LOG_TYPE = "tag STRING, row_id BIGINT, path ARRAY<INT>, linked BOOLEAN, payload STRING"
_LOG_ARROW = pa.schema([("tag", pa.string()), ("row_id", pa.int64()), ("path", pa.list_(pa.int32())), ("linked", pa.bool_()), ("payload", pa.string())])


#: Columns of session_log beside the message, by their names in the payload.
_LOG_ROW = {"session_id": "session_id", "line_no": "line_no", "host_tz": "host_tz", "row_type": "type", "row_entry": "id", "timestamp": "timestamp", "row_model": "model", "level": "level"}
#: Fields of a JSON entity that the walk may take from its message, by tag: those of the schema that no column and no rest gives.
_LOG_FIELDS = {t: dict(x.split() for x in ddl.split(", ") if x.split()[0] not in {*_LOG_ROW, "raw", "other"}) for t, ddl in LOG_SCHEMAS.items()}
#: Fields that stand as JSON text unless they are text themselves.
_OBJECTS = {"arguments", "source", "usage"}


def _kept(entity: dict, tag: str) -> dict:
    """All fields of an entity in the types of its tag; what doesn't fit them stands in ``other``."""
    out, other = {}, {}
    for name, value in entity.items():
        kind = _LOG_FIELDS[tag].get(name)
        if name == "content":
            blocks = _as_blocks(value)
            if blocks and all(isinstance(x, dict) for x in blocks):
                continue
            if value is not None:
                out[name] = value if isinstance(value, str) else json.dumps(value)
        elif kind == "STRING" and name in _OBJECTS and isinstance(value, (dict, list)):
            out[name] = json.dumps(value)
        elif (kind == "STRING" and name not in _OBJECTS and isinstance(value, str)) or (kind == "BOOLEAN" and isinstance(value, bool)):
            out[name] = value
        elif value is not None or kind is None:
            other[name] = value
    if other:
        out["other"] = json.dumps(other)
    return out


def log_nodes(df: DataFrame) -> DataFrame:
    """session_log: messages, content blocks and the blocks inside blocks. A block is linked if it has a string type."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("row_id", "message", *_LOG_ROW.values())], strict=True)
            for row_id, text, *rest in rows:
                for tag, path, linked, e in visit_message(text):
                    fields = _kept(e, tag) if e is not None else {}
                    if tag == "log_message":
                        fields |= {n: v for n, v in zip(_LOG_ROW, rest, strict=True) if v is not None} | ({"raw": text} if e is None and text is not None else {})
                    out.append((tag, row_id, path, linked, json.dumps(fields)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _LOG_ARROW.types, strict=True)], schema=_LOG_ARROW)

    rows = df.select("row_id", "message", *_LOG_ROW.values()).mapInArrow(walk, _LOG_TYPE)
    return rows.select("tag", F.lit(LOG).alias("src"), "row_id", "path", "linked", "payload")


def with_keys(nodes: DataFrame) -> DataFrame:
    """Adds ``node_id`` and ``parent_id``: paths of positions, so that a child's parent is its path without the last step."""
    key = lambda path: F.concat_ws("/", F.col("src"), F.col("row_id").cast("string"), F.when(F.size(path) > 0, F.array_join(path, "/")))
    path = F.col("path")
    return nodes.withColumn("node_id", key(path)).withColumn("parent_id", F.when(F.size(path) > 0, key(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))))).select(*COLUMNS)


def schemas_of(tools: DataFrame | None = None, export: DataFrame | None = None, log: DataFrame | None = None) -> dict[str, T.StructType]:
    """The schema of each flat table below the given sources."""
    out = {}
    for shape, df in ((tools_shape, tools), (export_shape, export)):
        out |= shape(df.schema).schemas if df is not None else {}
    return out | ({t: T.StructType.fromDDL(ddl) for t, ddl in LOG_SCHEMAS.items()} if log is not None else {})


def flatten_sessions(tools: DataFrame | None = None, export: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """All entities of the given sources as one table of tagged rows."""
    parts = [tools_shape(tools.schema).nodes(tools)] if tools is not None else []
    parts += [export_shape(export.schema).nodes(export)] if export is not None else []
    parts += [log_nodes(log)] if log is not None else []
    if not parts:
        raise ValueError("no source given")
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    return with_keys(nodes)


def write_tables(nodes: DataFrame, path: str) -> None:
    """Stores tagged rows partitioned by tag."""
    nodes.write.partitionBy("tag").option("compression", "zstd").parquet(path)


_STORED = "src STRING, row_id BIGINT, path ARRAY<INT>, node_id STRING, parent_id STRING, linked BOOLEAN, payload STRING, tag STRING"


def _typed(spark, path: str, tag: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.schema(_STORED).parquet(path).where(F.col("tag") == tag)
    return rows.select("src", "row_id", "path", "node_id", "parent_id", "linked", F.from_json("payload", schema, {"maxStringLen": str(2**31 - 1)}).alias("f"))


def read_table(spark, path: str, tag: str, schema: T.StructType) -> DataFrame:
    """One flat table: keys, parent key and the fields of the tag's schema. A field named like a key has its table's tag before it."""
    rows = _typed(spark, path, tag, schema).drop("linked")
    return rows.select("*", *[F.col(f"f.`{n}`").alias(f"{tag}_{n}" if n in rows.columns else n) for n in schema.names]).drop("f")


def read_all(spark, path: str, schemas: dict[str, T.StructType]) -> DataFrame:
    """The rows of all flat tables, each read by the schema of its tag; the typed fields stand in ``fields`` as JSON."""
    parts = [_typed(spark, path, tag, s).select(F.lit(tag).alias("tag"), *COLUMNS[1:-1], F.to_json("f").alias("fields")) for tag, s in schemas.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tables(tools: DataFrame, export: DataFrame, log: DataFrame) -> tuple[str, dict[str, T.StructType]]:
    """Writes the flat tables of the three sources once to the shared folder; gives their place and schemas."""
    path = new_path(tools.sparkSession, "tables")
    write_tables(flatten_sessions(tools, export, log), path)
    return path, schemas_of(tools, export, log)


def found(tools: DataFrame, export: DataFrame, log: DataFrame) -> DataFrame:
    """Linked tool calls, results, parts and content blocks with their positions, from the written tables."""
    path, schemas = tables(tools, export, log)
    rows = read_all(tools.sparkSession, path, {t: schemas[t] for t in FOUND}).where("linked")
    step = lambda n: F.coalesce(F.get("path", F.lit(n)), F.lit(-1))
    log_row = F.col("src") == LOG
    placed = rows.where(~log_row | (F.size("path") <= 2)).select(
        "src", "row_id", F.when(log_row, 0).otherwise(step(0)).alias("msg_pos"), F.when(log_row, step(0)).otherwise(step(1)).alias("item_pos"), F.when(log_row, step(1)).otherwise(step(2)).alias("sub_pos")
    )
    return placed.select("src", "row_id", *[F.col(c).cast("int").alias(c) for c in ("msg_pos", "item_pos", "sub_pos")])
