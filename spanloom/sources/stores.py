"""Stores: folders of fact tables, written append-only by commits, and read together.

A commit writes its rows into folders of its own (``table/commit=id``) and then, in one step, its marker. Only marked commits are
read, so what was interrupted leaves nothing behind that counts, and nothing that is stored has to be searched when
rows are added. Folders may lie on any file system that the session's Hadoop configuration knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.index import first_wins, latest
from spanloom.params import OUTCOMES, SCHEMA_VERSION, TABLES
from spanloom.runtime import Folder

MARKERS = "commits"
#: Order of the rows inside a commit: ranges of the column by which a table is looked up, so that files can be skipped.
SORTED = {"evidence": "anchor", "edges": "from_anchor", "tombstones": "anchor", "tape_lines": "tape_id"}


class Store:
    """One folder with a Parquet table for each of ``TABLES``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Folder(spark, self.root)

    def create(self) -> Store:
        if not self.exists():
            self.files.write("schema_version.json", json.dumps({"version": SCHEMA_VERSION}))
        return self.migrate().check()

    def version(self) -> int | None:
        text = self.files.read("schema_version.json")
        return json.loads(text)["version"] if text is not None else None

    def check(self) -> Store:
        version = self.version()
        if version != SCHEMA_VERSION:
            raise ValueError(f"{self.root} has version {version} of the schema; {SCHEMA_VERSION} is known. Rebuild it")
        return self

    def migrate(self) -> Store:
        """Brings a store of an older version to this one, a version at a time."""
        while (step := MIGRATIONS.get(self.version())) is not None:
            step(self)
        return self

    def exists(self) -> bool:
        return self.files.exists("schema_version.json")

    def commits(self) -> list[str]:
        return sorted(n.removesuffix(".json") for n in self.files.names(MARKERS) if n.endswith(".json"))

    def read(self, name: str) -> DataFrame:
        """A table, with no rows if nothing was written yet."""
        schema = TABLES[name][0]
        paths = [f"{name}/commit={c}" for c in self.commits()]
        held = set(self.files.names(name))
        paths = [f"{self.root}/{p}" for p in paths if p.rsplit("/", 1)[1] in held]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def commit(self, tables: dict[str, DataFrame]) -> str:
        """Adds rows to tables, all of them or none."""
        name = uuid.uuid4().hex
        for table, rows in tables.items():
            cols = [f.name for f in self.spark.createDataFrame([], TABLES[table][0]).schema.fields]
            rows = rows.select(*cols).dropDuplicates(TABLES[table][1]) if table in KEYED else rows.select(*cols)
            if table in SORTED:
                rows = rows.repartitionByRange(F.col(SORTED[table])).sortWithinPartitions(SORTED[table])
            rows.write.option("compression", "zstd").parquet(f"{self.root}/{table}/commit={name}")
        self.files.write(f"{MARKERS}/{name}.json", json.dumps(sorted(tables)))
        return name

    def compact(self) -> None:
        """Writes all commits as one, marks it and drops the others: for stores of very many small commits."""
        old = self.commits()
        if len(old) < 2:
            return
        tables = {t: self.read(t) for t in TABLES if self.files.names(t)}
        name = self.commit({t: rows.dropDuplicates(TABLES[t][1]) if t == "edges" else rows for t, rows in tables.items()})
        for c in old:
            self.files.delete(f"{MARKERS}/{c}.json")
        for t in tables:
            for n in self.files.names(t):
                if n != f"commit={name}" and n.removeprefix("commit=") in old:
                    self.files.delete(f"{t}/{n}")

    def has_tape(self, tape_id: str) -> bool:
        return not self.read("tapes").where(F.col("tape_id") == tape_id).isEmpty()

    def cursors(self) -> DataFrame:
        """(path, cursor, guard): how far each file has been read."""
        return latest(self.read("cursors"), ["path"], "read_at")

    def put_result(self, result_id: str, command: str, payload: str, created_at: str) -> None:
        """Replaces the result of that id: rows are added, and the latest counts on reading."""
        self.commit({"query_results": self.spark.createDataFrame([(result_id, command, payload, created_at)], TABLES["query_results"][0])})

    def results(self) -> DataFrame:
        return latest(self.read("query_results"), ["result_id"], "created_at")

    def rate(self, result_id: str, outcome: str, note: str | None, rated_at: str) -> None:
        if outcome not in OUTCOMES:
            raise ValueError(f"outcome must be one of {', '.join(OUTCOMES)}")
        if self.read("query_results").where(F.col("result_id") == result_id).isEmpty():
            raise KeyError(f"no result {result_id}")
        self.commit({"result_feedback": self.spark.createDataFrame([(result_id, outcome, note, rated_at)], TABLES["result_feedback"][0])})

    def feedback(self) -> DataFrame:
        known = self.read("query_results").select("result_id")
        return latest(self.read("result_feedback"), ["result_id"], "rated_at").join(known, "result_id", "left_semi")


#: Tables whose rows of one commit may repeat a key. The others are sets already, and a tape is committed only if the ledger lacks it.
KEYED = {"edges", "dispatch_links", "tapes"}


def _from_3(store: Store) -> None:
    """Version 3 kept the files of a table side by side and cursors in one document."""
    moved = []
    for t in TABLES:
        parts = [n for n in store.files.names(t) if n.endswith(".parquet")]
        for n in parts:
            store.files.move(f"{t}/{n}", f"{t}/commit=version3/{n}")
        moved += [t] if parts else []
    text = store.files.read("cursors.json")
    if text is not None:
        rows = [(p, c, g, "") for p, (c, g) in json.loads(text).items()]
        store.spark.createDataFrame(rows, TABLES["cursors"][0]).write.mode("overwrite").parquet(f"{store.root}/cursors/commit=version3")
        store.files.delete("cursors.json")
    store.files.write(f"{MARKERS}/version3.json", json.dumps(moved))
    store.files.write("schema_version.json", json.dumps({"version": 4}))


MIGRATIONS: dict[int | None, Callable[[Store], None]] = {3: _from_3}


def union_stores(stores: list[Store], name: str) -> DataFrame:
    """A table over all stores that exist, with each store's rank.

    One store is read as it is. Of several, a tape is taken whole from the first store that has rows of it: content-addressed
    tapes are alike everywhere, so the decision is one row a tape. Tables without tapes go by their keys.
    """
    there = [x for x in stores if x.exists()]
    if not there:
        raise ValueError("none of the stores exists")
    parts = [s.read(name).withColumn("store_rank", F.lit(rank)) for rank, s in enumerate(there)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) == 1:
        return out
    key = TABLES[name][1]
    if "tape_id" in key:
        return out.join(out.groupBy("tape_id").agg(F.min("store_rank").alias("store_rank")), ["tape_id", "store_rank"], "left_semi")
    return first_wins(out, key, ["store_rank", *[c for c in out.columns if c not in (*key, "store_rank")]])


def rebuild(old: Store, build: Callable[[Store], None], validate: Callable[[Store, Store], None]) -> Store:
    """Builds a new store beside the old one, validates it, swaps them and retires the old."""
    files = Folder(old.spark, "")
    files.delete(old.root + ".new")
    fresh = Store(old.spark, old.root + ".new").create()
    build(fresh)
    validate(old, fresh)
    retired = old.root + ".old"
    files.delete(retired)
    if files.exists(old.root):
        files.move(old.root, retired)
    files.move(fresh.root, old.root)
    files.delete(retired)
    return Store(old.spark, old.root).check()
