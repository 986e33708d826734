"""The engine's surface: ingest, watch, record, explain, grep, peek, rate and listings over a store."""

from __future__ import annotations

import hashlib
import json
import subprocess
import sys
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.dialects.normalise import content_ids, normalise, to_lines
from spanloom.dialects.registry import DIALECTS
from spanloom.operators import dispatch, index
from spanloom.operators.events import parse_strict
from spanloom.params import DEFAULT
from spanloom.plans import explain as plans
from spanloom.runtime import drop_path, materialize, ship
from spanloom.sources import append, detect, discovery, tapes
from spanloom.sources.stores import Store
from spanloom.streaming.watch import WatchSource, watch, watch_sources

CONFIG = "config.json"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def now_exact() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


@dataclass(frozen=True)
class Config:
    """Settings; the nearest file from the working folder up to the home wins, key by key, but ``peek`` and ``watch`` go as a whole."""

    store: str = ""
    stores: list = field(default_factory=list)
    metrics: bool = False
    peek: dict = field(default_factory=dict)
    watch: dict = field(default_factory=dict)

    @classmethod
    def load(cls, cwd: str, home: str, override: str | None = None) -> Config:
        """``override`` is a file that goes before all others."""
        here, top = Path(cwd).resolve(), Path(home).resolve()
        folders = [here, *here.parents]
        folders = folders[: folders.index(top) + 1] if top in folders else [here, top]
        places = [(f / discovery.STORE_DIR / CONFIG, f) for f in folders]
        if override:
            given = Path(cwd, override)
            if not given.is_file():
                raise ValueError(f"{override}: no such file")
            places.insert(0, (given, given.resolve().parent.parent if given.resolve().parent.name == discovery.STORE_DIR else here))
        values: dict = {}
        for path, folder in places:
            if path.is_file():
                given = json.loads(path.read_text())
                unknown = set(given) - set(cls.__dataclass_fields__)
                if unknown:
                    raise ValueError(f"{path}: unknown keys {', '.join(sorted(unknown))}")
                base = folder / discovery.STORE_DIR
                for k, v in given.items():
                    v = str((base / Path(v).expanduser()).resolve()) if k == "store" else [str((base / Path(x).expanduser()).resolve()) for x in v] if k == "stores" else v
                    values.setdefault(k, v)
        values.setdefault("store", str(here / discovery.STORE_DIR / "store"))
        return cls(**values)


class Engine:
    def __init__(self, spark: SparkSession, cwd: str, home: str | None = None, config: Config | None = None):
        ship(spark)
        self.spark, self.cwd = spark, str(Path(cwd).resolve())
        self.home = home or str(Path.home())
        self.config = config or Config.load(self.cwd, self.home)
        self.store = Store(spark, self.config.store)

    def init(self) -> Engine:
        self.store.create()
        return self

    @property
    def stores(self) -> list[Store]:
        return [self.store, *[Store(self.spark, s) for s in self.config.stores]]

    # --- writing ---

    def ingest(self, paths: list[str] | None = None) -> dict:
        """Reads what is new in the given files, or in all that can be found; counts outcomes.

        The driver only lists files. What is new in each is found and read on the executors and written once; cursors are stored
        after the facts, so what is interrupted is read again and found to be known.
        """
        files, failures = discovery.discover(self.cwd, self.home, paths)
        told = {"scanned": len(files), "imported": 0, "skipped_unchanged": 0, "skipped_unknown": 0, "skipped_existing": 0}
        files = [f for f in files if Path(f).suffix.lower() in discovery.EXTENSIONS]
        if files:
            rows, path = materialize(append.read_new(append.offered(self.spark, files, self.store.cursors())), "incoming")
            heads = rows.where("line_no = -1")
            n_new = heads.count()
            told["skipped_unchanged"] = len(files) - n_new
            if n_new:
                told |= self.ingest_lines(rows.where("line_no >= 0").select(F.concat_ws("@", "path", F.col("start").cast("string")).alias("tape_id"), "line_no", "raw"))
                self.store.commit({"cursors": heads.select("path", "cursor", "guard", F.lit(now_exact()).alias("read_at"))})
            drop_path(self.spark, path)
        return {**told, "failures": [{"path": p, "reason": r} for p, r in failures], "status": "partial" if failures else "ok"}

    def ingest_lines(self, lines: DataFrame) -> dict:
        """Detects, normalises and indexes raw lines (tape_id, line_no, raw); the store's tape ids are hashes of the normalised text."""
        kinds, _ = materialize(detect.detect(lines), "kinds")
        by_kind = {r["dialect"]: r["n"] for r in kinds.groupBy("dialect").agg(F.count("*").alias("n")).collect()}
        parts, markers = None, None
        for name in (n for n in DIALECTS if by_kind.get(n)):
            mine = lines.join(kinds.where(F.col("dialect") == name), "tape_id", "left_semi")
            out = to_lines(normalise(mine, name))
            parts = out if parts is None else parts.unionByName(out)
            links = dispatch.dispatch_links(mine)
            markers = links if markers is None else markers.unionByName(links)
        told = {"skipped_unknown": by_kind.get(None, 0), "imported": 0, "skipped_existing": 0}
        if parts is None:
            return told
        normal, _ = materialize(parts, "normal")
        return told | self._index(normal, markers)

    def _index(self, normal: DataFrame, markers: DataFrame) -> dict:
        telling = normal.where(F.get_json_object("raw", "$.k") != "meta").select("tape_id").distinct()
        ids, _ = materialize(content_ids(normal).join(telling, "tape_id", "left_semi"), "ids")
        fresh = ids.join(self.store.read("tapes").withColumnRenamed("tape_id", "content_id"), "content_id", "left_anti")
        fresh, _ = materialize(fresh, "fresh")
        n_all, n_new = ids.count(), fresh.count()
        if n_new:
            named = lambda df: df.join(fresh, "tape_id").drop("tape_id").withColumnRenamed("content_id", "tape_id")
            lines = named(normal)
            anchored, _ = materialize(index.with_anchors(parse_strict(lines)), "anchored")
            rows = index.valid_tapes_only(anchored)
            ledger = rows.select("tape_id").distinct()
            self.store.commit({"tape_lines": lines.join(ledger, "tape_id", "left_semi"), "evidence": index.evidence(rows), "edges": index.edges(rows), "tombstones": index.tombstones(rows), "dispatch_links": named(markers).join(ledger, "tape_id", "left_semi"), "tapes": ledger})
        return {"imported": n_new, "skipped_existing": n_all - n_new}

    def fingerprint(self, folder: str) -> dict:
        """Indexes the tapes of a folder of compressed files that the ledger lacks."""
        lines, _ = materialize(tapes.read_tapes(self.spark, [folder]), "tapes")
        return self._index(lines, dispatch.dispatch_links(lines))

    def record(self, lines: list[str] | None = None, command: list[str] | None = None) -> dict:
        """Indexes a normalised log given as lines, or the call and result of a command that is run."""
        if command is not None:
            run = subprocess.run(command, capture_output=True, text=True, cwd=self.cwd)
            head = subprocess.run(["git", "-C", self.cwd, "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip() or None
            base = {"t": now(), "source": {"harness": "record"}}
            events = [{**base, "k": "meta", "repo_head": head}, {**base, "k": "tool.call", "tool": command[0], "args": " ".join(command[1:])}, {**base, "k": "tool.result", "tool": command[0], "exit": run.returncode, "stdout": run.stdout, "stderr": run.stderr}]
            lines = [json.dumps({k: v for k, v in e.items() if v is not None}, sort_keys=True) for e in events]
        df = self.spark.createDataFrame([("record", i, x) for i, x in enumerate(lines or [])], "tape_id STRING, line_no BIGINT, raw STRING")
        df, _ = materialize(df, "record")
        return self._index(df, dispatch.dispatch_links(df))

    def _checkpoint(self, *parts: str) -> str:
        return f"{self.store.root}/watch-{hashlib.sha256(chr(0).join(parts).encode()).hexdigest()[:16]}"

    def _watch_params(self):
        given = {"debounce": "debounce_s", "ingest_timeout": "ingest_timeout_s"}
        return replace(DEFAULT, **{given[k]: v for k, v in self.config.watch.items() if k in given})

    def watch(self, folder: str, checkpoint: str | None = None, once: bool = False, pattern: str = "*.jsonl", tell=None, glob: str | None = None):
        """Indexes what is appended to the files of one folder, until the query is stopped."""
        source = WatchSource(folder, pattern, glob)
        return watch(self.spark, source, self.ingest_lines, checkpoint or self._checkpoint(folder), once, tell, self._watch_params())

    def watch_configured(self, once: bool = False) -> list:
        """One query for each source of the configuration (path, pattern and maybe glob); missing folders are told in the log and left out."""
        given = self.config.watch.get("sources") or []
        if not given:
            raise ValueError("watch.sources must name at least one source")
        log = self.config.watch.get("log") or str(Path(self.cwd, discovery.STORE_DIR, "watch.log"))
        Path(log).parent.mkdir(parents=True, exist_ok=True)

        def tell(text: str) -> None:
            with open(log, "a", encoding="utf-8") as f:
                f.write(f"{now()} {text}\n")

        sources = [WatchSource(str(Path(self.cwd, Path(s["path"]).expanduser())) if "://" not in s["path"] else s["path"], s.get("pattern", "*.jsonl"), s.get("glob")) for s in given]
        return watch_sources(self.spark, sources, self.ingest_lines, lambda s: self._checkpoint(s.folder, s.pattern, s.glob or ""), once, tell, self._watch_params())

    # --- reading ---

    def _answer(self, command: str, payload: dict, target: str) -> dict:
        out = plans.with_result_id(command, payload)
        self.store.put_result(out["result_id"], command, json.dumps(payload, default=str), now())
        if self.config.metrics:
            page = (payload.get("sessions") or [payload.get("session")] or [None])[0] or {}
            row = {"ts": now(), "command": command, "target": target, "session_id": page.get("session_id"), "window_start": page.get("window_start"), "window_lines": (page.get("window_end") or 0) - (page.get("window_start") or 0) + 1, "total_lines": page.get("total_lines")}
            try:  # a query's answer doesn't depend on its metrics
                self.store.files.write(f"metrics/{now_exact()}-{out['result_id']}.json".replace(":", ""), json.dumps(row))
            except Exception:  # noqa: BLE001, S110
                pass
        return out

    def explain(self, target: str, **options) -> dict:
        return self._answer("explain", plans.explain(self.stores, target, plans.Options(**options), self.cwd), target)

    def grep(self, literal: str, **options) -> dict:
        return self._answer("grep", plans.grep(self.stores, literal, plans.Options(**options)), literal)

    def peek(self, session_id: str, **options) -> dict:
        given = {"lines": "peek_lines", "before": "peek_before", "after": "peek_after", "context": "grep_context"}
        p = replace(DEFAULT, **{given[k]: v for k, v in self.config.peek.items()})
        return self._answer("peek", plans.peek(self.stores, session_id, p=p, **options), session_id)

    def rate(self, result: str, outcome: str, note: str | None = None) -> None:
        self.store.rate(result, outcome, note, now())

    def tapes(self) -> DataFrame:
        return tapes.list_tapes(self.store.read("tape_lines"))

    def show(self, tape_id: str, raw: bool = False) -> list:
        """All events of a tape: as stored, or as compact objects of the fields a reader needs."""
        rows = self.store.read("tape_lines").where(F.col("tape_id") == tape_id).orderBy("line_no").collect()
        if not rows:
            raise plans.SessionNotFound(tape_id)
        return [r["raw"] for r in rows] if raw else [compact_event(r["line_no"], r["raw"]) for r in rows]

    def gc(self) -> dict:
        """Counts the tapes; nothing is ever deleted."""
        return {"kept": self.store.read("tapes").count(), "deleted": 0}


#: The fields of a compact event.
COMPACT = ("t", "k", "role", "tool", "file", "range", "before_range", "after_range", "before_hash", "after_hash", "from_file", "from_range", "to_file", "to_range", "note", "exit")


def compact_event(offset: int, raw: str) -> dict:
    event = json.loads(raw)
    return {"offset": offset, **{k: event[k] for k in COMPACT if k in event}}


def error_payload(e: Exception) -> dict:
    return {"error": {"code": getattr(e, "code", "other"), "message": str(e)}}


_EXPLAIN = {"limit": int, "offset": int, "since": str, "until": str, "grep_filter": str, "min_confidence": float, "max_fanout": int, "max_edges": int, "depth": int, "count": None, "anchor": None, "include_deleted": None, "forensics": None, "pretty": None}
_GREP = {k: _EXPLAIN[k] for k in ("limit", "offset", "since", "until", "count")}
_PEEK = {"start": int, "lines": int, "before": int, "after": int, "grep_filter": str}
#: Commands with their positional arguments (``*`` any number of them) and flags (None: without value).
COMMANDS = {
    "init": ([], {}), "ingest": (["paths*"], {}), "watch": ([], {"config": str, "once": None}), "fingerprint": (["folder"], {}), "record": (["argv*"], {"stdin": None}), "explain": (["target"], _EXPLAIN), "grep": (["literal"], _GREP),
    "peek": (["session"], _PEEK), "rate": (["result"], {"outcome": str, "note": str}), "tapes": ([], {}), "show": (["tape"], {"raw": None}), "gc": ([], {}),
}


def parser():
    import argparse

    ap = argparse.ArgumentParser(prog="spanloom", description="Which sessions made or mention a text, and what stands in them.")
    sub = ap.add_subparsers(dest="command", required=True)
    for name, (args, flags) in COMMANDS.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a.rstrip("*"), nargs=("..." if name == "record" else "*") if a.endswith("*") else None)
        for flag, kind in flags.items():
            how = {"action": "store_true"} if kind is None else {"type": kind, "required": flag == "outcome"}
            p.add_argument("--" + flag.replace("_", "-"), dest=flag, **how)
    return ap


def run(e: Engine, a, stdin=None) -> object:
    """The answer of a parsed command."""
    flags = {k: v for k in COMMANDS[a.command][1] if (v := getattr(a, k)) not in (None, False)}
    if a.command == "explain":
        show = flags.pop("pretty", False)
        out = e.explain(a.target, **{{"depth": "max_depth"}.get(k, k): v for k, v in flags.items()})
        return plans.pretty(out) if show else out
    if a.command == "grep":
        return e.grep(a.literal, **flags)
    if a.command == "peek":
        return e.peek(a.session, **{{"grep_filter": "literal"}.get(k, k): v for k, v in flags.items()})
    if a.command == "record":
        if a.stdin == bool(a.argv):
            raise ValueError("record takes either --stdin or a command")
        return e.record(lines=[x for x in (stdin or sys.stdin).read().splitlines()]) if a.stdin else e.record(command=a.argv[1:] if a.argv[:1] == ["--"] else a.argv)
    if a.command == "watch":
        queries = e.watch_configured(a.once)
        for q in queries:
            q.awaitTermination()
        return {"watched": len(queries)}
    return {
        "init": lambda: {"store": e.store.root}, "ingest": lambda: e.ingest(a.paths), "fingerprint": lambda: e.fingerprint(a.folder), "rate": lambda: e.rate(a.result, a.outcome, a.note),
        "tapes": lambda: [r.asDict() for r in e.tapes().toLocalIterator()], "show": lambda: e.show(a.tape, a.raw), "gc": e.gc,
    }[a.command]()


def main(argv: list[str] | None = None, spark: SparkSession | None = None, cwd: str = ".", home: str | None = None) -> int:
    """The command line; see ``COMMANDS``. Errors are one JSON object on the error stream and exit code 1."""
    a = parser().parse_args(argv)
    try:
        config = Config.load(cwd, home or str(Path.home()), getattr(a, "config", None))
        spark = spark or SparkSession.builder.appName("spanloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        out = run(Engine(spark, cwd, home, config).init(), a)
    except (LookupError, ValueError, OSError) as x:
        print(json.dumps(error_payload(x)), file=sys.stderr)
        return 1
    for x in out if a.command == "show" and a.raw else [out]:
        print(x if isinstance(x, str) else json.dumps(x, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
