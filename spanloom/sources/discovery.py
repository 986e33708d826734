"""Where transcripts of a repository lie: below a folder, or in the homes of the tools that write them."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
from pathlib import Path

STORE_DIR = ".spanloom"
EXTENSIONS = (".json", ".jsonl")
HINT_LINES = 80


def _files(root: Path, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> list[Path]:
    found = root.rglob("*") if recursive else root.glob("*")
    return sorted({p.resolve() for p in found if p.is_file() and p.suffix.lower() in extensions}) if root.is_dir() else []


def local(cwd: str) -> list[str]:
    """All transcript files below a folder, those of the store left out."""
    root = Path(cwd).resolve()
    return [str(p) for p in _files(root) if STORE_DIR not in p.relative_to(root).parts]


def scoped(cwd: str, given: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(files, failures) of paths given by the user; each failure tells its path and reason."""
    root, files, failures = Path(cwd).resolve(), set(), []
    for raw in given:
        p = (root / raw).resolve() if not Path(raw).is_absolute() else Path(raw).resolve()
        if not p.exists():
            failures.append((raw, "no such file"))
        elif root != p and root not in p.parents:
            failures.append((raw, "outside of the folder"))
        elif STORE_DIR in p.relative_to(root).parts:
            failures.append((raw, "inside of the store"))
        elif p.is_dir():
            files |= {x for x in _files(p) if STORE_DIR not in x.relative_to(root).parts}
        elif p.suffix.lower() not in EXTENSIONS:
            failures.append((raw, "neither .json nor .jsonl"))
        else:
            files.add(p)
    return sorted(map(str, files)), failures


def related(a: Path, b: Path) -> bool:
    """Equal, or one above the other."""
    return a == b or a in b.parents or b in a.parents


def _json_lines(path: Path, most: int | None = None):
    try:
        with path.open(encoding="utf-8", errors="replace") as f:
            for i, line in enumerate(f):
                if most is not None and i >= most:
                    return
                try:
                    yield json.loads(line)
                except ValueError:
                    continue
    except OSError:
        return


def claude(repo: str, home: str) -> list[str]:
    root = Path(home, ".claude", "projects", str(Path(repo).resolve()).replace("/", "-"))
    deep = [p for p in _files(root, extensions=(".jsonl",)) if "subagents" in p.parts and "memory" not in p.parts]
    return sorted({str(p) for p in _files(root, False, (".jsonl",)) + deep})


def codex(repo: str, home: str) -> list[str]:
    """Session files whose first stated working folder lies in, or above, the repository."""
    out = []
    for p in _files(Path(home, ".codex", "sessions"), extensions=(".jsonl",)):
        cwd = next((r["payload"]["cwd"] for r in _json_lines(p) if isinstance(r, dict) and r.get("type") == "session_meta" and isinstance(r.get("payload"), dict) and isinstance(r["payload"].get("cwd"), str)), None)
        if cwd and related(Path(cwd), Path(repo).resolve()):
            out.append(str(p))
    return out


def gemini(repo: str, home: str) -> list[str]:
    bucket = Path(home, ".gemini", "tmp", hashlib.sha256(str(Path(repo).resolve()).encode()).hexdigest())
    logs = [bucket / "logs.json"] if (bucket / "logs.json").is_file() else []
    return sorted(str(p) for p in [p for p in _files(bucket / "chats", False, (".json",)) if p.name.startswith("session-")] + logs)


def _mentions(value: object, repo: str) -> bool:
    """Whether a value below a key that tells of places relates to the repository."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                if isinstance(x, str) and re.search("cwd|repo|workspace|path", k, re.IGNORECASE) and (repo in x or (x and repo.startswith(x))):
                    return True
                stack.append(x)
        elif isinstance(v, list):
            stack += v
    return False


def openclaw(repo: str, home: str) -> list[str]:
    path = str(Path(repo).resolve())
    marks = (path.replace("/", "-"), hashlib.sha256(path.encode()).hexdigest())
    root = Path(home, ".openclaw", "sessions")
    return [str(p) for p in _files(root, extensions=(".jsonl",)) if any(m in str(p) for m in marks) or any(_mentions(r, path) for r in _json_lines(p, HINT_LINES))]


def _git(repo: str, *args: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def opencode(repo: str, home: str) -> list[str]:
    """Exports of the project, whose id is cached in the repository, or else its first root commit, or else global."""
    root = Path(os.environ.get("XDG_DATA_HOME") or Path(home, ".local", "share"), "opencode")
    git = _git(repo, "rev-parse", "--git-common-dir")
    cache = Path(repo, git or ".git", "opencode")
    commits = _git(repo, "rev-list", "--max-parents=0", "HEAD") if git else None
    project = cache.read_text().strip() if cache.is_file() else min(commits.split()) if commits else "global"
    bucket = root / "project" / str(Path(repo).resolve()).strip("/").replace("/", "-") / "storage" / "session"
    folders = [bucket / "info", bucket / "message", bucket / "part", root / "storage" / "session" / project]
    return sorted({str(p) for f in folders for p in _files(f, extensions=(".json",))})


def cursor(repo: str, home: str) -> list[str]:
    """State files of the workspaces whose manifest names the repository."""
    roots = [Path(home, "Library", "Application Support", "Cursor"), Path(home, ".config", "Cursor"), *([Path(os.environ["APPDATA"], "Cursor")] if os.environ.get("APPDATA") else [])]
    out = []
    for manifest in (m for r in roots for m in sorted((r / "User" / "workspaceStorage").glob("*/workspace.json"))):
        try:
            value = json.loads(manifest.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
        if str(Path(repo).resolve()) in {re.sub("^file://", "", x).rstrip("/") for x in _places(value)}:
            state = next((manifest.parent / n for n in ("state.vscdb", "state.vscdb.backup") if (manifest.parent / n).is_file()), None)
            out += [str(state)] if state else []
    return out


def _places(value: object) -> list[str]:
    if isinstance(value, dict):
        own = [x for k, x in value.items() if isinstance(x, str) and re.search("folder|path|workspace|uri", k, re.IGNORECASE)]
        return own + [p for x in value.values() for p in _places(x)]
    return [p for x in value for p in _places(x)] if isinstance(value, list) else []


HOMES = {"claude": claude, "codex": codex, "gemini": gemini, "openclaw": openclaw, "opencode": opencode, "cursor": cursor}


def discover(cwd: str, home: str, given: list[str] | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """Given paths alone, or else the files below the folder and in all homes."""
    if given:
        return scoped(cwd, given)
    return sorted({*local(cwd), *[p for f in HOMES.values() for p in f(cwd, home)]}), []
