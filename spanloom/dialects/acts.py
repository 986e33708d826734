"""Transcript rows of each dialect to acts.

An act is what one row, or one block of it, does: a message in or out, a tool call, a tool result, or facts about the session.
Reading a row needs no other row, so this step runs over any split of the input. What spans rows (a result's
call, counters of a session) is done afterwards by joins and windows, see ``normalise``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from spanloom.functions.scalar import TOOL_EDITS, TOOL_READS

EXIT = re.compile(r"^\s*Process exited with code (-?\d+)\s*$", re.MULTILINE)


@dataclass
class Act:
    act: str
    t: str | None = None
    session_id: str | None = None
    model: str | None = None
    repo_head: str | None = None
    text: str | None = None
    tool: str | None = None
    call_id: str | None = None
    args: str | None = None
    error: bool = False
    exit: int | None = None
    stdout: str | None = None
    stderr: str | None = None
    reads: list[dict] = field(default_factory=list)
    edits: list[dict] = field(default_factory=list)

    def row(self) -> dict:
        return asdict(self)


def compact(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def text_of(content: object) -> str:
    """Text as it is, or the texts of an array's items on lines of their own."""
    if isinstance(content, str):
        return content
    out = []
    for item in content if isinstance(content, list) else []:
        if isinstance(item, str):
            out.append(item)
        elif isinstance(item, dict):
            out += [item[k] for k in ("text", "input_text", "output_text") if isinstance(item.get(k), str)][:1]
    return "\n".join(out)


def _s(d: object, *names: str) -> str | None:
    """The first of some keys that holds a string."""
    return next((d[n] for n in names if isinstance(d.get(n), str)), None) if isinstance(d, dict) else None


def _n(d: object, *names: str) -> int | None:
    return next((d[n] for n in names if isinstance(d.get(n), int) and not isinstance(d.get(n), bool)), None) if isinstance(d, dict) else None


def _d(d: object, name: str) -> dict:
    v = d.get(name) if isinstance(d, dict) else None
    return v if isinstance(v, dict) else {}


def _list(d: object, name: str) -> list:
    v = d.get(name) if isinstance(d, dict) else None
    return v if isinstance(v, list) else []


def _blocks(content: object) -> object:
    """The array that a text holds, if it is the JSON text of one; else the content itself."""
    if isinstance(content, str) and content.lstrip()[:1] == "[":
        try:
            value = json.loads(content)
        except (ValueError, RecursionError):
            return content
        return value if isinstance(value, list) else content
    return content


def _read(file: str | None, start: int = 1, end: int | None = None, text: str | None = None) -> list[dict]:
    return [{"file": file, "start": start, "end": max(start, end if end is not None else start), "text": text}] if file else []


def _edit(file: str | None, before: str | None, after: str | None) -> list[dict]:
    return [{"file": file, "before": before, "after": after}] if file else []


def claude(row: object) -> Iterator[Act]:
    kind, message = _s(row, "type"), _d(row, "message")
    t, session = _s(row, "timestamp"), _s(row, "session_id", "sessionId")
    content = _blocks(message.get("content"))
    if kind == "user":
        if isinstance(content, str):
            yield Act("in", t, session, text=content)
        for b in content if isinstance(content, list) else []:
            if isinstance(b, dict) and b.get("type") == "tool_result":
                bad = b.get("is_error") is True
                yield Act("result", t, session, call_id=_s(b, "tool_use_id"), stdout=text_of(b.get("content")), error=bad, exit=int(bad))
    elif kind == "assistant":
        yield Act("facts", t, session, _s(message, "model"))
        blocks = [{"type": "text", "text": content}] if isinstance(content, str) else content if isinstance(content, list) else []
        for b in blocks:
            if not isinstance(b, dict):
                continue
            if b.get("type") == "text" and _s(b, "text"):
                yield Act("out", t, session, text=b["text"])
            elif b.get("type") == "tool_use":
                name, given = _s(b, "name"), _d(b, "input")
                file, edits, reads = _s(given, "file_path"), [], []
                if name == "Read":
                    start = max(1, _n(given, "offset") or 1)
                    limit = _n(given, "limit")
                    reads = _read(file, start, start + limit - 1 if limit is not None else start)
                elif name == "Edit":
                    edits = _edit(file, _s(given, "old_string"), _s(given, "new_string"))
                elif name == "Write":
                    edits = _edit(file, None, _s(given, "content"))
                elif name == "MultiEdit":
                    edits = [e for x in _list(given, "edits") for e in _edit(file, _s(x, "old_string"), _s(x, "new_string"))]
                yield Act("call", t, session, tool=name or "unknown", call_id=_s(b, "id"), args=compact(b.get("input")), reads=reads, edits=edits)


def patch_sections(patch: str) -> list[dict]:
    """Edits of a patch text: the first section of each file, with its lines before and after."""
    out: dict[str, tuple[list, list]] = {}
    current = None
    for line in patch.split("\n"):
        m = re.match(r"\*\*\* (?:Update|Add|Delete) File: (.+?)\s*$", line)
        if m:
            current = None if m[1] in out else out.setdefault(m[1], ([], []))
        elif current is not None and line[:1] in ("+", "-", " "):
            if line[0] in "- ":
                current[0].append(line[1:])
            if line[0] in "+ ":
                current[1].append(line[1:])
    return [{"file": f, "before": "\n".join(b) if b else None, "after": "\n".join(a) if a else None} for f, (b, a) in out.items()]


def codex(row: object) -> Iterator[Act]:
    kind, p = _s(row, "type"), _d(row, "payload")
    t, session = _s(row, "timestamp"), _s(row, "session_id", "sessionId") or _s(p, "session_id", "sessionId")
    if kind == "session_meta":
        yield Act("meta", t, session or _s(p, "id"), _s(p, "model", "model_provider"), _s(_d(p, "git"), "commit_hash"))
    elif kind == "response_item":
        inner = _s(p, "type")
        if inner == "message":
            text = text_of(_blocks(p.get("content")))
            if text:
                yield Act("out" if p.get("role") == "assistant" else "in", t, session, text=text)
        elif inner in ("function_call", "custom_tool_call"):
            args = _s(p, "arguments", "input")
            args = args if args is not None else compact(p.get("arguments", p.get("input")))
            edits = []
            if _s(p, "name") == "apply_patch":
                try:
                    given = json.loads(args)
                except ValueError:
                    given = None
                edits = patch_sections(_s(given, "patch", "input") or args)
            yield Act("call", t, session, tool=_s(p, "name") or "unknown", call_id=_s(p, "call_id"), args=args, edits=edits)
        elif inner in ("function_call_output", "custom_tool_call_output"):
            out = _s(p, "output")
            out = out if out is not None else text_of(p.get("output"))
            m = EXIT.search(out)
            yield Act("result", t, session, call_id=_s(p, "call_id"), stdout=out, exit=int(m[1]) if m else None)


def cursor(row: object) -> Iterator[Act]:
    kind, sub = _s(row, "type"), _s(row, "subtype")
    t, session = _s(row, "timestamp"), _s(row, "session_id")
    if kind == "system" and sub == "init":
        yield Act("meta", t, session, _s(row, "model"))
    elif kind in ("user", "assistant"):
        text = text_of(_d(row, "message").get("content"))
        if text:
            yield Act("in" if kind == "user" else "out", t, session, text=text)
    elif kind == "tool_call":
        call = row.get("tool_call")
        try:
            call = json.loads(call) if isinstance(call, str) else call
        except ValueError:
            call = {}
        name, inner = next(((k, v) for k, v in (call or {}).items() if isinstance(v, dict)), ("unknown", {}))
        if name == "function":
            name = _s(inner, "name") or name
        given = inner.get("args", inner.get("arguments"))
        try:
            given = json.loads(given) if isinstance(given, str) else given
        except ValueError:
            given = {"text": given}
        if sub == "started":
            path = _s(given, "path", "file_path")
            reads = _read(path) if "read" in name.lower() else []
            edits = _edit(path, None, _s(given, "content", "text", "fileText")) if re.search("write|edit", name, re.IGNORECASE) else []
            yield Act("call", t, session, tool=name, call_id=_s(row, "call_id"), args=compact(given), reads=reads, edits=edits)
        elif sub == "completed":
            result = inner.get("result")
            good, bad = _d(result, "success"), (result or {}).get("error") if isinstance(result, dict) else None
            out = _s(good, "content", "output", "stdout") or ""
            err = bad if isinstance(bad, str) else _s(bad, "message") or (compact(bad) if bad else "")
            yield Act("result", t, session, tool=name, call_id=_s(row, "call_id"), stdout=out, stderr=err, error=bad is not None, exit=int(bad is not None))


def gemini(doc: object) -> Iterator[Act]:
    """A session document, or a log: an array of messages without tools."""
    if isinstance(doc, list):
        for r in doc:
            if isinstance(r, dict) and isinstance(r.get("message"), str) and r.get("type") in ("user", "gemini"):
                yield Act("in" if r["type"] == "user" else "out", _s(r, "timestamp"), _s(r, "sessionId"), text=r["message"])
        return
    session = _s(doc, "sessionId")
    yield Act("facts", _s(doc, "startTime"), session)
    for m in _list(doc, "messages"):
        t = _s(m, "timestamp")
        text = text_of(m.get("content")) if isinstance(m, dict) else ""
        if _s(m, "model"):
            yield Act("facts", t, session, m["model"])
        if text:
            yield Act("in" if _s(m, "type") == "user" else "out", t, session, text=text)
        for c in _list(m, "toolCalls"):
            if not isinstance(c, dict):
                continue
            name, given, at = _s(c, "name") or "unknown", _d(c, "args"), _s(c, "timestamp") or t
            answers = [_d(_d(x, "functionResponse"), "response") for x in _list(c, "result")]
            out = "\n".join(x for a in answers if (x := _s(a, "output")) is not None)
            err = "\n".join(x for a in answers if (x := _s(a, "error")) is not None)
            out = out or ("" if err else _s(c, "resultDisplay") or "")
            file = _s(given, "file_path", "absolute_path", "path")
            reads = _read(file, text=out or None) if name == "read_file" else []
            edits = _edit(file, None, _s(given, "content")) if name == "write_file" else _edit(file, _s(given, "old_string"), _s(given, "new_string")) if name == "replace" else []
            yield Act("call", at, session, tool=name, call_id=_s(c, "id"), args=compact(c.get("args")), reads=reads, edits=edits)
            yield Act("result", at, session, tool=name, call_id=_s(c, "id"), stdout=out, stderr=err or None, error=bool(err), exit=int(_s(c, "status") != "success" or bool(err)))


def _ms(value: object) -> str | None:
    """Milliseconds as seconds with Z; texts as they are, and numbers that are no time as text."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        try:
            return datetime.fromtimestamp(value // 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        except (ValueError, OverflowError, OSError):
            return str(value)
    return value if isinstance(value, str) else None


def opencode(doc: object) -> Iterator[Act]:
    session = _s(_d(doc, "info"), "id")
    yield Act("facts", _ms(_d(_d(doc, "info"), "time").get("created")), session)
    for m in _list(doc, "messages"):
        info = _d(m, "info")
        t = _ms(_d(info, "time").get("created"))
        for p in _list(m, "parts"):
            if _s(p, "type") == "text" and _s(p, "text"):
                yield Act("out" if info.get("role") == "assistant" else "in", t, session, text=p["text"])
            elif _s(p, "type") == "tool":
                state, name = _d(p, "state"), _s(p, "tool") or "unknown"
                given, status = _d(state, "input"), _s(state, "status")
                file, reads, edits = _s(given, "filePath"), [], []
                if name == "read":
                    start = (_n(given, "offset") or 0) + 1
                    limit = _n(given, "limit")
                    reads = _read(file, start, start + limit - 1 if limit is not None else start, _s(state, "output"))
                elif name == "edit":
                    edits = _edit(file, _s(given, "oldString"), _s(given, "newString"))
                elif name == "write":
                    edits = _edit(file, None, _s(given, "content"))
                elif name in ("patch", "apply_patch"):
                    edits = patch_sections(_s(given, "patchText") or "") or [e for f in _patch_files(_s(given, "patchText") or "") for e in _edit(f, None, None)]
                yield Act("call", t, session, tool=name, call_id=_s(p, "callID"), args=compact(state.get("input")), reads=reads, edits=edits)
                if status in ("completed", "error"):
                    bad = status == "error"
                    yield Act("result", t, session, tool=name, call_id=_s(p, "callID"), stdout=_s(state, "output"), stderr=_s(state, "error"), error=bad, exit=int(bad))


def _patch_files(patch: str) -> list[str]:
    found = re.findall(r"^(?:\*\*\* (?:Update|Add|Delete) File: |\+\+\+ b/|--- a/)(.+?)\s*$", patch, re.MULTILINE)
    return [f for f in dict.fromkeys(found) if f != "/dev/null"]


def _claw_file(given: dict) -> str | None:
    return _s(given, "file_path", "filePath", "path", "file") or (_claw_file(given["input"]) if isinstance(given.get("input"), dict) else None)


def _claw_range(given: dict) -> tuple[int, int]:
    r = given.get("range")
    if isinstance(r, list) and len(r) == 2 and all(isinstance(x, int) for x in r):
        return max(1, r[0]), max(1, r[0], r[1])
    start = _n(given, "start", "start_line")
    start = start if start is not None else (_n(given, "offset") or 0) + 1
    end = _n(given, "end", "end_line")
    limit = _n(given, "limit")
    end = end if end is not None else start + limit - 1 if limit is not None else start
    return max(1, start), max(1, start, end)


def openclaw(row: object) -> Iterator[Act]:
    kind = _s(row, "type")
    t = _ms(row.get("timestamp")) if isinstance(row, dict) else None
    session = _s(row, "session_id", "sessionId") or (_s(row, "id") if kind == "session" else None)
    if kind == "session":
        yield Act("facts", t, session)
        return
    message = row.get("message") if isinstance(row, dict) else None
    if isinstance(message, str):
        try:
            message = json.loads(message)
        except (ValueError, RecursionError):
            message = None
    if kind != "message" or not isinstance(message, dict):
        return
    role, content = _s(message, "role"), _blocks(message.get("content"))
    if role in ("user", "assistant"):
        if _s(message, "model"):
            yield Act("facts", t, session, message["model"])
        blocks = content if isinstance(content, list) else []
        text = content if isinstance(content, str) else "\n".join(b["text"] for b in blocks if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str))
        if text:
            yield Act("in" if role == "user" else "out", t, session, text=text)
        for b in blocks:
            if isinstance(b, dict) and b.get("type") == "toolCall":
                given, name = _d(b, "arguments"), _s(b, "name") or "unknown"
                file, (start, end) = _claw_file(given), _claw_range(given)
                reads = _read(file, start, end) if name.lower() in TOOL_READS else []
                edits = _edit(file, _s(given, "old_string", "oldString", "before"), _s(given, "new_string", "newString", "content", "after")) if name.lower() in TOOL_EDITS else []
                yield Act("call", t, session, tool=name, call_id=_s(b, "id"), args=compact(b.get("arguments")), reads=reads, edits=edits)
    elif role == "toolResult":
        bad, out = message.get("isError") is True, text_of(content)
        yield Act("result", t, session, tool=_s(message, "toolName"), call_id=_s(message, "toolCallId"), stdout=None if bad else out, stderr=out if bad else None, error=bad, exit=int(bad))
