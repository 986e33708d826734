"""Text files by path or address, read by ranges: the same on the driver and on executors.

A plain path is one of the local file system (in a cluster: of a folder all machines share); an address such as
``file:///x``, ``hdfs://host/x`` or ``s3://bucket/x`` names its own.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs

#: Spellings of one store by different clients.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
BLOCK = 8 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.\-]*):/", path)
    if not m:
        return fs.LocalFileSystem(), path
    scheme = SCHEMES.get(m[1].lower(), m[1])
    rest = path[m.end() - 1 :]
    return fs.FileSystem.from_uri(f"{scheme}:{rest if rest.startswith('//') else '//' + rest}")


@dataclass(frozen=True)
class Seen:
    path: str
    size: int
    changed_ns: int


def stat(path: str) -> Seen | None:
    """Size and time of change of a file; None if there is none."""
    where, inner = place(path)
    info = where.get_file_info(inner)
    return Seen(path, info.size, info.mtime_ns or 0) if info.type == fs.FileType.File else None


def listed(folder: str) -> list[Seen]:
    """All files below a folder, by path; their contents aren't read."""
    where, inner = place(folder)
    base, root = folder.rstrip("/"), inner.rstrip("/")
    found = where.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted((Seen(base + i.path[len(root) :], i.size, i.mtime_ns or 0) for i in found if i.type == fs.FileType.File), key=lambda s: s.path)


def read_range(path: str, start: int, end: int) -> bytes:
    where, inner = place(path)
    with where.open_input_file(inner) as f:
        f.seek(start)
        return f.read(max(0, end - start))


def lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines of a range with their terminators, read block by block."""
    where, inner = place(path)
    with where.open_input_file(inner) as f:
        f.seek(start)
        rest, at = b"", start
        while at < end:
            block = f.read(min(BLOCK, end - at))
            if not block:
                break
            at += len(block)
            *whole, rest = (rest + block).split(b"\n") if b"\n" in block else (rest + block,)
            for x in whole:
                yield x + b"\n"
        if rest:
            yield rest


def write_whole(path: str, data: bytes) -> None:
    """Writes beside the target, then renames, so that readers see all or nothing."""
    where, inner = place(path)
    temp = f"{inner}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(temp) as f:
        f.write(data)
    where.move(temp, inner)


def name_of(path: str) -> str:
    return posixpath.basename(path)
