"""Encoding of a corpus with a public byte-level BPE tokenizer.

Every text is encoded as a tree: it is halved down to leaves of a few hundred characters, the leaves are encoded on
their own, and neighbours are joined in a monoid on the way up. The pre-tokenizer reads from left to right without
memory, and none of its matches holds two neighbouring characters of different kinds (white space, letters, numbers,
others), but for a blank before a word and the apostrophe of a contraction. So between two such characters a match
starts whatever stands around: a fixed point. A join encodes again only the window from the last fixed point of the
left side to the first of the right side; the search for both grows from the seam, and tokens outside can't change. The
result is exactly that of the whole text, and no call of the tokenizer sees more than a leaf or a window.

Defined results: null and empty texts have the empty list of ids; strings of special tokens are ordinary text;
repeated rows are encoded each; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS_KEY = "spanloom.tokenizers.dir"
TOKENIZERS_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: The published pre-tokenizer of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between these two characters a match ends and another starts, whatever else the text holds.
FIXED = r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[^\p{White_Space}\p{L}])|(?<=\p{N})(?=[^\p{White_Space}\p{N}])|(?<=[^\p{White_Space}\p{L}\p{N}'])(?=[\p{L}\p{N}])"
LEAF_CHARS = 512
FIRST_WINDOW = 24


def tokenizer_path(spark: SparkSession, name: str = BYTE_BPE) -> str:
    """Place of a vocabulary file; the folder is the session's ``spanloom.tokenizers.dir``."""
    return f"{spark.conf.get(TOKENIZERS_KEY, TOKENIZERS_DIR)}/{name}"


@dataclass
class Piece:
    """The ids of a stretch of a text, encoded on its own."""

    start: int
    end: int
    ids: list[int]


class ByteBpe:
    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf = self.encoding._core_bpe.encode_ordinary if hasattr(self.encoding, "_core_bpe") else self.encoding.encode_ordinary
        self.fixed = regex.compile(FIXED)
        self.leaf_chars, self.joins = leaf_chars, 0
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.width = list(map(len, self.bytes_of))

    def encode(self, text: str | None) -> list[int]:
        return self._tree(text, 0, len(text)).ids if text else []

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8")

    def _tree(self, text: str, start: int, end: int) -> Piece:
        if end - start <= self.leaf_chars:
            return Piece(start, end, self.leaf(text[start:end]))
        mid = (start + end) // 2
        return self.join(text, self._tree(text, start, mid), self._tree(text, mid, end))

    def join(self, text: str, a: Piece, b: Piece) -> Piece:
        """The encoding of both stretches together; the left side's list is used up."""
        self.joins += 1
        if a.start == a.end:
            return b
        p = self._last_fixed(text, a)
        r = self._first_fixed(text, b) if p < b.start else b.start
        ids = a.ids
        if p < r:
            n = len(text[p : a.end].encode())
            while n > 0:
                n -= self.width[ids.pop()]
            ids += self.leaf(text[p:r])
        k, n = 0, len(text[b.start : r].encode())
        while n > 0:
            n -= self.width[b.ids[k]]
            k += 1
        ids += b.ids[k:] if k else b.ids
        return Piece(a.start, b.end, ids)

    def _last_fixed(self, text: str, a: Piece) -> int:
        """The last fixed point of the left side, the seam included; its start if it has none."""
        if self.fixed.match(text, a.end):
            return a.end
        high, n = a.end, FIRST_WINDOW
        while high > a.start:
            low = max(a.start, high - n)
            points = [m.start() for m in self.fixed.finditer(text, max(low, a.start + 1), high)]
            if points:
                return points[-1]
            high, n = low, n * 2
        return a.start

    def _first_fixed(self, text: str, b: Piece) -> int:
        """The first fixed point inside the right side; its end if it has none."""
        m = self.fixed.search(text, b.start + 1, b.end)
        return m.start() if m and m.start() < b.end else b.end


@lru_cache(4)
def bpe(path: str) -> ByteBpe:
    """One tokenizer for each Python worker."""
    return ByteBpe(path)


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of each document."""
    path = path or tokenizer_path(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bpe(path)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                ids = [t.encode(x) for x in part.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, ids ARRAY<INT>")


def sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of each document."""
    path = path or tokenizer_path(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bpe(path)
        for b in batches:
            n = [len(t.encode(x)) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id BIGINT, source STRING, n_tokens BIGINT")
