"""Byte-level BPE of whole texts as a reduction over a tree of text halves.

A text is halved until its parts are short. Two neighbours are joined at a seam: the text between a
boundary left of it and one right of it is encoded again, and the tokens outside stay. The window
grows until it ends in boundaries that no context can move: places where a white-space character
follows another character. No alternative of the split pattern matches white space after anything
else, so every tokenisation of every text splits there, and what lies outside can't change.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small

#: Code points in a leaf of the tree, and in the first window on each side of a seam.
LEAF, WINDOW = 4096, 32
#: A boundary whatever the context: a space or line end after a visible character.
ANCHOR = re.compile(r"(?<=\S)(?=[ \n])")
#: A run as long as this, of one class in the split pattern, is left to merge() below.
LONG_RUN = 20_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one piece by a heap of pairs: least rank first, leftmost on ties."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = bytearray(n)

    def rank(at: int) -> int | None:
        mid = after[at]
        return ranks.get(piece[at : after[mid]]) if mid < n else None

    heap = [(r, at, after[after[at]]) for at in range(n) if (r := rank(at)) is not None]
    heapq.heapify(heap)
    while heap:
        r, at, end = heapq.heappop(heap)
        if gone[at] or after[at] >= n or after[after[at]] != end:
            continue
        mid = after[at]
        gone[mid], after[at] = 1, end
        if end < n:
            before[end] = at
        for x in (at, before[at]):
            if x >= 0 and (new := rank(x)) is not None:
                heapq.heappush(heap, (new, x, after[after[x]]))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Codec:
    """Encodes and decodes by the ranks in ``path``, splitting by ``pattern``; no special tokens."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        self.ranks, self.leaf, self.window = read_ranks(path), leaf, window
        self.short = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pieces = regex.compile(pattern)

    def part(self, text: str) -> list[int]:
        """One part at once. The library's splitter runs out of stack on very long runs, hence merge()."""
        if len(text) < LONG_RUN:
            return self.short.encode_ordinary(text)
        out: list[int] = []
        for m in self.pieces.finditer(text):
            piece = m[0].encode("utf-8", "replace")
            out += merge(piece, self.ranks) if len(piece) >= LONG_RUN else self.short.encode_ordinary(m[0]) if len(piece) < 200 else merge(piece, self.ranks)
        return out

    def _seam(self, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
        """The nearest sure boundaries around ``mid``, or the ends, by windows that double."""
        size, left, right = self.window, lo, hi
        while mid - size > lo:
            if found := [m.start() for m in ANCHOR.finditer(text, mid - size, mid - 1) if m.start() > mid - size]:
                left = found[-1]
                break
            size *= 2
        size = self.window
        while mid + size < hi:
            if found := next((m.start() for m in ANCHOR.finditer(text, mid + 1, mid + size) if m.start() > mid + 1), None):
                right = found
                break
            size *= 2
        return left, right

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
        """The tokens of ``text[lo:hi]``, equal to those of one left-to-right pass over it."""
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf:
            return self.part(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._seam(text, lo, mid, hi)
        if left == lo and right == hi:
            return self.part(text[lo:hi])
        a, b = self.encode(text, lo, mid), self.encode(text, mid, hi)
        old_a, old_b = len(self.part(text[left:mid])), len(self.part(text[mid:right]))
        del a[len(a) - old_a :]
        a += self.part(text[left:right])
        a += b[old_b:]
        return a

    def decode(self, ids: list[int], lo: int = 0, hi: int | None = None) -> bytes:
        """The bytes of the tokens, concatenated up a tree of halves."""
        hi = len(ids) if hi is None else hi
        if hi - lo <= self.leaf:
            return self.short.decode_bytes(ids[lo:hi])
        mid = (lo + hi) // 2
        return self.decode(ids, lo, mid) + self.decode(ids, mid, hi)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker; the ranks are read once, from the path on the executor."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row for each input row: ``id``, ``ids`` (array of int) and ``n_tokens``.

    With ``digests``, instead of the ids: ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256`` (of the bytes that decoding them gives). A null
    text counts as empty and has no tokens. Repeated rows and null ids keep a row each; other columns
    are ignored. Each text is encoded where it lies; no row moves.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "ids", "n_tokens"]
    kinds = [kind, "long", "string", "string"] if digests else [kind, "array<int>", "long"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for b in small(batches):
            ids = (use.encode(t.as_py() or "") for t in b.column(1))
            if digests:
                made = [(len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(use.decode(x)).hexdigest()) for x in ids]
                columns = [pa.array([r[k] for r in made], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            else:
                arrays = [np.array(x, np.int32) for x in ids]
                columns = [pa.array(arrays, pa.list_(pa.int32())), pa.array([len(x) for x in arrays], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    return rows.mapInArrow(each, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def decode_documents(tokens: DataFrame, path: str, pattern: str, *, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id`` and ``text`` of each row of token ids; null ids give an empty text, broken UTF-8 U+FFFD."""
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for b in small(batches):
            texts = [use.decode(x.as_py() or []).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, text string")
