"""Chat formatting with loss masks that are aligned by offsets.

A conversation is rendered with a template, encoded once with the offsets of its tokens, and the
sorted spans of its assistant texts are intersected with the token spans by binary search. Long
conversations are rendered and encoded as consecutive parts of whole turns; the control tokens at
their ends split text before anything else, so the tokens are those of the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, processors

from .scratch import small

#: The control strings of the template.
START, BREAK, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Characters in a part of a conversation, unless one turn is longer.
PART_CHARS = 200_000
TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(BREAK) + r"(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """Puts a backslash into each ``<|``, and one more where there are some: no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{BREAK}", escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, with the control strings as tokens and offsets that keep white space."""
    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, BREAK, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def loss_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each sorted span of characters, the run (from, to) of tokens that meet it."""
    if not spans:
        return []
    begins, ends = np.array(spans).T
    lo = np.searchsorted(offsets[:, 1], begins, side="right")
    hi = np.searchsorted(offsets[:, 0], ends, side="left")
    return [(int(a), int(max(a, b))) if e > s else (int(a), int(a)) for a, b, s, e in zip(lo, hi, begins, ends, strict=True)]


def _sorted(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = table.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    # By range, so that a conversation of any length is spread over tasks, in order.
    return rows.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn", "role", "text")


def format_conversations(table: DataFrame, tokenizer_path: str, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", part_chars: int = PART_CHARS) -> DataFrame:
    """Rows ``(conv, task, part, formatted, ids, loss)``: the parts of a conversation, in the order of (task, part).

    ``loss``: runs (from, to) of the tokens of each text by ``loss_role``. Turns go by their number
    (nulls first), ties by role and text; repeated rows are turns of their own. Null roles and texts
    are empty, and the rows with a null conversation are one conversation. Other columns are ignored.
    An empty table gives an empty result. A task holds one part of one conversation at a time.
    """
    rows = _sorted(table, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, task = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        held: list[tuple[str, str]] = []
        conv, part, size, kinds = None, 0, 0, None

        def made() -> pa.RecordBatch:
            text, spans = render(held)
            coded = use.encode(text, add_special_tokens=False)
            runs = loss_tokens(np.array(coded.offsets, np.int64).reshape(-1, 2), [s for s, (role, _) in zip(spans, held, strict=True) if role == loss_role])
            loss = pa.array([[{"from": a, "to": b} for a, b in runs]], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([conv], kinds), pa.array([task], pa.int32()), pa.array([part], pa.int64()), pa.array([text]), pa.array([coded.ids], pa.list_(pa.int32())), loss], ["conv", "task", "part", "formatted", "ids", "loss"])

        for b in small(batches):
            kinds = b.schema.field("conv").type
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if held and (c != conv or size + len(text) > part_chars):
                    yield made()
                    part, held, size = part + 1, [], 0
                conv, size = c, size + len(text)
                held.append((role, text))
        if held:
            yield made()

    return rows.mapInArrow(each, f"conv {kind}, task int, part long, formatted string, ids array<int>, loss array<struct<from:int, to:int>>")


def read_back(parts: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each conversation, from its formatted parts: ``conv``, ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256``, ``formatted_chars``, ``n_tokens``.

    Turns are parsed from the formatted text; the text under the loss mask is decoded from the masked
    token ids. Both are done part by part, wherever a part lies; what then meets in one task is a
    stream of sorted parts, which only run through the digests. A null conversation id is an id like
    any other; null texts and roles were formatted as empty ones; a conversation without a masked token
    has 0 ``loss_chars`` and the digest of nothing. Other columns are ignored. No parts, no rows.
    """
    kind = parts.schema["conv"].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = tokenizer(tokenizer_path)
        for b in small(batches):
            out = []
            for r in b.to_pylist():
                turns = [(unescape(role), unescape(text)) for role, text in TURN.findall(r["formatted"])]
                loss = "".join(unescape(use.decode(r["ids"][x["from"] : x["to"]], skip_special_tokens=False)) for x in r["loss"] if x["to"] > x["from"])
                out.append((len(turns), "".join(f"{role}\n{text}\n" for role, text in turns), loss, len(r["formatted"]), len(r["ids"])))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], ["conv", "task", "part", "n", "turns", "masked", "chars", "tokens"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, out = None, False, []
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def done() -> tuple:
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in small(batches):
            kinds[0] = b.schema.field("conv").type
            for conv, n, turns, masked, chars, tokens in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5, 6, 7)), strict=True):
                if not started or conv != now[0]:
                    out += [done()] if started else []
                    now, started = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], True
                now[2].update(turns.encode("utf-8", "replace"))
                now[4].update(masked.encode("utf-8", "replace"))
                for k, x in ((1, n), (3, len(masked)), (5, chars), (6, tokens)):
                    now[k] += x
            if out:
                yield batch()
                out = []
        if started:
            out = [done()]
            yield batch()

    pieces = parts.mapInArrow(parsed, f"conv {kind}, task int, part long, n long, turns string, masked string, chars long, tokens long")
    pieces = pieces.repartition("conv").sortWithinPartitions("conv", "task", "part")
    return pieces.mapInArrow(chained, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
