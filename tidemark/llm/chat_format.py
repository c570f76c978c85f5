"""Chat formatting on the level of tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import by_bytes, hold

#: The template: a turn is TURN role SAYS text END. Reserved ids follow the vocabulary; no text encodes to them.
TURN, SAYS, END = "<turn>", "### ", "</turn>"
CONTROLS = ("<turn>", "</turn>", "### User:", "### Assistant:", "### System:", "### ")
N_RESERVED = 3
_TO_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *sorted(CONTROLS, key=len, reverse=True)))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Puts a backslash before each backslash and control string."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """Undoes :func:`escape`: a backslash stands for the character after it."""
    return _ESCAPED.sub(r"\1", text)


class SegmentCoder:
    """Encodes and decodes segments for themselves; special strings in them are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.first = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def coder(path: str) -> SegmentCoder:
    return hold(("segments", path), lambda: SegmentCoder(path))


def _assemble(first: int, turns: list[tuple[str, bytes, bytes]], trained: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a conversation, and the mask of the texts of trained roles as the prefix sum of their edges."""
    parts: list[np.ndarray] = []
    edges: list[tuple[int, int]] = []
    at = 0
    turn, says, end = (np.array([first + i], np.int32) for i in range(N_RESERVED))
    for role, role_ids, text_ids in turns:
        body = np.frombuffer(text_ids, "<i4")
        piece = [turn, np.frombuffer(role_ids, "<i4"), says, body, end]
        start = at + 2 + len(piece[1])
        if role in trained:
            edges.append((start, start + len(body)))
        at = start + len(body) + 1
        parts += piece
    step = np.zeros(at + 1, np.int32)
    for a, b in edges:
        step[a] += 1
        step[b] -= 1
    return np.concatenate(parts).astype(np.int32), np.cumsum(step[:at]) > 0


def _by_text(turns: list[tuple], tool: SegmentCoder) -> list[tuple]:
    """Turns in order of number and role; those equal in both, which are rare, are read back and ordered by text."""
    out: list[tuple] = []
    for _, run in groupby(turns, key=lambda t: t[:2]):
        same = list(run)
        if len(same) > 1:
            texts = [unescape(x) for x in tool.decode([np.frombuffer(t[3], "<i4").tolist() for t in same])]
            same = [same[i] for i in sorted(range(len(same)), key=texts.__getitem__)]
        out += same
    return out


def format_chats(turns: DataFrame, tokenizer: str, trained: tuple[str, ...] = ("assistant",), batch_bytes: int = 2 << 20) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): conv_id, ids array<int>, loss_mask array<boolean>.

    Segments are encoded row by row wherever rows lie; then rows go to their conversation and reserved ids are spliced
    between segments. Null texts and roles count as empty; null conv_ids are one conversation. Turns go by number, null
    first; equal numbers by role, then text. Repeated rows are repeated turns. A conversation is one output row, so it must
    fit in a task; memory holds one more than about ``batch_bytes`` / 4 finished ids. Other columns are not read.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, "text", batch_bytes):
                columns = [pa.array([np.array(x, "<i4").tobytes() for x in tool.encode([escape(t) for t in part.column(c).to_pylist()])], pa.binary()) for c in ("role", "text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "turn", "role")), *columns], ["conv_id", "turn", "role", "role_ids", "text_ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(tokenizer)
        first = tool.first
        now: object = assemble  # no conversation yet
        held: list[tuple] = []  # turn, role, ids of role and text
        out: tuple[list, list, list] = ([], [], [])
        size = 0

        def close() -> None:
            nonlocal size
            ids, mask = _assemble(first, [h[1:] for h in _by_text(held, tool)], trained)
            size += len(ids)
            for column, value in zip(out, (now, ids, mask), strict=True):
                column.append(value)

        def take(like: pa.DataType) -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], like), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.bool_()))], ["conv_id", "ids", "loss_mask"])
            nonlocal size
            size = 0
            for column in out:
                column.clear()
            return batch

        like = pa.null()
        for batch in batches:
            like = batch.column("conv_id").type
            for conv, turn, role, role_ids, text_ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "role_ids", "text_ids")), strict=True):
                if now is assemble or conv != now:
                    if held:
                        close()
                        held.clear()
                    if 4 * size >= batch_bytes:
                        yield take(like)
                    now = conv
                held.append((turn, role, role_ids, text_ids))
        if held:
            close()
            yield take(like)

    turn_type = turns.schema["turn"].dataType.simpleString()
    encoded = rows.mapInArrow(encode, f"conv_id {kind}, turn {turn_type}, role string, role_ids binary, text_ids binary")
    dealt = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role")
    return dealt.mapInArrow(assemble, f"conv_id {kind}, ids array<int>, loss_mask array<boolean>")


def read_turns(ids: np.ndarray, mask: np.ndarray, tool: SegmentCoder) -> tuple[list[tuple[str, str]], str, str]:
    """Turns (role, text), the text under the mask, and the rendered text, from the ids alone."""
    marks = np.flatnonzero(ids >= tool.first)
    if not len(marks):
        return [], "", ""
    segments = [x.tolist() for x in np.split(ids, marks)[1:]]
    masked = [x[m].tolist() for x, m in zip(np.split(ids, marks)[1:], np.split(mask, marks)[1:], strict=True)]
    texts = tool.decode([x[1:] for x in segments])
    names = (TURN, SAYS, END)
    kinds = [x[0] - tool.first for x in segments]
    rendered = "".join(names[k] + t + ("\n" if k == 2 else "") for k, t in zip(kinds, texts, strict=True))
    roles = [unescape(t) for k, t in zip(kinds, texts, strict=True) if k == 0]
    said = [unescape(t) for k, t in zip(kinds, texts, strict=True) if k == 1]
    loss = "".join(unescape(t) for t in tool.decode(masked))
    return list(zip(roles, said, strict=True)), loss, rendered
