"""Chat formatting: whole conversations as text, with token masks for the loss.

A conversation's turns are rendered one behind the other between control
strings. The rendered text is encoded once, with offsets, and the spans of the
assistant's texts are met with the token offsets by binary search, which gives
the tokens under the loss. Control strings are special tokens, so no token
reaches across the edge of a turn.

Control strings that occur inside texts or roles are escaped by a backslash
behind their first character, and backslashes are doubled; parsing undoes both.

Turns are ordered by turn number, then role and text where numbers tie or are
null. A null text or role is empty; rows with a null conversation id form one
conversation of their own; repeated rows are repeated turns. A conversation is
sorted and read as a stream; rendered text is cut at a turn's edge into segments
of bounded size, which changes no token, so memory doesn't grow with the number
of turns.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import segment_sums, worker_memo

# The template's control strings. Other roles carry their name.
SYSTEM = ("<<SYS>>", "<</SYS>>")
USER = ("<s>[INST]", "[/INST]")
ASSISTANT = ("<s>", "</s>")
OTHER = ("<<ROLE>>", "<</ROLE>>")
NAME_END = "<</NAME>>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", *SYSTEM, *OTHER, NAME_END)
SEGMENT_CHARS = 1 << 20
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """The text without control strings; ``unescape`` undoes it."""
    return _CONTROL.sub(lambda m: m[0][0] + "\x00" + m[0][1:], text.replace("\\", "\\\\").replace("\x00", "\\0")).replace("\x00", "\\x")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"\\": "\\", "0": "\x00", "x": ""}[m[1]], text, flags=re.DOTALL)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and the span of its content."""
    if role == "user":
        start, end, name = *USER, ""
    elif role == "assistant":
        start, end, name = *ASSISTANT, ""
    elif role == "system":
        start, end, name = *SYSTEM, ""
    else:
        start, end, name = *OTHER, escape(role) + NAME_END
    content = escape(text)
    head = start + name
    return head + content + end, len(head), len(head) + len(content)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted conversation, unescaped."""
    at = 0
    while at < len(formatted):
        for role, (start, end) in (("user", USER), ("system", SYSTEM), ("", OTHER), ("assistant", ASSISTANT)):
            if formatted.startswith(start, at):
                at += len(start)
                if start == OTHER[0]:
                    stop = formatted.index(NAME_END, at)
                    role, at = unescape(formatted[at:stop]), stop + len(NAME_END)
                stop = formatted.index(end, at)
                yield role, unescape(formatted[at:stop])
                at = stop + len(end)
                break
        else:
            raise ValueError(f"no turn starts at character {at}")


class Encoder:
    """Byte-level tokenizer with the control strings as special tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens(list(CONTROLS))
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and start and end offsets, in characters, of all tokens."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int64), np.array(found.offsets, np.int64).reshape(-1, 2)


def mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token inside each span and the one behind its last, by binary search.

    Tokens of one character cut into bytes share their offsets; all of them lie
    inside the span or none.
    """
    first = np.searchsorted(offsets[:, 0], spans[:, 0], side="left")
    last = np.searchsorted(offsets[:, 1], spans[:, 1], side="right")
    empty = spans[:, 0] >= spans[:, 1]
    return first, np.where(empty, first, np.maximum(first, last))


@dataclass
class Formatted:
    """A conversation while its turns stream by."""

    conv_id: int | None
    turns: int = 0
    tokens: int = 0
    loss_tokens: int = 0
    chars: int = 0
    loss_chars: int = 0
    turns_hash: object = field(default_factory=hashlib.sha256)
    loss_hash: object = field(default_factory=hashlib.sha256)


@dataclass
class Segment:
    """Rendered turns of one conversation: what a trainer reads."""

    conv_id: int | None
    number: int
    text: str
    ids: np.ndarray
    loss: np.ndarray
    spans: np.ndarray
    last: bool


def segments(rows: Iterator[tuple[int | None, str | None, str | None]], encoder: Encoder, limit: int = SEGMENT_CHARS) -> Iterator[Segment]:
    """Rendered and encoded conversations from rows sorted by conversation and turn."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    size, number, current, begun = 0, 0, None, False

    def made(last: bool) -> Segment:
        text = "".join(parts)
        ids, offsets = encoder.encode(text)
        loss = np.zeros(len(ids), bool)
        own = np.array(spans, np.int64).reshape(-1, 2)
        for first, behind in zip(*mask(offsets, own), strict=True):
            loss[first:behind] = True
        # What the masked tokens cover, as spans of characters.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], loss, [False]]).astype(np.int8)))
        covered = np.stack([offsets[edges[::2], 0], offsets[edges[1::2] - 1, 1]], 1) if len(edges) else np.zeros((0, 2), np.int64)
        return Segment(current, number, text, ids, loss, covered, last)

    for conv, role, text in rows:
        if begun and conv != current:
            yield made(True)
            parts, spans, size, number = [], [], 0, 0
        elif begun and size >= limit:
            yield made(False)
            parts, spans, size, number = [], [], 0, number + 1
        current, begun = conv, True
        turn, start, end = render_turn(role or "", text or "")
        if role == "assistant":
            spans.append((size + start, size + end))
        parts.append(turn)
        size += len(turn)
    if begun:
        yield made(True)


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str | None]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def formatted(conversations: DataFrame, tokenizer: str, limit: int = SEGMENT_CHARS) -> DataFrame:
    """Training text, ids and loss mask: one row a conversation, or a segment of a very long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_memo(("chat", tokenizer), lambda: Encoder(tokenizer))
        held: list[Segment] = []
        size = 0
        for segment in segments(_rows(batches), encoder, limit):
            held.append(segment)
            size += len(segment.text)
            if size >= 1 << 20:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    out = "conv_id long, segment int, formatted string, ids array<int>, loss array<boolean>, loss_spans array<struct<start: int, end: int>>, last boolean"
    return _sorted_turns(conversations).mapInArrow(run, out)


def _batch(held: list[Segment]) -> pa.RecordBatch:
    spans = pa.array([[{"start": int(a), "end": int(b)} for a, b in s.spans] for s in held], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([s.conv_id for s in held], pa.int64()),
            pa.array([s.number for s in held], pa.int32()),
            pa.array([s.text for s in held], pa.string()),
            pa.array([s.ids for s in held], pa.list_(pa.int32())),
            pa.array([s.loss for s in held], pa.list_(pa.bool_())),
            spans,
            pa.array([s.last for s in held], pa.bool_()),
        ],
        names=["conv_id", "segment", "formatted", "ids", "loss", "loss_spans", "last"],
    )


def read_back(output: DataFrame) -> DataFrame:
    """Turns and loss text read from the formatted output, as digests, one row a conversation.

    Segments of a conversation stand in order in one partition, as ``formatted`` leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own = [], None
        for batch in batches:
            tokens = pc.list_value_length(batch.column("ids")).to_pylist()
            loss = _true_counts(batch.column("loss"))
            for row, n_tokens, n_loss in zip(batch.drop_columns(["ids", "loss"]).to_pylist(), tokens, loss, strict=True):
                own = own if own is not None and own.conv_id == row["conv_id"] and row["segment"] else Formatted(row["conv_id"])
                text = row["formatted"]
                for role, content in parse(text):
                    own.turns += 1
                    own.turns_hash.update(f"{role}\n{content}\n".encode())
                for span in row["loss_spans"]:
                    content = unescape(text[span["start"] : span["end"]])
                    own.loss_chars += len(content)
                    own.loss_hash.update(content.encode())
                own.chars += len(text)
                own.tokens += n_tokens
                own.loss_tokens += n_loss
                if row["last"]:
                    rows.append(own)
            if rows:
                yield _digests(rows)
                rows = []

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    return output.mapInArrow(run, out)


def _true_counts(lists: pa.ListArray) -> list[int]:
    """How many values of each list are true, counted in Arrow."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return segment_sums(lists.flatten().cast(pa.uint8()).to_numpy(), ends).tolist()


def _digests(rows: list[Formatted]) -> pa.RecordBatch:
    numbers = {"n_turns": "turns", "loss_chars": "loss_chars", "formatted_chars": "chars", "n_tokens": "tokens", "loss_tokens": "loss_tokens"}
    found = {name: pa.array([getattr(r, attribute) for r in rows], pa.int64()) for name, attribute in numbers.items()}
    found |= {"conv_id": pa.array([r.conv_id for r in rows], pa.int64())}
    found |= {"turns_sha256": pa.array([r.turns_hash.hexdigest() for r in rows]), "loss_sha256": pa.array([r.loss_hash.hexdigest() for r in rows])}
    order = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    return pa.RecordBatch.from_arrays([found[c] for c in order], names=order)
