"""Chat formatting from event logs.

A log holds one row per event: conversation, turn, sequence number, kind, role and text. The log is partitioned by
conversation and sorted; the events of a turn then stand together in sequence order and are folded into its final message:

* ``message``  opens a message with a role and a first piece of text
* ``delta``    appends streamed text to the message that is open
* ``edit``     replaces its text
* ``regenerate`` empties it for a new answer and voids every later turn's events that came before it
* ``retract``  removes it

The fold keeps one message at a time, so a conversation of any length takes bounded memory in its task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"
SEGMENTS = "conv_id long, pos long, role string, segment string, loss_start int, loss_end int"
ROWS = 2048


def escape(text: str) -> str:
    r"""Breaks every ``<|`` by one backslash more than stands there, so no control string is left; unescape() undoes it."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(events: Iterable[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """(conv_id, role, text) of each final message, from events (conv_id, turn, seq, kind, role, text) in sorted order."""
    conv: object = object()
    void_before = pending = None  # the highest sequence number of a regenerate on an earlier turn; on this turn
    turn: object = None
    role, parts, is_open = "", [], False
    for c, t, seq, kind, r, text in events:
        if c != conv or t != turn or kind == "message":
            if is_open:
                yield conv, role, "".join(parts)  # type: ignore[misc]
            is_open = False
        if c != conv:
            conv, turn, void_before, pending = c, t, None, None
        elif t != turn:
            turn = t
            void_before = max((x for x in (void_before, pending) if x is not None), default=None)
            pending = None
        if void_before is not None and seq is not None and seq < void_before:
            continue
        if kind == "message":
            role, parts, is_open = r or "", [text or ""], True
        elif not is_open:
            continue
        elif kind == "delta":
            parts.append(text or "")
        elif kind == "edit":
            parts = [text or ""]
        elif kind == "regenerate":
            parts, pending = [], seq
        elif kind == "retract":
            is_open = False
    if is_open:
        yield conv, role, "".join(parts)  # type: ignore[misc]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows and about ``most`` characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= ROWS or chars >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


SEGMENT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])


def render(batches: Iterator[pa.RecordBatch], learn: str) -> Iterator[pa.RecordBatch]:
    def segments() -> Iterator[tuple]:
        last, pos = object(), 0
        for conv, role, text in fold(_rows(batches)):
            pos = pos + 1 if conv == last else 0
            last = conv
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            a, b = (len(head), len(head) + len(body)) if role == learn else (0, 0)
            yield conv, pos, role, f"{head}{body}{END}\n", a, b

    return _batches(segments(), SEGMENT_SCHEMA)


def format_events(log: DataFrame, *, learn: str = "assistant") -> DataFrame:
    """One row per final message: (conv_id, pos, role, segment, loss_start, loss_end).

    A conversation's training text is its segments in order of pos; loss_start and loss_end mark, in code points of the
    segment, the text that a model learns (only messages of the role ``learn``; else 0, 0). Rows of a conversation follow each other in
    one partition. Null text is empty, a null role is an empty role, null conversations form one of their own, a null turn comes first;
    events of equal turn and sequence number go by kind, role and text; a repeated message is a message again; events
    without an open message are ignored; an empty log gives an empty result; further columns are ignored.
    """
    rows = log.select("conv_id", "turn", "seq", "kind", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return ordered.mapInArrow(lambda batches: render(batches, learn), SEGMENTS)


DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
MARKED = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + "\n", re.DOTALL)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses the formatted segments again and digests what they say; only running hashes are kept."""

    def digests() -> Iterator[tuple]:
        last: object = object()
        now: list = []
        for conv, _, _, segment, a, b in _rows(batches):
            if conv != last:
                if now:
                    yield last, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]
                last, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            found = MARKED.fullmatch(segment)
            role, text, learnt = unescape_role(found[1]), unescape(found[2]), unescape(segment[a:b])
            now[0] += 1
            now[1].update(f"{role}\n{text}\n".encode())
            now[2] += len(learnt)
            now[3].update(learnt.encode())
            now[4] += len(segment)
        if now:
            yield last, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]

    return _batches(digests(), DIGEST_SCHEMA)


def digest(segments: DataFrame, *, in_order: bool = False) -> DataFrame:
    """What format_events() wrote, read back: one row per conversation.

    in_order: the rows stand as format_events() leaves them, without a write in between; otherwise they are brought into that order first.
    """
    rows = segments if in_order else segments.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return rows.mapInArrow(read_back, DIGESTS)


def as_log(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) as an event log: each row opens a message with the first half of its text and streams the rest as a delta."""
    from pyspark.sql import Window

    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    numbered = messages.select("conv_id", "turn", "role", text.alias("text"), half.alias("half"), at.alias("at"))
    pieces = F.array(
        F.struct((2 * F.col("at")).cast("long").alias("seq"), F.lit("message").alias("kind"), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("piece")),
        F.struct((2 * F.col("at") + 1).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.substring(F.col("text"), F.col("half") + 1, F.length("text")).alias("piece")),
    )
    return numbered.select("conv_id", "turn", "role", F.explode(pieces).alias("e")).select("conv_id", "turn", "e.seq", "e.kind", "role", F.col("e.piece").alias("text"))
