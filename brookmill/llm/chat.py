"""Chat formatting by event-sourced reconstruction.

A log of events is dealt by conversation and sorted by message and sequence; each message's events are folded into its
final text, and the message is rendered in a template:

    message     opens a new message with this role and text
    delta       appends to the message's text
    edit        replaces the message's text
    regenerate  drops the message's text and every later message of the conversation opened before; deltas follow

A task streams its rows and holds one message at a time, so a conversation may be of any length; its output is the texts of its
rows, joined, and is read back by its marks alone, wherever the rows are cut. The template marks turns with <|turn|>role, a new line, the text and <|end|>. Inside roles and texts
the escape sign is written as itself and "e", a control string (of this template or of other common ones) is broken by
the escape sign and "." after its first character, and a new line in a role is the escape sign and "n"; reading back
undoes each exactly.

Defined cases: null texts and roles are empty; rows that agree in conversation and turn keep the order (role, text),
each as a turn of its own; a null turn comes first; rows without a conv_id form one conversation; an event of unknown
kind raises an error; an event for a message that was never opened opens it with the event's role; events for a message that a
regeneration dropped are dropped too, until the message is opened again; an empty log gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.llm._common import map_arrow

TURN, END = "<|turn|>", "<|end|>"
ESCAPE = "\u241b"
#: The first character of a control string, then the rest of it: <| of this and like templates, <s>, </s>, [INST], <<SYS>>.
CONTROL = re.compile(r"([<\[])(\||/?s>|/?INST\]|</?SYS>>)")
KINDS = ("message", "delta", "edit", "regenerate")
LEARNED = "assistant"
ROWS_OUT = 4000

RENDERED = "conv_id bigint, at bigint, text string, loss_start bigint, loss_end bigint"
READ_BACK = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return CONTROL.sub(rf"\1{ESCAPE}.\2", text.replace(ESCAPE, ESCAPE + "e"))


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    return re.sub(ESCAPE + "([.en])", lambda m: {".": "", "e": ESCAPE, "n": "\n"}[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and the span of it that is learned (empty unless the assistant speaks)."""
    head = TURN + escape(role).replace("\n", ESCAPE + "n") + "\n"
    body = escape(text)
    start = len(head)
    return head + body + END + "\n", start, start + len(body) if role == LEARNED else start


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    head, _, rest = turn.removeprefix(TURN).partition("\n")
    return unescape(head), unescape(rest.removesuffix(END + "\n"))


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) of each final message, from (conv_id, message, seq, kind, role, text) in the order of the first three."""
    conv, last_message, opened, dropped_before, dropped = object(), None, None, None, False
    role, parts = "", []
    for c, message, seq, kind, r, text in events:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of event: {kind!r}")
        if c != conv or message != last_message or kind == "message":
            if opened is not None:
                yield conv, role, "".join(parts)
            if c != conv:
                dropped_before = None
            conv, last_message, opened = c, message, None
            # Whether a regeneration of an earlier message came after this opening.
            dropped = dropped_before is not None and message > dropped_before[0] and seq < dropped_before[1]
        if dropped:
            continue
        if opened is None:
            opened, role, parts = seq, r or "", []
        if kind in ("edit", "regenerate"):
            parts = []
        if kind == "regenerate":
            if dropped_before is None or seq > dropped_before[1]:
                dropped_before = (message, seq)
        if kind != "regenerate" or text:
            parts.append(text or "")
    if opened is not None:
        yield conv, role, "".join(parts)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    size = 0
    for row in rows:
        kept.append(row)
        size += len(row[2] or "")
        if len(kept) >= ROWS_OUT or size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (x.split() for x in ddl.split(", "))])


def format_log(events: DataFrame) -> DataFrame:
    """Formatted output of a log with conv_id, message, seq (longs), kind, role and text: rows conv_id, at (0, 1, ...), text,
    loss_start and loss_end (code points within the conversation's output). The output is the texts in this order, in
    which they also stand in their partition.
    """
    first = F.lit(-(2**63))
    log = events.select("conv_id", *[F.coalesce(c, first).cast("bigint").alias(c) for c in ("message", "seq")], "kind", "role", "text")
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", "role", "text")
    schema = _schema(RENDERED)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, at, offset = object(), 0, 0
        for conv, role, text in fold(rows(batches)):
            now, at, offset = (conv, at + 1, offset) if conv == now else (conv, 0, 0)
            turn, start, end = render(role, text)
            yield conv, at, turn, offset + start, offset + end
            offset += len(turn)

    return map_arrow(log, lambda batches: _batches(turns(batches), schema), RENDERED)


#: One turn of an output; texts hold no mark, as those are escaped.
ONE_TURN = re.compile(re.escape(TURN) + "(?s:.*?)" + re.escape(END + "\n"))


class Reader:
    """Reads a conversation's output piece by piece; a piece may end anywhere."""

    def __init__(self) -> None:
        self.rest, self.at, self.masks = "", 0, []
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = 0

    def add(self, text: str, start: int, end: int) -> None:
        self.rest += text
        if end > start:
            self.masks.append((start, end))
        used = 0
        for m in ONE_TURN.finditer(self.rest):
            if m.start() != used:
                break
            role, said = parse(m[0])
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode())
            used = m.end()
        while self.masks and self.masks[0][1] <= self.at + used:
            a, b = self.masks.pop(0)
            learned = unescape(self.rest[a - self.at : b - self.at])
            self.chars += len(learned)
            self.loss.update(learned.encode())
        self.rest, self.at = self.rest[used:], self.at + used

    def result(self) -> tuple:
        if self.rest or self.masks:
            raise ValueError("the output does not end with a whole turn")
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.at


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the output of format_log as it stands in its partitions."""
    schema = _schema(READ_BACK)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, reader = None, None
        for b in batches:
            for conv, _, text, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        yield now, *reader.result()
                    now, reader = conv, Reader()
                reader.add(text, start, end)
        if reader is not None:
            yield now, *reader.result()

    return map_arrow(rendered, lambda batches: _batches(digests(batches), schema), READ_BACK)


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: every row opens a message."""
    return conversations.select("conv_id", F.col("turn").alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


#: Events of one turn at most, and pieces that it is streamed in.
EVENTS_MOST, PIECES = 64, 8


def streamed_log(conversations: DataFrame) -> DataFrame:
    """The same turns as a chat service would have logged them, a hash of the turn's place deciding how: at once; streamed as
    deltas; opened with another text and edited; or answered wrongly, gone on from and regenerated.

    Folding this log gives back the turns.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), (F.row_number().over(order) - 1).cast("bigint").alias("at"))
    step = F.greatest(F.lit(1), F.ceil(F.length("text") / PIECES)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr(F.col("text"), i * step + 1, step))
    event = lambda kind, text, later=0: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(later).alias("later"))
    deltas = F.transform(pieces, lambda x: event("delta", x))
    nothing, draft = F.lit(""), F.reverse("text")
    how = F.pmod(F.xxhash64("conv_id", "at"), F.lit(4))
    events = (
        F.when(how == 0, F.array(event("message", F.col("text"))))
        .when(how == 1, F.concat(F.array(event("message", nothing)), deltas))
        .when(how == 2, F.array(event("message", draft), event("delta", draft), event("edit", F.col("text"))))
        .otherwise(F.concat(F.array(event("message", draft), event("message", draft, 1), event("delta", draft, 1), event("regenerate", F.lit(None).cast("string"))), deltas))
    )
    t = t.select("conv_id", "role", "at", F.posexplode(events).alias("i", "e"))
    return t.select("conv_id", (F.col("at") + F.col("e.later")).alias("message"), (F.col("at") * EVENTS_MOST + F.col("i")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))
