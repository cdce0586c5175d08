"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role: text</turn>`` and a line end, with ``role``
and ``text`` as they are. The deterministic parser reads it back: a backslash
makes the next character plain, an unescaped ``</turn>`` ends the text, and an
unescaped ``### `` inside a text or ``: `` inside a role is an error. A turn
that isn't recovered exactly is escaped one level further, until it is:
level 1 puts a backslash before control strings and backslashes, level 2
before every character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE, END = "### ", ": ", "</turn>", "\n"
PIECES = "conv_id long, seq long, role string, piece string, loss_from long, loss_to long, level int, checked boolean"
READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, identical boolean")


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return re.sub(r"\\|### |</turn>|: ", lambda m: "\\" + m.group(), text)
    return re.sub(r"(?s)(.)", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text


def render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """The turn, and where its text starts and ends in it."""
    head = OPEN + escape(role, level) + MIDDLE
    body = escape(text, level)
    return head + body + CLOSE + END, len(head), len(head) + len(body)


_IN_ROLE = re.compile(r"(?s)\\.|### |</turn>|: ")
_IN_TEXT = re.compile(r"(?s)\\.|### |</turn>")


def _until(pattern: re.Pattern, source: str, at: int, stop: str) -> int:
    for m in pattern.finditer(source, at):
        if m.group()[0] != "\\":
            return m.start() if m.group() == stop else -1
    return -1


def parse(source: str, at: int = 0) -> tuple[str, str, int] | None:
    """(role, text, position after) of the turn at ``at``; None: none there."""
    if not source.startswith(OPEN, at):
        return None
    mid = _until(_IN_ROLE, source, at + len(OPEN), MIDDLE)
    end = _until(_IN_TEXT, source, mid + len(MIDDLE), CLOSE) if mid >= 0 else -1
    if end < 0 or not source.startswith(END, end + len(CLOSE)):
        return None
    role, text = source[at + len(OPEN):mid], source[mid + len(MIDDLE):end]
    return unescape(role), unescape(text), end + len(CLOSE) + len(END)


def format_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """Renders at the first level whose reparse is identical."""
    for level in (0, 1, 2):
        piece, a, b = render(role, text, level)
        if parse(piece) == (role, text, len(piece)):
            return piece, a, b, level
    raise AssertionError("every character is escaped at level 2")


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _packed(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` characters of strings."""
    kept, chars = [], 0
    for row in rows:
        kept.append(row)
        chars += 64 + sum(len(x) for x in row if isinstance(x, str))
        if chars >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
            kept, chars = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn, in the order of each conversation: ``piece`` is its
    formatted text, ``loss_from`` and ``loss_to`` the loss mask in the piece
    (an assistant's text; null for other roles), ``level`` its escape level.
    A conversation's formatted text is its pieces, joined in order of ``seq``.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. A
    null text or role is empty, a null turn comes first, equal turn numbers go by
    role, then text; a null conv_id is a conversation of its own. Rows of a
    conversation are sorted into one task, as its digests and its text run in
    order, but stream through it turn by turn, so its length isn't bounded by
    memory.
    """
    schema = _arrow(PIECES)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last, seq = object(), 0
            for conv, role, text in _rows(batches, ["conv_id", "role", "text"]):
                seq = seq + 1 if conv == last else 0
                last = conv
                piece, a, b, level = format_turn(role, text)
                loss = (a, b) if role == "assistant" else (None, None)
                yield conv, seq, role, piece, *loss, level, True

        yield from _packed(rows(), schema)

    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return own.mapInArrow(formatted, PIECES)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted text. The pieces
    of a conversation must be together and in order, as format_turns() leaves
    them. ``identical``: the parser recovered every turn to the last character.
    """
    schema = _arrow(READ)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last, state = object(), None
            for conv, role, piece, a, b in _rows(batches, ["conv_id", "role", "piece", "loss_from", "loss_to"]):
                if conv != last:
                    if state:
                        yield closed(last, state)
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                state[4] += len(piece)
                at = 0
                while got := parse(piece, at):
                    state[0] += 1
                    state[1].update(f"{got[0]}\n{got[1]}\n".encode())
                    state[5] &= got[0] == role
                    at = got[2]
                state[5] &= at == len(piece)
                if a is not None:
                    loss = unescape(piece[a:b])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
            if state:
                yield closed(last, state)

        def closed(conv, s):
            return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5]

        yield from _packed(rows(), schema)

    return pieces.mapInArrow(read, READ)


def conversations(pieces: DataFrame) -> DataFrame:
    """One row per conversation with its whole formatted text, for output that
    wants it so; a conversation must then fit in a row."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda p: p["piece"]), "").alias("formatted"))
