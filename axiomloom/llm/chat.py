"""Chat formatting with a compiled template, and reading it back.

A turn's text depends on the turn alone if the template is one loop over the
messages whose body uses only the message; turns are then formatted where they
lie, without a shuffle, and a conversation is its turns in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches
from .template import Template, TemplateError, unescape, unescape_line
from .text import whole

START, END = "<|im_start|>", "<|im_end|>"

#: The default template. Assistant texts are under the loss mask.
CHATML = (
    "{% for message in messages %}" + START + "{{ message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)


def format_turns(turns: DataFrame, source: str = CHATML, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, mask): the text of each turn and the ranges in
    it (code points, end exclusive) that generation blocks wrote.

    Null roles and texts are empty; null conversations and turns, ties and
    repeated rows are rows like others; an empty table gives no rows. Only the
    named columns are read.
    """
    if not Template(source).turn_by_turn:
        raise TemplateError("the template must be one loop over the messages that uses the message alone")
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), whole(role).alias("r"), whole(text).alias("t"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source)
        for b in batches:
            made = [template.render([{"role": r, "text": t}]) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            mask = pa.array([[{"start": s, "end": e} for s, e in o.ranges] for o in made],
                            pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o.text for o in made], pa.string()), mask],
                                             names=["conv_id", "turn", "formatted", "mask"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(render, f"conv_id {kind['conv_id']}, turn {kind['turn']}, formatted string, "
                                   "mask array<struct<start: bigint, end: bigint>>")


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a turn formatted by CHATML."""
    head, _, body = formatted.removeprefix(START).partition("\n")
    return unescape_line(head), unescape(body[:body.rindex(END)])


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, mask: list[dict]) -> None:
        role, text = read_turn(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{text}\n".encode())
        for m in mask:
            part = unescape(formatted[m["start"]:m["end"]])
            self.loss += len(part)
            self.masked.update(part.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted turns of each conversation say, read back from them.

    A digest is sequential, so one conversation's turns pass through one task,
    sorted on disk and read as a stream: the task holds one batch at a time,
    whatever the conversation's length. Ties in ``turn`` are in the order of the
    formatted text.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = dict(formatted.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        now, done = None, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[] for _ in names]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for conv, text, mask in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(text, mask)
            if len(done) > 5_000:
                yield out()
        if now is not None:
            done.append(now.row())
            yield out()

    streamed = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return streamed.mapInArrow(digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                       "loss_sha256 string, formatted_chars bigint")
