"""Chat formatting: typed content parts.

A turn's content is a list of parts (text, image, audio, document). A visitor flattens them
in order: texts are escaped, the others become placeholders, and an attachment (kind,
reference, place of its placeholder, expanded tokens) is recorded. The template marks each
turn with its role; ``loss`` lists the spans of the assistant's texts.

``format_turns`` works on each turn by itself; a conversation's output is its turns' in
order, so no conversation has to fit in memory. ``read_back`` parses the output again, also
turn by turn, with a running digest for each conversation.

Escaping: in a text a backslash is put between ``<`` and the ``|`` (or backslashes and ``|``)
behind it, so control strings never arise from texts; reading takes one away. A line feed
in a role is written as a control string.

Cases: a null text or part list is empty, a null role is an empty one; an unknown kind of
part raises; null sizes expand to one token; turns of equal number are ordered by role, then
output, a null turn comes first; a null conversation id is a conversation; repeated rows are
turns of their own; an empty table gives an empty one; input columns that are written anew
are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calendra.llm.common import ddl, without

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|line|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Pixels of an image patch's side, audio tokens a second, tokens of a document's page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "array<struct<kind: string, ref: string, place: int, tokens: bigint>>"
SPANS = "array<struct<start: int, `end`: int>>"
_PARTIAL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(f"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.DOTALL)
_MARKS = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))


def escape(text: str) -> str:
    return _PARTIAL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


class Visitor:
    """Flattens the parts of one turn."""

    def __init__(self, role: str | None):
        self.role = role or ""
        self.out = [START, escape(self.role).replace("\n", LINE), "\n"]
        self.size = sum(map(len, self.out))
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}")(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part["text"] or "")
        if self.role == "assistant" and text:
            self.loss.append({"start": self.size, "end": self.size + len(text)})
        self._put(text)

    def visit_image(self, part: dict) -> None:
        sides = (max(1, math.ceil((part[k] or 0) / PATCH)) for k in ("width", "height"))
        self._attach("image", part, math.prod(sides))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part["seconds"] or 0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part["pages"] or 0) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part["ref"], "place": self.size, "tokens": tokens})
        self._put(PLACEHOLDERS[kind])

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def close(self) -> str:
        self._put(f"{END}\n")
        return "".join(self.out)


def text_parts(turns: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``parts`` with one text part for plain turns."""
    part = F.struct(
        F.lit("text").alias("type"), F.col(text).alias("text"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))],
    )
    return turns.withColumn("parts", F.array(part).cast(f"array<{PART}>"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield batch.slice(at, 500)


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted``, ``loss`` and ``attachments`` to turns (role, parts, ...)."""
    turns = without(turns, "formatted", "loss", "attachments")
    types = {
        "loss": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
        "attachments": pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int32()), ("tokens", pa.int64())])),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            formatted, loss, attachments = [], [], []
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                visitor = Visitor(role)
                for part in parts or []:
                    if part is not None:
                        visitor.visit(part)
                formatted.append(visitor.close())
                loss.append(visitor.loss)
                attachments.append(visitor.attachments)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(formatted, pa.string()), pa.array(loss, types["loss"]), pa.array(attachments, types["attachments"])],
                [*batch.schema.names, "formatted", "loss", "attachments"],
            )

    return turns.mapInArrow(run, f"{ddl(turns)}, formatted string, loss {SPANS}, attachments {ATTACHMENT}")


class _Reader:
    """What one conversation's output says, read turn by turn."""

    def __init__(self):
        self.turns = self.chars = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, loss: list[dict]) -> None:
        self.chars += len(formatted)
        for role, body in _TURN.findall(formatted):
            self.turns += 1
            role = unescape(role.replace(LINE, "\n"))
            self.all.update(f"{role}\n{unescape(_MARKS.sub('', body))}\n".encode())
        for span in loss:
            text = unescape(formatted[span["start"]:span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self, conv_id) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation of ``format_turns``' output, read from that output alone:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = (
        formatted.select("conv_id", "turn", "role", "formatted", "loss").repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "formatted", "loss")
    )
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv, rows, schema = None, None, [], None

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema, strict=True)], names)
            rows.clear()
            return out

        for batch in _slices(batches):
            schema = schema or [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for own, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if reader is None or own != conv:
                    if reader is not None:
                        rows.append(reader.row(conv))
                    reader, conv = _Reader(), own
                reader.read(text, loss)
            if len(rows) >= 10_000:
                yield flush()
        if reader is not None:
            rows.append(reader.row(conv))
            yield flush()

    return ordered.mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
