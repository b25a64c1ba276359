"""Chat formatting: typed content parts, a reversible template and a loss mask.

A visitor flattens the parts of a turn, in order, into text and placeholders and
records each attachment with the tokens it will expand to. Turns are joined by a
template whose control strings are escaped inside roles and texts, so that the
formatted string can be read back without loss.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPE = "\\"
#: Control strings of this template and of common other ones (fixed values); all are escaped inside texts.
CONTROL = (TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
_BREAK = re.compile(re.escape(ESCAPE) + "|(?=" + "|".join(map(re.escape, CONTROL)) + r"|<\|(?:image|audio|document):\d+\|>)[\s\S]")
_UNBREAK = re.compile(re.escape(ESCAPE) + r"([\s\S])?")


def escape(text: str) -> str:
    """``text`` with an escape inside every control string and placeholder, and escapes doubled."""
    return _BREAK.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    return _UNBREAK.sub(lambda m: m[1] or "", text)


@dataclass
class TokenRates:
    """Tokens that attachments expand to."""

    patch: int = 28
    image_default: int = 256
    audio_per_second: float = 12.5
    document_per_page: int = 512


@dataclass
class Flattener:
    """Visits the parts of a conversation; attachments are numbered from 1 in order of appearance."""

    rates: TokenRates = field(default_factory=TokenRates)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        kind = part.get("type") or "text"
        found = getattr(self, f"visit_{kind}", None)
        if found is None:
            raise ValueError(f"unknown part type: {kind}")
        return found(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        width, height = part.get("width"), part.get("height")
        sized = width and height
        return self.attach("image", part, math.ceil(width / self.rates.patch) * math.ceil(height / self.rates.patch) if sized else self.rates.image_default)

    def visit_audio(self, part: dict) -> str:
        return self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.rates.audio_per_second))

    def visit_document(self, part: dict) -> str:
        return self.attach("document", part, (part.get("pages") or 1) * self.rates.document_per_page)

    def attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append({"number": len(self.attachments) + 1, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}:{len(self.attachments)}|>"


@dataclass
class Formatted:
    """A conversation while its turns arrive in order."""

    flattener: Flattener = field(default_factory=Flattener)
    pieces: list[str] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)
    length: int = 0

    def add(self, role: str | None, parts: list[dict]) -> None:
        head = TURN + escape(role or "") + TEXT
        body = "".join(map(self.flattener.visit, parts))
        if role == "assistant":
            self.loss.append((self.length + len(head), self.length + len(head) + len(body)))
        self.pieces += [head, body, END]
        self.length += len(head) + len(body) + len(END)

    @property
    def text(self) -> str:
        return "".join(self.pieces)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a formatted string; placeholders stay in the texts."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        middle = formatted.index(TEXT, at)
        end = formatted.index(END, middle)
        turns.append((unescape(formatted[at + len(TURN) : middle]), unescape(formatted[middle + len(TEXT) : end])))
        at = end + len(END)
    return turns


_ATTACHMENT = pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def format_conversations(turns: DataFrame, rates: TokenRates | None = None) -> DataFrame:
    """One row per ``conv_id``: ``formatted``, ``loss_spans`` (code points of assistant bodies), ``attachments`` and ``attachment_tokens``.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``, or instead of ``text`` an array of structs ``parts`` with
    ``type`` (text, image, audio, document) and any of ``text, ref, width, height, seconds, pages``. Turns are in order of
    ``turn``, nulls first, ties by role and text; repeated rows are turns of their own. A null role or text is empty, and
    rows with a null ``conv_id`` are one conversation. Other columns are ignored.
    """
    typed = "parts" in turns.columns
    body = F.col("parts") if typed else F.col("text")
    order = F.to_json("parts") if typed else F.col("text")
    key = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, current, work = None, None, None

        def row(conv, work: Formatted) -> pa.RecordBatch:
            found = work.flattener.attachments
            spans = [{"start": a, "end": b} for a, b in work.loss]
            values = ([conv], [work.text], [spans], [found], [sum(x["tokens"] for x in found)])
            kinds = (key_type, pa.string(), pa.list_(_SPAN), pa.list_(_ATTACHMENT), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["conv_id", "formatted", "loss_spans", "attachments", "attachment_tokens"])

        for batch in batches:
            key_type = batch.column(0).type
            for conv, role, parts in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if work is None or conv != current:
                    if work is not None:
                        yield row(current, work)
                    current, work = conv, Formatted(Flattener(rates or TokenRates()))
                work.add(role, [p for p in parts or [] if p is not None] if typed else [{"text": parts}])
        if work is not None:
            yield row(current, work)

    schema = (
        f"conv_id {key}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, "
        "attachments array<struct<number:bigint,kind:string,ref:string,tokens:bigint>>, attachment_tokens bigint"
    )
    # One conversation is one row of the result, so its turns meet in one task; they stream through it in order.
    rows = turns.select("conv_id", "role", body.alias("body"), F.col("turn"), order.alias("tie"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of conversations read back from ``formatted`` and ``loss_spans``."""
    key = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                whole, learnt, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"] : span["end"]])
                    learnt.update(said.encode())
                    chars += len(said)
                rows.append((len(turns), whole.hexdigest(), chars, learnt.hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = f"conv_id {key}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
