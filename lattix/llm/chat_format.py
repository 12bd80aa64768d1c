"""Operator 7, chat formatting with typed content parts.

A message is a role and an ordered list of parts: text, image, audio or document. A visitor flattens the parts: texts are
escaped, any other part becomes the placeholder `<|kind:i|>` (i its place in the message) and an attachment with its
reference, its place in the formatted turn and the tokens that it expands to. A turn is

    <|turn|>ROLE<|says|>CONTENT<|end|>

and a conversation its turns in order, so a turn is formatted by itself and no task holds a conversation. Within roles and
texts a backslash is doubled and `<|` is written `<\\|`, also where one text part ends with `<` and the next begins with `|`,
so control strings appear only as control strings, and parse() gives back exactly what went in (neighbouring texts as one). The loss mask covers the texts of assistant turns, as spans of the formatted turn.

Order: by turn, then role, then text; nulls first. Nulls and edges: a null text is an empty one, a null role an empty role,
a null list of parts an empty message; parts of unknown kind are documents. Rows with a null conv_id are one conversation.
Repeated rows are turns of their own. An empty table gives an empty result; other columns aren't looked at.

read_back() streams turns in order through a digest for each conversation; SHA-256 is sequential, so one conversation is
one task's stream, in bounded memory, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PART = re.compile(r"<\|(image|audio|document):(\d+)\|>")
#: Tokens of an image tile and its side in pixels, of a second of audio, and of a document's page.
TILE_TOKENS, TILE, SECOND_TOKENS, PAGE_TOKENS = 85, 512, 25, 600


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


@dataclass
class Flattened:
    """What visiting a message leaves: the formatted turn, spans of the loss mask, attachments and expanded tokens."""

    out: list[str] = field(default_factory=list)
    at: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    learnt: bool = False
    open: bool = False  # the text just written ends with "<"

    def write(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)
        self.open = False

    def visit(self, i: int, part: dict) -> None:
        kind = part.get("kind") or "text"
        {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio}.get(kind, self.visit_document)(i, part)

    def visit_text(self, i: int, part: dict) -> None:
        text = part.get("text") or ""
        if not text:
            return
        start = self.at
        self.write(("\\" if self.open and text[0] == "|" else "") + escape(text))
        self.open = text[-1] == "<"
        if self.learnt and self.at > start:
            self.loss.append((start, self.at))

    def visit_image(self, i: int, part: dict) -> None:
        tiles = -(-(part.get("width") or 1) // TILE) * -(-(part.get("height") or 1) // TILE)
        self.attach(i, "image", part, TILE_TOKENS * tiles)

    def visit_audio(self, i: int, part: dict) -> None:
        self.attach(i, "audio", part, SECOND_TOKENS * -(-(part.get("millis") or 0) // 1000))

    def visit_document(self, i: int, part: dict) -> None:
        self.attach(i, "document", part, PAGE_TOKENS * (part.get("pages") or 1))

    def attach(self, i: int, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"part": i, "kind": kind, "ref": part.get("ref"), "at": self.at, "tokens": tokens})
        self.write(f"<|{kind}:{i}|>")


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, Flattened]:
    v = Flattened(learnt=role == "assistant")
    v.write(TURN + escape(role or "") + SAYS)
    for i, part in enumerate(parts or ()):
        v.visit(i, part or {})
    v.write(END)
    return "".join(v.out), v


def parse(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """The (role, [(kind, text or placeholder's place)]) of formatted turns one after the other."""
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, _, rest = turn.partition(SAYS)
        parts, at = [], 0
        rest = rest[: rest.rindex(END)]
        for m in PART.finditer(rest):
            if m.start() > at:
                parts.append(("text", unescape(rest[at : m.start()])))
            parts.append((m[1], m[2]))
            at = m.end()
        if rest[at:]:
            parts.append(("text", unescape(rest[at:])))
        out.append((unescape(role), parts))
    return out


_ATTACHMENT = pa.struct([("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())])
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_OUT = "conv_id long, turn long, role string, formatted string, loss array<struct<start:int,end:int>>, attachments array<struct<part:int,kind:string,ref:string,at:int,tokens:long>>, expanded_tokens long"


def formatted(conversations: DataFrame) -> DataFrame:
    """A row a turn (conv_id, turn, role, formatted, loss, attachments, expanded_tokens) of rows (conv_id, turn, role, and text or parts).

    parts is an array of structs with kind and any of text, ref, width, height, millis and pages.
    """
    parts = F.col("parts") if "parts" in conversations.columns else F.array(F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text")))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), parts.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [format_turn(r, p) for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([s for s, _ in done], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in v.loss] for _, v in done], pa.list_(_SPAN)),
                    pa.array([v.attachments for _, v in done], pa.list_(_ATTACHMENT)),
                    pa.array([sum(a["tokens"] for a in v.attachments) for _, v in done], pa.int64()),
                ],
                ["conv_id", "turn", "role", "formatted", "loss", "attachments", "expanded_tokens"],
            )

    return own.mapInArrow(run, _OUT)


def read_back(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, expanded_tokens) of each conversation, from the formatted turns alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"]
        conv, state, out = None, None, []

        def end():
            n, turns, chars, loss, size, more = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, more))

        for batch in slices(batches):
            for conv_id, formatted_, spans, more in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv_id != conv:
                    if state:
                        end()
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, parts in parse(formatted_):
                    text = "".join(t for kind, t in parts if kind == "text")
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[0] += 1
                for s in spans:
                    learnt = unescape(formatted_[s["start"] : s["end"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted_)
                state[5] += more
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DIGEST)], names)
                out = []
        if state:
            end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DIGEST)], names)

    text = F.substring_index("formatted", SAYS, -1)
    order = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), text)
    return order.select("conv_id", "formatted", "loss", "expanded_tokens").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long")


_DIGEST = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
