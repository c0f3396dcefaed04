"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Turns are dealt by conversation and sorted inside each partition; one task streams through its conversations and
emits a row for each segment, so a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestat.llm.common import tidy

BATCH = 256


@dataclass(frozen=True)
class Template:
    """How roles are marked, which turns are trained on, and which role may follow which.

    ``labels``: role -> label; another role r is written as Role(r). ``order``: state -> roles that may come next;
    the state is the last role, or "start". ``controls`` are the strings that texts must not contain: each gets a
    backslash before it, and each backslash is doubled, so that escaping can be undone.
    """

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    trained: frozenset[str] = frozenset({"assistant"})
    order: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "start": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant", "tool"}),
        }
    )
    header: str = "### {label}: "
    close: str = " </turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>", ")")

    def escape(self, text: str) -> str:
        out = text.replace("\\", "\\\\")
        for c in self.controls:
            out = out.replace(c, "\\" + c)
        return out

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def label(self, role: str) -> str:
        return self.labels.get(role) or f"Role({self.escape(role)})"


DEFAULT = Template()


class Reader:
    """Parses formatted output, piece by piece, back to (role, text) turns."""

    def __init__(self, template: Template = DEFAULT):
        self.template, self.buffer = template, ""
        self.roles = {v: k for k, v in template.labels.items()}
        before, after = map(re.escape, template.header.split("{label}"))
        self.turn = re.compile(rf"{before}(Role\((?:\\.|[^\\)])*\)|[^:(]+?){after}((?:\\.|[^\\])*?){re.escape(template.close)}", re.S)

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.buffer += piece
        if not piece.endswith(self.template.close):
            return
        while m := self.turn.match(self.buffer):
            name = m[1]
            role = self.template.unescape(name[5:-1]) if name.startswith("Role(") else self.roles[name]
            yield role, self.template.unescape(m[2])
            self.buffer = self.buffer[m.end() :]


def format_conversations(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, turn, place, segment, loss, valid: the segments of every conversation, in order within a partition.

    place counts a conversation's segments from 0; loss marks trained text; valid says whether the turn order was allowed so far.
    Concatenating a conversation's segments by place gives its formatted text; that is all rows, valid or not.
    Cases: null text and role count as empty; rows without conv_id are one conversation; turns sort by turn (nulls first),
    then role, then text, so that ties and repeated rows have one order (each is a turn); other columns are ignored.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, place, valid = object(), "start", 0, True
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                out = []
                for conv, turn, role, text in zip(*[c.to_pylist() for c in b.slice(lo, BATCH).columns], strict=True):
                    if conv != at:
                        at, state, place, valid = conv, "start", 0, True
                    valid = valid and role in template.order.get(state, ())
                    state = role
                    for segment, loss in (
                        (template.header.format(label=template.label(role)), False),
                        (template.escape(text), role in template.trained),
                        (template.close, False),
                    ):
                        out.append((conv, turn, place, segment, loss, valid))
                        place += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["conv_id", "turn", "place", "segment", "loss", "valid"],
                )

    return dealt.mapInArrow(tidy(run), "conv_id long, turn long, place long, segment string, loss boolean, valid boolean")


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid: parsed from format_conversations' output.

    The turns are parsed from the concatenated text; the loss columns cover the unescaped text under the mask.
    Reads each partition as it is (a conversation's segments lie together and in order).
    """

    class State:
        def __init__(self, conv):
            self.conv, self.reader = conv, Reader(template)
            self.turns, self.n, self.loss, self.loss_chars, self.chars, self.valid = hashlib.sha256(), 0, hashlib.sha256(), 0, 0, True

        def add(self, segment: str, loss: bool, valid: bool) -> None:
            self.chars += len(segment)
            self.valid = valid
            if loss:
                plain = template.unescape(segment)
                self.loss.update(plain.encode())
                self.loss_chars += len(plain)
            for role, text in self.reader.feed(segment):
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n += 1

        def row(self) -> tuple:
            if self.reader.buffer:
                raise ValueError(f"conversation {self.conv}: the formatted text cannot be read back")
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            for conv, segment, loss, valid in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = State(conv)
                now.add(segment, loss, valid)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(now.row(), kinds, strict=True)], names=names)

    return segments.select("conv_id", "segment", "loss", "valid").mapInArrow(
        tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )
