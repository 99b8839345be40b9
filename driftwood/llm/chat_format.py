"""Chat formatting by a finite-state machine and a declarative template.

Roles are the states of the machine: each turn is valid if its role may follow
the role before. Every turn is written as three segments, a header, the text and
a footer; only the text of the template's loss roles is under the loss mask.
Control strings inside texts and roles are broken by an escape sign that can be
taken out again, so that a reader of the output finds exactly the turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.sources.workspace import shipped

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles follow which ('' is the start), and whose text has loss."""

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    end: str = "<|end|>\n"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(x.rstrip("\n") for x in (self.turn, self.says, self.end)) + self.reserved


def escaped(text: Column, template: Template) -> Column:
    """No control string is left; a lone escape sign is one that was put in."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for x in template.controls:
        out = F.replace(out, F.lit(x), F.lit(x[0] + ESCAPE + x[1:]))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def chat_segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """The segments of every turn, in order.

    conversations: conv_id bigint, turn bigint, role, text; other columns are
    ignored. Returns conv_id, turn_no (from 1; by turn, then role, then text;
    nulls first), seg (1 header, 2 text, 3 footer), text, loss, and valid (its
    turn's role may follow the one before). A null role or text is ''; rows with
    a null conv_id are one conversation. Repeated rows are turns of their own. An
    empty table gives none, and a long conversation streams through one task.
    """
    t = template or Template()
    blank = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text")).repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.lag("role").over(order), F.lit(""))
    pairs = [f"{a}\n{b}" for a, all_b in t.follows.items() for b in all_b]
    rows = rows.select("conv_id", F.row_number().over(order).cast("long").alias("turn_no"), "role", "text", F.concat(before, F.lit("\n"), F.col("role")).isin(pairs).alias("valid"))
    header = F.concat(F.lit(t.turn), escaped(F.col("role"), t), F.lit(t.says))
    segment = lambda n, text, loss: F.struct(F.lit(n).alias("seg"), text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.array(segment(1, header, no), segment(2, escaped(F.col("text"), t), F.col("role").isin(list(t.loss))), segment(3, F.lit(t.end), no))
    return rows.select("conv_id", "turn_no", "valid", F.inline(segments)).select("conv_id", "turn_no", "seg", "text", "loss", "valid")


def _digested(template: Template):
    turn = re.compile(re.escape(template.turn) + "(.*?)" + re.escape(template.says) + "(.*?)" + re.escape(template.end), re.DOTALL)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    class Reader:
        """Reads one conversation's segments as they come."""

        def __init__(self) -> None:
            self.rest, self.turns, self.loss, self.n, self.loss_n, self.chars, self.valid = "", hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True

        def feed(self, text: str, loss: bool, valid: bool) -> None:
            self.chars += len(text)
            self.valid &= valid
            if loss:
                plain = unescaped(text)
                self.loss.update(plain.encode())
                self.loss_n += len(plain)
            self.rest += text
            if self.rest.endswith(template.end):
                while m := turn.match(self.rest):
                    self.turns.update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                    self.n += 1
                    self.rest = self.rest[m.end() :]

        def row(self, conv: int | None) -> tuple:
            return conv, self.n, self.turns.hexdigest(), self.loss_n, self.loss.hexdigest(), self.chars, self.valid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for batch in batches:
            done = []
            for conv, text, loss, valid in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "text", "loss", "valid")), strict=True):
                if reader is None or conv != now:
                    if reader:
                        done.append(reader.row(now))
                    now, reader = conv, Reader()
                reader.feed(text, loss, valid)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
        if reader:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(reader.row(now), types, strict=True)], names)

    return run


def chat_digests(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """What a reader of the formatted output finds, per conversation; segments stream by in order."""
    rows = shipped(segments).repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "seg").select("conv_id", "text", "loss", "valid")
    return rows.mapInArrow(_digested(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
