"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are its context, and only
its own text is trainable.  The examples of a conversation are prefixes of one formatted
stream, so they are kept as that stream's segments, one per turn, with the example that a
segment closes and the span under its loss mask; `render_examples` writes any of them out
as a text of its own.  That keeps the output in proportion to the input even where one
conversation holds a third of all turns.  Segments are numbered in ranges of turns, so such a
conversation is spread over tasks; `read_back` reads every example through its prefix and mask,
and a digest over all of a conversation's text, which cannot be split, takes one task for it.

Template: `<|role|>\\n`, the escaped text, `<|end|>\\n`.  In texts and roles a backslash is
written `\\\\`, and `<|` is written `<\\|`; both are undone on reading.

Defined results: null text is empty, a null role is an empty role; turns go by turn number,
ties by role and text; a conversation without assistant turns has segments and no
example; repeated rows are turns of their own; columns besides conv_id, turn, role and text
are ignored.  A null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import staged

#: Fixed values of the template.
OPEN, CLOSE_ROLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def expand_prefix_targets(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per turn: conv_id, segment, text, example, start, loss_start, loss_end.

    Offsets are code points of the conversation's stream, which is its segments' texts
    joined in order.  Example e of a conversation is the stream up to the end of the segment
    with that number; its mask is [loss_start, loss_end).
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("|>"), F.lit("|\\>"))
    head = F.concat(F.lit(OPEN), role, F.lit(CLOSE_ROLE))
    body = escaped(F.coalesce("text", F.lit("")))
    formatted = turns.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(head, body, F.lit(END)).alias("text"),
        F.char_length(head).cast("bigint").alias("head_chars"),
        F.char_length(body).cast("bigint").alias("body_chars"),
    )
    # Equal segments of one conversation, role and turn are interchangeable, so this order is total.
    order = ["conv_id", "turn", "role", "text"]
    ordered = formatted.repartitionByRange(*order[:3], F.left("text", F.lit(64))).sortWithinPartitions(*order)
    own = "segment bigint, example bigint, start bigint, trained boolean, part int"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers a range's turns by conversation, as if the range began there; keeps three numbers of one at a time."""
        part = TaskContext.get().partitionId()
        conv, segment, example, start = object(), 0, 0, 0
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, segment, example, start = c, 0, 0, 0
                trained = role == trained_role
                out.append((segment, example, start, trained, part))
                segment, example, start = segment + 1, example + trained, start + len(text)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
                numbers = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                kept = ["conv_id", "text", "head_chars", "body_chars"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *numbers], names=kept + [x.split()[0] for x in own.split(", ")])

    rows = staged(ordered.mapInArrow(number, f"conv_id bigint, text string, head_chars bigint, body_chars bigint, {own}"), "turns")
    # What a conversation has in the ranges before; only the first conversation of a range has any, so these are fewer rows than tasks.
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum(F.col("trained").cast("bigint")).alias("m"), F.sum(F.char_length("text")).cast("bigint").alias("chars"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("of"), F.col("part").alias("in"), *(F.sum(c).over(before).alias(f"{c}_before") for c in ("n", "m", "chars"))).where("n_before is not null")
    rows = rows.join(F.broadcast(parts), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")), "left")
    start = F.col("start") + F.coalesce("chars_before", F.lit(0))
    lo = F.when(F.col("trained"), start + F.col("head_chars"))
    return rows.select(
        "conv_id",
        (F.col("segment") + F.coalesce("n_before", F.lit(0))).alias("segment"),
        "text",
        F.when(F.col("trained"), F.col("example") + F.coalesce("m_before", F.lit(0))).alias("example"),
        start.alias("start"),
        lo.alias("loss_start"),
        (lo + F.col("body_chars")).alias("loss_end"),
    )


def render_examples(segments: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: the examples as texts of their own.

    A conversation of n turns has up to n examples of up to n turns: the caller picks the
    examples (by filtering on `example`) whose prefixes are to be written out.
    """
    targets = segments.where("example is not null").select("conv_id", "example", F.col("segment").alias("last"), "loss_start", "loss_end")
    context = segments.select("conv_id", "segment", "text")
    joined = targets.join(context, "conv_id").where("segment <= last")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"])
    return joined.groupBy("conv_id", "example", "loss_start", "loss_end").agg(F.array_join(parts, "").alias("text"))


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, from its examples: each is the stream up to its end, with its mask.

    `examples_sha256` is over the lines `example:end:loss_start:loss_end:sha256 of the example's text`.
    """
    digests = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint, rendered_chars bigint, examples_sha256 string"
    names = [x.split()[0] for x in digests.split(", ")]

    @dataclass
    class Read:
        """What has been read of one conversation."""

        turns: object = field(default_factory=hashlib.sha256)
        loss: object = field(default_factory=hashlib.sha256)
        stream: object = field(default_factory=hashlib.sha256)
        examples: object = field(default_factory=hashlib.sha256)
        n_turns: int = 0
        loss_chars: int = 0
        chars: int = 0
        n_examples: int = 0
        rendered: int = 0

        def segment(self, text: str, start: int) -> None:
            if self.chars != start or not (text.startswith(OPEN) and text.endswith(END)):
                raise ValueError("a segment does not follow the one before it")
            role, body = text[len(OPEN) : -len(END)].split(CLOSE_ROLE, 1)
            self.n_turns += 1
            self.turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
            self.stream.update(text.encode("utf-8", "surrogatepass"))
            self.chars += len(text)

        def example(self, number: int, last: str, start: int, lo: int, hi: int) -> None:
            """An example that ends with the segment read last: all of the stream so far, of which [lo, hi) is trained on."""
            if number != self.n_examples or hi + len(END) != self.chars or lo < start:
                raise ValueError("an example does not end with its reply")
            target = unescape(last[lo - start : hi - start])
            self.loss.update(target.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(target)
            self.examples.update(f"{number}:{self.chars}:{lo}:{hi}:{self.stream.copy().hexdigest()}\n".encode())
            self.n_examples += 1
            self.rendered += self.chars

        def row(self, conv: int | None) -> tuple:
            return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_examples, self.rendered, self.examples.hexdigest()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, read, done = None, None, []
        for batch in batches:
            for c, text, example, start, lo, hi in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "example", "start", "loss_start", "loss_end"))):
                if read is None or c != conv:
                    if read is not None:
                        done.append(read.row(conv))
                    conv, read = c, Read()
                read.segment(text, start)
                if example is not None:
                    read.example(example, text, start, lo, hi)
            if len(done) >= 1000:
                yield _rows(done, names)
                done = []
        if read is not None:
            done.append(read.row(conv))
        if done:
            yield _rows(done, names)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(digest, digests)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)
