"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and only
its reply is trainable. The formatted conversation is stored once, as segments, one for each
turn; an example is a prefix of it, its context, told by length and SHA-256, with its reply as the
only trainable part, so that a conversation of n turns takes space in proportion to n and not to its
square. :func:`examples` explodes the assistant turns; :func:`example_texts` writes out the texts of those
that are asked for; :func:`digests` reads examples back against the segments and fails where
a context is not what precedes its reply.

Template: a user turn is ``<s>[INST] text [/INST]``, an assistant turn ``<s> text </s>``, a turn
of any other role ``<s><<ROLE>> role <</ROLE>> text </s>``. A control string inside a role or
text gets one backslash before it, after those that already stand there; one is taken away when
it is read back. No template mark has a backslash before it, so marks and texts cannot be taken
for each other.

Rows of a conversation are ordered by turn, then role, then text, so ties have a defined order.
Null roles and texts are empty; a null conversation id is a conversation like any other; rows that
repeat a turn are turns of their own; an empty table gives empty results; further columns are not
looked at. One sorted pass streams the turns, so a conversation of any length takes constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

START, END, USER, USER_END, ROLE, ROLE_END = "<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>"
CONTROL = (START, END, USER, USER_END, ROLE, ROLE_END)
_ANY = "|".join(map(re.escape, CONTROL))
_ESCAPE, _UNESCAPE = re.compile(rf"(\\*)({_ANY})"), re.compile(rf"\\(\\*(?:{_ANY}))")
_TURN = re.compile(rf"{re.escape(START)}(?:(?P<user>{re.escape(USER)} (?P<asked>.*) {re.escape(USER_END)})|(?:{re.escape(ROLE)} (?P<role>.*?) {re.escape(ROLE_END)})? (?P<said>.*) {re.escape(END)})", re.DOTALL)

SEGMENTS = "conv_id long, seq long, role string, segment string, start long, end long, loss_start long, loss_end long, example long, context_sha256 string"


def escaped(text: str) -> str:
    """The text with one more backslash before every control string."""
    return _ESCAPE.sub(r"\\\1\2", text)


def unescaped(text: str) -> str:
    """The inverse of :func:`escaped`."""
    return _UNESCAPE.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and the span of its text within the segment."""
    body = escaped(text)
    if role == "user":
        head, tail = f"{START}{USER} ", f" {USER_END}"
    elif role == "assistant":
        head, tail = f"{START} ", f" {END}"
    else:
        head, tail = f"{START}{ROLE} {escaped(role)} {ROLE_END} ", f" {END}"
    return head + body + tail, len(head), len(head) + len(body)


def parsed(segment: str) -> tuple[str, str]:
    """The role and text that a segment was made from."""
    m = _TURN.fullmatch(segment)
    if m is None:
        raise ValueError("not a formatted turn")
    if m["user"] is not None:
        return "user", unescaped(m["asked"])
    return ("assistant" if m["role"] is None else unescaped(m["role"])), unescaped(m["said"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, seq, at, example, so_far = object(), 0, 0, 0, hashlib.sha256()
    for batch in batches:
        rows: list[tuple] = []
        for conv_id, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if conv_id != conv:
                conv, seq, at, example, so_far = conv_id, 0, 0, 0, hashlib.sha256()
            segment, first, last = formatted(role, text)
            target = role == "assistant"
            so_far.update(segment[:first].encode("utf-8", "surrogatepass"))
            context = so_far.hexdigest() if target else None
            so_far.update(segment[first:].encode("utf-8", "surrogatepass"))
            rows.append((conv_id, seq, role, segment, at, at + len(segment), at + first if target else None, at + last if target else None, example if target else None, context))
            seq, at, example = seq + 1, at + len(segment), example + target
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[x.split()[0] for x in SEGMENTS.split(", ")])


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn, in order: its segment, its span, and of an assistant turn the trainable span and its number as an example."""
    rows = turns.select(turns[conv_col].cast("long").alias("conv_id"), turns[turn_col].cast("long").alias("turn"), F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"))
    order = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return order.mapInArrow(_segments, SEGMENTS)


def examples(formatted_turns: DataFrame) -> DataFrame:
    """One row for each assistant turn, an example of its own.

    Its context is the first ``loss_start`` characters of its conversation, whose SHA-256 is ``context_sha256``;
    ``reply`` is the formatted reply, all that is trainable; the example ends at ``end``.
    """
    reply = F.substring("segment", (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return formatted_turns.where("example is not null").select("conv_id", "example", "seq", "loss_start", "loss_end", "end", "context_sha256", reply.alias("reply"))


def example_texts(formatted_turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full texts of the wanted examples (conv_id, example): conv_id, example, text, loss_start, loss_end.

    The output has the size of its contexts, which for every example of a conversation grows with the square of its turns.
    """
    chosen = examples(formatted_turns).join(wanted.select("conv_id", "example"), ["conv_id", "example"], "left_semi").withColumnRenamed("seq", "last")
    parts = formatted_turns.select("conv_id", "seq", "segment")
    joined = chosen.join(parts, "conv_id").where(F.col("seq") <= F.col("last"))
    texts = joined.groupBy("conv_id", "example").agg(F.first("loss_start").alias("loss_start"), F.first("loss_end").alias("loss_end"), F.array_sort(F.collect_list(F.struct("seq", "segment"))).alias("parts"))
    return texts.select("conv_id", "example", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("text"), "loss_start", "loss_end")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


class ExampleError(ValueError):
    """An example that does not fit its conversation."""


class _Conversation:
    """A conversation as it is read back, turn by turn, each turn followed by the example that it is the reply of."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.examples, self.loss_chars = conv_id, 0, 0, 0, 0
        self.said, self.loss, self.so_far = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.segment, self.begun = "", self.so_far.copy()

    def turn(self, segment: str) -> None:
        role, text = parsed(segment)
        self.said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.segment, self.begun = segment, self.so_far.copy()
        self.so_far.update(segment.encode("utf-8", "surrogatepass"))
        self.turns, self.chars = self.turns + 1, self.chars + len(segment)

    def example(self, number: int, start: int, end: int, context: str, reply: str) -> None:
        at = start - (self.chars - len(self.segment))
        self.begun.update(self.segment[: max(at, 0)].encode("utf-8", "surrogatepass"))
        if at < 0 or self.begun.hexdigest() != context or self.segment[at : at + len(reply)] != reply or end - start != len(reply) or number != self.examples:
            raise ExampleError(f"example {number} of conversation {self.conv_id} does not follow its context")
        text = unescaped(reply)
        self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.loss_chars, self.examples = self.loss_chars + len(text), self.examples + 1

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.examples


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: _Conversation | None = None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names=[x.split()[0] for x in DIGESTS.split(", ")])
        done.clear()
        return batch

    for batch in batches:
        for conv_id, number, text, start, end, context in zip(*(batch[c].to_pylist() for c in ("conv_id", "example", "said", "loss_start", "loss_end", "context_sha256")), strict=True):
            if current is None or current.conv_id != conv_id:
                done += [current.row()] if current else []
                current = _Conversation(conv_id)
            if number is None:
                current.turn(text)
            else:
                current.example(number, start, end, context, text)
        if done:
            yield out()
    if current is not None:
        done.append(current.row())
        yield out()


def digests(formatted_turns: DataFrame, found: DataFrame) -> DataFrame:
    """What the formatted turns and their examples say, read back: one row for each conversation.

    ``found`` is of :func:`examples`; the loss columns come from its rows, each held against what precedes it in the segments.
    """
    turns = formatted_turns.select("conv_id", "seq", F.lit(None).cast("long").alias("example"), F.col("segment").alias("said"), F.lit(None).cast("long").alias("loss_start"), F.lit(None).cast("long").alias("loss_end"), F.lit(None).cast("string").alias("context_sha256"))
    both = turns.unionByName(found.select("conv_id", "seq", "example", F.col("reply").alias("said"), "loss_start", "loss_end", "context_sha256"))
    order = both.repartition(shuffle_partitions(both.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq", F.col("example").asc_nulls_first())
    return order.mapInArrow(_digests, DIGESTS)
