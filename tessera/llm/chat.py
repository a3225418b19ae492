"""Chat formatting from an event log.

A log holds events of conversations: a message starts at a position, streamed deltas add to it, an edit replaces what it says so far,
a regeneration empties it for a new stream, a deletion drops it.  The log is partitioned by conversation and position and sorted by
sequence, so that a long conversation is spread over tasks; one pass folds the events of each message, renders it and lets it go.  Only
then are the messages of a conversation brought together in their order.  A task never holds more than the message at hand.

A turn is rendered as <s>role[INST]text[/INST]</s>, and as <s>role[INST][/INST]text</s> where the text is an answer to
learn from: what stands between [/INST] and </s> is under the loss mask.  A control string inside a role or text gets a
backslash after its first character, one more than it has, which reading back removes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prepare

#: A control string, or what escaping made of one.
CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
ESCAPED = re.compile(r"([<\[])(\\*)\\(/?(?:s>|INST\]))")
TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
#: Kinds of events in the order in which those of equal sequence apply.
KINDS = ("message", "regenerate", "edit", "delta", "delete")
#: Whose texts are learned from.
ANSWERS = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> str:
    """One turn with its marks."""
    middle = f"[/INST]{escape(text)}" if role == ANSWERS else f"{escape(text)}[/INST]"
    return f"<s>{escape(role)}[INST]{middle}</s>"


def read(formatted: str) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn of a formatted text."""
    for role, prompt, answer in TURN.findall(formatted):
        yield unescape(role), unescape(prompt + answer), unescape(answer)


def event_log(messages: DataFrame, piece: int = 400, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages as the log of a chat that led to them: (conv_id, position, message, seq, kind, role, text), in no order.

    Every answer was streamed in deltas of ``piece`` characters; a third of them, by a hash, after a first stream that was broken off and
    regenerated.  Of the other messages a quarter was sent with another text first and then edited.  Every row is a message of its own,
    numbered where it is read, also where rows repeat one another or share a position.
    """
    rows = messages.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("position"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("message", F.monotonically_increasing_id().cast("string")).withColumn("h", F.pmod(F.xxhash64("text", "position"), F.lit(12)))
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    c, none = F.coalesce("text", F.lit("")), F.lit(None)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(c) / piece).cast("int") - 1)), lambda i: event(i + 4, "delta", F.substring(c, i * piece + 1, F.lit(piece))))
    broken = F.array(event(1, "delta", F.reverse(F.substring(c, 1, piece))), event(2, "regenerate", none))
    answer = F.concat(F.array(event(0, "message", none)), F.when(F.col("h") % 3 == 0, broken).otherwise(F.slice(broken, 1, 0)), pieces)
    other = F.when(F.col("h") % 4 == 0, F.array(event(0, "message", F.reverse(F.substring(c, 1, piece))), event(1, "edit", c))).otherwise(F.array(event(0, "message", c)))
    events = F.explode(F.when(F.col("role") == ANSWERS, answer).otherwise(other)).alias("e")
    return rows.select("conv_id", "position", "message", "role", events).select("conv_id", "position", "message", "e.seq", "e.kind", "role", "e.text")


class _Fold:
    """The message at hand."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.role, self.parts, self.live, self.first = "", [], False, None

    def end(self) -> tuple | None:
        """(conv_id, position, first sequence, role, text) of the message, unless it was deleted or never started."""
        return (*self.key[:2], self.first, self.role, "".join(self.parts)) if self.key is not None and self.live else None

    def event(self, key: tuple, seq: int | None, kind: str, role: str | None, text: str | None) -> tuple | None:
        """Apply an event; the message that it ends, if any."""
        done = None
        if key != self.key or kind == "message":
            done = self.end()
            self.key, self.role, self.parts, self.live, self.first = key, role or "", [], False, seq
        if kind == "delete":
            self.parts, self.live = [], False
        else:
            if kind in ("edit", "regenerate"):
                self.parts = []
            if text:
                self.parts.append(text)
            self.role = self.role or role or ""
            self.live = True
        return done


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, position, first, role, text) of each message of a log (conv_id, position, message, seq, kind, role, text); ``first`` is its first sequence.

    Events of one conversation, position and message (null, or no such column: one stream a position) are folded by sequence, kind (as in KINDS), role
    and text, nulls first; a message event starts a message; a delta, edit or regeneration without one does too; null texts and roles
    are empty; unknown kinds count as deltas.
    """
    prepare(log.sparkSession)
    kinds = {c: log.schema[c].dataType.simpleString() for c in ("conv_id", "position", "seq")}
    order: Column = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    message = F.col("message").cast("string") if "message" in log.columns else F.lit(None).cast("string")
    rows = log.select("conv_id", "position", message.alias("message"), "seq", order.alias("k"), "kind", "role", "text")
    keys = ["conv_id", "position", "message"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "k", "role", "text").drop("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, schema = _Fold(), None

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(schema)], names=["conv_id", "position", "first", "role", "text"])

        for batch in batches:
            schema = [*(batch.schema.field(i).type for i in (0, 1, 3)), pa.string(), pa.string()]
            columns = [c.to_pylist() for c in batch.columns]
            done = [fold.event((conv, position, message), seq, kind or "delta", role, text) for conv, position, message, seq, kind, role, text in zip(*columns)]
            yield out([d for d in done if d])
        if last := fold.end():
            yield out([last])

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, position {kinds['position']}, first {kinds['seq']}, role string, text string")


def format_log(log: DataFrame) -> DataFrame:
    """(conv_id, role, formatted) for each message of a log (see ``messages``), in order within partitions.

    All rows of a conversation are in one partition, one after another, by position, first sequence, role and text, nulls first; a null conv_id is
    a conversation of its own.  An empty log gives no rows.
    """
    folded = messages(log)
    id_type = log.schema["conv_id"].dataType.simpleString()
    rows = folded.repartition("conv_id").sortWithinPartitions("conv_id", "position", "first", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            formatted = [render(role, text) for role, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(formatted, pa.string())], names=["conv_id", "role", "formatted"])

    return rows.mapInArrow(run, f"conv_id {id_type}, role string, formatted string")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation what can be read back from format_log()'s rows: counts and hashes of turns and of the text under the loss mask.

    A conversation's hash needs its turns in order, so one task streams it, holding one turn at a time.  Other columns of ``turns`` do not matter; an
    empty table gives no rows.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, id_kind = None, None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            rows = [(c, n, t.hexdigest(), m, x.hexdigest(), f) for c, (n, t, m, x, f) in done]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((id_kind, *kinds))], names=names)

        for batch in batches:
            id_kind, done = batch.schema.field(0).type, []
            for c, formatted in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, state))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, learned in read(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            yield out(done)
        if state is not None:
            yield out([(conv, state)])

    return turns.select("conv_id", "role", "formatted").mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def sample_with_controls(spark: SparkSession, conv_id: int = -1) -> DataFrame:
    """A conversation whose texts look like another template's control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
