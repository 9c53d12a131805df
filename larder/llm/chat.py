"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, message, part, seq, kind, role, body): ``start`` opens a message, ``delta`` appends to it,
``edit`` replaces its text, ``regenerate`` empties it for a new stream, ``remove`` takes it back. ``message`` orders the
messages of a conversation, ``part`` tells apart messages of one number. Logs are partitioned by
conversation and message and sorted by sequence; a task folds one message at a time, so that a conversation with very many
turns is spread over tasks and only a single message's text is held.

Messages are rendered as segments, one row per turn, which concatenated in order are the training text:

    <turn ROLE>\\nTEXT</turn>\\n

In role and text a backslash and ``<`` are written with a backslash before them, so nothing in a text can be taken for a
mark, and reading back is exact. The loss mask of a segment is the span of code points of an assistant's text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.columns import in_small_batches, load, needs, tidy
from larder.llm.registered import query
from larder.session import written

_MARKED = re.compile(r"[\\<]")
_WRITTEN = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)

_KEY = ("conv_id", "message", "part")
_EVENT = (*_KEY, "seq", "kind", "role", "body")
_LONG, _TEXT = pa.int64(), pa.string()
_MESSAGE = {"conv_id": _LONG, "message": _LONG, "part": _LONG, "role": _TEXT, "text": _TEXT}
_RENDERED = {"conv_id": _LONG, "message": _LONG, "part": _LONG, "segment": _TEXT, "loss_start": _LONG, "loss_end": _LONG}
_DIGEST = {"conv_id": _LONG, "n_turns": _LONG, "turns_sha256": _TEXT, "loss_chars": _LONG, "loss_sha256": _TEXT, "formatted_chars": _LONG}


def escape(text: str) -> str:
    return _MARKED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _WRITTEN.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment of a turn and the span of its text that the loss covers (0, 0 unless an assistant speaks)."""
    # ``>`` ends the role's mark; inside a role it is written as an escape of its own.
    head = f"<turn {escape(role).replace('>', chr(92) + '>')}>\n"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}</turn>\n", *span


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn; anything that is not exactly one segment is an error."""
    found = _SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError("not a rendered turn")
    return unescape(found[1]), unescape(found[2])


def _ddl(fields: dict) -> str:
    return ", ".join(f"{name} {'long' if kind == _LONG else 'string'}" for name, kind in fields.items())


def _batch(rows: list[tuple], fields: dict) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, fields.values())], names=list(fields))


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events sorted by all their columns become one row per message that is left; an event like the one before it is a repeat."""
    done: list[tuple] = []
    key, role, parts, live, before = None, "", [], False, None

    def close():
        if live:
            done.append((*key, role, "".join(parts)))

    for batch in batches:
        for event in _rows(batch, *_EVENT):
            if event == before:
                continue
            before = event
            *at, _, kind, by, body = event
            if at != key:
                close()
                key, role, parts, live = at, "", [], False
            if kind == "start":
                role, parts, live = by or "", [], True
            elif kind == "delta":
                parts.append(body or "")
            elif kind == "edit":
                parts = [body or ""]
            elif kind == "regenerate":
                parts = []
            elif kind == "remove":
                live = False
            else:
                raise ValueError(f"unknown event {kind!r}")
        yield _batch(done, _MESSAGE)
        done = []
    close()
    yield _batch(done, _MESSAGE)


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, part, role, text): what each message of the log says in the end.

    Events of a message count in the order of seq (ties: kind, role, body). Deltas before a start, and messages without one,
    are left out; a null role, body or text is empty. A null conversation or message number is a number of its own, before
    all others. An event delivered twice under its seq counts once.
    """
    needs(events, *_EVENT)
    ordered = events.select(*_EVENT).repartition(*_KEY).sortWithinPartitions(*_EVENT)
    return in_small_batches(ordered).mapInArrow(tidy(_fold), _ddl(_MESSAGE))


def format_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, message, part, segment, loss_start, loss_end): each message rendered; concatenate by message, part."""
    needs(messages, *_MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*at, *render(role or "", text or "")) for *at, role, text in _rows(batch, *_MESSAGE)]
            yield _batch(rows, _RENDERED)

    return in_small_batches(messages.select(*_MESSAGE)).mapInArrow(tidy(run), _ddl(_RENDERED))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by conversation and message, read back one at a time into running digests."""
    done: list[tuple] = []
    key, open_, turns, loss, sums = None, False, None, None, [0, 0, 0]

    def close():
        if open_:
            done.append((key, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2]))

    for batch in batches:
        for conv, segment, start, end in _rows(batch, "conv_id", "segment", "loss_start", "loss_end"):
            if conv != key or not open_:
                close()
                key, open_, turns, loss, sums = conv, True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            role, text = read_segment(segment)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(segment[start:end])
            loss.update(masked.encode("utf-8", "surrogatepass"))
            sums[0] += 1
            sums[1] += len(masked)
            sums[2] += len(segment)
        yield _batch(done, _DIGEST)
        done = []
    close()
    yield _batch(done, _DIGEST)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from rendered segments: number of turns and digests of turns and loss text.

    A conversation's segments pass one after another through running digests (a sum over a text in order cannot be cut), so
    only one segment is held however long the conversation is.
    """
    needs(formatted, *_RENDERED)
    ordered = formatted.select(*_RENDERED).repartition("conv_id").sortWithinPartitions(*_KEY)
    return in_small_batches(ordered).mapInArrow(tidy(_digest), _ddl(_DIGEST))


def conversations_as_log(turns: DataFrame, piece: int = 120) -> DataFrame:
    """The event log that leads to ``turns`` (conv_id, turn, role, text), for tables that hold only final turns.

    An assistant's turn is streamed, dropped half way, regenerated and streamed again in pieces; a user's turn is first
    posted without its last character and then edited; any other turn is posted at once. Rows that repeat a turn
    number are taken as turns of their own, in the order of role and text.
    """
    text, size = F.coalesce("text", F.lit("")), F.lit(piece)
    event = lambda kind, body=F.lit(None), role=F.lit(None): F.struct(
        F.lit(kind).alias("kind"), role.cast("string").alias("role"), body.cast("string").alias("body")
    )
    start = F.array(event("start", role=F.col("role")))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(text) - 1, F.lit(0)) / size).cast("int"))
    pieces = F.transform(starts, lambda i: event("delta", F.substring(text, i * size + 1, size)))
    half = F.slice(pieces, 1, F.greatest(F.floor(F.size(pieces) / 2).cast("int"), F.lit(1)))
    shorter = F.array(event("delta", F.left(text, F.greatest(F.char_length(text) - 1, F.lit(0)))))
    log = (
        F.when(F.col("role") == "assistant", F.concat(start, half, F.array(event("regenerate")), pieces))
        .when(F.col("role") == "user", F.concat(start, shorter, F.array(event("edit", text))))
        .otherwise(F.concat(start, F.array(event("delta", text))))
    )
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    numbered = turns.select("conv_id", F.col("turn").alias("message"), (F.row_number().over(same) - 1).cast("long").alias("part"), "role", "text")
    return numbered.select(*_KEY, F.posexplode(log).alias("seq", "e")).select(
        *_KEY, F.col("seq").cast("long"), "e.kind", "e.role", "e.body"
    )


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(16 + length(role) + length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<', '')))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op8_chat_format", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    log = conversations_as_log(turns)
    formatted = written(format_messages(final_messages(log)), "formatted")
    return conversation_digests(formatted)
