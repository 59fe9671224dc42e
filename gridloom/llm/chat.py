"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role: text</turn>`` and a line end. The rendered turn is parsed again; where the result differs
from the source, control strings in the content are escaped with a backslash, and the parse must then give the source.
A rendered conversation is its turns one after the other: the grammar tells where each ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

OPEN, MIDDLE, CLOSE, ESCAPE = "### ", ": ", "</turn>\n", "\\"
_ROLE = re.compile(r"\\|###|</turn>|: ")
_TEXT = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
ROWS = 2048  # rows that a step holds at once


class GrammarError(ValueError):
    pass


def _content(s: str, at: int, control: re.Pattern, stop: str) -> tuple[str, int]:
    """Unescaped content from ``at`` up to ``stop``, and where the stop ends."""
    out, done = [], at
    while found := control.search(s, at):
        if found[0] == ESCAPE:
            held = control.match(s, found.end())
            if not held:
                raise GrammarError(f"a lone escape at {found.start()}")
            out += [s[done : found.start()], held[0]]
            at = done = held.end()
        elif s.startswith(stop, found.start()):
            return "".join(out) + s[done : found.start()], found.start() + len(stop)
        else:
            raise GrammarError(f"a control string at {found.start()}")
    raise GrammarError("no end")


def parse(s: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a rendered conversation."""
    turns, at = [], 0
    while at < len(s):
        if not s.startswith(OPEN, at):
            raise GrammarError(f"no turn at {at}")
        role, at = _content(s, at + len(OPEN), _ROLE, MIDDLE)
        text, at = _content(s, at, _TEXT, CLOSE)
        turns.append((role, text))
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its content begins and ends."""
    for escape in (False, True):
        r, t = (_ROLE.sub(r"\\\g<0>", role), _TEXT.sub(r"\\\g<0>", text)) if escape else (role, text)
        out = OPEN + r + MIDDLE + t + CLOSE
        try:
            if parse(out) == [(role, text)]:
                start = len(OPEN) + len(r) + len(MIDDLE)
                return out, start, start + len(t)
        except GrammarError:
            continue
    raise GrammarError("no rendering gives the source back")


def unescape(content: str) -> str:
    """Content as it was before it was escaped. What was not escaped holds no control string, so it stays."""
    return _ESCAPED.sub(lambda m: m[1], content)


def formatted(conversations: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """conv_id, nth, chunk, at, loss_from, loss_to: the rendered turns, in order within each conversation.

    The chunks of a conversation, joined by nth, are its formatted text; at is where a chunk begins in it. The loss mask
    covers [loss_from, loss_to) of the formatted text, null for turns that are not learned. Turns follow ``turn`` (null
    first), equal turns role and text; repeated rows stay. Null roles and texts are empty, null conv_ids are one
    conversation. Turns stream in sorted order, so a conversation of any length takes no more memory than its longest turn.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nth, at = object(), 0, 0
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                out: list[tuple] = []
                for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    if conv != last:
                        last, nth, at = conv, 0, 0
                    chunk, a, b = render(role or "", text or "")
                    learned = role == learned_role
                    out.append((nth, chunk, at, at + a if learned else None, at + b if learned else None))
                    nth, at = nth + 1, at + len(chunk)
                n, chunks, starts, a, b = map(list, zip(*out, strict=True))
                longs = [pa.array(x, pa.int64()) for x in (n, starts, a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), longs[0], pa.array(chunks, pa.string()), *longs[1:]], ["conv_id", "nth", "chunk", "at", "loss_from", "loss_to"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, nth bigint, chunk string, at bigint, loss_from bigint, loss_to bigint")


def digests(chunks: DataFrame) -> DataFrame:
    """What the contract asks of each conversation, read back from its chunks as ``formatted`` streams them.

    The turns are parsed from the joined chunks that a batch has of a conversation. The learned text is what the loss mask covers
    of the formatted text, unescaped; the mask is checked to lie within its chunk. Null texts and roles are read back as empty, turns
    that repeat come again, the null id is a conversation as any other, and no chunks give no rows.
    """
    kind = chunks.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        last, state, done = object(), None, []

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def out() -> pa.RecordBatch:
            columns = list(map(list, zip(*done, strict=True)))
            done.clear()
            types = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "at", "loss_from", "loss_to")), strict=True)
            for conv, of in groupby(rows, key=itemgetter(0)):
                if conv != last:
                    close()
                    last, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                chunks = list(of)
                for role, text in parse("".join(c[1] for c in chunks)):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for _, chunk, at, since, until in chunks:
                    if at != state[5] or (since is not None and not at <= since <= until <= at + len(chunk)):
                        raise GrammarError(f"chunk or mask out of place in conversation {conv}")
                    if since is not None:
                        text = unescape(chunk[since - at : until - at])
                        state[3] += len(text)
                        state[4].update(text.encode())
                    state[5] += len(chunk)
            if done:
                yield out()
        close()
        if done:
            yield out()

    return chunks.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


PROBE = "\\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every conversation, and of conversation -7, whose two texts look like control strings."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(formatted(rows.unionByName(probe)))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS text_chars,
    length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '###', ''))) // 3
    + (length(role) - length(replace(role, '</turn>', ''))) // 7 + (length(role) - length(replace(role, ': ', ''))) // 2 AS role_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + role_chars + 2 + text_chars + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
