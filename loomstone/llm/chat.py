r"""Chat formatting by columnar byte assembly, with a loss mask, and its reader.

A turn becomes ``### role:\n``, its text and ``</turn>\n``. Inside roles and texts ``\``, ``#`` and ``<`` (and ``:`` in roles) get a
``\`` before them, so no control string can come from a text and every text is read back exactly. The loss mask
covers the escaped text of assistant turns.

All turns of a batch are assembled together: segment lengths give cumulative offsets, numpy scatters header, text and
end bytes into one preallocated Arrow buffer, and the conversations' string column is a view of it.
Conversations are dealt by conv_id and sorted by turn. One that grows beyond ``fragment_bytes`` is given as several
fragments in order, so memory stays bounded whatever a conversation's size.

Edge cases: null role or text is empty; equal turns follow by role and text; null conv_id is a conversation of its own;
a conversation without assistant text has an empty mask; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lengths, map_arrow, table, text_bytes

HEAD, MID, END = "### ", ":\n", "</turn>\n"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+):\n([^\\<]*+(?:\\.[^\\<]*+)*+)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
FORMATTED = "conv_id long, fragment int, n_turns long, formatted string, loss array<struct<start:long,length:long>>"


def escape(column: pa.Array, signs: str = "#<") -> pa.Array:
    column = pc.replace_substring(pc.fill_null(column, ""), "\\", "\\\\")
    for s in signs:
        column = pc.replace_substring(column, s, "\\" + s)
    return column


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def assemble(batch: pa.RecordBatch, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The formatted strings and loss spans (code points) of the groups of rows that start at ``first``."""
    n = batch.num_rows
    roles = pc.binary_join_element_wise(HEAD, escape(batch.column(2), "#<:"), MID, "")
    parts = [text_bytes(roles), text_bytes(escape(batch.column(3)))]
    end = np.frombuffer(END.encode(), np.uint8)
    sizes = np.stack([np.diff(parts[0][1]), np.diff(parts[1][1]), np.full(n, len(end))], 1)
    offsets = np.concatenate([[0], np.cumsum(sizes.ravel())])
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for k, (raw, off) in enumerate(parts):
        at = offsets[k:-1:3]
        out[np.arange(len(raw)) + np.repeat(at - off[:-1], np.diff(off))] = raw
    out[(offsets[2:-1:3][:, None] + np.arange(len(end))).ravel()] = np.tile(end, n)
    bounds = np.append(offsets[:-1:3][first], offsets[-1])
    strings = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32)), buffer)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    speaks = np.flatnonzero(pc.fill_null(pc.equal(batch.column(2), "assistant"), False).to_numpy(zero_copy_only=False))
    group = np.searchsorted(first, speaks, side="right") - 1
    a, b = points[offsets[1::3][speaks]], points[offsets[2::3][speaks]]
    spans = pa.StructArray.from_arrays([pa.array(a - points[bounds[group]]), pa.array(b - a)], names=["start", "length"])
    return strings, pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(len(first) + 1)).astype(np.int32)), spans)


def format_chat(conversations: DataFrame, fragment_bytes: int = 8 << 20) -> DataFrame:
    """(conv_id, fragment, n_turns, formatted, loss), the fragments of a conversation in order within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current, fragment = object(), 0

        def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal current, fragment
            ids = batch.column(0).to_pylist()
            first = np.array([i for i, c in enumerate(ids) if not i or c != ids[i - 1]], np.int64)
            strings, loss = assemble(batch, first)
            numbers = [0] * len(first)
            numbers[0] = fragment + 1 if ids[0] == current else 0
            current, fragment = ids[-1], numbers[-1]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(numbers, pa.int32()), pa.array(np.diff(np.append(first, batch.num_rows))), strings, loss], names=["conv_id", "fragment", "n_turns", "formatted", "loss"])

        def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for batch in batches:
            start, ends = 0, np.cumsum(lengths(batch.column(3)) + lengths(batch.column(2)) + 32)
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + fragment_bytes // 2, side="right")))
                piece, start = batch.slice(start, stop - start), stop
                whole = joined([*held, piece])
                ids = whole.column(0).to_pylist()
                cut = next((i for i in range(len(ids) - 1, 0, -1) if ids[i - 1] != ids[-1]), 0)
                if cut:
                    yield flush(whole.slice(0, cut))
                held = [whole.slice(cut)]
                if held[0].nbytes > 4 * fragment_bytes or lengths(held[0].column(3)).sum() > fragment_bytes:
                    yield flush(held.pop())
        if held:
            yield flush(joined(held))

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return map_arrow(turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), run, FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; fails on a string that the template can't have made."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation at {at}")
    return out


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back; takes format_chat's rows as they come, a conversation's fragments in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def rows(states: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in states], pa.int64()), pa.array([s[1] for s in states], pa.int64()), pa.array([s[2].hexdigest() for s in states]), pa.array([s[3] for s in states], pa.int64()), pa.array([s[4].hexdigest() for s in states]), pa.array([s[5] for s in states], pa.int64())], names=names)

        for batch in batches:
            ready = []
            for conv, text, loss in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        ready.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["start"] + span["length"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if ready:
                yield rows(ready)
        if state is not None:
            yield rows([state])

    return map_arrow(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digest_formatted(format_chat(conversations.unionByName(probe)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + 2 * 0 + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
  + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) + 14 AS f FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(f) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace(" + 2 * 0", "")
