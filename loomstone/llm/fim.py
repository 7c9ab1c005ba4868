"""Fill-in-the-middle rewriting: a whole batch at once on the UTF-8 bytes of its Arrow buffer.

A unit is a run of ASCII letters or any other single code point. Bytes are classed by one table lookup (letter, continuation,
other); a unit starts at each byte that is no continuation and no letter behind a letter of the same text. The running sum of
starts, reset at each text, numbers the units, and one ``searchsorted`` finds the byte at which every text's prefix and middle end.
Outputs are gathered into one preallocated buffer.

Where a text is cut, and whether and how it is rewritten, comes from the SHA-256 of ``seed:doc_id`` and nothing else, so reruns and
repeated ids agree. ``restore`` rebuilds the text with built-in functions; a text that holds a marker is left plain, so no marker is
ambiguous.

Edge cases: null text is empty; an empty text is plain with no units; null doc_id hashes as the empty string; rows that share a doc_id
share draws, not lengths; a very long text is one slice, whose work arrays take about 16 bytes a byte of text; columns named like the new ones are
replaced, others kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
OTHER, LETTER, CONTINUED = 0, 1, 2
CLASSES = np.zeros(256, np.uint8)
CLASSES[[*range(65, 91), *range(97, 123)]] = LETTER
CLASSES[0x80:0xC0] = CONTINUED
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The running count of unit starts over the bytes, and the units before each text (one more entry: all)."""
    kind = CLASSES[raw]
    start = kind != CONTINUED
    inside = np.zeros(len(raw), bool)
    inside[1:] = (kind[1:] == LETTER) & (kind[:-1] == LETTER)
    inside[offsets[:-1][offsets[:-1] < len(raw)]] = False
    count = np.cumsum(start & ~inside, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
    return count, np.concatenate([[0], count]).astype(np.int64)[offsets]


def cut_bytes(count: np.ndarray, before: np.ndarray, offsets: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte at which each text's first ``units`` units end: where the next one starts, or the text's end."""
    at = np.searchsorted(count, (before[:-1] + units + 1).astype(count.dtype))
    return np.minimum(at, offsets[1:])


def gather(raw: np.ndarray, pieces: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray) -> pa.Array:
    """Strings of each row's pieces, byte spans of ``raw`` followed by ``marks``, in order, in one buffer."""
    source = np.concatenate([raw, marks])
    begin, end = (np.stack([p[k] for p in pieces], 1) for k in (0, 1))
    sizes = end - begin
    at = np.concatenate([[0], np.cumsum(sizes.ravel())])
    buffer = pa.allocate_buffer(int(at[-1]))
    out = np.frombuffer(buffer, np.uint8)
    if len(begin) == 1:  # a long text comes alone: no index of its bytes
        for k, (b, e) in enumerate(zip(begin[0], end[0], strict=True)):
            out[at[k] : at[k + 1]] = source[b:e]
    else:
        out[:] = source[np.arange(at[-1]) + np.repeat(begin.ravel() - at[:-1], sizes.ravel())]
    bounds = at[:: len(pieces)]
    if at[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(begin), pa.py_buffer(bounds.astype(np.int32)), buffer)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds.astype(np.int64)), buffer)


def rewrite(texts: pa.Array, draws: np.ndarray, fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """The columns of ``ADDED`` of a batch of texts; draws: four unsigned integers a row."""
    raw, offsets = text_bytes(texts)
    count, before = unit_starts(raw, offsets)
    n = np.diff(before)
    first, second = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    a, b = (cut_bytes(count, before, offsets, f(first, second)) for f in (np.minimum, np.maximum))
    marked = np.zeros(len(n), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
    plain = (np.diff(offsets) == 0) | marked | (draws[:, 2] % 100 >= fim_percent)
    spm = ~plain & (draws[:, 3] % 100 < spm_percent)
    zero, low, high, size = np.zeros(len(n), np.int64), offsets[:-1], offsets[1:], len(raw)
    mark = {m: (np.where(plain, 0, size + k), np.where(plain, 0, size + k + len(m))) for k, m in zip((0, 3, 6), (PREFIX, SUFFIX, MIDDLE), strict=True)}
    swap = lambda x, y: tuple(np.where(spm, q, p) for p, q in zip(x, y, strict=True))
    prefix, suffix, whole = (low, np.where(plain, low, a)), (np.where(plain, high, b), high), (np.where(plain, low, zero), np.where(plain, high, zero))
    middle = (np.where(plain, zero, a), np.where(plain, zero, b))
    pieces = [whole, swap(mark[PREFIX], mark[SUFFIX]), swap(prefix, suffix), swap(mark[SUFFIX], mark[PREFIX]), swap(suffix, prefix), mark[MIDDLE], middle]
    output = gather(raw, pieces, np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=count.dtype)])
    form = pa.array(np.where(plain, PLAIN, np.where(spm, SPM, PSM)).astype(object), pa.string())
    return [pa.array(n), form, pa.array((points[a] - points[low]).astype(np.int64), mask=plain), pa.array((points[b] - points[a]).astype(np.int64), mask=plain), output.cast(pa.string()) if output.nbytes < 1 << 31 else output]


def fill_in_middle(documents: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """The input's columns with n, form, prefix_chars, middle_chars and output added."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = F.array(*[F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])
    added = [part.split()[0] for part in ADDED.split(", ")]
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in (*added, "text")]
    plain = documents.select("text", digest.alias("_digest"), *kept).select("text", draws.alias("_draws"), *kept)
    out = documents.select("text", *kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            drawn = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *rewrite(batch.column(0), drawn, fim_percent, spm_percent)], names=[*out.names, *added])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in out], ADDED])
    names = list(dict.fromkeys([*documents.columns, *added]))
    return map_arrow(plain, run, schema).select(*[f"`{c}`" for c in names])


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form."""

    def part(text: Column, mark: str, k: int) -> Column:
        return F.split_part(text, F.lit(mark), F.lit(k))

    psm_rest, spm_rest = part(output, SUFFIX, 2), part(output, PREFIX, 2)
    psm = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), part(psm_rest, MIDDLE, 2), part(psm_rest, MIDDLE, 1))
    spm = F.concat(part(spm_rest, MIDDLE, 1), part(spm_rest, MIDDLE, 2), part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, [CAST('0x' || substr(x, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS r FROM d),
c AS (SELECT *, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
    WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
