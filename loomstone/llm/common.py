"""Shared helpers: table access, the shared folder, and byte-bounded Arrow slices."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class that the contracts name.
SPACE = "\x20\x09-\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one made here if it is unset (tests)."""
    sc = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="loomstone-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return shared_dir(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomstone/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``materialise`` wrote and that no plan needs any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "stored_at", None)):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of at most 512 rows and 4 MB, so that a Python worker's memory doesn't grow with the table.

    Both limits are session settings read when the plan runs.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 512:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def lean(batches):
        pool = pa.default_memory_pool()
        for i, out in enumerate(run(batches)):
            yield out
            if i % 16 == 15:
                pool.release_unused()

    return df.mapInArrow(lean, schema)


def lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece holds at most max_bytes of the column, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column, "")
    if column.offset:
        column = pa.concat_arrays([column])
    if column.offset:
        column = pa.array(column.to_pylist(), column.type)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[: len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_sample(keys: str | tuple[str, ...], bound: int, rows: int):
    """About ``bound`` of ``rows`` rows (all if there are fewer), by the hash of their keys: the same rows in every run.

    Rows alike in all keys are in or out together, so the bound is one of distinct rows.
    """
    cut = min((1 << 63) - 1, int(min(1.0, bound / max(1, rows)) * (1 << 63)))
    return F.shiftrightunsigned(F.xxhash64(*([keys] if isinstance(keys, str) else keys)), 1) <= F.lit(cut)


def count_floor(counts: DataFrame, column: str, bound: int) -> int:
    """The least c, a power of two, such that at most ``bound`` rows have a count of c or more; 1 if all may stay."""
    room, floor = bound, 1 << 62
    for row in sorted(counts.groupBy(F.floor(F.log2(column)).alias("power")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r.power):  # 63 rows
        room -= row.rows
        if room < 0:
            return floor
        floor = 1 << row.power
    return 1


def keep_rows(documents: DataFrame, test) -> DataFrame:
    """Rows of documents, columns as they are, for which test(ids, texts), a maker of one bool a row, holds.

    ``test`` is made once a task by calling it without arguments.
    """
    plain = documents.select(F.col("doc_id"), F.col("text"), *[F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = test()
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(check(batch.column(0).to_pylist(), batch.column(1).to_pylist()), pa.bool_()))

    return map_arrow(plain, run, plain.schema).select(documents.columns)
