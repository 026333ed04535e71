"""Tables in the folder that driver and executors share, and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at most (a longer document is a pass of its own).
SLICE_BYTES = 2 << 20

#: Bytes of an Arrow batch that goes to Python at most, one row at least.
BATCH_BYTES = 4 << 20

_fallback: dict[str, str] = {}


def lean(spark: SparkSession) -> SparkSession:
    """Lowers the session's Arrow batch size to BATCH_BYTES: texts differ in length a thousandfold, and rows are no measure of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without that setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        _fallback[key] = "file://" + tempfile.mkdtemp(prefix="sluice-")
    return _fallback[key]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sluice-{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a written table: later reads don't repeat its work, and survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    for paths in _tracked:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_tracked: list[list[str]] = []
_ends: list[list[Callable[[], None]]] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go when it ends, however it ends; a result is written with keep_written.

    Inside, Spark deletes a query's shuffle files when the query is done. May be nested.
    """
    paths: list[str] = []
    ends: list[Callable[[], None]] = []
    before = spark.conf.get(_FREE)
    _tracked.append(paths)
    _ends.append(ends)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)
        _tracked.remove(paths)
        _ends.remove(ends)
        for end in ends:
            end()
        for path in paths:
            remove(spark, path)


def at_end(f: Callable[[], None]) -> None:
    """f is called when the scratch around this ends."""
    if _ends:
        _ends[-1].append(f)


def keep_written(df: DataFrame, what: str) -> DataFrame:
    """As written, for what outlives the scratch it is made in; it goes with the scratch around that, if there is one."""
    path = new_path(df.sparkSession, what)
    for paths in _tracked[:-1]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_frame(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the text as UTF-8 bytes, nothing else of docs."""
    lean(docs.sparkSession)
    return docs.select(*columns, F.col("text").cast("binary").alias("text"))


def binary_views(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a binary Arrow column, without copying; nulls are empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    kind = np.int64 if wide else np.int32
    if len(arr) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(arr.buffers()[1], kind, len(arr) + 1, arr.offset * kind().itemsize).astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in runs of rows whose texts have about `limit` bytes, with offsets and bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, raw = binary_views(batch.column(batch.schema.get_field_index("text")))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), offsets[at : to + 1] - offsets[at], raw[offsets[at] : offsets[to]]
            at = to


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system at a task's end: a worker outlives its task, and its executor's JVM shares the machine's memory with it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def ints(column) -> np.ndarray:
    """An int64 column that has no nulls."""
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.int64)
