"""What the training-data operators share: tables, scratch space and Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where ids are ordered or compared: it comes before all others.
NULL_ID = -(2**63)


def at_workers(spark: SparkSession) -> SparkSession:
    """Python workers find this package where the driver found it, besides what --py-files and PYTHONPATH give them."""
    home, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return at_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if it has fewer partitions than the cluster has cores (a small table in one file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


_made: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _clean() -> None:
    for path, spark in _made.items():
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended first; the files are scratch
            return


atexit.register(_clean)


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{scratch_root(spark)}/tallyforge/{what}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared scratch folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def stored_small(df: DataFrame, what: str) -> DataFrame:
    """stored() for narrow tables: two files for each core, whatever the number of shuffle partitions, are written and read."""
    return stored(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism), what)


def released(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for frames from which nothing will be read again."""
    for frame in frames:
        if (spark := _made.pop(getattr(frame, "_scratch", ""), None)) is not None:
            _remove(spark, frame._scratch)


def doc_key(col: str = "doc_id"):
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary column; nulls are empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of a single longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def binaries(rows: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over the bytes of `rows`; offsets are in bytes."""
    data = np.ascontiguousarray(rows).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def trim() -> None:
    """Memory that is free goes back to the system."""
    if give := _trim():
        give(0)


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work with each batch on its own; what a batch took goes back to the system, as workers outlive their stage."""

    @wraps(work)
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(iter((batch,)))
            del batch
            trim()

    return each


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's values are at most `most` bytes in each, or one longer value."""
    for batch in batches:
        offsets, _ = strings(batch.column(column))
        for i, j in slices(offsets, most):
            yield batch.slice(i, j - i)
