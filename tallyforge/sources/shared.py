"""Tables that are published once and read by many queries, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .files import Files

_written: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or '/tmp/checkpoints').rstrip('/')}/tallyforge"


def stamp(spark: SparkSession, tables: list[str]) -> str:
    """A short digest of the path, size and time of every file of the tables: it changes with any of them."""
    files, seen = Files(spark), []
    for path in tables:
        seen += sorted(files.stamps(path))
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:20]


def published(spark: SparkSession, name: str, tables: list[str], make: Callable[[], DataFrame], by: list[str] | None = None, files: int = 1) -> DataFrame:
    """make()'s rows, written at the first call for the tables as they are now and read from then on.

    Two sessions that publish at once write the same rows to folders of their own; one rename wins. by: partition columns.
    files: how many files each of them gets at most; the rows are aggregates.
    """
    store, at = Files(spark), f"{folder(spark)}/published/{spark.sparkContext.applicationId}/{name}-{stamp(spark, tables)}"
    if not store.exists(f"{at}/_SUCCESS"):
        beside = f"{at}.{id(make):x}"
        rows = make()
        rows = rows.repartition(files, *by) if by else rows.coalesce(files)
        rows.write.mode("overwrite").partitionBy(*(by or [])).parquet(beside)
        _written[at] = spark
        try:
            store.rename(beside, at)
        except OSError:
            store.remove_under(beside, folder(spark))
            if not store.exists(f"{at}/_SUCCESS"):
                raise
    return spark.read.parquet(at)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's path for what one job leaves to the next; it is deleted at exit, or by discard()."""
    at = f"{folder(spark)}/{what}-{uuid.uuid4().hex}"
    _written[at] = spark
    return at


def kept(df: DataFrame, what: str) -> DataFrame:
    """df written once and read back: lineage ends here, and a lost executor costs a read."""
    at = scratch(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(path: str) -> None:
    if (spark := _written.pop(path, None)) is not None:
        Files(spark).remove_under(path, folder(spark))


def _clean() -> None:
    for path, spark in _written.items():
        try:
            Files(spark).remove_under(path, folder(spark))
        except Exception:  # the session may have ended first; another call publishes anew
            return


atexit.register(_clean)
