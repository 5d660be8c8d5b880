"""Exact deduplication against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest; the number of its buckets is kept with its files. New rows are reduced to one row per digest (partial
aggregation before the shuffle, so a hot group costs one row per task), anti-joined with the index by sort-merge, and
the digests that the index lacks are appended. Only DataFrame and SQL functions run here.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Files
from .common import doc_key, scratch_path

#: The white space that is deleted before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS, "")


class DigestIndex:
    """Digests seen so far: (digest, keep_id, n_chars, group_size), at most one live row per digest and batch.

    path: the folder in shared storage; an index that is there already is opened and extended.
    buckets: how many a new index gets, by default the session's number of shuffle partitions. An index that is there
    keeps the number it was made with, whatever is asked for: its files are dealt by it.
    """

    SCHEMA = "digest binary, keep_id long, n_chars long, group_size long, batch string"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, files = spark, path.rstrip("/"), Files(spark)
        about = files.read_json(f"{self.path}/_index.json")
        if about is None:
            if files.listing(self.path):
                raise ValueError(f"{path} has files but no _index.json that says how they are dealt")
            about = {"buckets": int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))}
            files.write_json(f"{self.path}/_index.json", about)
        self.buckets = about["buckets"]

    @contextmanager
    def table(self) -> Iterator[str]:
        """The index as a bucketed table; its entry in the catalog lives as long as the block, its files stay."""
        name = f"digest_index_{uuid.uuid4().hex}"
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def lookup(self) -> DataFrame:
        """All rows without the buckets, for joins whose other side may be skewed: Spark can then split a hot digest."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def append(self, keyed: DataFrame, batch: str = "0") -> None:
        """Adds the digests of keyed (digest, doc_id, n_chars) that the index lacks, with the row that stays."""
        best = F.max(F.struct("n_chars", F.bitwise_not(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("order"), "doc_id"))
        groups = keyed.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        with self.table() as name:
            known = self.spark.table(name).select(F.col("digest").alias("known")).hint("merge")
            # with the always true second condition the optimiser can't move the anti-join below the aggregation, where it
            # would shuffle every row of a hot group instead of one partial row for each task
            new = groups.join(known, (F.col("digest") == F.col("known")) & (F.col("group_size") > 0), "left_anti")
            rows = new.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.n_chars").cast("long").alias("n_chars"), "group_size", F.lit(batch).alias("batch"))
            rows = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
            rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(name)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text) and n_chars (code points of the original) of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"),
    )


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The longest original text of a group of equal texts stays, then the smallest doc_id. With an index that holds
    earlier batches, texts it knows are dropped in favour of the earlier keep_id and group_size is that of the batch
    that brought the digest. Null text is empty; a null doc_id loses against any other and is dropped unless its group
    has no id at all; rows that repeat a doc_id get the same answer; other columns are not read. No rows: no rows.
    """
    index = index or DigestIndex(docs.sparkSession, scratch_path(docs.sparkSession, "digests"))
    rows = keyed(docs)
    index.append(rows, batch)
    found = rows.select("doc_id", "digest").join(index.lookup().select("digest", "keep_id", "group_size"), "digest")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0") -> DataFrame:
    """The rows of docs that stay, with docs' own columns; of rows that repeat id and text one stays."""
    index = index or DigestIndex(docs.sparkSession, scratch_path(docs.sparkSession, "digests"))
    index.append(keyed(docs), batch)
    keep = index.lookup().where(F.col("batch") == batch).select(F.col("digest").alias("__kept"), doc_key("keep_id").alias("__keep_id"))
    rows = docs.withColumn("__digest", F.unhex(F.sha2(normalised("text").cast("binary"), 256))).withColumn("__id", doc_key())
    rows = rows.join(keep, (F.col("__digest") == F.col("__kept")) & (F.col("__id") == F.col("__keep_id")), "left_semi")
    same = Window.partitionBy("__digest", "__id").orderBy(F.length("text").desc())  # as the join has dealt the rows
    return rows.withColumn("__copy", F.row_number().over(same)).where("__copy = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
