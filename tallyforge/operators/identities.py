"""Exact counts of row identities without shuffling them: ordinals are bits, and a bitmap stands for up to 32,768 rows.

Rows of a file and bucket meet in one bitmap within each task; tasks' bitmaps are merged by or. What is shuffled is a bitmap
for each file, bucket and task, and never more than four kilobytes of it for 32,768 ordinals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(rows: DataFrame, files: list[Column], ordinal: Column, further: dict[str, Column] | None = None) -> DataFrame:
    """One row: n, identities (distinct pairs of file and ordinal without nulls), low, high and the sums named in further.

    further: aggregates over rows (counts) that can be added up, by name. Without rows n is 0 and low and high are null.
    """
    keys = [f"__f{i}" for i in range(len(files))]
    whole = F.lit(True)
    for f in files:
        whole = whole & f.isNotNull()
    at = F.when(whole, ordinal.cast("long"))
    named = rows.withColumns({**dict(zip(keys, files, strict=True)), "__at": at, "__ordinal": ordinal.cast("long")})
    parts = named.groupBy(*keys, F.bitmap_bucket_number("__at").alias("__bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__bits"), F.min("__ordinal").alias("low"), F.max("__ordinal").alias("high"),
        *[c.alias(name) for name, c in (further or {}).items()],
    )
    none = F.lit(0).cast("long")
    return parts.agg(
        F.coalesce(F.sum("n"), none).alias("n"), F.coalesce(F.sum(F.bitmap_count("__bits")), none).alias("identities"), F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.coalesce(F.sum(name), none).alias(name) for name in further or {}],
    )
