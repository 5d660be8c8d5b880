"""The driver's benchmark items asked against its documents, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import postings
from .driver_tables import table
from .lineage_data import STOP_WORDS


def retrieval_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents that share most tokens with each benchmark item."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), "text", F.array().cast("array<string>").alias("aliases"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))
    found = postings.search_all(documents, items)
    return found.select(F.col("q").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP})))"

QUERIES = {"retrieval_batch": retrieval_batch}
ORACLE_SQL = {
    "retrieval_batch": f"""WITH d AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents), b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark), q AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM b),
s AS (SELECT item_id, doc_id, round(count(*) / sqrt(CAST(any_value(n) AS DOUBLE)), 4) AS score FROM q JOIN d USING (t) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 5"""
}
