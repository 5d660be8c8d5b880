"""A supply graph made from the driver's tables, walked upstream; each query with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reach
from .driver_tables import table


def _node(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src feeds dst: suppliers parts, parts orders, orders customers, customers segments, nations suppliers, regions nations.

    A region's first nation feeds its region back, which closes a cycle; parts with several suppliers of one nation are diamonds.
    """
    items, orders, nations = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "nation"))
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    pair = lambda rows, src, dst: rows.select(src.alias("src"), dst.alias("dst"))
    first = nations.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n_nationkey"))
    return reduce(DataFrame.unionByName, [
        pair(items, _node("supplier", "l_suppkey"), _node("part", "l_partkey")), pair(items, _node("part", "l_partkey"), _node("order", "l_orderkey")),
        pair(orders, _node("order", "o_orderkey"), _node("customer", "o_custkey")), pair(customers, _node("customer", "c_custkey"), _node("segment", "c_mktsegment")),
        pair(suppliers, _node("nation", "s_nationkey"), _node("supplier", "s_suppkey")), pair(nations, _node("region", "n_regionkey"), _node("nation", "n_nationkey")),
        pair(first, _node("nation", "n_nationkey"), _node("region", "n_regionkey")),
    ])


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("focus"), _node("segment", "c_mktsegment").alias("node"))


def lineage_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that feeds each market segment, with its distance."""
    return reach.upstream(supply(spark, sf_dir), _segments(spark, sf_dir))


def lineage_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments' walks as one: nodes at their least depth, and how many edges of the graph lead to them."""
    edges = reach.stored(supply(spark, sf_dir))
    walks = reach.walk(edges, _segments(spark, sf_dir))
    return reach.merged(walks).join(reach.fan_in(edges), "node", "left").select("node", "depth", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"))


#: No way is longer than 20 steps; the walk over sets of (focus, node, depth) ends there, where a cycle would go on.
_REACH = """WITH RECURSIVE e AS (SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst FROM lineitem UNION SELECT 'part:' || l_partkey, 'order:' || l_orderkey FROM lineitem
  UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders UNION SELECT 'customer:' || c_custkey, 'segment:' || c_mktsegment FROM customer
  UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier UNION SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey FROM nation
  UNION SELECT 'nation:' || min(n_nationkey), 'region:' || n_regionkey FROM nation GROUP BY n_regionkey),
w(focus, node, depth) AS (SELECT DISTINCT c_mktsegment, 'segment:' || c_mktsegment, 0 FROM customer UNION SELECT focus, src, depth + 1 FROM w JOIN e ON dst = node WHERE depth < 20),
r AS (SELECT focus, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY focus, node)
"""

QUERIES = {"lineage_reach": lineage_reach, "lineage_merged_walks": lineage_merged}
ORACLE_SQL = {
    "lineage_reach": f"{_REACH} SELECT focus, node, depth FROM r",
    "lineage_merged_walks": f"{_REACH} SELECT m.node, depth, coalesce(n, 0) AS edges FROM (SELECT node, min(depth) AS depth FROM r GROUP BY node) m LEFT JOIN (SELECT dst AS node, count(*) AS n FROM e GROUP BY dst) USING (node)",
}
