"""Upstream walks over a lineage graph held in two DataFrames, by a recursive common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import constants
from ..plans.lineage_data import EDGES, LAYERS, NODES


def nodes(spark: SparkSession) -> DataFrame:
    rows = [(n[0], n[0].split(".")[0], n[1], n[2], n[3], constants.METRIC_OWNER, n[4], n[5]) for n in NODES]
    return spark.createDataFrame(rows, "object_name string, layer string, object_kind string, table_name string, grain string, owner string, version string, note string")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate(EDGES, 1)], "edge_id int, src string, dst string, transform string, grain string")


def upstream(edge: DataFrame, focus: list[str]) -> DataFrame:
    """(object_name, depth): everything that feeds the focus objects, themselves at depth 0.

    For the engine's own graph of a few objects without cycles, in one job; reach.upstream walks any graph.
    """
    spark = edge.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE up(object_name, depth) AS (
          SELECT explode(:focus), 0
          UNION ALL
          SELECT e.src, up.depth + 1 FROM up JOIN {edges} e ON e.dst = up.object_name
        )
        SELECT object_name, min(depth) AS depth FROM up GROUP BY object_name
        """,
        args={"focus": F.array(*[F.lit(x) for x in focus])},
        edges=edge,
    )


def walk(spark: SparkSession, focus: list[str]) -> dict:
    """focus, nodes by layer and name, edges and path of all upstream objects; names that are unknown are skipped."""
    known = {n[0] for n in NODES}
    names = [x for x in focus if x in known]
    if not names:
        return {"focus": names, "nodes": [], "edges": [], "path": []}
    reached = upstream(edges(spark), names)
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    found = [r.asDict() for r in nodes(spark).join(reached.select("object_name"), "object_name", "left_semi").orderBy(rank, "object_name").collect()]
    path = [n["object_name"] for n in found]
    used = edges(spark).where(F.col("dst").isin(*path)).orderBy("edge_id").drop("edge_id")
    return {"focus": names, "nodes": found, "edges": [r.asDict() for r in used.collect()], "path": path}


def for_answer(spark: SparkSession, metric: str | None, scan: str | None) -> dict:
    focus = [f"metric.{metric}"] if metric in constants.METRICS else []
    return walk(spark, [*focus, scan if scan in ("ads.brand_year", "ads.brand_month") else "dwd.fact_month"])
