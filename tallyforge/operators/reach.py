"""Walks over any graph in a DataFrame: semi-naive search from a frontier, many walks at once.

Walks are numbered, and a row of a round is a node with the bits of up to 64 walks that are there: an edge is followed once
for all of them. A round joins the nodes that the last round found with the edges, and keeps the bits that no round has set
yet. Each round's nodes are written to a folder of their own, so the visited set is a read of what is stored, lineage
doesn't grow with depth, and a node is expanded once whatever the number of paths to it. A cycle ends the search as
everything on it is visited. The number of rounds is the greatest depth plus one. Edges are read between the least and the
greatest node of the frontier only: where files hold one kind of edge each, a round shuffles the kinds that it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared


def stored(edges: DataFrame) -> DataFrame:
    """The edges src, dst without nulls, written once; repeated ones stay."""
    return shared.kept(edges.select("src", "dst").where("src is not null and dst is not null"), "reach-edges")


def upstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(focus, node, depth): all that feeds each focus, on the shortest way; its own nodes are at depth 0.

    edges: src feeds dst. seeds: focus, node; a focus may begin at several nodes. Nulls name nothing and feed nothing;
    repeated edges and seeds count once. Nodes that no edge knows are reached as seeds only.
    """
    return walk(stored(edges), seeds)


def walk(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """upstream() over edges that are stored()."""
    spark = edges.sparkSession
    seeds = seeds.select("focus", "node").where("node is not null").distinct()
    numbers = shared.kept(seeds.select("focus").distinct().withColumn("number", F.monotonically_increasing_id()), "reach-walks")
    number = F.col("number")
    walks = numbers.select(F.col("focus").alias("walk"), F.shiftright(number, 6).alias("block"), number.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = seeds.join(walks, F.col("focus").eqNullSafe(F.col("walk"))).groupBy("node", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    at, schema = shared.scratch(spark, "reach"), found.schema
    for depth in range(2**31):
        found.write.parquet(f"{at}/depth={depth}")
        frontier = spark.read.schema(schema).parquet(f"{at}/depth={depth}")
        low, high = frontier.agg(F.min("node"), F.max("node")).first()
        if low is None:
            break
        near = edges.where(F.col("dst").between(F.lit(low), F.lit(high))) if isinstance(low, (int, str)) else edges
        step = shared.scratch(spark, "reach-step")
        frontier.join(near, F.col("node") == F.col("dst")).groupBy(F.col("src").alias("node"), "block").agg(F.bit_or("bits").alias("bits")).write.parquet(step)
        reached = spark.read.schema(schema).parquet(step)
        visited = spark.read.schema(schema).parquet(*[f"{at}/depth={d}" for d in range(depth + 1)])
        again = visited.join(reached.select("node", "block"), ["node", "block"]).groupBy("node", "block").agg(F.bit_or("bits").alias("old"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        found = reached.join(again, ["node", "block"], "left").select("node", "block", new.alias("bits")).where("bits <> 0")
    kinds = ", ".join(f"{c} {t}" for c, t in frontier.dtypes)
    rows = spark.read.schema(f"{kinds}, depth int").parquet(at)
    return rows.join(walks, "block").where("shiftright(bits, bit) % 2 <> 0").select(F.col("walk").alias("focus"), "node", "depth")


def merged(walks: DataFrame) -> DataFrame:
    """(node, depth): the walks as one, each node at its least depth."""
    return walks.groupBy("node").agg(F.min("depth").alias("depth"))


def fan_in(edges: DataFrame) -> DataFrame:
    """(node, edges): how many nodes feed each node directly. Edges are dealt once, by the node they lead to."""
    return edges.repartition("dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("edges"))


def edges_within(edges: DataFrame, walks: DataFrame) -> DataFrame:
    """(focus, src, dst): the edges that lead to a node of a walk, once for each walk."""
    own = edges.select("src", "dst").where("src is not null").distinct()
    return walks.select("focus", F.col("node").alias("dst")).join(own, "dst").select("focus", "src", "dst")
