"""Exact top-k inner products with a vector-approximation file.

Every component is quantised to a cell of its dimension; a byte for each. For a block of queries a scan of the cells gives
lower and upper bounds of each score by two matrix products. Rows whose upper bound reaches the k-th best lower bound are
candidates. Their exact vectors are read in the order of upper bounds: first as many as can be needed, then those whose
bound still reaches the k-th exact score. Equal vectors are one class in the file, with the smallest ids of its members,
so a vector that a third of all rows share costs no more than any other.

Components are whole numbers in doubles, which hold them exactly. Vectors are filed by magnitude: those whose length (root of
the sum of squares) is below 2^30 in one stratum, longer ones in strata of 16 powers of two each, so that a few long vectors
don't put all others into one cell. Bounds are computed in doubles; where scores can pass 2^53 they are widened by what
rounding can do. Exact scores of short vectors are 64-bit sums; those of long ones are sums of Python's integers. A score
among the k best that a long can't hold is an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored

CELLS = 64
#: Queries of a block, vectors of a packed block of the file, and packed blocks that one task scans.
QUERY_BLOCK, VECTOR_BLOCK, STRIPE = 512, 1024, 64
#: Length from which vectors are long, as a power of two, and the powers of a stratum of them.
LONG, POWERS = 30, 16
#: Candidates that a scan holds before it drops those that the rising floor excludes.
HELD = 1 << 20


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component, as doubles.

    Rows with a null or non-finite component or no vec_id take no part. A component that is no double after scaling is an error.
    """
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~odd
    too_long = F.raise_error(F.lit("a component is no double after scaling: scale the vectors down")).cast("double")

    def whole(c):
        y = c * float(scale)
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).when(F.abs(y) < float("inf"), y).otherwise(too_long)

    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _stratum():
    """0 for short vectors, else a number of 1 or more by magnitude: of the largest component, which can't overflow."""
    most = F.aggregate("v", F.lit(0.0), lambda s, c: F.greatest(s, F.abs(c)))
    power = F.log2(F.greatest(most, F.lit(1.0))) + F.log2(F.sqrt(F.greatest(F.size("v"), F.lit(1)).cast("double")))
    return F.when(power < LONG, 0).otherwise(1 + F.floor((power - LONG) / POWERS)).cast("int")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    for i, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes, strict=True)):
        out[i, :n] = flat[a : a + n]
    return out


def _extent(width: int):
    """(stratum, d, low, high) of each task's vectors."""

    def extent(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                m, strata = _matrix(batch.column(0), width), batch.column(1).to_numpy()
                for s in np.unique(strata).tolist():
                    low, high = m[strata == s].min(axis=0), m[strata == s].max(axis=0)
                    found[s] = (np.minimum(found[s][0], low), np.maximum(found[s][1], high)) if s in found else (low, high)
        for s, (low, high) in found.items():
            yield pa.record_batch([pa.array(np.full(width, s, np.int32)), pa.array(np.arange(width)), pa.array(low), pa.array(high)], names=["stratum", "d", "low", "high"])

    return extent


def _edges(low: np.ndarray, high: np.ndarray, cells: int) -> np.ndarray:
    """Bounds of each cell of each dimension, (dimension, cells + 1): a component lies in [edge, next edge), the last one beside.

    Whole numbers where they are small, so that the next edge less one bounds a cell as well.
    """
    steps = np.arange(cells + 1) / cells
    edges = low[:, None] * (1 - steps) + (high + 1)[:, None] * steps
    edges = np.where(np.abs(edges) < 2.0**53, np.ceil(edges - 1e-9 * np.abs(edges)), edges)
    edges[:, 0], edges[:, -1] = low, np.maximum(high + 1, high)
    return np.maximum.accumulate(edges, axis=1)


def _packed(edges: dict[int, np.ndarray]):
    def packed(table: pa.Table) -> pa.Table:
        own = edges[table["stratum"][0].as_py()]
        m = _matrix(table["v"], len(own))
        cells = np.stack([np.clip(np.searchsorted(own[d], m[:, d], "right") - 1, 0, own.shape[1] - 2) for d in range(len(own))], axis=1).astype(np.uint8)
        return pa.table({"block": table["block"].slice(0, 1), "stratum": table["stratum"].slice(0, 1), "ids": [table["id"].to_numpy().tobytes()], "cells": [cells.tobytes()]})

    return packed


def _scan(edges: dict[int, np.ndarray], k: int):
    """A block of queries against a stripe of the file -> candidates with their upper bounds."""
    width = len(next(iter(edges.values())))
    sizes = np.max([np.maximum(np.abs(e[:, 0]), np.abs(e[:, -1])) for e in edges.values()], axis=0)
    rounding = 0.0 if float(sizes.max(initial=0.0)) < 2**26 and float((sizes**2).sum()) < 2**53 else (width + 4) * 2.0**-52  # of a sum of products, against the sum of their sizes

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore", invalid="ignore"):
            return scanned(left, right)

    def scanned(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return none
        own, q = left["id"].to_numpy(), _matrix(left["v"], width)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        floor = np.full((len(own), k), -np.inf)
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def pruned(found):
            i, ids, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
            stay = high >= floor.min(axis=1)[i]
            return [(i[stay], ids[stay], low[stay], high[stay])]

        for ids, cells, stratum in zip(right["ids"].to_pylist(), right["cells"].to_pylist(), right["stratum"].to_pylist(), strict=True):
            ids, c = np.frombuffer(ids, np.int64), np.frombuffer(cells, np.uint8).reshape(-1, width)
            dims = np.arange(width)
            lo, hi = edges[stratum][dims, c], edges[stratum][dims, c + 1]
            hi = np.where(hi > lo, np.maximum(hi - 1, lo), hi) if stratum == 0 else hi
            lows, highs = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
            if rounding:
                slack = rounding * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T)
                # what a double can't hold bounds nothing
                lows, highs = np.nan_to_num(lows - slack, nan=-np.inf, posinf=np.finfo(float).max, neginf=-np.inf), np.nan_to_num(highs + slack, nan=np.inf, posinf=np.inf, neginf=np.inf)
            best = np.concatenate((floor, lows), axis=1)
            floor = -np.partition(-best, k - 1, axis=1)[:, :k]
            i, j = np.nonzero(highs >= floor.min(axis=1)[:, None])
            found.append((i, ids[j], lows[i, j], highs[i, j]))
            held += len(i)
            if held > HELD:
                found = pruned(found)
                held = len(found[0][0]) // 2  # what is left may be right: then look again when it has grown
        i, ids, low, high = pruned(found)[0]
        return pa.table({"q": own[i], "id": ids, "low": low, "high": high})

    return scan


def top_k(vectors: DataFrame, is_query, k: int = 20, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows by inner product for each row where is_query holds.

    vectors: vec_id (unique) and v (whole numbers as doubles; a shorter vector counts as ending in zeros). Ties go to the
    smaller vec_id. With k or fewer other rows all are returned; a single row has no result; no rows give no rows.
    """
    rows = stored(vectors.withColumn("is_query", is_query), "vectors")
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.max("is_query").alias("asks"))
    classes = stored(classes.select("v", "id", "asks", _stratum().alias("stratum")), "classes")
    keyed = stored(rows.join(classes.select("v", "id"), "v").select("vec_id", "is_query", "id"), "members")
    smallest = Window.partitionBy("id").orderBy("vec_id")
    members = keyed.select("id", "vec_id", F.row_number().over(smallest).alias("r")).where(F.col("r") <= k + 1).select("id", "vec_id")
    released(rows)
    n, asking, width = classes.agg(F.count(F.lit(1)), F.sum(F.col("asks").cast("int")), F.max(F.size("v"))).first()
    if not n or not asking or not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranges = classes.select("v", "stratum").mapInArrow(_extent(width), "stratum int, d long, low double, high double").groupBy("stratum", "d").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    edges = {}
    for s in sorted({r["stratum"] for r in ranges}):  # a few magnitudes
        own = np.array(sorted((r["d"], r["low"], r["high"]) for r in ranges if r["stratum"] == s))
        edges[s] = _edges(own[:, 1], own[:, 2], cells)
    counts = {r["stratum"]: r["n"] for r in classes.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks, block = 0, None
    for s, m in sorted(counts.items()):  # the blocks of each stratum follow those of the last
        mine = F.lit(blocks) + F.pmod(F.xxhash64("id"), F.lit(-(-m // VECTOR_BLOCK)))
        block = F.when(F.col("stratum") == s, mine) if block is None else block.when(F.col("stratum") == s, mine)
        blocks += -(-m // VECTOR_BLOCK)
    parts = -(-asking // QUERY_BLOCK)
    stripes = -(-blocks // STRIPE)
    file = classes.select("id", "v", "stratum", block.cast("long").alias("block")).groupBy("block").applyInArrow(_packed(edges), "block long, stratum int, ids binary, cells binary")
    file = file.select((F.col("block") % stripes).alias("stripe"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "stratum", "ids", "cells")
    asks = classes.where("asks").select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
    asks = asks.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    scanned = asks.groupBy("part", "stripe").cogroup(file.groupBy("part", "stripe")).applyInArrow(_scan(edges, k + 1), "q long, id long, low double, high double")
    scanned = stored(scanned, "candidates")
    by_low = Window.partitionBy("q").orderBy(F.desc("low"), "id")
    floor = scanned.select("q", "low", F.row_number().over(by_low).alias("r")).where(F.col("r") <= k + 1).groupBy("q").agg(F.min("low").alias("floor"), F.count(F.lit(1)).alias("c"))
    floor = floor.select("q", F.when(F.col("c") == k + 1, F.col("floor")).otherwise(float("-inf")).alias("floor"))
    by_high = Window.partitionBy("q").orderBy(F.desc("high"), "id")
    able = scanned.join(floor, "q").where("high >= floor").select("q", "id", "high").withColumn("turn", F.row_number().over(by_high))
    able = stored(able, "able")
    released(scanned)
    first = stored(_scores(able.where(F.col("turn") <= 2 * (k + 1)), classes, set(counts)), "scores")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    sure = first.select("q", "score", F.row_number().over(by_score).alias("r")).where(F.col("r") == k + 1).select("q", F.col("score").alias("sure"))
    rest = able.where(F.col("turn") > 2 * (k + 1)).join(sure, "q").where("high >= sure").select("q", "id", "high", "turn")
    scores = first.union(_scores(rest, classes, set(counts)))
    ranked = scores.join(members, "id").select("q", "vec_id", "score")
    order = [F.desc("score"), F.col("vec_id")]
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    queries = keyed.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    out = queries.join(ranked, "q").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    if set(counts) != {0}:
        beyond = F.raise_error(F.lit("a score exceeds a long: scale the vectors down")).cast("long")
        out = out.withColumn("score", F.when(F.abs("score") <= F.lit(2**63 - 1).cast("decimal(38,0)"), F.col("score").cast("long")).otherwise(beyond))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scores(pairs: DataFrame, classes: DataFrame, strata: set[int]) -> DataFrame:
    """q, id, score: the exact vectors of both are read and multiplied.

    Where there are long vectors the score is a decimal, and one that no long can hold is as far out as a decimal goes: it
    stays above or below all others.
    """
    one, two = classes.select(F.col("id").alias("q"), F.col("v").alias("x")), classes.select("id", F.col("v").alias("y"))
    both = pairs.join(two, "id").join(one, "q")
    if strata == {0}:
        product = F.zip_with("x", "y", lambda a, b: F.coalesce(a.cast("long"), F.lit(0)) * F.coalesce(b.cast("long"), F.lit(0)))
        return both.select("q", "id", F.aggregate(product, F.lit(0).cast("long"), lambda s, p: s + p).alias("score"))
    return both.select("q", "id", "x", "y").mapInArrow(_whole_scores, "q long, id long, score string").select("q", "id", F.col("score").cast("decimal(38,0)").alias("score"))


def _whole_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    far = 10**37
    for batch in batches:
        scores = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            score = sum(int(a) * int(b) for a, b in zip(x, y, strict=False))
            scores.append(str(max(-far, min(far, score))))
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("id"), pa.array(scores, pa.string())], names=["q", "id", "score"])
