"""Lloyd's clustering in exact integers, with centroids screened by block norms.

A vector is cut into segments. Of each segment the sum and the norm of what deviates from the segment's mean are kept: that is
the compressed vector. By Cauchy and Schwarz two segments are at least (difference of sums)^2 / length + (difference of norms)^2
apart, so one small matrix of bounds tells which centroids may be nearest. Centroids are met in the order of their bounds; a
vector leaves as soon as its next bound exceeds the best exact distance. Exact distances are integers. Bounds are lowered by
their rounding error before they exclude anything, so ties are decided by exact distances and go to the smaller number.

Each round is one pass over the stored vectors. What comes back is a sum and a count for each centroid and component: k rows,
whatever the number of vectors.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; with fewer
vectors than k there are as many centroids as vectors; rows that repeat an id are vectors of their own; a null id is hashed as
if it were empty; a distance or a sum of them that a long can't hold is an error, not a wrong number. Further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SEGMENTS = 16
#: Components below this can be subtracted, squared and added up for 4096 dimensions in 64 bits.
SMALL = 2**24


def quantised(vectors: DataFrame, scale: int, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and `v`, the floor of every component times scale; one that a long can't hold is an error."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = (F.size(vector_col) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    too_long = F.raise_error(F.lit("a component exceeds 2^62 after scaling: scale the vectors down")).cast("long")
    floors = F.transform(v, lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * F.lit(float(scale)))).otherwise(too_long))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), floors.alias("v"))


def rows_of(v: pa.Array, dim: int) -> np.ndarray:
    """A matrix of integers over a batch's lists."""
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), dim)


def exact(x: np.ndarray) -> np.ndarray:
    """x as it is where 64 bits hold all that is computed from it, else as Python's integers."""
    return x if x.size == 0 or (np.abs(x) < SMALL).all() and (x != np.iinfo(np.int64).min).all() else x.astype(object)


def compress(x: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums / sqrt(length) and deviation norms of the segments, a row a vector; and the error that each row may have."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, a:b].astype(np.float64) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    sums = np.stack([p.sum(1) / np.sqrt(p.shape[1]) for p in parts], 1)
    norms = np.stack([np.sqrt(((p - p.mean(1, keepdims=True)) ** 2).sum(1)) for p in parts], 1)
    size = np.sqrt((sums**2).sum(1) + (norms**2).sum(1))
    return sums, norms, size


def bounds(x: tuple, c: tuple) -> np.ndarray:
    """Lower bounds of the squared distances of all vectors to all centroids, lowered by more than their rounding error."""
    (xs, xn, xl), (cs, cn, cl) = x, c
    a, b = np.concatenate([xs, xn], 1), np.concatenate([cs, cn], 1)
    low = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
    return low - 1e-12 * (xl[:, None] + cl[None, :]) ** 2


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid and exact squared distance, and how many exact distances that took."""
    n, taken = len(x), 0
    low = bounds(compress(x), compress(centroids))
    order = np.argsort(low, axis=1, kind="stable")
    x, c = exact(x), exact(centroids)
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    best, number = np.zeros(n, x.dtype), np.full(n, -1, np.int64)
    left = np.arange(n)
    for turn in range(len(centroids)):
        cand = order[left, turn]
        if turn:
            open_ = low[left, cand] <= best[left].astype(np.float64) * (1 + 1e-12)
            left, cand = left[open_], cand[open_]
        if not len(left):
            break
        d = ((x[left] - c[cand]) ** 2).sum(1)
        taken += len(left)
        better = np.full(len(left), True) if not turn else (d < best[left]) | ((d == best[left]) & (cand < number[left]))
        best[left[better]], number[left[better]] = d[better], cand[better]
    return number, best, taken


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least sha256 of salt and id, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), len(rows[0]["v"]) if rows else 0)


def updated(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of its vectors' mean."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [[0] * dim for _ in range(k)], [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column("v"), dim)
            number, _, _ = nearest(x, centroids)
            x = exact(x)
            for j in np.unique(number):
                of = x[number == j]
                total[j], count[j] = [a + int(b) for a, b in zip(total[j], of.sum(0), strict=True)], count[j] + len(of)
        used = [j for j in range(k) if count[j]]
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(used, pa.int32()), "count": pa.array([count[j] for j in used], pa.int64()), "total": pa.array([[str(t) for t in total[j]] for j in used], pa.list_(pa.string()))}
        )

    found = vectors.mapInArrow(sums, "cluster int, count long, total array<string>")
    parts = found.select("cluster", "count", F.posexplode("total").alias("i", "part"))
    out = centroids.copy()
    for row in parts.groupBy("cluster", "i").agg(F.sum("count").alias("count"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        out[row["cluster"], row["i"]] = int(row["total"]) // row["count"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dim = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number, distance, _ = nearest(rows_of(batch.column("v"), dim), centroids)
            if distance.dtype == object and max(distance) >= 2**63:
                raise ValueError("a squared distance exceeds a long: scale the vectors down")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance.astype(np.int64))], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int, rounds: int, salt: str = "") -> tuple[DataFrame, np.ndarray]:
    """The assignment of all quantised vectors after so many rounds, and the final centroids."""
    kept = stored(vectors, "cluster-vectors")
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = updated(kept, centroids)
    return stored(assigned(kept, centroids), "cluster-assigned"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with its sums of distances and each centroid's digest; both tables that are joined have k rows."""
    spark = found.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest()) for j, c in enumerate(centroids)]
    of_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    of_all = of_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    named = of_cluster.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    out = found.join(F.broadcast(named), "cluster").join(F.broadcast(of_all))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
