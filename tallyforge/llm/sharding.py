"""A uniform random shuffle into shards of exact size, by a hypergeometric communication matrix.

Source p sends row counts to the shards that are drawn exactly as a uniform permutation would send them: its row of the
matrix is a multivariate hypergeometric draw from what the shards still lack. Each source permutes its rows locally and
deals them out by its row; each shard permutes what it has received by random keys, in ranges of keys of bounded size, so
that no task holds a shard. The matrix is at most `sources` by `shards` numbers, whatever the input. Both permutations are
of row numbers; the rows themselves are exchanged once, to meet their shard and slot.
"""

from __future__ import annotations

from itertools import accumulate
from math import e, floor, lgamma, log, sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 24
#: Sources at most: input partitions beyond are taken together. Rows of a shard's key range on average.
SOURCES, RANGE_ROWS = 4096, 65536


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each source to each shard, as a uniform permutation distributes them. Row and column sums hold."""
    rng = np.random.default_rng(seed)
    lack = np.array(shards, np.int64)
    out = []
    for n in sources:
        left, pool, row = n, int(lack.sum()), np.zeros(len(lack), np.int64)
        for k in range(len(lack)):
            if not left:
                break
            good = int(lack[k])
            row[k] = _drawn(rng, good, pool - good, left)
            pool -= good
            left -= int(row[k])
        lack -= row
        out.append(row.tolist())
    return out


def _drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw: good ones among n of good + bad.

    numpy's takes populations below 10^9. Larger ones go by ratio of uniforms (Stadlober, 1990), whose acceptance test
    compares logarithms of factorials; their error in double precision is below 10^-4 for 10^11 rows.
    """
    size = good + bad
    if not good or not bad or n in (0, size):
        return min(good, n) if not bad or n == size else 0
    if size < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    few, many, m = min(good, bad), max(good, bad), min(n, size - n)
    share = few / size
    centre, spread = m * share + 0.5, sqrt((size - m) * n * share * (1 - share) / (size - 1) + 0.5)
    width = 2 * sqrt(2 / e) * spread + 3 - 2 * sqrt(3 / e)
    weight = lambda z: lgamma(z + 1) + lgamma(few - z + 1) + lgamma(m - z + 1) + lgamma(many - m + z + 1)
    mode = weight((m + 1) * (few + 1) // (size + 2))
    top = min(min(m, few) + 1, floor(centre + 16 * spread))
    while True:
        x, y = 1 - rng.random(), rng.random()
        at = centre + width * (y - 0.5) / x
        if 0 <= at < top and 2 * log(x) <= mode - weight(floor(at)):
            break
    z = floor(at) if good <= bad else m - floor(at)
    return z if m == n else good - z


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = 17, sources: int = SOURCES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in its shard); counts of shards differ by at most one.

    The order is uniform over all permutations for a random seed, and the same for the same seed and input files. Nulls
    and repeated rows are placed like any others; no rows give no rows. Rows are stored once, so that each keeps its
    number if an executor is lost. Columns named shard and slot are replaced; those named __* are the operator's own.
    """
    spark = rows.sparkSession
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    whole = stored(rows.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("__rid")), "shard_rows")
    numbered = whole.select("__rid", F.pmod(F.shiftright("__rid", 33), F.lit(sources)).alias("__p"))
    counts = {r["__p"]: r["n"] for r in numbered.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `sources` rows
    names, total = sorted(counts), sum(counts.values())
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([counts[p] for p in names], sizes, seed)
    deals = spark.createDataFrame([(p, [0, *accumulate(row)][:-1]) for p, row in zip(names, matrix, strict=True)], "__p long, __cuts array<long>")
    local = Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(seed), "__rid"), "__rid")
    dealt = numbered.withColumn("__row", F.row_number().over(local) - 1).join(deals, "__p")
    # a shard that gets nothing shares its cut with the next one: the last whose cut is reached takes the row
    dealt = dealt.withColumn("shard", F.size(F.filter("__cuts", lambda c: c <= F.col("__row"))) - 1).drop("__cuts", "__p", "__row")
    ranges = max(1, -(-total // (shards * range_rows)))
    keyed = dealt.withColumn("__key", F.xxhash64(F.lit(seed + 1), "__rid"))
    keyed = keyed.withColumn("__range", F.floor((F.shiftright("__key", 32) + F.lit(2**31)) * ranges / F.lit(2**32)).cast("long"))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = keyed.groupBy("shard", "__range").agg(F.count(F.lit(1)).alias("__n"))
    firsts = firsts.select("shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    again = Window.partitionBy("shard", "__range").orderBy("__key", "__rid")
    placed = keyed.withColumn("__place", F.row_number().over(again) - 1).join(firsts, ["shard", "__range"])
    placed = placed.select("__rid", "shard", (F.col("__first") + F.col("__place")).cast("long").alias("slot"))
    return whole.join(placed, "__rid").drop("__rid")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Shard files in slot order, one folder for each shard."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
