"""Merkle manifest of a table of documents: leaf digests, a subtree per source, one root, and every leaf's proof.

Leaves get their place within their source from sorted ranges, so a source that holds most rows is spread like any other.
Aligned blocks of 3^6 leaves are traversed in postorder, each in one task: a visit returns its subtree's digest and, while the
recursion unwinds, appends the siblings to the leaves below. The block roots are the leaves of the next distributed
traversal, until each source has one root; the sources' roots make one more tree in the same way.

Defined results: a null field counts as `-`; a null source is a source of its own and comes first; rows that repeat a doc_id
stay leaves of their own, ordered by leaf digest; a null doc_id comes first and is never tampered with; an empty table has no
rows. Columns that the leaf doesn't name play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ARITY = 3
LEVELS = 6
#: Leaves of a block: what one task holds at a time.
BLOCK = ARITY**LEVELS


def leaf(values: list[Column]) -> Column:
    """Digest (32 bytes) of the values in their order: `-` for null, else the UTF-8 byte count, `:` and the value."""
    texts = [v.cast("string") for v in values]
    framed = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*framed).cast("binary"), 256))


def depth(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while ARITY**levels < n:
        levels += 1
    return levels


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def traverse(digests: list[bytes], levels: int) -> tuple[bytes, list[bytes]]:
    """The root of the leaves after so many levels, and each leaf's siblings from its own level upwards, left to right."""
    n, paths = len(digests), [[] for _ in digests]

    def visit(first: int, level: int) -> bytes:
        if level == 0:
            return digests[first]
        step = ARITY ** (level - 1)
        starts = range(first, min(first + ARITY * step, n), step)
        children = [visit(start, level - 1) for start in starts]
        for i, start in enumerate(starts):
            others = b"".join(children[:i] + children[i + 1 :])
            if others:
                for at in range(start, min(start + step, n)):
                    paths[at].append(others)
        return parent(children)

    root = visit(0, levels)
    return root, [b"".join(path) for path in paths]


def fold(digest: bytes, place: int, n: int, siblings: bytes, used: int = 0) -> tuple[bytes, int]:
    """The root that a leaf at this place among n leaves leads to, and how many bytes of siblings were used."""
    while n > 1:
        run, at = divmod(place, ARITY)
        others = min(ARITY, n - ARITY * run) - 1
        found = [siblings[used + 32 * i : used + 32 * (i + 1)] for i in range(others)]
        digest, used = parent(found[:at] + [digest] + found[at:]), used + 32 * others
        place, n = run, -(-n // ARITY)
    return digest, used


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows (with a string column g) with their place `pos` in g and g's count `n`; and the largest n.

    Rows are dealt by ranges of (g, order), so that one g may fill many tasks. Equal rows are told apart by where they stood.
    """
    keys = ["g", *order, "__row"]
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",__part:int,__at:bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g")
            codes = g.dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            lengths = np.diff(np.append(starts, len(codes)))
            at = np.arange(len(codes)) - np.repeat(starts, lengths)
            if g[0].as_py() == last:
                at[: lengths[0]] += seen
            last, seen = g[len(g) - 1].as_py(), int(at[-1]) + 1
            kept = batch.drop_columns(["__row"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(at)], names=[*kept.schema.names, "__part", "__at"])

    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(dealt.mapInArrow(place, schema), "merkle-places")
    ranges = placed.groupBy("g", "__part").agg(F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy("g")
    before = F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = stored(ranges.select("g", "__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("n")), "merkle-ranges")
    most = ranges.agg(F.max("n")).first()[0] or 0
    out = placed.join(ranges, ["g", "__part"]).withColumn("pos", F.col("__at") + F.col("__before"))
    return out.drop("__part", "__at", "__before"), most


def climb(nodes: DataFrame) -> DataFrame:
    """Each aligned block of nodes (g, pos, n, digest) on its own: adds `block`, the siblings `sib` within it and its `root`."""
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    schema = nodes.schema.simpleString()[len("struct<") : -1] + ",sib:binary,root:binary"

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        root, paths = traverse(table.column("digest").to_pylist(), LEVELS if n > BLOCK else depth(n))
        table = table.append_column("sib", pa.array(paths, pa.binary()))
        return table.append_column("root", pa.array([root] * len(paths), pa.binary()))

    return nodes.groupBy("g", "block").applyInArrow(block, schema)


def forest(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The nodes with their siblings in their block; and for every block (g, block) the siblings `up` above it and g's root."""
    low = stored(climb(nodes), "merkle-blocks")
    blocks = low.where(F.col("pos") % BLOCK == 0)
    if most <= BLOCK:
        return low, blocks.select("g", "block", F.lit(b"").alias("up"), "root")
    roots = blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("root").alias("digest"))
    middle, above = forest(roots, -(-most // BLOCK))
    joined = middle.drop("root").join(above, ["g", "block"])
    return low, joined.select("g", F.col("pos").alias("block"), F.concat("sib", "up").alias("up"), "root")


def manifest(docs: DataFrame, fields: list[str], changed: dict[str, Column]) -> DataFrame:
    """A row per document: digests, and the root that a changed copy's leaf leads to with the original siblings.

    fields: the leaf's columns in order. changed: what replaces a column in the copy that is checked against the manifest.
    """
    values = {name: F.col(f"`{name}`") for name in fields}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(list(values.values())).alias("digest"),
        leaf(list((values | changed).values())).alias("other"),
    )
    nodes, most = numbered(stored(rows, "merkle-leaves"), ["doc_id", "digest"])
    low, blocks = forest(nodes, most)
    subroots = blocks.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("root").alias("digest"))
    tops, most = numbered(subroots, ["of"])
    high, above = forest(tops, most)
    high = high.drop("root").join(above, ["g", "block"]).select(
        F.col("of").alias("g"), F.col("digest").alias("subroot"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"), F.concat("sib", "up").alias("top"), F.col("root").alias("top_root")
    )
    # The few block rows take the top's proof along, so that no join of all leaves is keyed by source alone.
    blocks = blocks.drop("root").join(high, "g")
    joined = low.drop("root").join(blocks, ["g", "block"])
    return joined.mapInArrow(_checked, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {name: [] for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
        names = ("digest", "other", "pos", "n", "sib", "up", "top", "top_pos", "top_n", "subroot", "top_root")
        for digest, other, pos, n, sib, up, top, top_pos, top_n, subroot, root in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            proof = sib + up + top
            mid, used = fold(other, pos, n, proof)
            folded, _ = fold(mid, top_pos, top_n, proof, used)
            out["leaf"].append(digest.hex())
            out["subroot"].append(subroot.hex())
            out["root"].append(root.hex())
            out["proof_sha256"].append(hashlib.sha256(proof.hex().encode()).hexdigest())
            out["folded_root"].append(folded.hex())
            out["verified"].append(folded == root)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[c], pa.bool_() if c == "verified" else pa.string()) for c in out)], names=["doc_id", *out])
