"""MinHash near-deduplication: many universal hash minima, banding, signature and full-set verification, and connected
components by alternating large-star and small-star.

Texts of equal word sequences are one class and only its smallest document goes on. Candidates never are all pairs of a
bucket: each bucket first links its members to its smallest one. Once these links are verified and their components known,
only members of buckets that still span several components meet, in cells of two blocks of bounded size: first within
blocks of the first bands, then, after components have been found anew, in all cells of what is still mixed. A component
that fills blocks of a bucket has them for itself, and no cell is made of two of its blocks. A block travels as one row with
its members' sketches and full sets; a cell compares sketches first, and only links that join components leave it. So a
large group of copies costs one link per copy, and no link between different components is passed over. What stays
quadratic is a bucket whose s members fall into components that no link joins: its blocks meet in pairs, s * s / 2^15 rows
of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binaries, by_bytes, doc_key, frugal, released, slices, stored, stored_small, strings
from .merkle import numbered
from .words import mix, run_starts, runs, whole, word_hashes

SHINGLE = 5
#: 54 bands of 6 minima: a pair of similarity 0.75 shares no band with probability (1 - 0.75^6)^54 = 2.6e-5.
BANDS, ROWS = 54, 6
#: Minima kept for signature verification, a byte of each, and how many must agree. At similarity 0.75, 96 of 128 agree
#: on average and fewer than 70 with probability below 1e-6.
CHECKED, AGREE = 128, 70
_SLICE = 1 << 20
#: Members of a block on average, and shingles of their sets: a cell holds two blocks.
_BLOCK, _BLOCK_SHINGLES = 128, 1 << 19
#: A component's members of one bucket are dealt to so many tasks.
_SALTS = 8
#: Bands whose buckets are compared first; most components have met when the others follow.
FIRST_BANDS = 6

_SIGNED = "id long, print long, n_shingles long, sequence long, sequence2 long, bands binary, sketch binary"


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] | np.uint64(1)).astype(np.uint32), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int = SHINGLE, lanes: int = 1) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(distinct shingle hashes text by text, their number for each text, words by lane, first word of each text).

    Shingles are 64-bit hashes: two of a pair's n and m shingles are mistaken for one with probability n * m / 2^64.
    """
    lanes_of, first = word_hashes(offsets, data, fold=True, lanes=lanes)
    words = lanes_of[0]
    begin, counts = run_starts(first, k)
    hashes, text = runs(words, k)[begin] if len(begin) else np.zeros(0, np.uint64), np.repeat(np.arange(len(counts)), counts)
    short = np.flatnonzero((counts == 0) & (np.diff(first) > 0))
    if len(short):
        hashes = np.concatenate((hashes, mix(whole(words, first)[short] ^ np.uint64(0x5851F42D4C957F2D))))
        text = np.concatenate((text, short))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(counts)), lanes_of, first


def _sign(bands: int, rows: int, checked: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(max(bands * rows, checked))
        for batch in batches:
            offsets, data = strings(batch.column(2))
            for i, j in slices(offsets, _SLICE):
                hashes, sizes, words, first = shingle_sets(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], lanes=2)
                full = np.flatnonzero(sizes)
                minima = np.empty((len(a), j - i), np.uint32)
                minima.fill(2**32 - 1)
                if len(full):
                    low = (hashes >> np.uint64(32)).astype(np.uint32)
                    cuts = (np.cumsum(sizes) - sizes)[full]
                    work = np.empty_like(low)
                    for p in range(len(a)):
                        np.multiply(low, a[p], out=work)
                        np.add(work, b[p], out=work)
                        minima[p, full] = np.minimum.reduceat(work, cuts)
                keys = np.zeros((bands, j - i), np.uint64)
                for r in range(rows):
                    keys = mix(keys + minima[r : bands * rows : rows].astype(np.uint64) + np.uint64(r + 1))
                sketch = np.ascontiguousarray(mix(minima[:checked].astype(np.uint64)).astype(np.uint8).T)
                keys = np.ascontiguousarray(keys.T)
                sequence, other = (whole(lane, first) for lane in words)
                wide = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(sequence.view(np.int64)), pa.array(other.view(np.int64)), wide(keys), wide(sketch)],
                    names=["id", "print", "n_shingles", "sequence", "sequence2", "bands", "sketch"],
                )

    return frugal(sign)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, checked: int = CHECKED) -> DataFrame:
    """id, print, n_shingles, two hashes of the word sequence, band keys (8 bytes each) and a byte of each checked minimum."""
    slim = docs.select(doc_key().alias("id"), F.xxhash64("text").alias("print"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_sign(bands, rows, checked), _SIGNED)


def _spread(bands: int):
    """Signatures -> one row per band: band key (the band's number is mixed in; its lowest bit tells the first bands) and id."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        early = (np.arange(bands) < FIRST_BANDS).astype(np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            _, data = strings(batch.column(1))
            keys = mix(np.ascontiguousarray(data).view("<u8").reshape(len(ids), bands) ^ salt) & ~np.uint64(1) | early
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, bands))], names=["bucket", "id"])

    return spread


def _linked(percent: int, agree: int):
    """Pairs with the sketches (s, t) and texts (x, y) of their documents -> those whose sketches agree and whose sets have percent of their union in common."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        hashes, sizes, _, _ = shingle_sets(*strings(column))
        return np.split(hashes, np.cumsum(sizes)[:-1])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, t = (strings(batch.column(c))[1].reshape(batch.num_rows, -1) for c in ("s", "t"))
            alike = batch.filter(pa.array((s == t).sum(axis=1) >= agree))
            for part in by_bytes(by_bytes([alike], "x", _SLICE), "y", _SLICE):
                keep = []
                for one, two in zip(sets(part.column("x")), sets(part.column("y")), strict=True):
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append(100 * both >= percent * (len(one) + len(two) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return frugal(linked)


def confirmed(pairs: DataFrame, known: DataFrame, texts: DataFrame, percent: int, agree: int = AGREE) -> DataFrame:
    """The pairs (a, b) of whose checked minima at least `agree` agree and whose full shingle sets have percent or more of their union in common.

    known: id, sketch; texts: id, text. Both are joined once, on the documents of the pairs; each pair then meets its two documents.
    """
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    ends = ends.join(known.select("id", "sketch"), "id").join(texts, "id")
    two = ends.groupBy("a", "b").agg(F.collect_list(F.struct("id", "sketch", "text")).alias("ends"))
    of = lambda end, what: F.filter("ends", lambda x: x["id"] == F.col(end))[0][what]
    two = two.select("a", "b", of("a", "sketch").alias("s"), of("b", "sketch").alias("t"), of("a", "text").alias("x"), of("b", "text").alias("y"))
    return two.mapInArrow(_linked(percent, agree), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component), stored, for every node of edges (a, b): the smallest id reachable, by large-star and small-star in turn.

    Hot nodes are joined, not collected: each star is a minimum per node (pre-aggregated) and a join with the edges.
    """
    edges = stored_small(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # done when all are stars: no node has two smaller neighbours, or one and a larger one
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up")))).alias("end")).select("end.*")
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
        if not ends.where("up > 0 and n > 1").agg(F.count(F.lit(1)).alias("n")).first()["n"]:
            break
        # large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: every smaller neighbour of a node, and the node, is linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        last, edges = edges, stored_small(small, "edges")
        released(last)
    out = stored_small(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct()), "components")
    released(edges)
    return out


def _candidates(ids: np.ndarray, component: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, side: np.ndarray, percent: int, agree: int) -> np.ndarray:
    """Pairs of a cell's members that could be linked and aren't in one component: two positions and the minima that agree.

    side: only 0 and 1 meet if both occur.
    """
    pairs = []
    both = side.any() and not side.all()
    for k in range(len(ids) - 1):
        rest = slice(k + 1, None)
        fits = (component[rest] != component[k]) & (ids[rest] != ids[k])
        fits &= 100 * np.minimum(sizes[k], sizes[rest]) >= percent * np.maximum(sizes[k], sizes[rest])
        if both:
            fits &= side[rest] != side[k]
        at = np.flatnonzero(fits) + k + 1
        alike = (sketch[at] == sketch[k]).sum(axis=1)
        good = alike >= agree
        pairs.append(np.stack([np.full(good.sum(), k), at[good], alike[good]]))
    return np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), np.int64)


def cell_links(ids: np.ndarray, component: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, agree: int) -> list[tuple[int, int]]:
    """Links between components of a cell's members, by their numbers, each verified on full sets of two members."""
    pairs = _candidates(ids, component, sizes, sketch, side, percent, agree)
    pairs = pairs[:, np.argsort(-pairs[2], kind="stable")]
    shared = _shared(sets) if pairs.shape[1] > 400 else None
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    for x, y in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True):
        one, two = find(int(component[x])), find(int(component[y]))
        if one == two:
            continue
        both_have = int(shared[x, y]) if shared is not None else len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both_have >= percent * (len(sets[x]) + len(sets[y]) - both_have):
            root[max(one, two)] = min(one, two)
            ends = int(component[x]), int(component[y])
            links.append((min(ends), max(ends)))
    return links


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of indicator matrices of 4096 elements each."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = times > 1  # the others are in no intersection
    owner, element = owner[twice[element]], (np.cumsum(twice) - 1)[element[twice[element]]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, 4096):
        i, j = np.searchsorted(element, (low, low + 4096))
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[i:j], element[i:j] - low] = 1
        out += has @ has.T
    return out


_PACKED = "bucket long, own long, ids binary, components binary, sizes binary, sketches binary, shingles binary"


def _pack(table: pa.Table) -> pa.Table:
    """Members of a block -> one row."""
    shingles = table["shingles"].to_pylist()
    sizes = np.array([len(x) // 8 for x in shingles], np.int64)
    column = lambda name: [table[name].to_numpy().tobytes()]
    packed = [column("id"), column("component"), [sizes.tobytes()], [b"".join(table["sketch"].to_pylist())], [b"".join(shingles)]]
    return pa.Table.from_arrays([table["bucket"].slice(0, 1), table["own"].slice(0, 1), *[pa.array(x, pa.binary()) for x in packed]], names=["bucket", "own", "ids", "components", "sizes", "sketches", "shingles"])


def _meet(percent: int, agree: int):
    """The one or two blocks of a cell -> links."""

    def meet(table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        ids, sizes = joined("ids", np.int64), joined("sizes", np.int64)
        side = np.repeat(np.arange(len(table)), [len(x) // 8 for x in table["ids"].to_pylist()])
        sets = np.split(joined("shingles", np.uint64), np.cumsum(sizes)[:-1])
        links = cell_links(ids, joined("components", np.int64), sizes, joined("sketches", np.uint8).reshape(len(ids), -1), sets, side, percent, agree)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return meet


@frugal
def _as_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = strings(batch.column("text"))
        for i, j in slices(offsets, _SLICE):
            hashes, sizes, _, _ = shingle_sets(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("sketch").slice(i, j - i), binaries(hashes, np.concatenate(([0], np.cumsum(sizes))) * 8)], names=["id", "sketch", "shingles"])


def cells(members: DataFrame, comps: DataFrame, known: DataFrame, own_blocks: bool) -> tuple[DataFrame, DataFrame]:
    """(members of buckets that span several components with their blocks, stored; the blocks of each cell).

    The first has bucket, own (the block), id and component, the second bucket, i, j (the cell) and own. The given members
    are distinct bucket, lead, id; the leader has met all members of its bucket, so it takes no part. Blocks have about _BLOCK members
    and _BLOCK_SHINGLES shingles; a component that has more than that in the bucket has blocks of its own, smaller ones
    share. own_blocks: blocks meet only themselves.
    """
    named = members.where("id <> lead").select("bucket", "id").join(known.select("id", "n"), "id").join(comps, "id", "left")
    named = named.select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    open_ones = named.join(mixed, "bucket").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(_SALTS)))
    open_ones = stored(open_ones, "open")
    parts = lambda members, shingles: F.greatest(F.ceil(members / F.lit(_BLOCK)), F.ceil(shingles / F.lit(_BLOCK_SHINGLES))).cast("int")
    own = open_ones.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    own = own.withColumn("large", (F.col("members") > _BLOCK) | (F.col("shingles") > _BLOCK_SHINGLES))
    shared = own.where("not large").groupBy("bucket").agg(parts(F.sum("members"), F.sum("shingles")).alias("shared"))
    own = own.select("bucket", "component", "large", parts(F.col("members"), F.col("shingles")).alias("parts")).join(shared, "bucket", "left")
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    within = F.when(F.col("large"), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("component"), F.col("shared")))
    owner = F.when(F.col("large"), F.col("component"))
    dealt = open_ones.join(own, ["bucket", "component", "salt"]).select("bucket", "id", "component", owner.alias("owner"), F.xxhash64("large", owner, within.cast("int")).alias("own"))
    dealt = stored(dealt, "dealt")
    released(open_ones)
    blocks = dealt.select("bucket", "own", "owner").distinct()
    pairs = blocks.where("owner is null").select("bucket", F.col("own").alias("i"), F.col("own").alias("j"))
    if not own_blocks:
        one, two = blocks.select("bucket", F.col("own").alias("i"), F.col("owner").alias("x")), blocks.select("bucket", F.col("own").alias("j"), F.col("owner").alias("y"))
        pairs = pairs.union(one.join(two, "bucket").where("i < j and not coalesce(x = y, false)").select("bucket", "i", "j"))
    return dealt, pairs.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))


def links_across(members: DataFrame, comps: DataFrame, known: DataFrame, texts: DataFrame, percent: int, own_blocks: bool) -> DataFrame:
    """Links (a, b), stored, between components that share a bucket, by their numbers, from all cells."""
    dealt, ends = cells(members, comps, known, own_blocks)
    sets = texts.join(dealt.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).join(known.select("id", "sketch"), "id")
    sets = stored(sets.mapInArrow(_as_set, "id long, sketch binary, shingles binary"), "sets")
    packed = dealt.join(sets, "id").groupBy("bucket", "own").applyInArrow(_pack, _PACKED)
    links = ends.join(packed, ["bucket", "own"]).groupBy("bucket", "i", "j").applyInArrow(_meet(percent, AGREE), "a long, b long").distinct()
    links = stored(links, "more_links")
    released(dealt, sets)
    return links


def near_groups(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of distinct 5-word shingles (words
    of A-Z lower-cased; fewer than five words are one shingle). component_id is the smallest doc_id reachable. Texts
    without words, and null, are linked with nothing. A null doc_id comes before all others and gives a null component_id
    to its group. Rows that repeat a doc_id are one node: what is linked with one of them is linked with all that have
    words. No rows give no rows.

    Where a doc_id repeats with different texts, the search runs on numbers of (doc_id, text) in that order, and the rows of
    a doc_id are linked with each other; so the outcome never depends on which of them is met first.
    """
    own = F.xxhash64(F.col("text").cast("string"))
    ids = docs.select(doc_key().alias("id"), own.alias("print"))
    if ids.groupBy("id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low < high").isEmpty():
        return _groups(docs, percent, bands, rows)
    nodes, _ = numbered(ids.distinct().select(F.lit("").alias("g"), "id", "print"), ["id", "print"])
    nodes = stored(nodes.select("id", "print", "pos"), "nodes")
    texts = docs.select(doc_key().alias("id"), own.alias("print"), F.col("text").cast("string").alias("text"))
    found = _groups(texts.join(nodes, ["id", "print"]).select(F.col("pos").alias("doc_id"), "text"), percent, bands, rows, nodes.select("id", "pos"))
    plain = lambda c: F.when(F.col(c) != F.lit(-(2**63)), F.col(c))
    found = found.join(nodes.select(F.col("pos").alias("doc_id"), "id"), "doc_id").join(nodes.select(F.col("pos").alias("component_id"), F.col("id").alias("component")), "component_id")
    return found.select(plain("id").alias("doc_id"), "n_shingles", plain("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _groups(docs: DataFrame, percent: int, bands: int, rows: int, same: DataFrame | None = None) -> DataFrame:
    """near_groups of documents of which each doc_id has one text. same: id and pos, where the pos of one id are one node."""
    signed = stored(signatures(docs, bands, rows), "signatures")
    with_words = signed.where("n_shingles > 0")
    classes = with_words.groupBy("sequence", "sequence2").agg(F.min("id").alias("rep"))
    reps = with_words.groupBy("sequence", "sequence2").agg(F.min(F.struct("id", "bands")).alias("rep")).select("rep.*")
    buckets = reps.mapInArrow(_spread(bands), "bucket long, id long")
    # a running minimum in order of id: one pass over the sorted rows of a task, whatever the size of a bucket
    so_far = Window.partitionBy("bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = stored(buckets.withColumn("lead", F.min("id").over(so_far)).where("id <> lead"), "buckets")
    near_any = members.select(F.explode(F.array("id", "lead")).alias("id")).distinct()
    known = with_words.select("id", F.col("n_shingles").alias("n"), "sketch").join(near_any, "id", "left_semi").dropDuplicates(["id"])
    known = stored_small(known, "known")
    texts = docs.select(doc_key().alias("id"), F.col("text").cast("string").alias("text"))
    # the same exchange at every size: by its own choice Spark would send small inputs' ids to all tasks and deal large inputs' texts
    texts = stored(texts.join(known.select("id").hint("merge"), "id", "left_semi"), "texts")
    links = confirmed(members.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), known, texts, percent)
    if same is not None:
        of = with_words.join(classes, ["sequence", "sequence2"]).select(F.col("id").alias("pos"), "rep").join(same, "pos").select("id", "rep").distinct()
        least = of.groupBy("id").agg(F.min("rep").alias("a"))
        links = links.union(of.join(least, "id").where("a < rep").select("a", F.col("rep").alias("b")))
    links = stored(links, "links")
    comps = components(links)
    released(links)
    for few in (True, False):
        some = members.where("bucket & 1 = 1") if few else members
        more = links_across(some, comps, known, texts, percent, own_blocks=few)
        if not more.isEmpty():
            # links are between components, so their graph is small; a node that had no component yet is in it as itself
            roots = components(more)
            moved = comps.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
            moved = moved.select("id", F.coalesce("root", "component").alias("component")).union(roots).distinct()
            last, comps = comps, stored_small(moved, "components")
            released(last, roots)
        released(more)
    named = classes.join(comps, F.col("rep") == F.col("id"), "left").select("sequence", "sequence2", F.coalesce("component", "rep").alias("component"))
    named = stored(named, "named")  # both sides of the join then are plain tables, so Spark can split a hot class
    released(members, known, texts, comps)
    found = with_words.select("id", "n_shingles", "sequence", "sequence2").join(named, ["sequence", "sequence2"]).select("id", "n_shingles", "component")
    found = found.union(signed.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component")))
    plain = lambda c: F.when(F.col(c) != F.lit(-(2**63)), F.col(c))
    return found.select(plain("id").alias("doc_id"), "n_shingles", plain("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
