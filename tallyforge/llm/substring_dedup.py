"""Substring deduplication by relative Lempel-Ziv parsing against an index of all reference blocks.

Every text is cut into content-defined blocks: runs of consecutive windows (20 words) that share their smallest 5-word
hash. That hash is the block's key in the index, so equal windows always lie in blocks of one key, wherever they stand in
the corpus. A block is parsed greedily against all earlier blocks of its key: as long as the next window continues the
window that the current source gives, the factor grows. A factor that covers a window or more is at least 20 words and
becomes a duplicate span; where one factor ends and the next begins, the windows over the boundary are looked up
themselves, so none is missed.

Before the shuffle each slice of a task parses its own blocks: of windows that repeat in a slice only the earliest leaves
it, so a passage that many documents share reaches the index a few times per slice and not once per document. A phrase
that is common in ever new surroundings would still bring a large part of all blocks under one key. Such keys are found in
a sample of the documents; their windows travel one by one under a key of their own, so only equal windows meet. Which
keys are dealt so changes where windows are compared and nothing else.

Windows under one key are told apart by 64 bits that are independent of the key's 64; no words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, by_bytes, doc_key, frugal, slices, strings
from .words import mix, run_starts, runs, word_hashes

WINDOW, ANCHOR = 20, 5
#: Bytes of a window's hash that travel to the index, besides the 8 of the key.
_HASH_BYTES = 8
#: One in so many documents is looked at for hot keys. Hot are the most frequent keys, 16 for each partition, with at least
#: so many blocks in the sample: any other key has at most about a sixteenth of what a task gets on average.
_SAMPLED, _HOT_SHARE, _HOT_LEAST = 64, 16, 32
#: Bytes of text that are parsed at once; longer texts are parsed alone.
_SLICE = 3 << 19
#: Bytes of blocks that the index parses at once.
_HELD = 2 << 20

#: Blocks on their way to the index. A factor that is done travels among them with -1 - start for start and its length,
#: source_start and source_id (4, 4 and 8 bytes) for hashes.
_BLOCKS = "key long, id long, print long, start int, hashes binary"
_DONE = np.dtype([("length", "<i4"), ("source_start", "<i4"), ("source_id", "<i8")])
_FACTORS = "id long, print long, start int, length int, source_id long, source_start int"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _earliest(hashes: np.ndarray, keys: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each window the position of the earliest window with its hash and key, by (id, start)."""
    order = np.lexsort((starts, ids, keys, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (keys[order[1:]] != keys[order[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def _factors(repeat, text, ids, prints, starts, source, window):
    """Greedy factors over windows in text order: runs that repeat and whose sources are consecutive."""
    at = np.flatnonzero(repeat)
    if not len(at):
        return [np.zeros(0, np.int64)] * 6
    src = source[at]
    grows = (text[at[1:]] == text[at[:-1]]) & (starts[at[1:]] == starts[at[:-1]] + 1)
    grows &= (ids[src[1:]] == ids[src[:-1]]) & (starts[src[1:]] == starts[src[:-1]] + 1)
    first = np.flatnonzero(np.concatenate(([True], ~grows)))
    windows = np.diff(np.append(first, len(at)))
    head = at[first]
    return [ids[head], prints[head], starts[head], windows + window - 1, ids[source[head]], starts[source[head]]]


def _blocks(offsets, data, window, anchor):
    """(text of each window, its start, hash and key)."""
    (words, others), first = word_hashes(offsets, data, lanes=2)
    begin, counts = run_starts(first, window)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(begin):
        return text, begin, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return text, begin - first[:-1][text], runs(others, window)[begin], _least(runs(words, anchor), window - anchor + 1)[begin]


def _heads(text: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where blocks begin among windows (at: their numbers): runs of consecutive windows of one text and key."""
    joined = (text[at[1:]] == text[at[:-1]]) & (at[1:] == at[:-1] + 1) & (keys[at[1:]] == keys[at[:-1]])
    return np.flatnonzero(np.concatenate(([True], ~joined))) if len(at) else at


def _parse_slice(ids, prints, offsets, data, window, anchor, hot) -> Iterator[pa.RecordBatch]:
    text, start, hashes, keys = _blocks(offsets, data, window, anchor)
    if not len(start):
        return
    win_id, win_print = ids[text], prints[text]
    if len(hot):
        salted = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys)
        keys[salted] = mix(keys[salted] ^ hashes[salted])
    source = _earliest(hashes, keys, win_id, start)
    repeat = (win_id != win_id[source]) | (start != start[source])
    found = _factors(repeat, text, win_id, win_print, start, source, window)
    if len(found[0]):
        done = np.zeros(len(found[0]), _DONE)
        done["length"], done["source_start"], done["source_id"] = found[3], found[5], found[4]
        spread = mix(found[0].astype(np.uint64) * np.uint64(31) + found[2].astype(np.uint64))
        yield _rows(spread, found[0], found[1], -1 - found[2], binaries(done, np.arange(len(done) + 1) * 16))
    stay = np.flatnonzero(~repeat)
    head = _heads(text, stay, keys)
    blocks = stay[head]
    cuts = np.append(head, len(stay)) * _HASH_BYTES
    yield _rows(keys[blocks], win_id[blocks], win_print[blocks], start[blocks], binaries(hashes[stay], cuts))


def _rows(key, ids, prints, starts, hashes) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(key).astype(np.uint64).view(np.int64)), pa.array(ids), pa.array(prints.astype(np.int64)), pa.array(starts.astype(np.int32)), hashes]
    return pa.RecordBatch.from_arrays(columns, names=["key", "id", "print", "start", "hashes"])


def _parse_texts(window: int, anchor: int, hot: np.ndarray):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offsets, data = strings(batch.column(2))
            for i, j in slices(offsets, _SLICE):
                yield from _parse_slice(ids[i:j], prints[i:j], offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], window, anchor, hot)

    return frugal(parse)


def _keys_of(window: int, anchor: int):
    """Texts -> the key of each block."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = strings(batch.column(0))
            for i, j in slices(offsets, _SLICE):
                text, _, _, keys = _blocks(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], window, anchor)
                yield pa.record_batch([pa.array(keys[_heads(text, np.arange(len(keys)), keys)].view(np.int64))], names=["key"])

    return frugal(keys_of)


def hot_keys(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """Keys that would bring a task more than its share, sorted; at most 16 for each shuffle partition."""
    sample = docs.where(F.pmod(F.xxhash64(doc_key(), F.lit(5)), F.lit(_SAMPLED)) == 0).select(F.col("text").cast("string").alias("text"))
    counts = sample.mapInArrow(_keys_of(window, anchor), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= _HOT_LEAST)
    most = _HOT_SHARE * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = counts.orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
    return np.sort(counts["key"].to_numpy().view(np.uint64))


def _as_factors(columns) -> pa.RecordBatch:
    kinds = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int32]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in zip(columns, kinds, strict=True)], names=["id", "print", "start", "length", "source_id", "source_start"])


def _resolve(rows: list[pa.RecordBatch], window: int, keep: bool = False) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
    """Factors of all blocks that are given; with keep also the windows that are the earliest so far, as blocks of one."""
    table = pa.Table.from_batches(rows).combine_chunks()
    out = []
    done = table.filter(pc.less(table["start"], 0)).combine_chunks()
    if len(done):
        told = np.frombuffer(np.ascontiguousarray(strings(done["hashes"].chunk(0))[1]), _DONE)
        out.append(_as_factors([done["id"].to_numpy(), done["print"].to_numpy(), -1 - done["start"].to_numpy(), told["length"], told["source_id"], told["source_start"]]))
    table = table.filter(pc.greater_equal(table["start"], 0)).combine_chunks()
    if not len(table):
        return out, None
    offsets, data = strings(table["hashes"].chunk(0))
    counts = np.diff(offsets) // _HASH_BYTES
    block = np.repeat(np.arange(len(table)), counts)
    hashes = np.ascontiguousarray(data).view("<u8")
    column = lambda name: table[name].to_numpy()
    keys = column("key")
    ids, prints = column("id")[block], column("print")[block]
    starts = column("start").astype(np.int64)[block] + np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    source = _earliest(hashes, keys[block], ids, starts)
    repeat = (ids != ids[source]) | (starts != starts[source])
    out.append(_as_factors(_factors(repeat, block, ids, prints, starts, source, window)))
    if not keep:
        return out, None
    first = np.flatnonzero(~repeat)
    return out, _rows(keys[block[first]].view(np.uint64), ids[first], prints[first], starts[first], binaries(hashes[first], np.arange(len(first) + 1) * _HASH_BYTES))


def _parse_index(window: int):
    """Blocks sorted by key -> factors. Several keys are parsed at a time.

    A key that fills the buffer alone is parsed as it comes: of its windows only the earliest so far stay, one for each
    distinct window, so a passage that a third of all documents share takes no more room than one that two share.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, _HELD
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < most:
                continue
            keys = batch.column("key").to_numpy()
            last = keys[-1]
            cut = int(np.searchsorted(keys, last, "left"))
            if not cut and held[0].column("key")[0].as_py() == last:
                found, rest = _resolve(held, window, keep=True)
                yield from found
                held = [] if rest is None else [rest]
                size = sum(x.nbytes for x in held)
                most = max(_HELD, 2 * size)
                continue
            ready, held = [*held[:-1], batch.slice(0, cut)], [batch.slice(cut)]
            if not cut:  # the key began in an earlier batch
                whole = pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                at = int(np.searchsorted(whole.column("key").to_numpy(), last, "left"))
                ready, held = [whole.slice(0, at)], [whole.slice(at), *held]
            size, most = sum(x.nbytes for x in held), _HELD
            yield from _resolve(ready, window)[0]
        if held:
            yield from _resolve(held, window)[0]

    return parse


def _print(docs: DataFrame):
    """Tells rows apart that repeat a doc_id with different texts: 64 bits of the text where any doc_id repeats so, else 0.

    Ids and hashes alone are grouped to know it. Where ids are unique they tell all rows apart, and zeros take no room.
    """
    own = F.xxhash64(F.col("text").cast("string"))
    repeated = docs.groupBy(doc_key().alias("id")).agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low < high")
    return F.lit(0).cast("long") if repeated.isEmpty() else own


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, own_print=None) -> DataFrame:
    """Duplicate spans: id, print (what tells rows of an id apart, see _print), start and length in words, and the earlier source_id, source_start.

    A span's every window occurs earlier, in a smaller doc_id or earlier in the same one. A span ends where its block or
    its source's does, so a longer passage is several overlapping spans. A null doc_id comes before all
    others. Rows that repeat a doc_id are one document at the same place: neither is earlier than the other.
    """
    own_print = _print(docs) if own_print is None else own_print
    rows = docs.select(doc_key().alias("id"), own_print.alias("print"), F.col("text").cast("string").alias("text"))
    blocks = rows.mapInArrow(_parse_texts(window, anchor, hot_keys(docs, window, anchor)), _BLOCKS)
    sorted_blocks = blocks.repartition(F.col("key")).sortWithinPartitions("key")
    return sorted_blocks.mapInArrow(_parse_index(window), _FACTORS)


def _pressed(text: str):
    """The column `text` as zstd frames in `__pressed`: texts are most of what the join with the spans shuffles."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in by_bytes(batches, text, _SLICE):
            frames = pa.array([None if t is None else pack(t.encode()) for t in batch.column(text).to_pylist()], pa.binary())
            own = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), frames], names=[*own, "__pressed"])

    return frugal(press)


def _cut_words(text: str | None, names: tuple[str, str, str]):
    """text: the column to give back, None if it isn't wanted."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        total, removed, left, texts = [], [], [], []
        for value, found in zip(batch.column("__pressed").to_pylist(), batch.column("__spans"), strict=True):
            whole = b"" if value is None else unpack(value)
            if text is not None:
                texts.append(None if value is None else whole.decode())
            words = whole.split()
            kept = words
            if found.is_valid and len(found):
                flags = np.ones(len(words), np.uint8)
                pairs = found.values.flatten()
                for start, length in zip(pairs[0].to_pylist(), pairs[1].to_pylist(), strict=True):
                    flags[start : start + length] = 0
                kept = list(compress(words, flags.tobytes()))
            total.append(len(words))
            removed.append(len(words) - len(kept))
            left.append(b" ".join(kept))
        own = [c for c in batch.schema.names if c not in ("__pressed", "__spans")]
        more = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
        if text is not None:
            own, more = [*own, text], [pa.array(texts, pa.string()), *more]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in own if c in batch.schema.names] + more, names=[*own, *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__pressed", _SLICE // 2):
            yield part(batch)

    return frugal(cut)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, names: tuple[str, str, str] = ("n_words", "n_removed", "kept_text")) -> DataFrame:
    """docs with its number of words, of words removed, and the words that stay, joined by one space.

    Columns of docs with these names are replaced; the others stay. Null texts have no words; no rows give no rows.
    """
    keep = [c for c in docs.columns if c not in names]
    own_print = _print(docs)
    spans = factors(docs, window, anchor, own_print).groupBy("id", "print").agg(F.collect_list(F.struct("start", "length")).alias("__spans"))
    spans = spans.select(F.col("id").alias("__id"), F.col("print").alias("__print"), "__spans")
    text = "text" if "text" in keep and docs.schema["text"].dataType.simpleString() == "string" else None  # it travels once
    own = [F.col(f"`{c}`") for c in keep if c != text]
    rows = docs.select(*own, F.col("text").cast("string").alias("__text"), doc_key().alias("__key"), own_print.alias("__own"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "__text")
    rows = rows.mapInArrow(_pressed("__text"), f"{fields}__pressed binary")
    rows = rows.join(spans, (F.col("__key") == F.col("__id")) & (F.col("__own") == F.col("__print")), "left").drop("__key", "__own", "__id", "__print")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name not in ("__pressed", "__spans"))
    back = "`text` string, " if text else ""
    out = rows.mapInArrow(_cut_words(text, names), f"{fields}{back}`{names[0]}` long, `{names[1]}` long, `{names[2]}` string")
    return out.select(*[F.col(f"`{c}`") for c in (*keep, *names)])


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what remove_repeats returns."""
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

