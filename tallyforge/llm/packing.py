"""Best-fit packing of token pieces into sequences, with a swap-based local search between underfull bins.

What a packing needs of the corpus is how many pieces have each length, at most `capacity` numbers. The plan is made from
them on the driver: classes of bins with equal content and their counts, filled by best fit decreasing and improved by
moves and exchanges that raise the sum of squared fills, each done for all bins of a class at once, until none is left or
the number of bins is proven least. Its size follows the number of lengths, not of pieces. Pieces then find their place by
their rank among the pieces of their length; ranks are counted in salted groups, as many as a length needs, so a hot
length is spread over tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binaries, by_bytes, frugal, stored, trim

CAPACITY = 1024
#: Bytes of text that are encoded at once, characters of units that a task remembers, and units that outlast a task.
_SLICE, _REMEMBERED, _OUTLAST = 4 << 20, 5 << 20, 150_000
_DOUBLE, _BOUNDARY = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
#: A unit that ends in signs after a letter of Latin-1: the library's split always cuts there, so both parts are encoded alone.
_SIGNED = re.compile(r"(.*[A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)
#: Units that are encoded in one call, one after the other.
_JOINED = 1000


class _Numbers(dict):
    """Numbers of strings in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _gathered(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of source that begin at starts, one after the other."""
    return source[np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


class Encoder:
    """Texts -> uint32 ids as the tokenizers library gives them for a byte-level BPE file.

    With the usual split (letters, digits or signs with at most one space in front) no token crosses a space between two
    characters that are not white space, whatever stands around. So texts are cut there into units, each distinct unit
    is encoded once by the library and remembered for the task; those that were asked for most often outlast it. Texts with
    special strings are one unit, as are all texts if the file has another split.
    """

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        split = layout["pre_tokenizer"] or {}
        self.splits = not any(c.isspace() for s in self.special for c in s) and layout["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and not layout["model"].get("dropout")
        vocabulary = self.library.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a letter stands for each byte
        self.forget()

    def forget(self) -> None:
        self.number, self.held = _Numbers(), 0
        self.flat, self.start, self.size, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def thin(self, most: int = _OUTLAST) -> None:
        """Forgets all units but the `most` that were asked for most often, and those that were asked for once. Older uses count half."""
        at = np.argsort(-self.used, kind="stable")[:most]
        at = np.sort(at[self.used[at] > 1])
        units = list(self.number)
        number = _Numbers()
        number.update((units[u], i) for i, u in enumerate(at.tolist()))
        self.number, self.held = number, sum(map(len, number))
        sizes = self.size[at]
        self.flat = _gathered(self.flat, self.start[at], sizes)
        self.start, self.size, self.used = np.cumsum(sizes) - sizes, sizes, self.used[at] // 2 + 1

    def units(self, text: str) -> list[str]:
        """What follows each space that is cut at; a first one, before any such space, has a space in front instead."""
        if not self.splits or any(s in text for s in self.special):
            return [" " + text]
        found = _BOUNDARY.split(text) if _DOUBLE.search(text) else text.split(" ")
        found[0] = " " + found[0]
        return found

    def _learn(self, known: int) -> None:
        """ids of the units from this number on. A unit with signs at its end is its word and the signs: it brings only its word."""
        units = list(islice(self.number, known, None))
        parts = [None if u.isalpha() or not u or u[0] == " " else _SIGNED.fullmatch(u) for u in units]
        signed = [i for i, m in enumerate(parts) if m]
        words = np.fromiter((self.number[parts[i][1]] for i in signed), np.int64, len(signed))
        units += islice(self.number, known + len(units), None)  # words that were not asked for yet
        self.held += sum(map(len, units))
        starts, sizes = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        whole = np.ones(len(units), bool)
        whole[signed] = False
        at = np.flatnonzero(whole)
        starts[at], sizes[at] = self._encoded([units[i] for i in at.tolist()])
        self.start, self.size = np.concatenate((self.start, starts)), np.concatenate((self.size, sizes))
        self.used = np.concatenate((self.used, np.zeros(len(units), np.int64)))
        self.used += np.bincount(words, minlength=len(self.used))
        if not signed:
            return
        kinds = _Numbers()
        kind = np.fromiter((kinds[parts[i][2]] for i in signed), np.int64, len(signed))
        ends = [np.array(self.library.encode(k, add_special_tokens=False).ids, np.uint32) for k in kinds]
        lengths = np.array([len(x) for x in ends], np.int64)
        source = np.concatenate((self.flat, *ends))
        first = len(self.flat) + np.cumsum(lengths) - lengths
        ids = _gathered(source, np.stack((self.start[words], first[kind]), axis=1).ravel(), np.stack((self.size[words], lengths[kind]), axis=1).ravel())
        both = self.size[words] + lengths[kind]
        self.start[known + np.array(signed)], self.size[known + np.array(signed)] = len(self.flat) + np.cumsum(both) - both, both
        self.flat = np.concatenate((self.flat, ids))

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of units: regular ones, without white space at their ends, in rows; all others alone."""
        flat, sizes = [self.flat], np.zeros(len(units), np.int64)
        fit = np.fromiter((bool(u) and u[0] != " " and not u[-1].isspace() for u in units), bool, len(units))
        regular, others = np.flatnonzero(fit), np.flatnonzero(~fit)
        for k in range(0, len(regular), _JOINED):
            part = ["", *[units[i] for i in regular[k : k + _JOINED].tolist()]]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([1 + len(u.encode()) for u in part[1:]])
            sizes[regular[k : k + _JOINED]] = np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "left") + 1, prepend=0)
            flat.append(ids)
        alone = [u[1:] if u[:1] == " " else " " + u for u in (units[i] for i in others.tolist())]
        for i, found in zip(others.tolist(), self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            flat.append(np.array(found.ids, np.uint32))
            sizes[i] = len(found.ids)
        starts = np.empty(len(units), np.int64)
        order = np.concatenate((regular, others))
        starts[order] = len(self.flat) + np.cumsum(sizes[order]) - sizes[order]
        self.flat = np.concatenate(flat)
        return starts, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        if self.held > _REMEMBERED:
            self.thin()
        units, counts, known = [], [0], len(self.number)
        for text in texts:
            units += self.units(text)
            counts.append(len(units))
        at = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        if len(self.number) > known:
            self._learn(known)
        self.used += np.bincount(at, minlength=len(self.used))
        sizes = self.size[at]
        return _gathered(self.flat, self.start[at], sizes), np.concatenate(([0], np.cumsum(sizes)))[counts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """Token pieces of at most capacity tokens: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    Every document's ids end with end_id. A longer document is cut into full pieces from its end, so that only its
    first piece may be shorter. Null and empty texts are one piece that is only the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _SLICE):
            flat, first = encoder(tokenizer).encode([t or "" for t in batch.column(1).to_pylist()])
            sizes = np.diff(first) + 1
            ids = np.insert(flat, first[1:], np.uint32(end_id)).astype("<u4")
            counts = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = np.where(piece > 0, sizes[doc] - (counts[doc] - piece) * capacity, 0)
            length = np.where(piece > 0, capacity, sizes[doc] - (counts[doc] - 1) * capacity)
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), binaries(ids, np.concatenate(([0], np.cumsum(length))) * 4)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from frugal(cut)(batches)
        encoder(tokenizer).thin()
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        task, "doc_id long, piece int, start long, length long, ids binary"
    )


class Bins:
    """Classes of equal bins (the lengths in them, longest first) with their counts, by free room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_free: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        self.frees: list[int] = []

    def add(self, content: tuple[int, ...], count: int) -> None:
        if not content or not count:
            return
        free = self.capacity - sum(content)
        group = self.by_free[free]
        if not group:
            insort(self.frees, free)
        group[content] = group.get(content, 0) + count

    def take(self, content: tuple[int, ...], count: int) -> None:
        free = self.capacity - sum(content)
        group = self.by_free[free]
        group[content] -= count
        if not group[content]:
            del group[content]
            if not group:
                self.frees.remove(free)

    def tightest(self, length: int) -> tuple[tuple[int, ...], int] | None:
        at = bisect_left(self.frees, length)
        if at == len(self.frees):
            return None
        return next(iter(self.by_free[self.frees[at]].items()))

    def underfull(self) -> list[tuple[tuple[int, ...], int]]:
        """Emptiest first."""
        return [x for free in reversed(self.frees) if free for x in self.by_free[free].items()]

    def classes(self) -> list[tuple[tuple[int, ...], int]]:
        return [x for free in self.frees for x in sorted(self.by_free[free].items())]


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best fit decreasing over counted lengths: each length goes to the bins with the least room that hold it."""
    bins = Bins(capacity)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            found = bins.tightest(length)
            content, n = found or ((), left)
            each = min(left, (capacity - sum(content)) // length)
            n = min(n, left // each)
            if found:
                bins.take(content, n)
            bins.add(content + (length,) * each, n)
            left -= n * each
    return bins


@lru_cache(maxsize=1 << 16)
def _offers(content: tuple[int, ...]) -> tuple[list[tuple[int, tuple[int, ...]]], list[tuple[int, tuple[int, ...]]]]:
    """(sum, lengths) of each single length and of each pair of a bin's content, by sum."""
    kinds = sorted(set(content))
    pairs = {a + b: (a, b) for i, a in enumerate(kinds) for b in kinds[i:] if a != b or content.count(a) > 1}
    return [(x, (x,)) for x in kinds], sorted(pairs.items())


def _exchange(giver: tuple[int, ...], taker: tuple[int, ...], room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """(lengths that leave the giver, lengths that leave the taker) raising the taker's fill most, by at most its room.

    One or two lengths go for none, one or (one only) for two.
    """
    best, gain = None, 0
    singles, pairs = _offers(giver)
    own, own_pairs = _offers(taker)
    for outs, backs in ((singles, [(0, ()), *own]), (pairs, [(0, ()), *own]), (singles, own_pairs)):
        for y, back in backs:
            at = bisect_right(outs, y + room, key=lambda o: o[0]) - 1
            if at >= 0 and outs[at][0] - y > gain:
                best, gain = (outs[at][1], back), outs[at][0] - y
                if gain == room:
                    return best
    return best


def _without(content: tuple[int, ...], gone: tuple[int, ...], new: tuple[int, ...]) -> tuple[int, ...]:
    rest = list(content)
    for x in gone:
        rest.remove(x)
    return tuple(sorted(rest + list(new), reverse=True))


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A number of bins that no packing beats (Martello and Toth's second bound; it includes the bound by tokens)."""
    lengths = sorted(counts)
    total = sum(x * n for x, n in counts.items())
    best = -(-total // capacity)
    for low in [0, *(x for x in lengths if 2 * x <= capacity)]:
        large = sum(counts[x] for x in lengths if x > capacity - low)
        middle = {x: counts[x] for x in lengths if capacity < 2 * x and x <= capacity - low}
        small = sum(x * counts[x] for x in lengths if low <= x and 2 * x <= capacity)
        spare = sum((capacity - x) * n for x, n in middle.items())
        best = max(best, large + sum(middle.values()) + max(0, -(-(small - spare) // capacity)))
    return best


def local_search(bins: Bins, least: int = 0) -> Bins:
    """Moves and one-for-one and two-for-one exchanges from emptier to fuller underfull bins.

    Each raises the sum of squared fills, so the search ends: when no pair of classes has an exchange left, or when there
    are only `least` bins. Emptied bins vanish. An agenda holds pairs of classes, emptiest giver and fullest taker first;
    a class that is new meets all others, a pair that has nothing to exchange is never tried again.
    """
    fill: Callable[[tuple[int, ...]], int] = sum
    stuck: set[tuple] = set()
    left = sum(n for _, n in bins.classes())
    there = dict(bins.underfull())

    def meeting(content: tuple[int, ...], other: tuple[int, ...]) -> tuple:
        giver, taker = (content, other) if fill(content) <= fill(other) else (other, content)
        return fill(giver), -fill(taker), giver, taker

    contents = list(there)
    agenda = [meeting(x, y) for i, x in enumerate(contents) for y in contents[i:]]
    heapify(agenda)

    def enter(content: tuple[int, ...], count: int) -> None:
        bins.add(content, count)
        if not content or fill(content) == bins.capacity:
            return
        new = content not in there
        there[content] = there.get(content, 0) + count
        for other in there if new else (content,):
            pair = meeting(content, other)
            if pair[2:] not in stuck:
                heappush(agenda, pair)

    def leave(content: tuple[int, ...], count: int) -> None:
        bins.take(content, count)
        there[content] -= count
        if not there[content]:
            del there[content]

    while agenda and left > least:
        _, _, giver, taker = heappop(agenda)
        n, m = there.get(giver, 0), there.get(taker, 0)
        if not n or not m or (giver == taker and n < 2) or (giver, taker) in stuck:
            continue
        step = _exchange(giver, taker, bins.capacity - fill(taker))
        if step is None:
            stuck.add((giver, taker))
            continue
        count = n // 2 if taker == giver else min(n, m)
        rest = _without(giver, step[0], step[1])
        leave(giver, count)
        leave(taker, count)
        enter(rest, count)
        enter(_without(taker, step[1], step[0]), count)
        left -= 0 if rest else count
        if there.get(giver) and there.get(taker):  # some of both are left when their numbers were odd
            heappush(agenda, meeting(giver, taker))
    return bins


def _places(bins: Bins) -> dict[str, np.ndarray]:
    """For each length, intervals of ranks: (length, first rank) -> first sequence, offset in the sequence."""
    seen: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for content, count in bins.classes():
        at = 0
        for length in content:
            rows.append((length, seen[length], base, at))
            seen[length] += count
            at += length
        base += count
    rows.sort()
    length, rank, first, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return {"key": (length << 44) + rank, "rank": rank, "first": first, "offset": offset}


#: Pieces of a length that are ranked in one group on average.
_RANKED = 1024


def plan(counts: dict[int, int], capacity: int) -> Bins:
    return local_search(best_fit(counts, capacity), least_bins(counts, capacity))


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, start, length and any other columns) with sequence_id and offset.

    Sequences hold at most capacity tokens and have no gaps; sequence_id is any number. Lengths must be 1 to capacity.
    Rows that repeat are packed as often as they come; no rows give no rows. Columns named __* are the operator's own.

    The driver holds a count for each length and the plan, one number four times for each length in a class of bins: best
    fit makes at most two classes for each length, and each exchange of the search adds one at most.
    """
    rows = stored(rows, "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    places = rows.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))
    salts = F.element_at(F.lit([-(-counts.get(x, 1) // _RANKED) for x in range(1, capacity + 1)]), F.col("length").cast("int"))
    others = [c for c in rows.columns if c not in ("length", "ids")]
    keyed = rows.withColumn("__salt", F.pmod(F.xxhash64(*others), salts))
    sizes = stored(keyed.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")), "sizes")
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__salt").orderBy(*[F.col(f"`{c}`") for c in others])
    ranked = keyed.withColumn("__row", F.row_number().over(within)).join(starts, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__row") - 1).select(*[F.col(f"`{c}`") for c in rows.columns], "__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = places.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(held["key"], (length << 44) + rank, "right") - 1
            own = [batch.column(c) for c in batch.schema.names if c != "__rank"]
            names = [c for c in batch.schema.names if c != "__rank"]
            more = [pa.array(held["first"][at] + rank - held["rank"][at]), pa.array(held["offset"][at])]
            yield pa.RecordBatch.from_arrays(own + more, names=names + ["sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, in place order, from packed pieces that carry ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    return joined.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"))
