"""SentencePiece encoding and decoding for merge-type vocabularies, from a score-ordered agenda of adjacent pairs.

A text falls into chunks that start at a space after another character. No piece has a space inside other characters,
so no merge crosses a chunk's start and equal chunks are encoded once per slice. The agenda holds, for every chunk, its
adjacent symbol pairs that form a piece; in each round every chunk takes its pair of highest score, the leftmost among
equals, merges it and enters the two new pairs, until no chunk has a pair left. Rounds run over all chunks of a slice at
once with numpy; a chunk of more than 256 symbols would need as many rounds and has an agenda of its own, a heap, which
takes n log n steps and some 100 bytes for each of its n symbols. Every Arrow batch is checked against the sentencepiece library: each distinct chunk's ids, and each
text's normal form, which must be the text with marked spaces. As no piece crosses a chunk's start, both give the whole
text's ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, strings
from .token_counts import SPACE, processor
from .words import span_hashes

_SLICE = 3 << 20
_STEP = 0xC2B2AE3D27D4EB4F
_SLOT_BITS = 20
_LOWEST = np.float64(-np.inf)
#: Symbols of a chunk that is merged in rounds with the others.
_SHORT = 256


class Vocabulary:
    """What the agenda needs of a model: symbols of characters, pairs that merge with their scores, and bytes."""

    def __init__(self, path: str):
        model = processor(path)
        self.model, n = model, model.get_piece_size()
        kinds = [(model.is_byte(i), model.is_control(i) or model.is_unknown(i)) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        if any(model.is_unused(i) for i in range(n)) or any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("the vocabulary has unused pieces or spaces inside pieces")
        symbols = {p: i for i, p in enumerate(names) if not any(kinds[i])}
        self.first_byte = next(i for i in range(n) if kinds[i][0])
        for p in list(symbols):
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.known = n
        pairs = {}
        for p, i in list(symbols.items()):
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = (i, model.get_score(i))
        keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k][0] for k in keys.tolist()] + [-1], np.int64)
        self.pair_scores = np.array([pairs[k][1] for k in keys.tolist()] + [_LOWEST], np.float64)
        # open addressing, at most an eighth full: slot -> key and its number; the last number stands for no pair
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int64)
        self.numbers = np.full(1 << _SLOT_BITS, len(keys), np.int64)
        for number, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & (len(self.slots) - 1)
            self.slots[slot], self.numbers[slot] = key, number
        chars = {ord(p): i for p, i in symbols.items() if len(p) == 1}
        self.char_codes = np.array(sorted(chars), np.int64)
        self.char_ids = np.array([chars[c] for c in sorted(chars)], np.int64)
        spelled = [b"" if kinds[i][1] else bytes([i - self.first_byte]) if kinds[i][0] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate(([0], np.cumsum([len(s) for s in spelled])))

    @cached_property
    def turns(self) -> dict[int, int]:
        """For each pair (left << 24 | right) its turn by score, the highest first, << 32 | its piece."""
        scores = self.pair_scores[:-1]
        turn = np.searchsorted(np.unique(-scores), -scores)
        stored = np.flatnonzero(self.slots >= 0)
        keys, numbers = self.slots[stored].tolist(), self.numbers[stored]
        return dict(zip(keys, (turn[numbers] << 32 | self.pair_ids[numbers]).tolist(), strict=True))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbol of each code point; one without is its own symbol, that nothing merges with."""
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        return np.where(self.char_codes[at] == codes, self.char_ids[at], codes + (1 << 22))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_STEP)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and score of each pair; -1 where the two form none."""
        keys = left << 24 | right
        slot = self._slot(keys)
        there = self.slots[slot]
        number = np.where(there == keys, self.numbers[slot], len(self.pair_ids) - 1)
        odd = np.flatnonzero((there != keys) & (there >= 0))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & (len(self.slots) - 1)
            there = self.slots[slot[odd]]
            hit = there == keys[odd]
            number[odd[hit]] = self.numbers[slot[odd[hit]]]
            odd = odd[~hit & (there >= 0)]
        return self.pair_ids[number], self.pair_scores[number]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def long_agenda(vocab: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Symbols of one long chunk merged to their end. The heap holds turn << 40 | place of the left symbol."""
    turns, n = vocab.turns, len(symbols)
    known = vocab.merged(symbols[:-1], symbols[1:])[0] >= 0
    held = symbols.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(turns[held[i] << 24 | held[i + 1]] >> 32) << 40 | i for i in np.flatnonzero(known).tolist()]
    heapify(heap)
    place_of = (1 << 40) - 1
    while heap:
        entry = heappop(heap)
        i = entry & place_of
        j = after[i]
        if held[i] < 0 or j >= n:
            continue
        found = turns.get(held[i] << 24 | held[j], -1)
        if found < 0 or found >> 32 != entry >> 40:  # one of the two has been merged since
            continue
        held[i], held[j] = found & 0xFFFFFFFF, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (new := turns.get(held[i] << 24 | held[k], -1)) >= 0:
                heappush(heap, (new >> 32) << 40 | i)
        if (k := before[i]) >= 0 and (new := turns.get(held[k] << 24 | held[i], -1)) >= 0:
            heappush(heap, (new >> 32) << 40 | k)
    out = np.array(held, np.int64)
    return out[out >= 0]


def agenda(vocab: Vocabulary, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of chunks (first: where each starts, and the end) merged to their end; the same two of the result."""
    sizes = np.diff(first)
    large = np.flatnonzero(sizes > _SHORT)
    if not len(large):
        return _rounds(vocab, symbols, first)
    small = np.flatnonzero(sizes <= _SHORT)
    done, cuts = _rounds(vocab, _gather(symbols, first[small], sizes[small]), np.concatenate(([0], np.cumsum(sizes[small]))))
    merged = [long_agenda(vocab, symbols[first[c] : first[c + 1]]) for c in large.tolist()]
    new = np.empty(len(sizes), np.int64)
    new[small], new[large] = np.diff(cuts), [len(m) for m in merged]
    ends = np.cumsum(new)
    out = np.empty(int(ends[-1]), np.int64)
    out[np.arange(len(done)) + np.repeat((ends - new)[small] - cuts[:-1], new[small])] = done
    for c, m in zip(large.tolist(), merged, strict=True):
        out[ends[c] - new[c] : ends[c]] = m
    return out, np.concatenate(([0], ends))


def _rounds(vocab: Vocabulary, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """agenda() of short chunks, one merge of each in a round."""
    n = len(symbols)
    chunk = np.repeat(np.arange(len(first) - 1), np.diff(first))
    symbols, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
    after[first[1:] - 1] = -1
    before[first[:-1]] = -1
    alive = np.ones(n, bool)
    has = np.flatnonzero(after >= 0)
    pair, score = np.full(n, -1, np.int64), np.full(n, _LOWEST)
    pair[has], score[has] = vocab.merged(symbols[has], symbols[after[has]])
    open_at = np.flatnonzero(pair >= 0)  # the agenda: left symbols of pairs, chunk by chunk
    listed = pair >= 0
    while len(open_at):
        owner = chunk[open_at]
        head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        values = score[open_at]
        best = np.maximum.reduceat(values, head)
        top = np.flatnonzero(values == np.repeat(best, np.diff(np.append(head, len(owner)))))
        top = top[np.concatenate(([True], owner[top[1:]] != owner[top[:-1]]))]  # the leftmost of equals
        left = open_at[top]
        right = after[left]
        symbols[left] = pair[left]
        alive[right] = False
        pair[right] = -1
        after[left] = after[right]
        following = left[after[left] >= 0]
        before[after[following]] = following
        pair[left], score[left] = -1, _LOWEST
        pair[following], score[following] = vocab.merged(symbols[following], symbols[after[following]])
        leading = before[left[before[left] >= 0]]
        pair[leading], score[leading] = vocab.merged(symbols[leading], symbols[after[leading]])
        new = leading[(pair[leading] >= 0) & ~listed[leading]]
        stays = pair[open_at] >= 0
        listed[open_at[~stays]] = False
        open_at = open_at[stays]
        if len(new):
            listed[new] = True
            open_at = np.insert(open_at, np.searchsorted(open_at, new), new)
    kept = np.flatnonzero(alive)
    return symbols[kept], np.searchsorted(kept, first, "left")


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] one after the other."""
    total = int(sizes.sum())
    return values[np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


def encode(vocab: Vocabulary, offsets: np.ndarray, data: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, first id of each text, texts with a chunk for which the library has other ids)."""
    filled = np.diff(offsets) > 0
    sizes = np.diff(offsets) + filled
    at = np.concatenate(([0], np.cumsum(sizes)))
    text = np.full(at[-1], 0x20, np.uint8)
    text[np.arange(len(data)) + np.repeat(at[:-1] + filled - offsets[:-1], np.diff(offsets))] = data
    blank = text == 0x20
    begins = np.zeros(len(text), bool)
    begins[1:] = blank[1:] & ~blank[:-1]
    begins[at[:-1][filled]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(text))
    (keys,) = span_hashes(text, end - start)
    _, one, which = np.unique(keys, return_index=True, return_inverse=True)
    raw = _gather(text, start[one], (end - start)[one])
    cuts = np.concatenate(([0], np.cumsum((end - start)[one])))
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
    leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    codes[codes == 0x20] = ord(SPACE)
    symbols, first = agenda(vocab, vocab.symbols(codes), leads[cuts])
    ids, first = _with_bytes(vocab, symbols, first)
    wrong = _differing(vocab, raw, cuts, ids, first)
    counts = np.diff(first)[which]
    out = _gather(ids, first[:-1][which], counts)
    per_text = np.searchsorted(start, at, "left")
    odd = np.zeros(len(sizes), bool)
    if len(wrong):
        odd[np.searchsorted(at, start[np.isin(which, wrong)], "right") - 1] = True
    token_at = np.concatenate(([0], np.cumsum(counts)))[per_text]
    if end_id is not None:
        out = np.insert(out, token_at[1:], end_id)
        token_at = token_at + np.arange(len(token_at))
    return out, token_at, odd


def _differing(vocab: Vocabulary, raw: np.ndarray, cuts: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct chunks for which the library gives other ids. Its own space in front takes the place of a chunk's first."""
    blob = raw.tobytes()
    at = cuts.tolist()
    found = vocab.model.encode([blob[i + 1 : j].decode() for i, j in zip(at, at[1:], strict=False)], num_threads=1, return_type="numpy") if len(at) > 1 else []
    if (alone := np.flatnonzero(np.diff(cuts) == 1)).size:  # a space at a text's end, without which nothing is left
        found[int(alone[0])] = np.array([vocab.model.piece_to_id(SPACE)])
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    own = np.diff(first)
    bad = np.flatnonzero(sizes != own)
    if not len(bad):
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        bad = np.unique(np.searchsorted(first, np.flatnonzero(flat != ids), "right") - 1)
    else:
        bad = np.array([k for k, x in enumerate(found) if len(x) != own[k] or (x != ids[first[k] : first[k + 1]]).any()], np.int64)
    return bad


def _with_bytes(vocab: Vocabulary, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are no pieces become the ids of their bytes."""
    odd = np.flatnonzero(symbols >= vocab.known)
    if not len(odd):
        return symbols, first
    names = {int(i): int(c) for c, i in zip(vocab.char_codes, vocab.char_ids, strict=True) if i >= vocab.known}
    spelled = [chr(names.get(s, s - (1 << 22))).encode() for s in symbols[odd].tolist()]
    sizes = np.ones(len(symbols), np.int64)
    sizes[odd] = [len(b) for b in spelled]
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.repeat(symbols, sizes)
    places = np.repeat(at[:-1][odd], sizes[odd]) + np.concatenate([np.arange(len(b)) for b in spelled])
    out[places] = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64) + vocab.first_byte
    return out, at[first]


def decode(vocab: Vocabulary, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """Texts of the ids: pieces with spaces for their marks, bytes joined, the space in front dropped."""
    sizes = np.diff(vocab.spelled_at)[ids]
    raw = _gather(vocab.spelled, vocab.spelled_at[ids], sizes).tobytes()
    at = np.concatenate(([0], np.cumsum(sizes)))[first].tolist()
    return [raw[i + raw.startswith(b" ", i, j) : j].decode("utf-8", "replace") for i, j in zip(at, at[1:], strict=False)]


def _code(path: str, end_id: int | None):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            offsets, data = strings(batch.column(1))
            for i, j in slices(offsets, _SLICE):
                given = ["" if t is None else t for t in batch.column(1).slice(i, j - i).to_pylist()]
                own_at, own = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                if any(SPACE in t for t in given):  # the mark itself is a space to the library
                    given = [t.replace(SPACE, " ") for t in given]
                    own_at, own = strings(pa.array(given, pa.string()))
                ids, first, odd = encode(vocab, own_at, own, end_id)
                texts = decode(vocab, ids, first)
                odd |= np.array([a != b for a, b in zip(texts, given, strict=True)], bool)
                odd |= np.array([bool(t) and m != SPACE + t.replace(" ", SPACE) for m, t in zip(vocab.model.normalize(given), given, strict=True)], bool)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                if odd.any():
                    lists, texts = _from_library(vocab.model, batch.column(1).slice(i, j - i), lists, texts, odd, end_id)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(texts, pa.string()), pa.array(odd)], names=["doc_id", "ids", "decoded", "from_library"])

    return frugal(code)


def _from_library(model, column: pa.Array, lists: pa.Array, texts: list[str], odd: np.ndarray, end_id: int | None):
    """The library's answer for the texts whose check failed."""
    own, given = lists.to_pylist(), column.to_pylist()
    for k in np.flatnonzero(odd).tolist():
        own[k] = model.encode(given[k] or "") + ([] if end_id is None else [end_id])
        texts[k] = model.decode(own[k])
    return pa.array(own, pa.list_(pa.int32())), texts


def code_texts(docs: DataFrame, model: str, end_id: int | None = 2) -> DataFrame:
    """doc_id, ids (with end_id at the end), decoded (the text that the ids give) and from_library.

    ids and decoded are exactly the library's; from_library marks texts for which the agenda's answer differed and was
    replaced. Null counts as empty, which is the end id alone. Nulls in other columns, repeated rows and further columns
    change nothing; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_code(model, end_id), "doc_id long, ids array<int>, decoded string, from_library boolean")


def digest(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what code_texts returns."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "from_library",
    )
