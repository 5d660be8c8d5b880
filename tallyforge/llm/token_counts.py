"""Token counts of whole texts, with huge documents encoded in overlapping chunks that are spliced where both agree.

A boundary between two characters is proven stable when no piece of the vocabulary contains the two side by side: no
merge can ever cross it, so what stands before and after is encoded independently. Neighbouring chunks are spliced at
such a boundary inside their overlap, at which both encodings must also end a token. Where the overlap has none, it is
doubled until it has, at worst up to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, frugal

LIMIT = 4096
#: Characters of a chunk and of the first overlap; longer texts than a chunk are encoded in chunks.
CHUNK, OVERLAP = 16384, 256
SPACE = "▁"


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def inner_pairs(path: str) -> frozenset[str]:
    """Every two characters that stand side by side in a piece of the vocabulary."""
    model = processor(path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i))
    return frozenset(p[i : i + 2] for p in names for i in range(len(p) - 1))


def _ends(model, text: str) -> np.ndarray:
    """The offset at which each token ends, in characters of the text."""
    offsets = model.encode(text, return_type="offset_mapping")["offsets"]
    return np.fromiter((end for _, end in offsets), np.int64, len(offsets))


def _boundary(text: str, pairs: frozenset[str], ends: np.ndarray, more: np.ndarray, low: int, high: int) -> int | None:
    """The last offset between low and high at which both encodings end a token and that no piece can cross."""
    both = np.intersect1d(ends[(ends > low) & (ends < high)], more)
    for p in both[::-1].tolist():
        if text[p - 1 : p + 1].replace(" ", SPACE) not in pairs:
            return p
    return None


def count_chunked(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens that the library gives for the whole text, found chunk by chunk.

    Tokens of a chunk count up to the splice. The next chunk starts `width` characters before this one's end, so that its
    own start, where the library puts a space, lies before the splice.
    """
    model, pairs = processor(path), inner_pairs(path)
    total, splice, begin, size = 0, -1, 0, chunk
    end = min(len(text), size)
    ends = _ends(model, text[:end])
    while end < len(text):
        width, found = overlap, None
        while found is None:
            next_begin = max(splice, begin, end - width)
            next_end = min(len(text), next_begin + size + width)
            more = _ends(model, text[next_begin:next_end]) + next_begin
            found = _boundary(text, pairs, ends, more, next_begin, end)
            if found is None and next_begin <= max(splice, begin):
                break
            width *= 2
        if found is None:  # nothing to splice at in the whole chunk: a longer one
            size *= 2
            end = min(len(text), end + size)
            ends = _ends(model, text[begin:end]) + begin
            continue
        total += int(((ends > splice) & (ends <= found)).sum())
        splice, begin, end, ends, size = found, next_begin, next_end, more, chunk
    return total + int((ends > splice).sum())


def plain(model, text: str) -> bool:
    """True if the model's normaliser only marks spaces, so that offsets in the text are offsets in what is encoded."""
    return model.normalize(text) == SPACE + text.replace(" ", SPACE)


def normal(model, text: str) -> str:
    """A text with the same tokens that the normaliser leaves alone, as far as there is one."""
    return text if plain(model, text) else model.normalize(text).removeprefix(SPACE).replace(SPACE, " ")


def _count(path: str, chunk: int, overlap: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = processor(path)
        for batch in by_bytes(batches, "text", 4 << 20):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            out = np.zeros(len(texts), np.int64)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for k in range(0, len(short), 256):
                part = short[k : k + 256]
                out[part] = [len(x) for x in model.encode([texts[i] for i in part], num_threads=1, return_type="numpy")]
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    t = normal(model, t)
                    out[i] = count_chunked(path, t, chunk, overlap) if plain(model, t) else len(model.encode(t))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 2)), pa.array(out)], names=["doc_id", "n_bytes", "n_tokens"])

    return frugal(count)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, as the library counts whole texts.

    Special strings inside texts are text, as is the library's default. Null counts as empty: no bytes, no tokens. Nulls
    in other columns, repeated rows and further columns change nothing; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(_count(model, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
