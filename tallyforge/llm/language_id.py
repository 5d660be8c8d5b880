"""Language identification by string kernels.

Two texts are compared by the character n-grams that occur in both (blended spectrum of orders 1 to 3, presence only):
for each order the number of shared n-grams over the root of the product of their numbers, averaged over orders. The
kernel is approximated from landmark texts (Nystroem) and one ridge regression for each language against the rest is
fitted on it. As the kernel is linear in the n-gram indicators, landmarks and regression fold into one weight per n-gram
and language, and a batch of texts is scored by one matrix product for each order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, frugal, trim

UNDETERMINED = "und"
#: Rows that are learned from, at most: of each language and in all; and how many of them are landmarks. The bounds of the
#: labelled sample are parameters of train(); everything that is not fitted reads all rows.
PER_LANGUAGE, SAMPLE, LANDMARKS = 200, 2048, 256
RIDGE = 0.01
#: log2 of the number of slots that n-grams of order 1, 2, 3 are hashed to.
BITS = (12, 14, 16)
_EDGES = np.concatenate(([0], np.cumsum([1 << b for b in BITS])))
_BATCH = 32
#: Landmarks and slots that are numbers at a time while the driver fits.
_MARKS, _SLOTS = 64, 4096
#: Bytes of text that are unpacked at once.
_SLICE = 2 << 20


def indicators(text: str) -> np.ndarray:
    """Which slots the n-grams of the whole text fall in."""
    out = np.zeros(_EDGES[-1], bool)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32) * np.uint32(0x9E3779B1)
    gram = codes
    for k, bits in enumerate(BITS):
        if k:
            gram = gram[:-1] * np.uint32(0x85EBCA77) + codes[k:]
        mixed = gram ^ (gram >> np.uint32(15))
        out[_EDGES[k] + ((mixed * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - bits))] = True
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _parts(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the indicators as float32 and the root of their number, at least 1."""
    out = []
    for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True):
        x = rows[:, a:b].astype(np.float32)
        out.append((x, np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))))
    return out


@dataclass
class Model:
    """languages and, for each slot, a weight for each of them: len(languages) * 86,016 numbers of 4 bytes."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        parts = _parts(rows)
        return sum(x @ self.weights[a:b] / root for (x, root), a, b in zip(parts, _EDGES[:-1], _EDGES[1:], strict=True)) / len(BITS)


def _unpacked(rows: np.ndarray) -> np.ndarray:
    """Indicators, which may be packed to bits."""
    return rows if rows.dtype == bool else np.unpackbits(rows, axis=1).view(bool)


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Both may be packed. Only two blocks of them are numbers at a time; their products are whole, so blocks change nothing."""
    out = np.zeros((len(rows), len(landmarks)), np.float64)
    for i in range(0, len(landmarks), _MARKS):
        marks = _parts(_unpacked(landmarks[i : i + _MARKS]))
        for k in range(0, len(rows), _BATCH):
            for (x, root), (y, other) in zip(_parts(_unpacked(rows[k : k + _BATCH])), marks, strict=True):
                out[k : k + _BATCH, i : i + _MARKS] += (x @ y.T) / (root * other.T)
    return out / len(BITS)


def _folded(marks: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Each slot's weights: the landmarks' own, summed over those that have the slot."""
    rows, out = _unpacked(marks), []
    for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True):
        root = np.sqrt(np.maximum(rows[:, a:b].sum(axis=1, keepdims=True, dtype=np.float32), 1))
        out += [(rows[:, i : min(i + _SLOTS, b)].astype(np.float32) / root).T @ alpha for i in range(a, b, _SLOTS)]
    return np.concatenate(out)


def fit(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """rows: indicators of the sample, which may be packed to bits; the landmarks first."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((_EDGES[-1], 0), np.float32))
    marks = rows[:landmarks]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = kernel(rows, marks) @ root
    target = np.array([[1.0 if x == y else -1.0 for y in languages] for x in labels])
    w = np.linalg.solve(z.T @ z + ridge * len(rows) * np.eye(z.shape[1]), z.T @ target)
    alpha = (root @ w).astype(np.float32)
    return Model(languages, _folded(marks, alpha).astype(np.float32))


def held_out():
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@frugal
def _indicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", _SLICE):
        packed = [np.packbits(indicators(t)).tobytes() if has_letter(t) else None for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "print", "lang", "turn")), pa.array(packed, pa.binary())], names=["doc_id", "print", "lang", "turn", "slots"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Learns from at most per_language labelled rows of each language and at most `sample` in all, in hash order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out()).withColumn("print", F.xxhash64("text", "lang"))
    drawn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "print"), "doc_id")
    chosen = rows.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "print", "lang").withColumn("turn", F.row_number().over(drawn)).where(F.col("turn") <= per_language)
    chosen = chosen.orderBy("turn", "lang", "doc_id").limit(sample).select("doc_id", "print", "turn").collect()  # at most `sample` rows
    if not chosen:
        return fit(np.zeros((0, int(_EDGES[-1])), bool), [])
    keys = docs.sparkSession.createDataFrame(chosen, "doc_id long, print long, turn int")
    found = rows.join(F.broadcast(keys), ["doc_id", "print"]).select("doc_id", "print", "lang", "turn", "text")
    found = found.mapInArrow(_indicate, "doc_id long, print long, lang string, turn int, slots binary").where("slots is not null")
    got = found.groupBy("doc_id", "print").agg(F.min(F.struct("turn", "lang", "slots")).alias("x")).select("x.*", "doc_id").toArrow().to_pylist()
    model = _learned(got, landmarks)
    trim()
    return model


def _learned(got: list[dict], landmarks: int = LANDMARKS) -> Model:
    """From turn, lang, doc_id and packed indicators of the chosen rows; they stay packed, 10,752 bytes a row."""
    got = sorted(got, key=lambda r: (r["turn"], r["lang"], r["doc_id"]))
    slots = np.frombuffer(b"".join(r["slots"] for r in got), np.uint8).reshape(len(got), int(_EDGES[-1]) // 8)
    return fit(slots, [r["lang"] for r in got], landmarks)


def _predict(shared, text: str, names: tuple[str, str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in by_bytes(batches, text, _SLICE):
            texts = batch.column(text).to_pylist()
            found, sure = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
            for k in range(0, len(at), _BATCH):
                part = at[k : k + _BATCH]
                scores = model.scores(np.array([indicators(texts[i]) for i in part]))
                for i, best, row in zip(part, scores.argmax(axis=1).tolist(), scores, strict=True):
                    found[i], sure[i] = model.languages[best], min(1.0, max(0.0, (float(row[best]) + 1) / 2))
            own = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=[*own, *names])

    return frugal(predict)


def identify(docs: DataFrame, model: Model, columns: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The named columns of docs with the predicted language and its score (0 to 1). Only the text is an input.

    A text that is null, empty or without letters is `und` with score 0, as is every text if no row was learned from.
    Columns with the two names are replaced.
    """
    own = [c for c in columns if c not in names]
    text = "text" if "text" in own else "__text"  # it travels once
    rows = docs.select(*[F.col(f"`{c}`") for c in own], *([] if text in own else [F.col("text").alias(text)]))
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in own)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see Model
    return rows.mapInArrow(_predict(shared, text, names), f"{fields}`{names[0]}` string, `{names[1]}` double")
