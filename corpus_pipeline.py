"""The corpus pipeline: language ID, exact dedup, near-dedup, substring dedup and packing, one stage after the other.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last return the
columns of documents. run() writes each stage's documents as Parquet to the shared scratch folder and reads them again; a
stage's documents are deleted when the next one's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import exact_dedup, language_id, near_dedup, packing, substring_dedup
from tallyforge.llm.common import at_workers, doc_key, released, spread, stored, table
from tallyforge.llm.queries import tokenizer_path


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty or without letters: `und`) go; a null lang takes the prediction.

    Where no document is labelled, nothing can be learned: then only documents without letters go.
    """
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.identify(docs, model, docs.columns, names=("__language", "__sure")).where(F.col("__language") != language_id.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "__language")).select(*_own(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays."""
    keep = near_dedup.near_groups(docs).where("kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__kept")).distinct()
    return docs.join(keep, doc_key() == F.col("__kept"), "left_semi").select(*_own(docs))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a text that has none stays as it is, to the byte. A text with no words left goes."""
    cut = substring_dedup.remove_repeats(docs, names=("__words", "__removed", "__text_kept"))
    changed = F.col("__removed") > 0
    cut = cut.where(~changed | (F.col("__text_kept") != ""))
    cut = cut.withColumn("text", F.when(changed, F.col("__text_kept")).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*_own(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their place in sequences of at most 1024 tokens."""
    placed = packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json")))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def _stage(work):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return work(at_workers(spark), docs, sf_dir)

    return run_stage


STAGES = [(name, _stage(work)) for name, work in (("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substring), ("best_fit_packing", packed))]

#: The fitted language model and packing can't be expressed in SQL; tests compare the stages with brute force. The three
#: dedup stages in a row are the query dedup_stages, which has SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        released(last)
    return STAGES[-1][1](spark, docs, sf_dir)
