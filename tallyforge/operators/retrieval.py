"""Token-overlap retrieval over a corpus DataFrame, scored with array functions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import constants
from ..plans.lineage_data import FOCUS, LAYER_SECTIONS, METRIC_ALIASES, NODES, PREAMBLE, SECTION_ALIASES, STOP_WORDS
from . import lineage


def tokens(text: Column) -> Column:
    """Distinct latin words of two letters or more, runs of Han characters and their pairs, without stop words."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)")), lambda w: F.length(w) > 1)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    han = F.array_except(F.regexp_extract_all(text, F.lit("([\\x{4e00}-\\x{9fff}]+)")), stop)
    pairs = F.flatten(F.transform(han, lambda r: F.when(F.length(r) >= 2, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.array_except(F.array_distinct(F.concat(words, han, pairs)), stop)


def search(corpus: DataFrame, question: str, k: int = 5) -> DataFrame:
    """The k best chunks (id, object, kind, title, text, score), ties by id. corpus: id, object, kind, title, text, aliases.

    Two points for each alias in the question (an empty one names nothing), 1.5 for the title, and shared tokens over the
    root of the question's.
    """
    question = (question or "").strip()
    low = F.lit(question.lower())
    asked = tokens(F.lit(question))
    own = tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    named = F.size(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: (a != "") & F.contains(low, F.lower(a)))) * 2.0
    titled = F.when((F.length("title") > 0) & F.contains(low, F.lower("title")), 1.5).otherwise(0.0)
    shared = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, own)).cast("double"), F.sqrt(F.size(asked))), F.lit(0.0))
    scored = corpus.withColumn("score", F.round(named + titled + shared, 4)).where(F.lit(bool(question)) & (F.col("score") > 0))
    return scored.select("id", "object", "kind", "title", "text", "score").orderBy(F.desc("score"), "id").limit(k)


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as a corpus: what stands before the first `## ` heading, and every section under one.

    Empty openings and headings without a name are left out; a heading's further names come from SECTION_ALIASES.
    """
    layers = F.array(*[F.lit(x) for x in LAYER_SECTIONS])
    aliases = F.from_json(F.lit(json.dumps(SECTION_ALIASES, ensure_ascii=False)), "map<string,array<string>>")
    parts = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^## ")).alias("at", "part"))
    heading = F.trim(F.regexp_extract("part", r"^([^\r\n]*)", 1))
    named = parts.select(
        F.when(F.col("at") == 0, PREAMBLE).otherwise(heading).alias("title"),
        F.regexp_replace(F.when(F.col("at") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"^[^\r\n]*", "")), r"^\s+|\s+$", "").alias("text"), "at",
    ).where((F.length("title") > 0) & ((F.col("at") > 0) | (F.length("text") > 0)))
    own = F.when(F.col("at") > 0, F.array("title")).otherwise(F.array().cast("array<string>"))
    return named.select(
        F.concat(F.lit("doc:"), "title").alias("id"), F.when(F.array_contains(layers, F.col("title")), "doc.分层").otherwise("doc.口径").alias("object"), F.lit("doc").alias("kind"), "title", "text",
        F.array_distinct(F.concat(own, F.coalesce(F.try_element_at(aliases, F.col("title")), F.array().cast("array<string>")))).alias("aliases"),
    )


def chunks(spark: SparkSession, documents: DataFrame | None = None) -> DataFrame:
    """Metric definitions and lineage nodes as a corpus, and documents as sections() gives them."""
    rows = []
    for key, (name, definition, grain) in constants.METRICS.items():
        text = f"{definition.rstrip('。.')} 粒度 {grain}。owner {constants.METRIC_OWNER}。version {constants.METRIC_VERSION}。"
        rows.append((f"metric:{key}", f"metric.{key}", "metric", name, text, METRIC_ALIASES.get(key, [key])))
    for name, _, table, grain, _, note, aliases in NODES:
        text = f"{note.rstrip('。.')} 层 {name.split('.')[0]}。表 {table or '无'}。{grain or ''}"
        rows.append((f"node:{name}", name, "lineage_node", name, text, aliases))
    own = spark.createDataFrame(rows, "id string, object string, kind string, title string, text string, aliases array<string>")
    return own if documents is None else documents.unionByName(own)


def focus_of(question: str, hits: list[dict]) -> list[str]:
    """Objects that the question names, else those of the three best hits."""
    low = (question or "").lower()
    named = [x for pattern, objects in FOCUS if re.search(pattern, low) for x in objects]
    return list(dict.fromkeys(named or [h["object"] for h in hits[:3] if h.get("object")]))


def retrieve(spark: SparkSession, question: str, k: int = 5, documents: DataFrame | None = None) -> dict:
    hits = [r.asDict() for r in search(chunks(spark, documents), question, k).collect()]
    return {"hits": hits, "lineage": lineage.walk(spark, focus_of(question, hits)), "method": "token-overlap", "note": "词重叠检索，无向量库、无外部模型。"}
