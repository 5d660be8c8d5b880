"""JSON texts in tables, judged strictly, and the places at which two tables of JSON texts differ.

Texts are parsed to VARIANT values by Spark; a value's paths become rows level by level, each level a lateral join with what the
containers of the last one hold. A level is stored before the next is taken, so deep values make long loops and no deep plans.
Paths are written as $.key and $[0]; a key that is no plain word is quoted, $["a.b"], so that no two places share a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared

#: A text that ends right after its one value. Strings are cut out first, so that brackets within them don't count.
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_SPACE = r"[\x20\t\r\n]*+"
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
#: What may follow the last bracket of a value or stand alone.
_SCALAR = rf"(?s)\A{_SPACE}(?:{_STRING}|{_NUMBER}|true|false|null){_SPACE}\z"


def fault(text: Column) -> Column:
    """What is wrong with a text: NO_TEXT, NOT_JSON, REPEATED_KEY, TRAILING_TEXT, NOT_FINITE; null for strict JSON.

    NaN and Infinity are no JSON; a number beyond a double is one, but not finite. Only the first fault is told.
    """
    bare = F.regexp_replace(text, _STRING, '""')
    value = F.try_parse_json(text)
    # without its strings a text with one outer container ends at that container's bracket
    outer = F.regexp_replace(bare, r"[^\[\]{}]", "")
    one = F.length(_reduced(outer)) == 0
    ends = bare.rlike(rf"(?s)\A{_SPACE}[\[{{].*[\]}}]{_SPACE}\z") & one & ~_closes_early(bare)
    whole = F.coalesce(ends | text.rlike(_SCALAR), F.lit(False))
    far = F.coalesce(F.exists(F.regexp_extract_all(bare, F.lit(rf"({_NUMBER})")), lambda n: F.abs(n.cast("double")) == float("inf")), F.lit(False))
    return (
        F.when(text.isNull(), "NO_TEXT").when(value.isNull() & _repeats_a_key(text), "REPEATED_KEY").when(value.isNull(), "NOT_JSON").when(~whole, "TRAILING_TEXT").when(far, "NOT_FINITE")
    )


def _reduced(brackets: Column) -> Column:
    """Brackets without pairs, pairs around pairs, and so on: what a balanced text has none of."""
    pairs = r"(\[\]|\{\})"
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(brackets) / 2, F.lit(1)).cast("int")), brackets, lambda s, _: F.when(s == "", s).otherwise(F.regexp_replace(s, pairs, "")))


def _closes_early(bare: Column) -> Column:
    """Whether the outermost container ends before the text does: its depth comes to nothing at some earlier bracket."""
    marks = F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda c: c != "")
    step = lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends"))
    seen = F.aggregate(marks, start, lambda s, c: F.struct((s["depth"] + step(c)).alias("depth"), (s["ends"] + F.when(s["depth"] + step(c) == 0, 1).otherwise(0)).alias("ends")))
    return F.coalesce(seen["ends"], F.lit(0)) > 1


def _repeats_a_key(text: Column) -> Column:
    """Whether a text that isn't taken would be if keys could repeat: a map of it has a key twice."""
    keys = F.json_object_keys(text)
    return F.coalesce(F.size(keys) > F.size(F.array_distinct(keys)), F.lit(False))


def _step(name: Column, position: Column) -> Column:
    """From a container to what it holds: [0], .word or ["any other key"]."""
    quoted = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    word = F.when(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit('["'), quoted, F.lit('"]')))
    return F.when(name.isNull(), F.concat(F.lit("["), position.cast("string"), F.lit("]"))).otherwise(word)


def paths(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, value) of every scalar and empty container of the texts that are JSON; kind is its VARIANT type.

    Rows that repeat a key are told apart by nobody: their paths are all there.
    """
    spark = texts.sparkSession
    level = texts.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(F.col(text)).alias("value")).where("value is not null")
    at, depth = shared.scratch(spark, "json-paths"), 0
    holds = lambda: F.schema_of_variant("value").rlike("(?s)^OBJECT<.+>$")
    while True:
        level = shared.kept(level, "json-level")
        full = F.coalesce(holds(), F.lit(False)) | F.coalesce(F.size(F.try_variant_get("value", "$", "array<variant>")) > 0, F.lit(False))
        level.where(~full).select("key", "path", F.schema_of_variant("value").alias("kind"), F.to_json("value").alias("value")).write.parquet(f"{at}/level={depth}")
        level = level.where(full)
        if level.isEmpty():
            break
        level = spark.sql("SELECT l.key AS owner, l.path, e.pos, e.key AS name, e.value FROM {level} l, LATERAL variant_explode(l.value) e", level=level)
        level = level.select(F.col("owner").alias("key"), F.concat("path", _step(F.col("name"), F.col("pos"))).alias("path"), "value")
        depth += 1
    return spark.read.parquet(at).drop("level")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, path, status, left_value, right_value) where two tables of paths differ: missing, extra, type or value."""
    one = left.select("key", "path", F.col("kind").alias("left_kind"), F.col("value").alias("left_value"))
    two = right.select("key", "path", F.col("kind").alias("right_kind"), F.col("value").alias("right_value"))
    both = one.join(two, ["key", "path"], "full_outer")
    status = F.when(F.col("right_kind").isNull(), "missing").when(F.col("left_kind").isNull(), "extra").when(F.col("left_kind") != F.col("right_kind"), "type").when(F.col("left_value") != F.col("right_value"), "value")
    return both.select("key", "path", status.alias("status"), "left_value", "right_value").where("status is not null")
