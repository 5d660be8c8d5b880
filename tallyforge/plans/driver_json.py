"""Strict JSON and path differences over the driver's events, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import json_tables
from .driver_tables import table

#: What an event's props become, {p} being the whole text and {k} its number, and what is wrong with that.
_DAMAGED = [
    ("{p}", "OK"), ('{"k": {k}, "k": {k}}', "REPEATED_KEY"), ("{p} {p}", "TRAILING_TEXT"), ('{"k": NaN}', "NOT_JSON"), ('{"k": [{k}, {"a": []}], "s": "]}"}', "OK"), ('{"k": 1e999}', "NOT_FINITE"),
    ('{"k": {k}', "NOT_JSON"), ("{'k': {k}}", "NOT_JSON"), ('{"k": 0{k}}', "NOT_JSON"), ("{k}", "OK"), ('[{p}, {p}, "\\u00e9"]', "OK"), (None, "NO_TEXT"), ("[{k}] x", "TRAILING_TEXT"),
]
_CHANGED = ['{"k": {k}}', '{"k": "{k}"}', '{"k": {k}, "t": [{k}, {"a": null}, []]}', '{"j": {k}}', '{"k": [{k}]}', '{"k": {"k": {k}}}', '{"k": {k}.5}', '{"k": 1{k}}']


def _made(templates: list[str | None], number):
    text = F.element_at(F.array(*[F.lit(t) for t in templates]), (number % len(templates) + 1).cast("int"))
    return F.replace(F.replace(text, F.lit("{p}"), F.col("props")), F.lit("{k}"), F.regexp_extract("props", r"(\d+)", 1))


def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose props were damaged in a dozen ways: how many have which fault."""
    texts = table(spark, sf_dir, "events").select(_made([t for t, _ in _DAMAGED], F.col("event_id")).alias("text"))
    return texts.groupBy(F.coalesce(json_tables.fault(F.col("text")), F.lit("OK")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def json_path_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's props against a changed copy: every path at which they differ."""
    events = table(spark, sf_dir, "events").select("event_id", "props", _made(_CHANGED, F.col("event_id")).alias("changed"))
    found = json_tables.differences(json_tables.paths(events, "event_id", "props"), json_tables.paths(events, "event_id", "changed"))
    return found.select(F.col("key").alias("event_id"), "path", "status", F.coalesce("left_value", F.lit("-")).alias("left_value"), F.coalesce("right_value", F.lit("-")).alias("right_value"))


_CODES = ", ".join(f"'{code}'" for _, code in _DAMAGED)
_WHAT = [  # path, status, and the two values, {k} being the number
    (), [("$.k", "type", "{k}", '"{k}"')], [("$.t[0]", "extra", "-", "{k}"), ("$.t[1].a", "extra", "-", "null"), ("$.t[2]", "extra", "-", "[]")], [("$.k", "missing", "{k}", "-"), ("$.j", "extra", "-", "{k}")],
    [("$.k", "missing", "{k}", "-"), ("$.k[0]", "extra", "-", "{k}")], [("$.k", "missing", "{k}", "-"), ("$.k.k", "extra", "-", "{k}")], [("$.k", "type", "{k}", "{k}.5")], [("$.k", "value", "{k}", "1{k}")],
]
_ROWS = ", ".join("(" + ", ".join([str(i), *[f"'{x}'" for x in row]]) + ")" for i, rows in enumerate(_WHAT) for row in rows)
QUERIES = {"json_faults": json_faults, "json_path_differences": json_path_differences}
ORACLE_SQL = {
    "json_faults": f"SELECT [{_CODES}][event_id % {len(_DAMAGED)} + 1] AS fault, COUNT(*) AS n FROM events GROUP BY 1",
    "json_path_differences": f"""WITH w(i, path, status, a, b) AS (VALUES {_ROWS}), e AS (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)
SELECT event_id, path, status, replace(a, '{{k}}', k) AS left_value, replace(b, '{{k}}', k) AS right_value FROM e JOIN w ON i = event_id % {len(_CHANGED)}""",
}
