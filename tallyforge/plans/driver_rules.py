"""The engine's rules over rows made from the driver's tables: questions, requests and broken aggregates, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marginals
from ..sources import snapshots
from . import driver_tables, intent, intent_columns, request_columns, serving


def _pick(number: Column, *values: str | None) -> Column:
    """The value whose place is number modulo their count."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks one of 240 questions: question, n."""
    orders = driver_tables.table(spark, sf_dir, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    parts = [_pick(customer, "2024年", "2025年", "2023年", "今年", ""), _pick(key, "Proton", "Toyota", ""), _pick(customer, "TIV", "上牌", "销量", ""), _pick(key, "排名", "份额", "同比", "趋势")]
    return orders.groupBy(F.concat(*parts).alias("question")).agg(F.count(F.lit(1)).alias("n"))


def parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question is read as, and what it would be read as if every stop were guessed over."""
    rows = intent_columns.readings(questions(spark, sf_dir), "question", {"": False, "forced_": True})
    return rows.select("question", "n", "task", "metric", "year", "brand_id", F.col("hitl_code").alias("stop"), "forced_task", "forced_metric", "forced_year", F.col("forced_hitl_code").alias("forced_stop"), F.col("forced_n_guesses").alias("guesses"))


_PARSED = """WITH o AS (SELECT ['2024年', '2025年', '2023年', '今年', ''][o_custkey % 5 + 1] AS y, ['Proton', 'Toyota', ''][o_orderkey % 3 + 1] AS b, ['TIV', '上牌', '销量', ''][o_custkey % 4 + 1] AS m, ['排名', '份额', '同比', '趋势'][o_orderkey % 4 + 1] AS t FROM orders),
q AS (SELECT y, b, m, t, COUNT(*) AS n FROM o GROUP BY ALL),
s AS (SELECT *, CASE WHEN y = '今年' THEN 'RELATIVE_TIME' WHEN m = '销量' THEN 'AMBIGUOUS_METRIC' WHEN y = '2023年' THEN 'YEAR_OUT_OF_RANGE' WHEN y = '' THEN 'MISSING_YEAR' WHEN m = '' THEN 'MISSING_METRIC' END AS stop,
  CASE t WHEN '排名' THEN 'brand_rank' WHEN '份额' THEN 'share' WHEN '同比' THEN 'yoy_brand' ELSE 'month_trend' END AS kind, CASE m WHEN 'TIV' THEN 'tiv' WHEN '上牌' THEN 'registration' END AS said FROM q),
r AS (SELECT *, stop IS NULL OR stop = 'MISSING_METRIC' AS whole FROM s)
SELECT y || b || m || t AS question, n, CASE WHEN whole THEN kind END AS task, CASE WHEN stop IS DISTINCT FROM 'RELATIVE_TIME' THEN said END AS metric, CASE WHEN whole THEN CAST(left(y, 4) AS INT) END AS year,
  CASE WHEN whole AND b <> '' THEN CASE b WHEN 'Proton' THEN 2 ELSE 4 END END AS brand_id, stop, kind AS forced_task, coalesce(said, 'tiv') AS forced_metric, CAST(CASE WHEN y = '2024年' THEN 2024 ELSE 2025 END AS INT) AS forced_year, stop AS forced_stop,
  CAST((y = '今年')::INT + (m = '销量')::INT + (y IN ('2023年', ''))::INT + (m = '')::INT AS INT) AS guesses FROM r"""


def checked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer sends a request for monthly figures; c_custkey, the first rule it breaks, and its maker as a key.

    What the snapshot holds is a few dimensions, which the tasks are given.
    """
    known = serving.catalog(driver_tables.snapshot(spark, sf_dir))
    number, segment = F.col("c_custkey"), F.col("c_mktsegment")
    fourth = F.floor(number / 4)
    sent = driver_tables.table(spark, sf_dir, "customer").select(
        "c_custkey", _pick(number, "2000-02", "2000-2", "2001-05", None).alias("start_month"), _pick(fourth, "2001-01", "2001-06", "2049-01").alias("end_month"),
        F.when(F.col("c_nationkey") % 4 == 1, F.concat(F.lit(" "), F.lower(segment), F.lit(" "))).when(F.col("c_nationkey") % 4 == 2, "NOBODY").alias("maker"),
        F.when(F.col("c_nationkey") % 4 == 3, "red").alias("colour"), _pick(F.floor(number / 12), None, "tiv").alias("metric"),
    )

    asked = sent.select("c_custkey", F.lit("monthly_registrations").alias("query"), F.to_json(F.struct("start_month", "end_month", "maker", "colour", "metric")).alias("params"))
    return request_columns.judged(asked, known).select("c_custkey", "code", F.col("maker_key").alias("maker"))


_CHECKED = """WITH s AS (SELECT c_custkey, upper(c_mktsegment) AS segment, c_nationkey % 4 AS kind, ['2000-02', '2000-2', '2001-05', NULL][c_custkey % 4 + 1] AS a, ['2001-01', '2001-06', '2049-01'][(c_custkey // 4) % 3 + 1] AS z, (c_custkey // 12) % 2 AS other FROM customer),
c AS (SELECT *, CASE WHEN kind = 3 THEN 'UNSUPPORTED_FILTER' WHEN a IS NULL THEN 'MISSING_PARAMETERS' WHEN other = 1 THEN 'METRIC_MISMATCH' WHEN a = '2000-2' THEN 'INVALID_MONTH' WHEN a > z THEN 'INVALID_RANGE'
  WHEN z = '2049-01' THEN 'OUT_OF_COVERAGE' WHEN kind = 2 THEN 'UNKNOWN_MAKER' ELSE 'OK' END AS code FROM s)
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, code, CASE WHEN code = 'OK' AND kind = 1 THEN segment END AS maker FROM c"""


#: Parts of questions: all brands, regions, energies, months, metrics and tasks, and words of every stop.
_WORDS = {
    "scope": ("", "华南", "", "豪华", "", "今年", "", "上个月", "定义", ""), "year": ("2024年", "2025", "2023年", "", "2025"), "brand": (*intent.BRAND_WORDS, ""), "region": (*intent.REGION_WORDS, ""),
    "energy": (*intent.ENERGY_WORDS, ""), "month": (*intent.MONTH_WORDS, "3月", "12月", "", "全年"), "metric": ("TIV", "上牌", "销量", ""),
    "task": ("同比", "份额", "国产和非国产", "趋势", "各区域", "车型", "多少", "排名", ""),
}
#: Which part an order takes: of key and by how much the key is divided.
_TAKEN = {"scope": ("o_orderkey", 1), "year": ("o_custkey", 1), "brand": ("o_orderkey", 9), "region": ("o_custkey", 5), "energy": ("o_orderkey", 7), "month": ("o_custkey", 11), "metric": ("o_orderkey", 3), "task": ("o_custkey", 2)}


def question_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of every word that the rules know, one for each order: all fields of their readings."""
    orders = driver_tables.table(spark, sf_dir, "orders")
    parts = [_pick(F.floor(F.col(_TAKEN[name][0]) / _TAKEN[name][1]), *words) for name, words in _WORDS.items()]
    asked = orders.groupBy(F.concat_ws(" ", *parts).alias("question")).agg(F.count(F.lit(1)).alias("n"))
    rows = intent_columns.readings(asked, "question", {"": False, "forced_": True})
    fields = [f for f in intent_columns.FIELDS if f != "n_guesses"]
    return rows.select("question", "n", *[F.col(f).alias("stop" if f == "hitl_code" else f) for f in fields], "forced_task", "forced_metric", "forced_year", "forced_month", F.col("forced_n_guesses").alias("guesses"))


def _list_sql(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'" for v in values) + "]"


def _vocabulary_sql() -> str:
    place = {name: f"({column} // {by}) % {len(_WORDS[name])} + 1" for name, (column, by) in _TAKEN.items()}
    words = ", ".join(f"{_list_sql(w)}[{place[name]}] AS {name}" for name, w in _WORDS.items())
    values = {"brand": intent.BRAND_WORDS, "region": intent.REGION_WORDS, "energy": intent.ENERGY_WORDS}
    ids = ", ".join(f"{_list_sql([*v.values(), None])}[{place[name]}] AS {name}_id" for name, v in values.items())
    month = _list_sql([*range(1, 13), 3, 12, None, None])
    known = "CASE metric WHEN 'TIV' THEN 'tiv' WHEN '上牌' THEN 'registration' END"
    return f"""WITH o AS (SELECT {words}, {ids}, {month}[{place["month"]}] AS month_no FROM orders),
q AS (SELECT *, COUNT(*) AS n FROM o GROUP BY ALL),
s AS (SELECT *, scope = '定义' AND task NOT IN ('趋势', '各区域', '多少', '排名') AS doc, {known} AS said, scope IN ('今年', '上个月') AS relative, TRY_CAST(left(year, 4) AS INT) AS y FROM q),
r AS (SELECT *, [x for x in [CASE WHEN scope = '华南' THEN 'OUT_OF_SCOPE_ENTITY' END, CASE WHEN scope = '豪华' THEN 'UNDEFINED_TERM' END, CASE WHEN relative THEN 'RELATIVE_TIME' END,
  CASE WHEN NOT doc AND metric = '销量' THEN 'AMBIGUOUS_METRIC' END, CASE WHEN NOT doc AND year = '2023年' THEN 'YEAR_OUT_OF_RANGE' END, CASE WHEN NOT doc AND year = '' AND NOT relative THEN 'MISSING_YEAR' END,
  CASE WHEN NOT doc AND metric = '' THEN 'MISSING_METRIC' END] if x IS NOT NULL] AS stops,
  CASE WHEN task = '同比' THEN 'yoy_brand' WHEN task = '份额' THEN 'share' WHEN task = '国产和非国产' THEN 'origin_split' WHEN task = '趋势' THEN 'month_trend' WHEN task = '各区域' THEN 'region_rank' WHEN task = '车型' THEN 'model_rank'
    WHEN task = '多少' AND brand <> '' THEN 'brand_total' WHEN task = '排名' THEN 'brand_rank' WHEN brand <> '' THEN 'brand_total' ELSE 'brand_rank' END AS kind,
  CASE WHEN said IS NOT NULL THEN said WHEN task = '份额' THEN 'share' WHEN task = '国产和非国产' THEN 'national' END AS about FROM s),
z AS (SELECT *, stops[1] AS stop, coalesce(stops[1], '') AS c, coalesce(stops[1] IN ('OUT_OF_SCOPE_ENTITY', 'UNDEFINED_TERM', 'RELATIVE_TIME'), false) AS early FROM r),
w AS (SELECT *, NOT early AND NOT doc AND c NOT IN ('AMBIGUOUS_METRIC', 'YEAR_OUT_OF_RANGE') AS timed, NOT early AND NOT doc AND c NOT IN ('AMBIGUOUS_METRIC', 'YEAR_OUT_OF_RANGE', 'MISSING_YEAR') AS whole FROM z)
SELECT concat_ws(' ', {", ".join(_WORDS)}) AS question, n, CASE WHEN doc AND NOT early THEN 'retrieve' WHEN whole THEN kind END AS task,
  CASE WHEN early THEN NULL WHEN doc THEN about ELSE said END AS metric, CAST(CASE WHEN timed THEN y END AS INT) AS year, CAST(CASE WHEN timed THEN month_no END AS INT) AS month,
  CAST(CASE WHEN whole THEN brand_id END AS INT) AS brand_id, CAST(CASE WHEN whole THEN region_id END AS INT) AS region_id, CASE WHEN whole THEN energy_id END AS energy, CAST(NULL AS VARCHAR) AS origin, stop,
  CASE WHEN doc THEN 'retrieve' ELSE kind END AS forced_task, CASE WHEN doc THEN about ELSE coalesce(said, 'tiv') END AS forced_metric,
  CAST(CASE WHEN doc THEN NULL WHEN y IN (2024, 2025) THEN y ELSE 2025 END AS INT) AS forced_year,
  CAST(CASE WHEN doc OR month = '全年' THEN NULL WHEN month_no IS NOT NULL THEN month_no WHEN scope = '上个月' THEN 12 END AS INT) AS forced_month, CAST(len(stops) AS INT) AS guesses FROM w"""


#: Requests by what they break, for a maker {m} that the snapshot has; a number of the list is an order's customer's.
_REQUESTS = [
    ("monthly_registrations", {"start_month": "2000-02", "end_month": "2001-06", "maker": " {m} "}, "OK"), ("sales", {"start_month": "2000-02", "end_month": "2001-06"}, "UNKNOWN_QUERY"),
    ("maker_ranking", ["{m}"], "INVALID_PARAMETERS"), ("brand_compare", {"start_month": "2000-02", "end_month": "2001-06", "makers": ["{m}", "building"], "state": "x"}, "UNSUPPORTED_FILTER"),
    ("fuel_monthly", {"start_month": "2000-02"}, "MISSING_PARAMETERS"), ("monthly_registrations", {"start_month": "2000-02", "end_month": "2001-06", "metric": "tiv"}, "METRIC_MISMATCH"),
    ("monthly_registrations", {"start_month": "2000-02", "end_month": "2001-6"}, "INVALID_MONTH"), ("maker_ranking", {"start_month": "2001-02", "end_month": "2000-06"}, "INVALID_RANGE"),
    ("maker_ranking", {"start_month": "2000-02", "end_month": "2049-06"}, "OUT_OF_COVERAGE"), ("monthly_registrations", {"start_month": "2000-02", "end_month": "2001-06", "maker": "{m} X"}, "UNKNOWN_MAKER"),
    ("brand_compare", {"start_month": "2000-02", "end_month": "2001-06", "makers": ["{m}"]}, "INVALID_MAKERS"), ("brand_compare", {"start_month": "2000-02", "end_month": "2001-06", "makers": ["{m}", " {m}"]}, "DUPLICATE_MAKERS"),
    ("fuel_monthly", {"start_month": "2000-02", "end_month": "2001-06", "fuel": "steam"}, "UNKNOWN_FUEL"), ("maker_ranking", {"start_month": "2000-02", "end_month": "2001-06", "limit": 31}, "INVALID_LIMIT"),
    ("maker_ranking", {"start_month": "2000-02", "end_month": "2001-06", "limit": 30}, "OK"), ("maker_ranking", {"start_month": "2000-02", "end_month": "2001-06", "limit": "3"}, "INVALID_LIMIT"),
]


def request_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request of every customer, as JSON, and the first rule it breaks: every code occurs."""
    known = serving.catalog(driver_tables.snapshot(spark, sf_dir))
    customers = driver_tables.table(spark, sf_dir, "customer")
    texts = _pick(F.col("c_custkey"), *[json.dumps(given) for _, given, _ in _REQUESTS])
    sent = customers.select("c_custkey", _pick(F.col("c_custkey"), *[q for q, _, _ in _REQUESTS]).alias("query"), F.replace(texts, F.lit("{m}"), F.lower("c_mktsegment")).alias("params"))
    return request_columns.judged(sent, known).select("c_custkey", "query", "code", F.col("maker_key").alias("maker"))


_CODES = f"""WITH c AS (SELECT c_custkey, c_custkey % {len(_REQUESTS)} + 1 AS i, c_mktsegment FROM customer)
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {_list_sql([q for q, _, _ in _REQUESTS])}[i] AS query, {_list_sql([c for _, _, c in _REQUESTS])}[i] AS code, CASE WHEN i = 1 THEN upper(c_mktsegment) END AS maker FROM c"""


def broken_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families with rows damaged by their counts: rows of each family by the first rule they break."""
    count = F.col("registrations")
    damaged = driver_tables.all_marginals(spark, sf_dir).select(
        F.col("dimension").alias("family"), F.when(count % 7 == 1, "colour").otherwise(F.col("dimension")).alias("dimension"), "key1",
        F.when(count % 7 == 2, "").when(count % 7 == 3, F.lit(None)).otherwise(F.col("key2")).alias("key2"),
        F.when(count % 7 == 4, F.concat(F.lit("0"), count.cast("string"))).otherwise(count.cast("string")).alias("registrations"), F.when(count % 7 == 5, 5).otherwise(4).alias("n_cells"),
    )
    return damaged.groupBy("family", F.coalesce(snapshots.first_broken(damaged), F.lit("OK")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


#: Versions of the families by how they are damaged; months before 2000 are left out, as the rules know none.
VERSIONS = ("good", "schema", "dimension", "count", "month", "twice", "family", "total", "shifted")


def broken_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine versions of the families, eight of them damaged: the first rule that each breaks, row rules and whole-table rules."""
    rows = driver_tables.registered(spark, sf_dir).where("registration_year >= 2000")
    families = marginals.marginals(marginals.monthly(rows))
    chosen = families.where("dimension = 'month_fuel'").agg(F.min(F.struct("key1", "key2")).alias("f"), F.max("key1").alias("z"))  # one row
    case = F.explode(F.array(*[F.lit(v) for v in VERSIONS])).alias("version")
    each = families.select("*", case).crossJoin(F.broadcast(chosen))
    kind, count = F.col("dimension"), F.col("registrations")
    one = (kind == "month_fuel") & (F.col("key1") == F.col("f.key1")) & (F.col("key2") == F.col("f.key2"))  # a single row of the table
    is_ = lambda v: F.col("version") == v
    damaged = each.where(~(is_("family") & (kind == "state"))).select(
        "version", F.when(is_("dimension") & one, "colour").otherwise(kind).alias("dimension"),
        F.when(is_("month") & one, "2000-13").when(is_("shifted") & one, F.col("z")).otherwise(F.col("key1")).alias("key1"),
        F.when(is_("shifted") & one, "moved").otherwise(F.col("key2")).alias("key2"),
        F.when(is_("count") & one, "0").when(is_("total") & (kind == "state") & (F.col("key1") == "NATION_1"), (count + 1).cast("string")).otherwise(count.cast("string")).alias("registrations"),
        F.when(is_("schema") & one, 5).otherwise(4).alias("n_cells"), F.when(is_("twice") & one, 2).otherwise(1).alias("times"),
    )
    damaged = damaged.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")
    found = snapshots.first_faults(damaged, "version")
    return found.select("version", F.coalesce("code", F.lit("OK")).alias("code"))


_VERSIONS = """WITH m AS (SELECT strftime(min(o_orderdate), '%Y-%m') AS first FROM orders WHERE year(o_orderdate) >= 2000)
SELECT v AS version, CASE v WHEN 'good' THEN 'OK' WHEN 'schema' THEN 'INVALID_SCHEMA' WHEN 'dimension' THEN 'INVALID_DIMENSION' WHEN 'count' THEN 'INVALID_COUNT' WHEN 'month' THEN 'INVALID_MONTH'
  WHEN 'twice' THEN 'DUPLICATE_AGGREGATE' WHEN 'family' THEN 'MISSING_AGGREGATE_FAMILY' WHEN 'total' THEN 'TOTAL_MISMATCH:state' ELSE 'MONTH_MISMATCH:' || first END AS code
FROM m, (SELECT unnest(['good', 'schema', 'dimension', 'count', 'month', 'twice', 'family', 'total', 'shifted']) AS v)"""


_BROKEN = f"""{driver_tables.FAMILIES_SQL}
SELECT dimension AS family, CASE WHEN registrations % 7 = 5 THEN 'INVALID_SCHEMA' WHEN registrations % 7 IN (1, 2, 3) THEN 'INVALID_DIMENSION' WHEN registrations % 7 = 4 THEN 'INVALID_COUNT'
  WHEN dimension LIKE 'month%' AND NOT key1 LIKE '20%' THEN 'INVALID_MONTH' ELSE 'OK' END AS code, COUNT(*) AS n FROM families GROUP BY 1, 2"""


QUERIES = {"question_vocabulary": question_vocabulary, "request_codes": request_codes, "parsed_questions": parsed_questions, "checked_requests": checked_requests, "broken_aggregates": broken_aggregates, "broken_versions": broken_versions}
ORACLE_SQL = {"question_vocabulary": _vocabulary_sql(), "request_codes": _CODES, "parsed_questions": _PARSED, "checked_requests": _CHECKED, "broken_aggregates": _BROKEN, "broken_versions": _VERSIONS}
