"""The engine's questions over the driver's tables: line items as the star, orders as registrations.

Each query comes with the same question as SQL. `f` is the star's rows, `reg` the registrations.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import maker_key, year_month
from ..operators import constraints, identities, lineage, marginals, retrieval
from ..operators.apportion import apportion, carry_over
from ..sources import registrations, shared, snapshots
from . import ablation, serving
from .lineage_data import EDGES
from .star import Star
from .templates import AGGREGATE, answer

NATIONAL = ("Brand#1", "Brand#2")
YEAR = 1998


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_years(rows: DataFrame, years: list[int]) -> DataFrame:
    """A range on the date column, which the Parquet scan can use; a year() of it can't be pushed down."""
    at = lambda y: F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz")
    return rows.where((F.col("l_shipdate") >= at(min(years))) & (F.col("l_shipdate") < at(max(years) + 1)))


def star(spark: SparkSession, sf_dir: str) -> Star:
    fact = table(spark, sf_dir, "lineitem").select(
        "l_shipdate", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_partkey").alias("model_id"), F.col("l_suppkey").alias("region_key"),
        F.col("l_quantity").cast("long").alias("tiv_units"), F.lit(1).cast("long").alias("registration_units"),
    )
    part = table(spark, sf_dir, "part")
    model = part.select(F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("brand_id"), F.col("p_name").alias("model_name"), F.col("p_type").alias("energy"))
    brand = part.select(F.col("p_brand").alias("brand_id")).distinct().select("brand_id", F.col("brand_id").alias("brand_name"), F.when(F.col("brand_id").isin(*NATIONAL), "national").otherwise("non_national").alias("origin"))
    nation, world = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    region = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(world, F.col("n_regionkey") == F.col("r_regionkey"))
    region = region.select(F.col("s_suppkey").alias("region_key"), F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"), F.lower("r_name").alias("region_name_zh"))
    return Star(fact, model, brand, region, None, _in_years)


def star_with_aggregate(spark: SparkSession, sf_dir: str) -> Star:
    """The star with its brand-year aggregate, published once for a table and partitioned by year."""
    s = star(spark, sf_dir)
    s.brand_year = brand_sums_published(spark, sf_dir, ["year"])
    return s


def brand_sums_published(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    s = star(spark, sf_dir)
    made = shared.published(spark, "_".join(["brand", *by]), [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part")], lambda: brand_sums(s.fact, s.model, by), ["year"])
    return made.select(*by, "brand_id", "tiv_units", "registration_units")


def brand_sums(fact: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    rows = fact.join(model.select("model_id", "brand_id"), "model_id").groupBy(*by, "brand_id")
    return rows.agg(F.sum("tiv_units").alias("tiv_units"), F.sum("registration_units").alias("registration_units"))


def registered(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Orders as registrations: date, maker (market segment), fuel (priority), state (nation). Of one year, if it is given."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    if year is not None:
        at = lambda y: F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz")
        orders = orders.where((F.col("o_orderdate") >= at(year)) & (F.col("o_orderdate") < at(year + 1)))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.year("o_orderdate").alias("registration_year"), F.month("o_orderdate").alias("registration_month"), F.col("c_mktsegment").alias("maker"), F.col("o_orderpriority").alias("fuel"), F.col("n_name").alias("state")
    )


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marginals.monthly(registered(spark, sf_dir))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families as a published snapshot: a query reads the partitions of its dimensions and no orders."""
    tables = [f"{sf_dir}/{t}.parquet" for t in ("orders", "customer", "nation")]
    return shared.published(spark, "snapshot", tables, lambda: snapshots.derived(marginals.marginals(ads(spark, sf_dir))), ["dimension"])


_F = """WITH f AS (
  SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, p_brand AS brand, p_name AS model, p_type AS energy,
         CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'national' ELSE 'non_national' END AS origin,
         r_regionkey AS region_id, r_name AS region, CAST(l_quantity AS BIGINT) AS tiv, CAST(1 AS BIGINT) AS reg
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
"""
_REG = """WITH reg AS (
  SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, c_mktsegment AS maker, o_orderpriority AS fuel, n_name AS state,
         strftime(o_orderdate, '%Y-%m') AS ym
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
"""
_FAMILIES = """SELECT 'total' AS dimension, 'ALL' AS key1, 'ALL' AS key2, COUNT(*) AS registrations FROM reg
UNION ALL SELECT 'month', CAST(y AS VARCHAR), lpad(CAST(m AS VARCHAR), 2, '0'), COUNT(*) FROM reg GROUP BY y, m
UNION ALL SELECT 'maker', maker, 'ALL', COUNT(*) FROM reg GROUP BY maker
UNION ALL SELECT 'fuel', fuel, 'ALL', COUNT(*) FROM reg GROUP BY fuel
UNION ALL SELECT 'state', state, 'ALL', COUNT(*) FROM reg GROUP BY state
UNION ALL SELECT 'month_maker', ym, maker, COUNT(*) FROM reg GROUP BY ym, maker
UNION ALL SELECT 'month_fuel', ym, fuel, COUNT(*) FROM reg GROUP BY ym, fuel"""

#: The families of all registrations as a named table, for SQL that goes on from there.
FAMILIES_SQL = f"{_REG}, families AS ({_FAMILIES})"


def _sum(column: str) -> str:
    return f"CAST(SUM({column}) AS BIGINT)"


def _rank(select: str, where: str, group: str, column: str = "tiv", tail: str = "") -> str:
    return f"{_F} SELECT {select}, {_sum(column)} AS units FROM f WHERE year = {YEAR} {where} GROUP BY {group} {tail}"


def _share_sql(brand: str, market: str) -> str:
    return f"""{_F} SELECT brand AS name, {_sum("tiv")} AS units,
      round(CAST(100 AS DOUBLE) * SUM(tiv) / (SELECT SUM(tiv) FROM f WHERE year = {YEAR} {market}), 1) AS share_pct
      FROM f WHERE year = {YEAR} {market} {brand} GROUP BY brand"""


_YOY = f"""{_F}, s AS (SELECT brand, {_sum(f"CASE WHEN year = {YEAR} THEN tiv ELSE 0 END")} AS units, {_sum(f"CASE WHEN year = {YEAR - 1} THEN tiv ELSE 0 END")} AS units_ly
  FROM f WHERE year IN ({YEAR}, {YEAR - 1}) GROUP BY brand)
SELECT brand AS name, units, units_ly, CASE WHEN units_ly = 0 THEN NULL ELSE round(CAST(100 AS DOUBLE) * (units - units_ly) / units_ly, 1) END AS yoy_pct FROM s"""


def _template(task: str, metric: str = "tiv", scan: str | None = None, **params):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = star_with_aggregate(spark, sf_dir) if scan == AGGREGATE else star(spark, sf_dir)
        return answer(rows, task, metric, {"year": YEAR} | params, scan or "dwd.fact_month")

    return build


def _served(name: str, **params):
    given = {"start_month": "2000-02", "end_month": "2001-06"} | params

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = snapshot(spark, sf_dir)
        months = [r["year_month"] for r in rows.where("dimension = 'month'").select("year_month").distinct().orderBy("year_month").collect()]  # 12 a year
        known = {"available_months": months, "makers": [given.get("maker"), *given.get("makers", [])], "fuels": [given.get("fuel")]}
        return serving.BUILDERS[name](rows, serving.prepare(name, given, known))

    return build


_PERIOD = "ym BETWEEN '2000-02' AND '2001-06'"


def brand_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_sums_published(spark, sf_dir, ["year"])


def brand_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_sums_published(spark, sf_dir, ["year", "month"])


def all_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marginals.marginals(ads(spark, sf_dir))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before July 1998 expected against all orders without one priority: every kind of difference occurs."""
    expected = marginals.independent_marginals(registered(spark, sf_dir).where("registration_year < 1998 or registration_month < 7"))
    actual = marginals.marginals(marginals.monthly(registered(spark, sf_dir).where("fuel <> '1-URGENT'")))
    found = marginals.compare(expected, actual, ["dimension", "key1", "key2"], "registrations")
    return found.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("expected", "actual")})


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as curated rows; every seventh order sits in a wrong month, and some have no row number."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.sha2(F.lit("lineitem"), 256).alias("source_sha256"), F.when(F.col("l_linenumber") > 0, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_row"), F.col("l_shipdate").cast("date").alias("date_reg"),
        F.year("l_shipdate").alias("registration_year"), F.when(F.col("l_orderkey") % 7 == 0, F.month("l_shipdate") % 12 + 1).otherwise(F.month("l_shipdate")).alias("registration_month"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layers(spark, sf_dir)
    return marginals.quality_checks(rows, rows)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("date_reg"), F.col("o_orderstatus").alias("type"), F.when(F.col("o_custkey") % 50 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("maker"),
        F.col("o_orderpriority").alias("model"), F.lit(None).cast("string").alias("colour"), F.when(F.col("o_orderkey") % 97 == 0, "a\tb").otherwise(F.col("o_orderpriority")).alias("fuel"), F.lit("x").alias("state"), F.col("o_orderkey").alias("source_row"),
    )
    return orders.select("source_row", registrations.reason(orders, YEAR, date(YEAR, 8, 31), ("F", "O")).alias("reason"))


_REASON = f"""CASE WHEN year(o_orderdate) <> {YEAR} THEN 'wrong_source_year' WHEN CAST(o_orderdate AS DATE) > DATE '{YEAR}-08-31' THEN 'after_data_asof'
  WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown_vehicle_type' WHEN o_custkey % 50 = 0 THEN 'missing_maker' WHEN o_orderkey % 97 = 0 THEN 'unsafe_tsv_fuel' END"""


def dq_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def dq_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("reason is not null").orderBy("source_row", "reason").limit(registrations.SAMPLES)


def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("_metadata.row_index") + 1).alias("source_row"), F.col("_metadata.file_path").alias("f"))
    return identities.counted(rows, [F.col("f")], F.col("source_row"))


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot(spark, sf_dir)
    pick = lambda kind, column: rows.where(F.col("dimension") == kind).select(F.lit(kind).alias("kind"), F.col(column).alias("value")).distinct()
    return pick("month", "year_month").unionByName(pick("maker", "maker_norm")).unionByName(pick("fuel", "fuel"))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that 2000 and 2001 share: totals of both years by maker, with the share of the later one."""
    return marginals.matched_makers(all_marginals(spark, sf_dir), [2000, 2001]).select("maker", "registrations", "previous_registrations", "share_pct")


def case_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written in upper or lower case by customer: labels that one maker key merges."""
    label = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(label.alias("label")).withColumn("maker", maker_key(F.col("label")))
    return rows.groupBy("maker").agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1).select("maker", F.array_join("labels", "|").alias("labels"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"))
    weights = spark.createDataFrame([(k, k / 21) for k in range(1, 7)], "part int, weight double")
    return total.crossJoin(F.broadcast(weights))  # six rows


def apportioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion(_nations(spark, sf_dir), ["c_nationkey"], "total", "weight", "part", "units").select("c_nationkey", "part", "units")


def lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lagged_all_years(spark, sf_dir).where("year < 2001")  # as its SQL has it; no carried value depends on a later year


def lagged_all_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carried series of every year of orders, the unfinished last one too."""
    rows = registered(spark, sf_dir).groupBy("maker", F.col("registration_year").alias("year"), F.col("registration_month").alias("month")).agg(F.count(F.lit(1)).alias("v"))
    rate = F.when(F.col("month") % 3 == 0, F.lit(0.75)).otherwise(F.lit(0.875))
    return carry_over(rows, ["maker"], "v", rate, F.lit(1.0), "carried").select("maker", "year", "month", "carried")


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of each scale in which the lagged series has another leading maker than the plain one, and the widest gap."""
    rows = registered(spark, sf_dir).groupBy("maker", F.col("registration_year").alias("year"), F.col("registration_month").alias("month")).agg(F.count(F.lit(1)).alias("tiv_units")).where("year < 2001")
    scales = spark.createDataFrame([(0.25,), (0.5,), (0.75,), (1.0,)], "scale double")
    rows = carry_over(rows.crossJoin(F.broadcast(scales)), ["maker", "scale"], "tiv_units", F.col("scale"), F.lit(1.0), "registration_units").where("year = 2000")
    led = ablation.top1(rows, ["scale", "month"], "maker", {"tiv_units": "t", "registration_units": "r"}).groupBy("scale").agg(F.count_if(F.col("t") != F.col("r")).alias("flips"))
    sums = rows.groupBy("scale", "month").agg(F.sum("tiv_units").alias("t"), F.sum("registration_units").alias("r"))
    return led.join(sums.groupBy("scale").agg(F.max(F.abs(F.col("r") - F.col("t"))).alias("widest")), "scale")


def sweep_all_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scale of the engine: months and states whose leading maker changes, and the widest gap of a month in per cent."""
    by = ["maker", "state", F.col("registration_year").alias("year"), F.col("registration_month").alias("month")]
    rows = registered(spark, sf_dir).groupBy(*by).agg(F.count(F.lit(1)).alias("tiv_units"))
    scales = spark.createDataFrame([(s,) for s in ablation.SCALES], "scale double")
    rows = carry_over(rows.crossJoin(F.broadcast(scales)), ["maker", "state", "scale"], "tiv_units", F.least(F.lit(1.0), F.col("scale") * 0.75), F.lit(1.0), "registration_units")
    return ablation.sweep_summary(rows.where("year = 2000"), "maker", "state")


_LAG = """, v AS (SELECT maker, y, m, COUNT(*) AS v FROM reg WHERE y < 2001 GROUP BY maker, y, m)"""


def gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.adjacent_gaps(registered(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("units")), "state", "units")


def kept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring states in the order of all registrations, and in how many months the leader is ahead."""
    rows = registered(spark, sf_dir).withColumn("one", F.lit(1))
    return ablation.pairs_kept(rows, "state", "one", ["registration_year", "registration_month"])


def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    rows = s.years(s.fact, [YEAR]).join(s.model, "model_id")
    return ablation.top1(rows, ["month"], "energy", {"tiv_units": "tiv_top", "registration_units": "reg_top"})


def _gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    rows = s.years(s.fact, [YEAR]).withColumn("registration_units", F.col("registration_units") * 25)
    return ablation.gaps(rows, "month")


def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.abs("gap_pct")
    return _gap_rows(spark, sf_dir).agg(F.min(size).alias("low"), F.max(size).alias("high"), F.round(F.avg(size), 6).alias("mean"))


def median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.upper_median(_gap_rows(spark, sf_dir).select(F.abs("gap_pct").alias("g")), "g")


_GAPS = f"""{_F}, g AS (SELECT month, abs(round(CAST(SUM(reg * 25) - SUM(tiv) AS DOUBLE) / CAST(SUM(tiv) AS DOUBLE) * 100, 2)) AS g FROM f WHERE year = {YEAR} GROUP BY month)"""


def month_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month from the first to the last order, with its orders of one segment and priority, 0 where there are none."""
    rows = registered(spark, sf_dir)
    bounds = table(spark, sf_dir, "orders").agg(F.trunc(F.min("o_orderdate"), "month").alias("a"), F.trunc(F.max("o_orderdate"), "month").alias("b"))
    months = bounds.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("year_month"))
    chosen = rows.where("maker = 'BUILDING' and fuel = '1-URGENT' and state = 'NATION_3'").groupBy(year_month(F.col("registration_year"), F.col("registration_month")).alias("year_month")).agg(F.count(F.lit(1)).alias("n"))
    return months.join(chosen, "year_month", "left").select("year_month", F.coalesce("n", F.lit(0).cast("long")).alias("registrations"))


def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity")).orderBy("category")


def upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.upstream(lineage.edges(spark), ["metric.share"])


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that share most tokens with the first one's text."""
    items = table(spark, sf_dir, "benchmark")
    asked = items.orderBy("item_id").select("text").first()["text"]
    corpus = items.select(F.col("item_id").cast("string").alias("id"), F.lit("item").alias("object"), F.lit("item").alias("kind"), F.lit("").alias("title"), "text", F.array().cast("array<string>").alias("aliases"))
    return retrieval.search(corpus, asked, 5).select("id", "score")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items against a key they don't have, two domains and their orders, of which the late ones are left out."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz'2001-01-01 00:00:00'")
    domains = {"l_quantity": F.col("l_quantity") >= 1, "l_returnflag": F.col("l_returnflag").isin("A", "N")}
    return constraints.violations("lineitem", table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], domains, {"l_orderkey": (orders, "o_orderkey")})


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


QUERIES = {
    "tpl_brand_rank": _template("brand_rank"),
    "tpl_model_rank": _template("model_rank"),
    "tpl_brand_total": _template("brand_total", brand_id="Brand#3"),
    "tpl_region_rank": _template("region_rank"),
    "tpl_month_trend": _template("month_trend", brand_id="Brand#1"),
    "tpl_share": _template("share"),
    "tpl_share_filtered": _template("share", brand_id="Brand#2", origin="national", month=6, region_id=1),
    "tpl_yoy_brand": _template("yoy_brand"),
    "tpl_origin_split": _template("origin_split"),
    "tpl_metric_registration": _template("brand_rank", "registration", month=12, energy="PROMO"),
    "ads_brand_year": brand_year,
    "ads_brand_month": brand_month,
    "ads_brand_rank": _template("brand_rank", scan=AGGREGATE),
    "ads_brand_total": _template("brand_total", scan=AGGREGATE, brand_id="Brand#3"),
    "ads_share": _template("share", scan=AGGREGATE, brand_id="Brand#1"),
    "ads_yoy": _template("yoy_brand", scan=AGGREGATE),
    "ads_origin_split": _template("origin_split", scan=AGGREGATE),
    "dwd_ads_monthly_count": ads,
    "marginals_grouping_sets": all_marginals,
    "marginals_independent": lambda s, d: marginals.independent_marginals(registered(s, d)),
    "quality_checks": checks,
    "reconcile_missing_extra_mismatch": reconcile,
    "dq_reasons": dq_reasons,
    "dq_rejected_samples": dq_samples,
    "row_identity": row_identity,
    "srv_monthly_all": _served("monthly_registrations"),
    "srv_monthly_maker_zero_fill": _served("monthly_registrations", maker="BUILDING"),
    "srv_brand_compare": _served("brand_compare", makers=["BUILDING", "MACHINERY"]),
    "srv_maker_ranking": _served("maker_ranking", limit=3),
    "srv_fuel_monthly_all": _served("fuel_monthly"),
    "srv_fuel_monthly_one": _served("fuel_monthly", fuel="1-URGENT"),
    "catalog_distinct": catalog_rows,
    "matched_period_summary": matched,
    "case_variants": case_variants,
    "apportion_largest_remainder": apportioned,
    "lag_carry_series": lagged,
    "lag_carry_series_all_years": lagged_all_years,
    "lambda_sweep": sweep,
    "lambda_sweep_all_scales": sweep_all_scales,
    "adjacent_gap": gap,
    "adjacent_pairs_kept": kept_pairs,
    "top1_flip_by_month": flips,
    "value_gap_stats": gap_stats,
    "upper_median_gap": median_gap,
    "month_spine": month_spine,
    "wordcount": wordcount,
    "smoke_group_sum": group_sum,
    "lineage_upstream_recursive": upstream,
    "token_overlap_topk": overlap,
    "constraint_violations": rules,
}

ORACLE_SQL = {
    "constraint_violations": """SELECT 'lineitem' AS table_name, 'unique l_orderkey,l_linenumber' AS rule, COUNT(*) AS violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)
UNION ALL SELECT 'lineitem', 'domain l_quantity', COUNT(*) FROM lineitem WHERE NOT l_quantity >= 1
UNION ALL SELECT 'lineitem', 'domain l_returnflag', COUNT(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT 'lineitem', 'reference l_orderkey', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01')""",
    "tpl_brand_rank": _rank("brand AS name", "", "brand"),
    "tpl_model_rank": _rank("brand || ' ' || model AS name", "", "brand, model", tail="ORDER BY units DESC, name LIMIT 15"),
    "tpl_brand_total": _rank("brand AS name", "AND brand = 'Brand#3'", "brand"),
    "tpl_region_rank": _rank("region AS name, lower(region) AS name_zh", "", "region_id, region"),
    "tpl_month_trend": _rank("month", "AND brand = 'Brand#1'", "month"),
    "tpl_share": _share_sql("", ""),
    "tpl_share_filtered": _share_sql("AND brand = 'Brand#2'", "AND origin = 'national' AND month = 6 AND region_id = 1"),
    "tpl_yoy_brand": _YOY,
    "tpl_origin_split": _rank("origin AS name", "", "origin"),
    "tpl_metric_registration": _rank("brand AS name", "AND month = 12 AND energy = 'PROMO'", "brand", "reg"),
    "ads_brand_year": f"{_F} SELECT year, brand AS brand_id, {_sum('tiv')} AS tiv_units, {_sum('reg')} AS registration_units FROM f GROUP BY year, brand",
    "ads_brand_month": f"{_F} SELECT year, month, brand AS brand_id, {_sum('tiv')} AS tiv_units, {_sum('reg')} AS registration_units FROM f GROUP BY year, month, brand",
    "ads_brand_rank": _rank("brand AS name", "", "brand"),
    "ads_brand_total": _rank("brand AS name", "AND brand = 'Brand#3'", "brand"),
    "ads_share": _share_sql("AND brand = 'Brand#1'", ""),
    "ads_yoy": _YOY,
    "ads_origin_split": _rank("origin AS name", "", "origin"),
    "dwd_ads_monthly_count": f"{_REG} SELECT y AS registration_year, m AS registration_month, maker, fuel, state, COUNT(*) AS registrations FROM reg GROUP BY y, m, maker, fuel, state",
    "marginals_grouping_sets": f"{_REG} {_FAMILIES}",
    "marginals_independent": f"{_REG} {_FAMILIES}",
    "quality_checks": """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS r, CAST(month(l_shipdate) AS INT) AS m, CASE WHEN l_orderkey % 7 = 0 THEN CAST(month(l_shipdate) AS INT) % 12 + 1 ELSE CAST(month(l_shipdate) AS INT) END AS p FROM lineitem)
SELECT 'ods_count' AS name, COUNT(*) AS value FROM l UNION ALL SELECT 'dwd_count', COUNT(*) FROM l UNION ALL SELECT 'distinct_lineage_count', COUNT(DISTINCT r) FROM l
UNION ALL SELECT 'invalid_partition_count', COUNT(*) FROM l WHERE m <> p UNION ALL SELECT 'invalid_lineage_count', COUNT(*) FROM l WHERE r < 1""",
    "reconcile_missing_extra_mismatch": f"""{_REG}, base AS (SELECT * FROM reg), e AS (WITH reg AS (SELECT * FROM base WHERE y < 1998 OR m < 7) {_FAMILIES}), a AS (WITH reg AS (SELECT * FROM base WHERE fuel <> '1-URGENT') {_FAMILIES})
SELECT coalesce(e.dimension, a.dimension) AS dimension, coalesce(e.key1, a.key1) AS key1, coalesce(e.key2, a.key2) AS key2,
  CASE WHEN a.dimension IS NULL THEN 'missing' WHEN e.dimension IS NULL THEN 'extra' ELSE 'mismatch' END AS status, coalesce(e.registrations, -1) AS expected, coalesce(a.registrations, -1) AS actual
FROM e FULL JOIN a ON e.dimension = a.dimension AND e.key1 = a.key1 AND e.key2 = a.key2 WHERE e.registrations IS DISTINCT FROM a.registrations""",
    "dq_reasons": f"SELECT coalesce({_REASON}, 'accepted') AS reason, COUNT(*) AS n FROM orders GROUP BY 1",
    "dq_rejected_samples": f"SELECT o_orderkey AS source_row, {_REASON} AS reason FROM orders WHERE {_REASON} IS NOT NULL ORDER BY 1, 2 LIMIT 50",
    "row_identity": "SELECT COUNT(*) AS n, COUNT(*) AS identities, CAST(1 AS BIGINT) AS low, COUNT(*) AS high FROM lineitem",
    "srv_monthly_all": f"{_REG} SELECT ym AS year_month, COUNT(*) AS registrations FROM reg WHERE {_PERIOD} GROUP BY ym",
    "srv_monthly_maker_zero_fill": f"{_REG} SELECT ym AS year_month, count_if(upper(maker) = 'BUILDING')::BIGINT AS registrations FROM reg WHERE {_PERIOD} GROUP BY ym",
    "srv_brand_compare": f"{_REG} SELECT upper(maker) AS maker, COUNT(*) AS registrations FROM reg WHERE {_PERIOD} AND upper(maker) IN ('BUILDING', 'MACHINERY') GROUP BY 1",
    "srv_maker_ranking": f"{_REG} SELECT upper(maker) AS maker, COUNT(*) AS registrations FROM reg WHERE {_PERIOD} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "srv_fuel_monthly_all": f"{_REG} SELECT ym AS year_month, fuel, COUNT(*) AS registrations FROM reg WHERE {_PERIOD} GROUP BY ym, fuel",
    "srv_fuel_monthly_one": f"{_REG} SELECT ym AS year_month, '1-URGENT' AS fuel, count_if(fuel = '1-URGENT')::BIGINT AS registrations FROM reg WHERE {_PERIOD} GROUP BY ym",
    "catalog_distinct": f"{_REG} SELECT DISTINCT 'month' AS kind, ym AS value FROM reg UNION ALL SELECT DISTINCT 'maker', upper(maker) FROM reg UNION ALL SELECT DISTINCT 'fuel', fuel FROM reg",
    "matched_period_summary": f"""{_REG}, c AS (SELECT m FROM reg WHERE y IN (2000, 2001) GROUP BY m HAVING COUNT(DISTINCT y) = 2),
s AS (SELECT upper(maker) AS maker, count_if(y = 2001)::BIGINT AS registrations, count_if(y = 2000)::BIGINT AS previous_registrations FROM reg WHERE y IN (2000, 2001) AND m IN (SELECT m FROM c) GROUP BY 1)
SELECT maker, registrations, previous_registrations, round(CAST(100 AS DOUBLE) * registrations / (SELECT SUM(registrations) FROM s), 4) AS share_pct FROM s""",
    "case_variants": """WITH l AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS label FROM customer)
SELECT upper(label) AS maker, string_agg(label, '|' ORDER BY label) AS labels FROM l GROUP BY 1 HAVING COUNT(*) > 1""",
    "apportion_largest_remainder": """WITH t AS (SELECT c_nationkey, COUNT(*) AS total FROM customer GROUP BY 1), r AS (SELECT c_nationkey, total, CAST(part AS INT) AS part, CAST(total AS DOUBLE) * (CAST(part AS DOUBLE) / 21) AS raw FROM t, range(1, 7) p(part)),
k AS (SELECT *, CAST(floor(raw) AS BIGINT) AS low, row_number() OVER (PARTITION BY c_nationkey ORDER BY raw - floor(raw) DESC, part) AS turn FROM r)
SELECT c_nationkey, part, low + CASE WHEN turn <= total - SUM(low) OVER (PARTITION BY c_nationkey) THEN 1 ELSE 0 END AS units FROM k""",
    "lag_carry_series": f"""{_REG}{_LAG}, r AS (SELECT *, CASE WHEN m % 3 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.875 AS DOUBLE) END AS rate FROM v),
w AS (SELECT *, coalesce(lag(v) OVER a, max(CASE WHEN m = 12 THEN v END) OVER b) AS lv, coalesce(lag(rate) OVER a, max(CASE WHEN m = 12 THEN rate END) OVER b) AS lr FROM r WINDOW a AS (PARTITION BY maker ORDER BY y, m), b AS (PARTITION BY maker, y))
SELECT maker, y AS year, m AS month, CAST(greatest(0, round_even(rate * v + (1 - lr) * lv, 0)) AS BIGINT) AS carried FROM w""",
    "lag_carry_series_all_years": f"""{_REG}, v AS (SELECT maker, y, m, COUNT(*) AS v FROM reg GROUP BY maker, y, m), r AS (SELECT *, CASE WHEN m % 3 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.875 AS DOUBLE) END AS rate FROM v),
w AS (SELECT *, coalesce(lag(v) OVER a, max(CASE WHEN m = 12 THEN v END) OVER b) AS lv, coalesce(lag(rate) OVER a, max(CASE WHEN m = 12 THEN rate END) OVER b) AS lr FROM r WINDOW a AS (PARTITION BY maker ORDER BY y, m), b AS (PARTITION BY maker, y))
SELECT maker, y AS year, m AS month, CAST(greatest(0, round_even(rate * v + (1 - lr) * lv, 0)) AS BIGINT) AS carried FROM w""",
    "lambda_sweep": f"""{_REG}{_LAG}, x AS (SELECT * FROM v, (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE)), (CAST(1.0 AS DOUBLE))) s(scale)),
w AS (SELECT *, CAST(greatest(0, round_even(scale * v + (1 - scale) * coalesce(lag(v) OVER (PARTITION BY maker, scale ORDER BY y, m), max(CASE WHEN m = 12 THEN v END) OVER (PARTITION BY maker, scale, y)), 0)) AS BIGINT) AS c FROM x),
t AS (SELECT scale, m, arg_min(maker, (-v, maker)) AS a, arg_min(maker, (-c, maker)) AS b, abs(SUM(c) - SUM(v)) AS d FROM w WHERE y = 2000 GROUP BY scale, m)
SELECT scale, count_if(a <> b)::BIGINT AS flips, CAST(max(d) AS BIGINT) AS widest FROM t GROUP BY scale""",
    "lambda_sweep_all_scales": f"""{_REG}, v AS (SELECT maker, state, y, m, COUNT(*) AS v FROM reg GROUP BY ALL), x AS (SELECT *, least(1.0::DOUBLE, scale * 0.75::DOUBLE) AS rate FROM v, (VALUES {", ".join(f"(CAST({s} AS DOUBLE))" for s in ablation.SCALES)}) s(scale)),
w AS (SELECT *, CAST(greatest(0, round_even(rate * v + (1 - rate) * coalesce(lag(v) OVER (PARTITION BY maker, state, scale ORDER BY y, m), max(CASE WHEN m = 12 THEN v END) OVER (PARTITION BY maker, state, scale, y)), 0)) AS BIGINT) AS c FROM x),
z AS (SELECT * FROM w WHERE y = 2000),
a AS (SELECT scale, m, arg_min(maker, (-t, maker)) AS a, arg_min(maker, (-r, maker)) AS b FROM (SELECT scale, m, maker, SUM(v) AS t, SUM(c) AS r FROM z GROUP BY ALL) GROUP BY scale, m),
b AS (SELECT scale, state, arg_min(maker, (-t, maker)) AS a, arg_min(maker, (-r, maker)) AS b FROM (SELECT scale, state, maker, SUM(v) AS t, SUM(c) AS r FROM z GROUP BY ALL) GROUP BY scale, state),
g AS (SELECT scale, max(abs(round(CAST(r - t AS DOUBLE) / CAST(t AS DOUBLE) * 100, 2))) AS month_gap_abs_max FROM (SELECT scale, m, SUM(v) AS t, SUM(c) AS r FROM z GROUP BY scale, m) GROUP BY scale)
SELECT scale, (SELECT count_if(a <> b) FROM a WHERE a.scale = g.scale)::BIGINT AS month_flips, (SELECT count_if(a <> b) FROM b WHERE b.scale = g.scale)::BIGINT AS region_flips, month_gap_abs_max FROM g""",
    "adjacent_gap": f"""{_REG}, s AS (SELECT state, COUNT(*) AS n FROM reg GROUP BY state), o AS (SELECT CAST(row_number() OVER w AS INT) AS place, state AS leader, lead(state) OVER w AS follower, n, lead(n) OVER w AS b FROM s WINDOW w AS (ORDER BY n DESC, state))
SELECT place, leader, follower, round((CAST(n AS DOUBLE) / b - 1) * 100, 2) AS gap_pct FROM o WHERE follower IS NOT NULL""",
    "adjacent_pairs_kept": f"""{_REG}, s AS (SELECT state, COUNT(*) AS n FROM reg GROUP BY state),
o AS (SELECT CAST(row_number() OVER w AS INT) AS place, state AS leader, lead(state) OVER w AS follower, n, lead(n) OVER w AS b FROM s WINDOW w AS (ORDER BY n DESC, state)),
d AS (SELECT ym, place, count_if(state = leader) - count_if(state = follower) AS ahead FROM o JOIN reg ON state IN (leader, follower) WHERE follower IS NOT NULL GROUP BY ym, place)
SELECT place, leader, follower, round((CAST(n AS DOUBLE) / b - 1) * 100, 2) AS gap_pct, (SELECT count_if(ahead > 0) FROM d WHERE d.place = o.place)::BIGINT AS kept, (SELECT COUNT(DISTINCT ym) FROM reg) AS periods
FROM o WHERE follower IS NOT NULL""",
    "top1_flip_by_month": f"""{_F}, s AS (SELECT month, energy, SUM(tiv) AS t, SUM(reg) AS r FROM f WHERE year = {YEAR} GROUP BY month, energy)
SELECT month, arg_min(energy, (-t, energy)) AS tiv_top, arg_min(energy, (-r, energy)) AS reg_top FROM s GROUP BY month""",
    "value_gap_stats": f"{_GAPS} SELECT min(g) AS low, max(g) AS high, round(avg(g), 6) AS mean FROM g",
    "upper_median_gap": f"{_GAPS}, o AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, COUNT(*) OVER () AS n FROM g) SELECT g AS upper_median FROM o WHERE i = n // 2",
    "month_spine": f"""{_REG}, b AS (SELECT date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS z FROM orders), s AS (SELECT strftime(unnest(generate_series(a, z, INTERVAL 1 MONTH)), '%Y-%m') AS ym FROM b)
SELECT s.ym AS year_month, count(reg.ym) AS registrations FROM s LEFT JOIN reg ON reg.ym = s.ym AND maker = 'BUILDING' AND fuel = '1-URGENT' AND state = 'NATION_3' GROUP BY s.ym""",
    "wordcount": r"SELECT word, COUNT(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM benchmark) WHERE word <> '' GROUP BY word",
    "smoke_group_sum": "SELECT l_returnflag AS category, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1",
    "lineage_upstream_recursive": f"""WITH RECURSIVE e(src, dst) AS (VALUES {_values([(a, b) for a, b, *_ in EDGES])}), up(object_name, depth) AS (SELECT 'metric.share', 0 UNION ALL SELECT e.src, depth + 1 FROM up JOIN e ON e.dst = up.object_name)
SELECT object_name, min(depth) AS depth FROM up GROUP BY object_name""",
    "token_overlap_topk": r"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 1 AND x NOT IN ('a','an','the','of','to','for','in','on','is','are'))) AS t FROM benchmark),
q AS (SELECT t AS q FROM w ORDER BY item_id LIMIT 1)
SELECT CAST(item_id AS VARCHAR) AS id, round(len(list_intersect(t, q)) / sqrt(CAST(len(q) AS DOUBLE)), 4) AS score FROM w, q WHERE len(list_intersect(t, q)) > 0 ORDER BY score DESC, id LIMIT 5""",
}
