"""The mart: dimensions, the apportioned and lagged fact table, and its aggregates, all as lazy DataFrames."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.apportion import apportion, carry_over
from . import constants as C
from .star import Star


def brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.BRANDS, "brand_id int, brand_name string, origin string")


def models(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(C.MODELS, "model_id int, brand_id int, model_name string, body string, energy string, price_band string, share double")
    return rows.drop("share")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:3] for r in C.REGIONS], "region_id int, region_name string, region_name_zh string")


def metrics(spark: SparkSession) -> DataFrame:
    rows = [(k, *v, C.METRIC_OWNER, C.METRIC_VERSION) for k, v in C.METRICS.items()]
    return spark.createDataFrame(rows, "metric_key string, display_name string, definition string, grain string, owner string, version string")


def anchors(spark: SparkSession) -> DataFrame:
    """Year totals of each brand; Others is what the year's total leaves."""
    rows = []
    for year, named in C.BRAND_YEAR.items():
        full = named | {"Others": C.YEAR_TOTALS[year] - sum(named.values())}
        rows += [(year, b, n, "synthetic residual / not an official MAA line" if b in ("Chery", "Others") else "public TIV-style year total (reported); not a JPJ extract") for b, n in full.items()]
    return spark.createDataFrame(rows, "year int, brand_name string, tiv_units long, source_note string")


def lookup(values: dict, key: Column, default: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def wholesale(spark: SparkSession) -> DataFrame:
    """TIV by year, month, model and region: year totals apportioned to months, then models, then regions."""
    months = spark.createDataFrame([(y, m, w) for y, ws in C.MONTH_WEIGHTS.items() for m, w in enumerate(ws, 1)], "year int, month int, month_weight double")
    shares = spark.createDataFrame([(m[0], m[1], m[6], C.MODEL_ORDER.get(m[0], m[0])) for m in C.MODELS], "model_id int, brand_id int, share double, turn int")
    places = spark.createDataFrame([(r[0], r[3]) for r in C.REGIONS], "region_id int, region_weight double")
    rows = anchors(spark).join(brands(spark), "brand_name").withColumnRenamed("tiv_units", "year_units").join(months, "year")
    rows = apportion(rows, ["year", "brand_id"], "year_units", "month_weight", "month", "month_units").join(shares, "brand_id")
    rows = apportion(rows, ["year", "brand_id", "month"], "month_units", "share", "turn", "model_units").crossJoin(F.broadcast(places))  # seven rows
    rows = apportion(rows, ["year", "month", "model_id"], "model_units", "region_weight", "region_id", "tiv_units")
    return rows.select("year", "month", "model_id", "region_id", "brand_name", "tiv_units")


def rate(scale: float | Column = 1.0) -> Column:
    """Share of a month's wholesale that is registered in that month."""
    base = lookup(C.SAME_MONTH_RATE, F.col("brand_name"), C.DEFAULT_RATE) * (F.lit(scale) if isinstance(scale, float) else scale)
    return F.least(F.lit(1.0), F.when(F.col("month") % 3 == 0, base * C.QUARTER_END).otherwise(base))


def registered(rows: DataFrame, scale: float | Column = 1.0, more: list[str] | None = None) -> DataFrame:
    return carry_over(rows, ["model_id", "region_id", *(more or [])], "tiv_units", rate(scale), lookup(C.REGION_BUMP, F.col("region_id"), C.OTHER_BUMP), "registration_units")


def facts(spark: SparkSession) -> DataFrame:
    return registered(wholesale(spark)).drop("brand_name")


def brand_year(fact: DataFrame, model: DataFrame) -> DataFrame:
    return fact.join(model, "model_id").groupBy("year", "brand_id").agg(F.sum("tiv_units").alias("tiv_units"), F.sum("registration_units").alias("registration_units"))


def brand_month(fact: DataFrame, model: DataFrame) -> DataFrame:
    return fact.join(model, "model_id").groupBy("year", "month", "brand_id").agg(F.sum("tiv_units").alias("tiv_units"), F.sum("registration_units").alias("registration_units"))


def star(spark: SparkSession, path: str | None = None) -> Star:
    """The mart as a star; with a path its tables are written there once and read from it."""
    fact, model = facts(spark), models(spark)
    if path is not None:
        try:
            fact = spark.read.parquet(f"{path}/fact_month")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            fact.write.partitionBy("year").parquet(f"{path}/fact_month")
            fact = spark.read.parquet(f"{path}/fact_month")
    region = regions(spark).withColumn("region_key", F.col("region_id"))
    return Star(fact.withColumn("region_key", F.col("region_id")), model, brands(spark), region, brand_year(fact, model))
