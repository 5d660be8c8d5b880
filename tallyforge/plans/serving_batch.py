"""Many serving requests as one plan: a table of requests joined with the families' months.

A request covers the months from its start to its end. Periods are split at year ends, so the join with the months is by
year, with the bounds as a further condition within a year: twelve months meet a piece of a request at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("month", "month_maker", "month_fuel")


def series(rows: DataFrame) -> DataFrame:
    """(kind, label, year_month, registrations) of the month families of a snapshot; the label of all months is null."""
    label = F.when(F.col("dimension") == "month_maker", F.col("maker_norm")).when(F.col("dimension") == "month_fuel", F.col("fuel"))
    return rows.where(F.col("dimension").isin(*KINDS)).groupBy(F.col("dimension").alias("kind"), label.alias("label"), "year_month").agg(F.sum("registrations").alias("registrations"))


def monthly(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, kind, label, year_month, registrations): each month of each request that the snapshot has, 0 where it has no count.

    requests: request, kind (one of KINDS), label (a maker's key, a fuel, or null), start_month, end_month as YYYY-MM. A period
    that ends before it starts has no months.
    """
    found = series(rows)
    months = rows.where("dimension = 'month'").select("year_month", F.substring("year_month", 1, 4).cast("int").alias("year")).distinct()
    of = lambda c: F.substring(c, 1, 4).cast("int")
    pieces = requests.where("start_month <= end_month").withColumn("year", F.explode(F.sequence(of("start_month"), of("end_month"))))
    covered = pieces.join(months, "year").where(F.col("year_month").between(F.col("start_month"), F.col("end_month")))
    label = F.coalesce("label", F.lit(""))
    covered = covered.select("request", "kind", "label", "year_month", label.alias("__label"))
    counts = found.select(F.col("kind").alias("__kind"), label.alias("__of"), F.col("year_month").alias("__month"), "registrations")
    joined = covered.join(counts, (F.col("kind") == F.col("__kind")) & (F.col("__label") == F.col("__of")) & (F.col("year_month") == F.col("__month")), "left")
    return joined.select("request", "kind", "label", "year_month", F.coalesce("registrations", F.lit(0).cast("long")).alias("registrations"))


def totals(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, months, registrations) of each request that has months."""
    return monthly(rows, requests).groupBy("request").agg(F.count(F.lit(1)).alias("months"), F.sum("registrations").alias("registrations"))


def every_label(rows: DataFrame) -> DataFrame:
    """(kind, label): all months, every maker and every fuel of a snapshot."""
    return series(rows).select("kind", "label").distinct()


def grid(rows: DataFrame) -> DataFrame:
    """Requests for every label and every period between two months of the snapshot. They grow with the square of the months, not with the rows."""
    months = rows.where("dimension = 'month'").select(F.array_sort(F.collect_set("year_month")).alias("m"))  # one row, twelve entries a year
    starts = every_label(rows).crossJoin(F.broadcast(months)).select("kind", "label", "m", F.posexplode("m").alias("i", "start_month"))
    pairs = starts.select("kind", "label", "start_month", F.explode(F.slice("m", F.col("i") + 1, F.size("m") - F.col("i"))).alias("end_month"))
    return pairs.withColumn("request", F.concat_ws("|", "kind", F.coalesce("label", F.lit("")), "start_month", "end_month"))
