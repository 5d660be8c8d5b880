"""Largest-remainder apportionment and the lagged series, as window expressions over long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import half_even


def apportion(rows: DataFrame, keys: list[str], total: str, weight: str, order: str, out: str) -> DataFrame:
    """Splits `total` (equal within keys) by `weight` into whole units that add up to it.

    Everyone gets the floor; the units left go to the largest fractions, ties in `order`.
    """
    raw = F.col(total).cast("double") * F.col(weight)
    cut = rows.withColumn("__raw", raw).withColumn("__floor", F.floor("__raw").cast("long"))
    whole = Window.partitionBy(*keys)
    rank = F.row_number().over(whole.orderBy(F.desc(F.col("__raw") - F.col("__floor")), F.col(order)))
    left = F.col(total) - F.sum("__floor").over(whole)
    return cut.withColumn(out, (F.col("__floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("__raw", "__floor")


def carry_over(rows: DataFrame, series: list[str], value: str, rate: Column, bump: Column, out: str) -> DataFrame:
    """rint((rate * value + (1 - last rate) * last value) * bump), at least 0, along each series by year and month.

    January takes the December before; without a year before, its own year's December.
    """
    line = Window.partitionBy(*series).orderBy("year", "month")
    own_year = Window.partitionBy(*series, "year")
    rated = rows.withColumn("__rate", rate)
    december = lambda c: F.max(F.when(F.col("month") == 12, F.col(c))).over(own_year)
    last_value = F.coalesce(F.lag(value).over(line), december(value))
    last_rate = F.coalesce(F.lag("__rate").over(line), december("__rate"))
    moved = rated.withColumn("__value", last_value).withColumn("__last", last_rate)
    reached = (F.col("__rate") * F.col(value) + (F.lit(1.0) - F.col("__last")) * F.col("__value")) * bump
    return moved.withColumn(out, F.greatest(F.lit(0).cast("long"), half_even(reached))).drop("__rate", "__value", "__last")
