"""Key, reference and domain rules that Spark tables don't enforce, as counts of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and not in target."""
    return rows.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def violations(table: str, rows: DataFrame, key: list[str], domains: dict[str, Column], references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, rule, violations): one row for the key, each domain (a condition that must be true) and each reference."""
    counted = lambda frame, rule: frame.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations")
    parts = [counted(duplicates(rows, key), "unique " + ",".join(key))]
    if domains:
        wide = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in domains.items()])
        pairs = F.array(*[F.struct(F.lit(f"domain {n}").alias("rule"), F.col(f"`{n}`").alias("violations")) for n in domains])
        parts.append(wide.select(F.explode(pairs).alias("x")).select(F.lit(table).alias("table_name"), "x.*"))
    parts += [counted(orphans(rows, c, target, k), f"reference {c}") for c, (target, k) in references.items()]
    return reduce(DataFrame.unionByName, parts)


def mart_violations(star) -> DataFrame:
    """The mart's rules: keys of all tables, months, units, origins and energies, and the fact's references."""
    fact = violations(
        "fact_month", star.fact, ["year", "month", "model_id", "region_id"],
        {"month": F.col("month").between(1, 12), "units": (F.col("tiv_units") >= 0) & (F.col("registration_units") >= 0)},
        {"model_id": (star.model, "model_id"), "region_id": (star.region, "region_id")},
    )
    model = violations("dim_model", star.model, ["model_id"], {"energy": F.col("energy").isin("ice", "hybrid", "ev")}, {"brand_id": (star.brand, "brand_id")})
    brand = violations("dim_brand", star.brand, ["brand_id"], {"origin": F.col("origin").isin("national", "non_national")}, {})
    return fact.unionByName(model).unionByName(brand)
