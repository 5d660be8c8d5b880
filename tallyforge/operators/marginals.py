"""Monthly counts, the seven marginal families, quality checks and the matched-period summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import maker_key, pct, two_digits, year_month
from .identities import counted

FINEST = ["registration_year", "registration_month", "maker", "fuel", "state"]
#: A family's columns and how its two keys are named.
FAMILIES = {
    "total": [], "month": FINEST[:2], "maker": ["maker"], "fuel": ["fuel"], "state": ["state"],
    "month_maker": [*FINEST[:2], "maker"], "month_fuel": [*FINEST[:2], "fuel"],
}
NULL_LABEL, ALL = "__NULL__", "ALL"


def monthly(rows: DataFrame) -> DataFrame:
    """ADS: registrations by year, month, maker, fuel and state."""
    return rows.groupBy(*FINEST).agg(F.count(F.lit(1)).alias("registrations"))


def marginals(ads: DataFrame) -> DataFrame:
    """(dimension, key1, key2, registrations): all seven families from one scan by grouping sets."""
    sets = ads.groupingSets([[F.col(c) for c in cols] for cols in FAMILIES.values()], *FINEST)
    rows = sets.agg(F.sum("registrations").alias("registrations"), F.grouping_id().alias("g"))
    full = (1 << len(FINEST)) - 1
    bits = {name: full - sum(1 << (len(FINEST) - 1 - FINEST.index(c)) for c in cols) for name, cols in FAMILIES.items()}
    return rows.select(*_keys(F.col("g"), bits), F.col("registrations").cast("long").alias("registrations"))


def _keys(g, bits: dict[str, int]):
    label = lambda c: F.coalesce(F.col(c), F.lit(NULL_LABEL))
    first = {
        "month": F.col("registration_year").cast("string"), "maker": label("maker"), "fuel": label("fuel"), "state": label("state"),
        "month_maker": year_month(F.col("registration_year"), F.col("registration_month")), "month_fuel": year_month(F.col("registration_year"), F.col("registration_month")),
    }
    second = {"month": two_digits(F.col("registration_month")), "month_maker": label("maker"), "month_fuel": label("fuel")}
    pick = lambda named: _case(g, bits, named)
    return (
        _case(g, bits, {name: F.lit(name) for name in bits}).alias("dimension"),
        F.coalesce(pick(first), F.lit(ALL)).alias("key1"),
        F.coalesce(pick(second), F.lit(ALL)).alias("key2"),
    )


def _case(g, bits, named):
    out = None
    for name, value in named.items():
        out = F.when(g == bits[name], value) if out is None else out.when(g == bits[name], value)
    return out


def independent_marginals(rows: DataFrame) -> DataFrame:
    """The same families counted from the raw rows, by another plan: each row is dealt to its seven keys."""
    month = year_month(F.col("registration_year"), F.col("registration_month"))
    label = lambda c: F.coalesce(F.col(c), F.lit(NULL_LABEL))
    key = lambda d, a, b: F.struct(F.lit(d).alias("dimension"), a.alias("key1"), b.alias("key2"))
    every = F.lit(ALL)
    keys = F.array(
        key("total", every, every), key("month", F.col("registration_year").cast("string"), two_digits(F.col("registration_month"))),
        key("maker", label("maker"), every), key("fuel", label("fuel"), every), key("state", label("state"), every),
        key("month_maker", month, label("maker")), key("month_fuel", month, label("fuel")),
    )
    return rows.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("registrations")).select("k.*", "registrations")


def quality_checks(ods: DataFrame, dwd: DataFrame) -> DataFrame:
    """(name, value): row counts of both layers, distinct row identities, rows with a wrong partition or identity."""
    wrong_partition = (
        F.col("date_reg").isNull() | F.col("registration_year").isNull() | F.col("registration_month").isNull()
        | (F.year("date_reg") != F.col("registration_year")) | (F.month("date_reg") != F.col("registration_month"))
    )
    wrong_identity = F.col("source_sha256").isNull() | ~F.col("source_sha256").rlike("^[0-9a-f]{64}$") | F.col("source_row").isNull() | (F.col("source_row") < 1)
    wrong = {"invalid_partition_count": F.count_if(wrong_partition), "invalid_lineage_count": F.count_if(F.coalesce(wrong_identity, F.lit(True)))}
    counts = counted(dwd, [F.col("source_sha256")], F.col("source_row"), wrong).withColumnsRenamed({"n": "dwd_count", "identities": "distinct_lineage_count"})
    both = counts.crossJoin(F.broadcast(ods.agg(F.count(F.lit(1)).alias("ods_count"))))  # one row each
    names = ["ods_count", "dwd_count", "distinct_lineage_count", "invalid_partition_count", "invalid_lineage_count"]
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in names])).alias("x")).select("x.*")


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that only one side has or whose values differ: keys, status (missing, extra, mismatch), expected, actual."""
    left = expected.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col(value).alias("expected"), F.lit(True).alias("in_expected"))
    right = actual.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col(value).alias("actual"), F.lit(True).alias("in_actual"))
    on = [F.col(f"e_{k}").eqNullSafe(F.col(f"a_{k}")) for k in keys]
    both = left.join(right, on, "full_outer")
    status = F.when(F.col("in_actual").isNull(), "missing").when(F.col("in_expected").isNull(), "extra").when(~F.col("expected").eqNullSafe(F.col("actual")), "mismatch")
    return both.select(*[F.coalesce(f"e_{k}", f"a_{k}").alias(k) for k in keys], status.alias("status"), "expected", "actual").where("status is not null")


def in_common_months(marginal: DataFrame, years: list[int]) -> DataFrame:
    """Rows of month families in the months that both years have: marginal's columns and year."""
    months = marginal.where("dimension = 'month'").select(F.col("key1").cast("int").alias("year"), F.col("key2").alias("mm")).where(F.col("year").isin(*years)).distinct()
    common = months.groupBy("mm").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("mm")  # at most 12
    rows = marginal.where(F.col("dimension").isin("month_maker", "month_fuel")).withColumns({"year": F.substring("key1", 1, 4).cast("int"), "mm": F.substring("key1", 6, 2)})
    return rows.where(F.col("year").isin(*years)).join(F.broadcast(common), "mm", "left_semi").drop("mm")


def matched_makers(marginal: DataFrame, years: list[int]) -> DataFrame:
    """maker, registrations, share_pct, previous_registrations over the months that the two years share."""
    named = in_common_months(marginal, years).where("dimension = 'month_maker'").withColumn("maker", maker_key(F.col("key2")))
    of = lambda y: F.sum(F.when(F.col("year") == y, F.col("registrations")).otherwise(0))
    rows = named.groupBy("maker").agg(of(years[1]).alias("registrations"), of(years[0]).alias("previous_registrations"))
    total = rows.agg(F.sum("registrations").alias("total"))  # one row
    return rows.where("registrations > 0").crossJoin(F.broadcast(total)).select("maker", "registrations", pct(F.col("registrations"), F.col("total"), 4).alias("share_pct"), "previous_registrations")


def matched_period(marginal: DataFrame, top: int = 10) -> dict:
    """Totals of the months that the last two years share, electric share, largest makers and labels that differ in case."""
    months = marginal.where("dimension = 'month'").select(F.col("key1").cast("int").alias("year"), F.col("key2").cast("int").alias("month"), "registrations")
    last = months.agg(F.max("year")).first()[0]
    if last is None:
        raise ValueError("No monthly observations")
    years = [last - 1, last]
    seen = sorted((r["year"], r["month"]) for r in months.select("year", "month").distinct().collect())  # at most 12 a year
    common = sorted({m for y, m in seen if y == years[0]} & {m for y, m in seen if y == years[1]})
    inside = in_common_months(marginal, years)
    totals = {y: 0 for y in years} | {r["year"]: r["n"] for r in months.where(F.col("year").isin(*years) & F.col("month").isin(*(common or [0]))).groupBy("year").agg(F.sum("registrations").alias("n")).collect()}
    electric = {y: 0 for y in years} | {r["year"]: r["n"] for r in inside.where("dimension = 'month_fuel' and key2 = 'electric'").groupBy("year").agg(F.sum("registrations").alias("n")).collect()}
    named = inside.where("dimension = 'month_maker'").withColumn("maker", maker_key(F.col("key2")))
    leading = matched_makers(marginal, years).orderBy(F.desc("registrations"), "maker").limit(top).collect()
    variants = named.groupBy("maker").agg(F.array_sort(F.collect_set("key2")).alias("labels")).where(F.size("labels") > 1).orderBy("maker").collect()
    share = lambda a, b, d=4: round(a / b * 100, d) if b else None
    return {
        "comparison_years": years, "common_months": common, "observed_year_months": [f"{y}-{m:02d}" for y, m in seen], "comparable_registrations": totals,
        "comparable_yoy_pct": round((totals[last] / totals[years[0]] - 1) * 100, 4) if totals[years[0]] else None,
        "electric_registrations": electric, "electric_share_pct": {y: share(electric[y], totals[y]) for y in years},
        "top_makers_current_comparable_period": [r.asDict() for r in leading], "maker_case_variants": {r["maker"]: r["labels"] for r in variants},
    }
