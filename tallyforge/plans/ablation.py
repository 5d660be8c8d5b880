"""What the two metrics and the guards change: flips, gaps, margins and the sensitivity to the registration rate."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import half_even
from . import constants as C
from . import mart
from .ask import ask
from .star import Star

#: Ranges of values in which a median is looked for.
_RANGES = 4096
SCALES = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2)


def top1(rows: DataFrame, by: list[str], name: str, columns: dict[str, str]) -> DataFrame:
    """The leading name of each group for each measure; ties go to the smaller name."""
    sums = rows.groupBy(*by, name).agg(*[F.sum(c).alias(c) for c in columns])
    lead = lambda c: F.min_by(F.col(name), F.struct((-F.col(c)).alias("u"), F.col(name).alias("n")))
    return sums.groupBy(*by).agg(*[lead(c).alias(out) for c, out in columns.items()])


def orders(rows: DataFrame, by: list[str], name: str, columns: dict[str, str]) -> DataFrame:
    """All names of each group in order of each measure (a group's names are a dimension, not rows)."""
    sums = rows.groupBy(*by, name).agg(*[F.sum(c).alias(c) for c in columns])
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("u"), F.col(name).alias("n")))), lambda x: x["n"])
    return sums.groupBy(*by).agg(*[ordered(c).alias(out) for c, out in columns.items()])


def adjacent_gaps(totals: DataFrame, name: str, units: str) -> DataFrame:
    """Each name with the next smaller one and by how many per cent it leads.

    totals: one row for each name of a dimension, such as brands or states; all are ordered in one task.
    """
    line = Window.partitionBy(F.lit(0)).orderBy(F.desc(units), name)
    rows = totals.select(F.row_number().over(line).alias("place"), F.col(name).alias("leader"), F.lead(name).over(line).alias("follower"), F.col(units).alias("a"), F.lead(units).over(line).alias("b"))
    return rows.where("follower is not null").select("place", "leader", "follower", F.round((F.col("a").cast("double") / F.col("b") - 1) * 100, 2).alias("gap_pct"))


def pairs_kept(rows: DataFrame, name: str, units: str, by: list[str]) -> DataFrame:
    """Neighbours in the order of all rows, by how many per cent the leader leads, and in how many periods it is ahead.

    by: the columns of a period. A name without rows in a period counts as 0 there; equal counts are no lead.
    """
    sums = rows.groupBy(name, *by).agg(F.sum(units).alias("units"))
    pairs = adjacent_gaps(sums.groupBy(name).agg(F.sum("units").alias("units")), name, "units")
    periods = sums.select(*by).distinct().agg(F.count(F.lit(1)).alias("periods"))  # one row
    sides = pairs.select("place", F.explode(F.array(F.struct(F.col("leader").alias(name), F.lit(1).alias("side")), F.struct(F.col("follower").alias(name), F.lit(-1).alias("side")))).alias("s")).select("place", "s.*")
    ahead = sides.join(sums, name).groupBy("place", *by).agg(F.sum(F.col("side") * F.col("units")).alias("lead"))
    kept = ahead.groupBy("place").agg(F.count_if(F.col("lead") > 0).alias("kept"))
    return pairs.join(kept, "place").crossJoin(F.broadcast(periods)).select("place", "leader", "follower", "gap_pct", "kept", "periods")


def gaps(rows: DataFrame, by: str, base: str = "tiv_units", other: str = "registration_units") -> DataFrame:
    sums = rows.groupBy(by).agg(F.sum(base).alias("base"), F.sum(other).alias("other"))
    return sums.select(by, F.round(F.try_divide((F.col("other") - F.col("base")).cast("double"), F.col("base").cast("double")) * 100, 2).alias("gap_pct"))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """The middle value in order, the larger of two: element n // 2 from 0. Values are counted first, equal ones together,
    and only their counts are added up in order: by ranges of values, then within the one range that holds the middle."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    low, high, total = counts.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    if total is None:
        return rows.sparkSession.createDataFrame([(None,)], "upper_median double")
    width = (float(high) - float(low)) / _RANGES or 1.0
    ranged = counts.withColumn("range", F.least(F.floor((F.col("v").cast("double") - float(low)) / width), F.lit(_RANGES - 1)))
    sums = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect())  # at most _RANGES
    before = 0
    for middle, n in sums:
        if before + n > total // 2:
            break
        before += n
    line = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.where(F.col("range") == middle).withColumn("upto", F.sum("n").over(line) + before)
    return inside.where(F.col("upto") > total // 2).agg(F.min("v").alias("upper_median"))


def legacy_gaps(fact: DataFrame) -> DataFrame:
    december = F.when((F.col("year") == 2025) & (F.col("month") == 12), C.LEGACY_DECEMBER_2025).otherwise(1.0)
    bump = mart.lookup(C.LEGACY_BUMP, F.col("region_id"), C.OTHER_LEGACY_BUMP) * december
    rows = fact.withColumn("legacy", F.greatest(F.lit(0).cast("long"), half_even(F.col("tiv_units") * bump)))
    return gaps(rows, "month", "tiv_units", "legacy")


def metric_flip(star: Star, year: int = 2025) -> dict:
    fact = star.fact.where(F.col("year") == year).join(star.model, "model_id").join(star.brand, "brand_id").cache()
    both = {"tiv_units": "tiv", "registration_units": "registration"}
    differs = lambda rows: rows.agg(F.count_if(F.col("tiv") != F.col("registration")), F.count(F.lit(1))).first()
    flips = lambda f, by: "{}/{}".format(*differs(f(fact, by, "brand_name", both)))
    totals = fact.groupBy("brand_name").agg(F.sum("tiv_units").alias("tiv_units"), F.sum("registration_units").alias("registration_units"))
    year_gap = totals.where("tiv_units > 0 and registration_units > 0").select((F.abs(F.col("tiv_units") - F.col("registration_units")) / F.col("tiv_units") * 100).alias("g"))
    low, high, mean = (round(x, 2) for x in year_gap.agg(F.min("g"), F.max("g"), F.avg("g")).first())
    pairs = [r.asDict() for r in pairs_kept(fact, "brand_name", "tiv_units", ["month"]).orderBy("place").collect()]  # a row a brand
    months = [r["gap_pct"] for r in gaps(fact, "month").orderBy("month").collect()]
    legacy = legacy_gaps(fact).orderBy("month")
    old = [r["gap_pct"] for r in legacy.collect()]
    out = {
        "year": year, "top": top1(fact, [], "brand_name", both).first().asDict(), "month_rank_diff": flips(top1, ["month"]), "region_rank_diff": flips(top1, ["region_id"]),
        "full_order_diff_year": bool(differs(orders(fact, [], "brand_name", both))[0]), "full_order_diff_month": flips(orders, ["month"]),
        "year_value_gap_pct": {"min": low, "max": high, "mean": mean}, "adjacent_brand_gap_pct": pairs, "tightest": min(pairs, key=lambda p: p["gap_pct"]) | {"max_year_value_gap_pct": high},
        "month_value_gap_pct": {"by_month": months, "abs_max": max(map(abs, months))},
        "legacy_flat_bump_model": {"by_month": old, "abs_typical": upper_median(legacy.select(F.abs("gap_pct").alias("g")), "g").first()[0], "abs_max": max(map(abs, old))},
    }
    fact.unpersist()
    return out


def lambda_sweep(spark: SparkSession, year: int = 2025, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """scale, month_flips, region_flips, month_gap_abs_max: the series again under every scale, in one plan."""
    steps = spark.createDataFrame([(s,) for s in scales], "scale double")
    rows = mart.registered(mart.wholesale(spark).crossJoin(F.broadcast(steps)), F.col("scale"), ["scale"]).where(F.col("year") == year)
    return sweep_summary(rows, "brand_name", "region_id")


def sweep_summary(rows: DataFrame, name: str, region: str) -> DataFrame:
    """For each scale the months and regions whose leading name differs between the measures, and the widest month's gap."""
    both = {"tiv_units": "tiv", "registration_units": "registration"}
    flips = lambda by, out: top1(rows, ["scale", by], name, both).groupBy("scale").agg(F.count_if(F.col("tiv") != F.col("registration")).alias(out))
    sums = rows.groupBy("scale", "month").agg(F.sum("tiv_units").alias("t"), F.sum("registration_units").alias("r"))
    widest = sums.groupBy("scale").agg(F.max(F.abs(F.round((F.col("r") - F.col("t")).cast("double") / F.col("t") * 100, 2))).alias("month_gap_abs_max"))
    return flips("month", "month_flips").join(flips(region, "region_flips"), "scale").join(widest, "scale").orderBy("scale")


def guard_arms(spark: SparkSession, star: Star, cases: list[dict]) -> dict:
    """The cases with guards on and off: who stops, who answers, and how many guesses go unsaid."""
    stops = [c for c in cases if c["expect_hitl"]]
    answers = [c for c in cases if not c["expect_hitl"]]
    on = {c["id"]: ask(spark, star, c["q"]) for c in cases}
    off = {c["id"]: ask(spark, star, c["q"], force=True) for c in cases}
    top = lambda r: r["rows"][0].get("name") if r["rows"] else None
    right = lambda c, r: not r["hitl"] and bool(r["rows"]) and r["template_id"] == c["template_id"] and r["metric"] == c["metric"] and c.get("top_name") in (None, top(r))
    changed = 0
    for c in stops:
        r = off[c["id"]]
        if r["hitl_code"] == "AMBIGUOUS_METRIC":
            changed += top(ask(spark, star, c["q"] + " TIV")) != top(ask(spark, star, c["q"] + " 上牌"))
        else:
            changed += bool(r["rows"]) and bool(r["guesses"])
    return {
        "guard_on": {"stopped": sum(on[c["id"]]["hitl"] for c in stops), "answered": sum(right(c, on[c["id"]]) for c in answers)},
        "guard_off": {"stopped": sum(off[c["id"]]["hitl"] for c in stops), "guessed": sum(bool(off[c["id"]]["rows"] and off[c["id"]]["guesses"]) for c in stops), "changed": changed,
                      "regression": sum(top(on[c["id"]]) != top(off[c["id"]]) for c in answers)},
        "codes": dict(Counter(off[c["id"]]["hitl_code"] for c in stops)), "n_stop": len(stops), "n_answer": len(answers),
    }
