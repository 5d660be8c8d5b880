"""Every template, metric and filter against sums over plain rows."""

import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.plans.mart import brand_year
from tallyforge.plans.star import Star
from tallyforge.plans.templates import AGGREGATE, DETAIL, ON_AGGREGATE, TEMPLATES, answer, scan_for

BRANDS = [(1, "B1", "national"), (2, "B2", "non_national"), (3, "B3", "national")]
MODELS = [(m, (m + 1) // 2, f"M{m}", ["ev", "ice", "ev", "hybrid", "ev", "ice"][m - 1]) for m in range(1, 7)]
FACTS = [
    (y, mo, m, r, u := (y - 2023) * 100 + (m + 1) // 2 * 10 + m + mo + r, u + 7)
    for y, mo, m, r in itertools.product((2024, 2025), (1, 2), range(1, 7), (1, 2))
]
FILTERS = [
    {}, {"origin": "national"}, {"origin": "non_national"}, {"brand_id": 1}, {"month": 1}, {"region_id": 2}, {"energy": "ev"}, {"brand_id": 3, "month": 2},
    {"origin": "national", "energy": "ice"}, {"brand_id": 2, "origin": "national"}, {"brand_id": 1, "month": 1, "region_id": 1, "energy": "ev", "origin": "national"},
]
PAIRS = [{k: v for k, v in (("brand_id", b), ("origin", o)) if v is not None} for b in (None, 1, 2) for o in (None, "national", "non_national")]


@pytest.fixture(scope="module")
def star(spark):
    fact = spark.createDataFrame(FACTS, "year int, month int, model_id int, region_id int, tiv_units long, registration_units long").withColumn("region_key", F.col("region_id")).cache()
    model = spark.createDataFrame(MODELS, "model_id int, brand_id int, model_name string, energy string")
    brand = spark.createDataFrame(BRANDS, "brand_id int, brand_name string, origin string")
    region = spark.createDataFrame([(1, 1, "R1", "一"), (2, 2, "R2", "二")], "region_key int, region_id int, region_name string, region_name_zh string")
    return Star(fact, model, brand, region, brand_year(fact, model).cache())


def expected(task, column, filters, year=2025):
    named = {b: (n, o) for b, n, o in BRANDS}
    rows = [
        {"year": y, "month": mo, "region_id": r, "brand_id": b, "origin": named[b][1], "energy": e, "brand": named[b][0], "model": n, "u": (t, g)[column]}
        for y, mo, m, r, t, g in FACTS for _, b, n, e in [MODELS[m - 1]]
    ]
    fit = lambda r, f: all(r[k] == v for k, v in f.items())
    key = {"model_rank": lambda r: f"{r['brand']} {r['model']}", "region_rank": lambda r: f"R{r['region_id']}", "month_trend": lambda r: r["month"], "origin_split": lambda r: r["origin"]}.get(task, lambda r: r["brand"])
    sums, last = defaultdict(int), defaultdict(int)
    for r in rows:
        if fit(r, filters) and r["year"] in ((year, year - 1) if task == "yoy_brand" else (year,)):
            sums[key(r)] += r["u"] * (r["year"] == year)
            last[key(r)] += r["u"] * (r["year"] != year)
    if task == "share":
        market = sum(r["u"] for r in rows if r["year"] == year and fit(r, {k: v for k, v in filters.items() if k != "brand_id"}))
        return {k: (v, 100 * v / market) for k, v in sums.items()}
    if task == "yoy_brand":
        return {k: (v, last[k], 100 * (v - last[k]) / last[k]) for k, v in sums.items()}
    return {k: (v,) for k, v in sums.items()}


def check(star, task, scan, filters):
    for metric, column in (("tiv", 0), ("registration", 1)):
        rows = answer(star, task, metric, {"year": 2025} | filters, scan).collect()
        want = expected(task, column, filters)
        first = "month" if task == "month_trend" else "name"
        assert {r[first] for r in rows} == set(want)
        for r in rows:
            values = [r[c] for c in ("units", "units_ly", "share_pct", "yoy_pct") if c in r.asDict()]
            assert all(abs(a - b) <= (0.051 if isinstance(a, float) else 0) for a, b in zip(values, want[r[first]], strict=True))
        if task not in ("month_trend", "brand_total"):
            assert [r["units"] for r in rows] == sorted((r["units"] for r in rows), reverse=True)


@pytest.mark.parametrize("task", list(TEMPLATES))
def test_detail_grid(star, task):
    for filters in FILTERS:
        check(star, task, DETAIL, filters)


@pytest.mark.parametrize("task", ON_AGGREGATE)
def test_aggregate_grid(star, task):
    for filters in PAIRS:
        check(star, task, AGGREGATE, filters)


def test_router_and_refusals(star):
    assert scan_for("share", {"brand_id": 1}) == AGGREGATE and scan_for("share", {"month": 1}) == DETAIL and scan_for("model_rank", {}) == DETAIL
    for bad, error in ((("share", "sales", None), ValueError), (("pie", "tiv", None), KeyError), (("region_rank", "tiv", AGGREGATE), KeyError), (("share", "tiv", "elsewhere"), ValueError)):
        with pytest.raises(error):
            answer(star, bad[0], bad[1], {"year": 2025}, bad[2])
    with pytest.raises(ValueError):
        answer(star, "share", "tiv", {"year": 2025, "month": 1}, AGGREGATE)


def test_a_missing_filter_leaves_no_trace_in_the_plan(star):
    plan = answer(star, "brand_rank", "tiv", {"year": 2025}, DETAIL)._jdf.queryExecution().optimizedPlan().toString()
    assert "(energy" not in plan and "(origin" not in plan and "(year" in plan


def test_growth_is_null_without_a_last_year(star):
    rows = answer(star, "yoy_brand", "tiv", {"year": 2024}, DETAIL).collect()
    assert all(r["units_ly"] == 0 and r["yoy_pct"] is None for r in rows) and len(rows) == 3


def test_upper_median_of_any_column(spark):
    import random

    from tallyforge.plans import ablation

    rng = random.Random(4)
    for n in (1, 2, 3, 10, 101, 1000):
        values = [round(rng.gauss(0, 10) if n % 2 else rng.choice([-3.5, 0.25, 7.0]), 3) for _ in range(n)]
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "g double")
        assert ablation.upper_median(rows, "g").first()[0] == sorted(values)[n // 2]
    assert ablation.upper_median(spark.createDataFrame([], "g double"), "g").first()[0] is None
