"""Stored aggregates over a lattice of grouping sets: which to keep under a row budget, and which one answers a request.

A view sums the measures by year and some of DIMENSIONS. The sizes of all views are measured in one pass over the finest. A view
is worth what it spares: for each set of columns that it covers, the rows of the smallest table so far minus its own. Views
are chosen greedily by what they spare for each row they take. A request goes to the smallest view that has its columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .star import Star, View

DIMENSIONS = ("month", "brand_id", "region_id", "energy")
SETS = [frozenset(c) for n in range(len(DIMENSIONS) + 1) for c in combinations(DIMENSIONS, n)]
#: The columns by which each question groups; models are in no view.
GROUPED = {
    "brand_rank": {"brand_id"}, "brand_total": {"brand_id"}, "share": {"brand_id"}, "yoy_brand": {"brand_id"}, "origin_split": {"brand_id"},
    "month_trend": {"month"}, "region_rank": {"region_id"},
}
FILTERED = {"origin": "brand_id", "brand_id": "brand_id", "month": "month", "region_id": "region_id", "energy": "energy"}


def named(columns: Iterable[str]) -> str:
    """A view's name: ads.year and its columns in the order of DIMENSIONS."""
    return "_".join(["ads.year", *[d.removesuffix("_id") for d in DIMENSIONS if d in columns]])


def sums(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    by = ["year", *[d for d in DIMENSIONS if d in columns]]
    return rows.groupBy(*by).agg(F.sum("tiv_units").alias("tiv_units"), F.sum("registration_units").alias("registration_units"))


def finest(star: Star) -> DataFrame:
    """The view by all dimensions. Facts of unknown regions stay, with a null, as questions without regions count them."""
    rows = star.fact.join(star.model, "model_id").join(star.brand.select("brand_id"), "brand_id", "left_semi")
    regions = star.region.select("region_key", "region_id")
    rows = rows.drop("region_id") if "region_id" in rows.columns else rows
    return sums(rows.join(regions, "region_key", "left"), DIMENSIONS)


def sizes(top: DataFrame) -> DataFrame:
    """(view, n_rows) of every view, from one pass over the finest."""
    sets = top.groupingSets([[F.col("year"), *[F.col(d) for d in DIMENSIONS if d in s]] for s in SETS], "year", *DIMENSIONS)
    counts = sets.agg(F.grouping_id().alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n_rows"))
    bits = lambda s: sum(1 << (len(DIMENSIONS) - 1 - i) for i, d in enumerate(DIMENSIONS) if d not in s)
    names = F.create_map(*[x for s in SETS for x in (F.lit(bits(s)).cast("long"), F.lit(named(s)))])
    return counts.select(F.element_at(names, F.col("g").cast("long")).alias("view"), "n_rows")


def choose(measured: dict[str, int], fact_rows: int, budget: int) -> list[str]:
    """Views worth keeping, the most valuable for a row first; together they have at most `budget` rows."""
    sets = {named(s): s for s in SETS}
    cost = {name: fact_rows for name in sets}
    chosen: list[str] = []
    while True:
        left = budget - sum(measured[v] for v in chosen)
        gains = []
        for name, columns in sets.items():
            if name in chosen or measured[name] > left:
                continue
            gain = sum(max(0, cost[other] - measured[name]) for other, below in sets.items() if below <= columns)
            if gain > 0:
                gains.append((-gain / max(1, measured[name]), measured[name], name))
        if not gains:
            return chosen
        best = min(gains)[2]
        chosen.append(best)
        for other, below in sets.items():
            if below <= sets[best]:
                cost[other] = min(cost[other], measured[best])


def needed(task: str, params: dict) -> frozenset[str] | None:
    """The columns that a question reads beside the year; None where no view can have them."""
    if task not in GROUPED:
        return None
    market = {"brand_id"} if task == "share" else set()
    return frozenset(GROUPED[task] | market | {FILTERED[k] for k, v in params.items() if k in FILTERED and v is not None})


def route(views: dict[str, View], task: str, params: dict) -> str | None:
    """The smallest view with all the columns of the question; None if only the facts have them."""
    columns = needed(task, params)
    fit = [] if columns is None else [(v.n_rows, name) for name, v in views.items() if columns <= v.columns]
    return min(fit)[1] if fit else None


def with_views(star: Star, top: DataFrame, fact_rows: int, budget: int, store: Callable[[str, DataFrame], DataFrame], measured: dict[str, int] | None = None) -> Star:
    """The star with its chosen views. store writes a view's rows under a name and reads them back, when a question needs them."""
    measured = measured or {r["view"]: r["n_rows"] for r in sizes(top).collect()}  # sixteen rows
    sets = {named(s): s for s in SETS}
    for name in choose(measured, fact_rows, budget):
        star.views[name] = View(sets[name], partial(store, name, sums(top, sets[name])), measured[name])
    return star
