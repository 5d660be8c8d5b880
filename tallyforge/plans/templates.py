"""The closed set of analytical questions over a star, under one filter contract.

Filters: origin, brand_id, month, region_id, energy. A filter that is None leaves no trace in the plan. A share's
denominator drops brand_id and nothing else. The brand-year aggregate answers what has no month, region or energy; a view
of the lattice answers what it has the columns for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import change_pct, pct
from .star import Star

MEASURES = {"tiv": "tiv_units", "registration": "registration_units"}
DETAIL, AGGREGATE = "dwd.fact_month", "ads.brand_year"
ON_AGGREGATE = ("brand_rank", "brand_total", "share", "yoy_brand", "origin_split")
FILTERS = ("origin", "brand_id", "month", "region_id", "energy")
MODEL_LIMIT = 15


def scan_for(task: str, params: dict | None = None) -> str:
    given = params or {}
    narrow = any(given.get(k) is not None for k in ("month", "region_id", "energy"))
    return AGGREGATE if task in ON_AGGREGATE and not narrow else DETAIL


def rows_for(star: Star, years: list[int], params: dict, scan: str, market: bool = False, region: bool = False) -> DataFrame:
    """The scan joined with the dimensions that the question needs, filtered. market: brand_id is left out."""
    chosen = {k: v for k, v in params.items() if k in FILTERS and v is not None and not (market and k == "brand_id")}
    if scan == AGGREGATE:
        if star.brand_year is None:
            raise ValueError("this star has no brand-year aggregate")
        if set(chosen) - {"origin", "brand_id"}:
            raise ValueError(f"the aggregate has no {sorted(set(chosen) - {'origin', 'brand_id'})}")
        rows = star.years(star.brand_year, years).join(star.brand, "brand_id")
    elif scan == DETAIL:
        rows = star.years(star.fact, years)
        if "month" in chosen:
            rows = rows.where(F.col("month") == chosen.pop("month"))
        rows = rows.join(star.model, "model_id").join(star.brand, "brand_id")
        if region or "region_id" in chosen:
            rows = rows.join(star.region.drop("region_id") if "region_id" in rows.columns else star.region, "region_key")
    elif scan in star.views:
        view = star.views[scan]
        wanted = {"brand_id" if k == "origin" else k for k in chosen} | ({"region_id"} if region else set())
        if not wanted <= view.columns:
            raise ValueError(f"{scan} has no {sorted(wanted - view.columns)}")
        rows = star.years(view.rows(), years)
        if "brand_id" in view.columns:
            rows = rows.join(star.brand, "brand_id")
        if region:
            rows = rows.join(star.region.select("region_id", "region_name", "region_name_zh").distinct(), "region_id")
    else:
        raise ValueError(scan)
    for name, value in chosen.items():
        rows = rows.where(F.col(name) == value)
    return rows


def _ranked(by: list[str], names: dict[str, str], limit: int | None = None) -> Callable:
    def build(star: Star, column: str, params: dict, scan: str) -> DataFrame:
        rows = rows_for(star, [params["year"]], params, scan, region="region_id" in by)
        out = rows.groupBy(*by).agg(F.sum(column).alias("units"))
        out = out.select(*[F.col(c).alias(n) for c, n in names.items()], "units").orderBy(F.desc("units"), next(iter(names.values())))
        return out.limit(limit) if limit else out

    return build


def _by_model(star: Star, column: str, params: dict, scan: str) -> DataFrame:
    rows = rows_for(star, [params["year"]], params, scan).groupBy("brand_name", "model_name").agg(F.sum(column).alias("units"))
    return rows.select(F.concat_ws(" ", "brand_name", "model_name").alias("name"), "units").orderBy(F.desc("units"), "name").limit(MODEL_LIMIT)


def _by_month(star: Star, column: str, params: dict, scan: str) -> DataFrame:
    return rows_for(star, [params["year"]], params, scan).groupBy("month").agg(F.sum(column).alias("units")).orderBy("month")


def _share(star: Star, column: str, params: dict, scan: str) -> DataFrame:
    """One scan: brands are summed under all filters but brand_id; the market is their total, then brand_id applies."""
    brands = rows_for(star, [params["year"]], params, scan, market=True).groupBy("brand_id", "brand_name").agg(F.sum(column).alias("units"))
    market = brands.agg(F.sum("units").alias("market"))  # one row
    if params.get("brand_id") is not None:
        brands = brands.where(F.col("brand_id") == params["brand_id"])
    out = brands.crossJoin(F.broadcast(market)).groupBy("brand_name", "market").agg(F.sum("units").alias("units"))
    return out.select(F.col("brand_name").alias("name"), "units", pct(F.col("units"), F.col("market")).alias("share_pct")).orderBy(F.desc("units"), "name")


def _yoy(star: Star, column: str, params: dict, scan: str) -> DataFrame:
    year = params["year"]
    rows = rows_for(star, [year, year - 1], params, scan)
    of = lambda y: F.sum(F.when(F.col("year") == y, F.col(column)).otherwise(0))
    out = rows.groupBy("brand_name").agg(of(year).alias("units"), of(year - 1).alias("units_ly"))
    return out.select(F.col("brand_name").alias("name"), "units", "units_ly", change_pct(F.col("units"), F.col("units_ly")).alias("yoy_pct")).orderBy(F.desc("units"), "name")


TEMPLATES: dict[str, Callable[[Star, str, dict, str], DataFrame]] = {
    "brand_rank": _ranked(["brand_name"], {"brand_name": "name"}),
    "model_rank": _by_model,
    "brand_total": _ranked(["brand_name"], {"brand_name": "name"}),
    "region_rank": _ranked(["region_id", "region_name", "region_name_zh"], {"region_name": "name", "region_name_zh": "name_zh"}),
    "month_trend": _by_month,
    "share": _share,
    "yoy_brand": _yoy,
    "origin_split": _ranked(["origin"], {"origin": "name"}),
}


def answer(star: Star, task: str, metric: str, params: dict, scan: str | None = None) -> DataFrame:
    """The question's result. An unknown metric or scan is a ValueError, an unknown task a KeyError."""
    if metric not in MEASURES:
        raise ValueError(metric)
    scan = scan or scan_for(task, params)
    if scan == AGGREGATE and task in TEMPLATES and task not in ON_AGGREGATE:
        raise KeyError(task)
    return TEMPLATES[task](star, MEASURES[metric], params, scan)
