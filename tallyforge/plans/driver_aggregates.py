"""Stored aggregates over the driver's tables: a lattice of views, families kept by deltas, all serving requests; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deltas, marginals
from ..sources import shared
from . import lattice, serving_batch
from .driver_tables import _F, _FAMILIES, _REG, FAMILIES_SQL, YEAR, _rank, _share_sql, ads, registered, snapshot, star
from .templates import answer

#: The views together may have this share of the facts' rows.
BUDGET = 0.5
FACT = ("lineitem", "part", "supplier", "nation", "region")


def _published(spark: SparkSession, sf_dir: str, name: str, make, by: list[str] | None = None) -> DataFrame:
    return shared.published(spark, f"lattice_{name}", [f"{sf_dir}/{t}.parquet" for t in FACT], make, by)


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "top", lambda: lattice.finest(star(spark, sf_dir)), ["year"])


def lattice_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every view."""
    return lattice.sizes(_top(spark, sf_dir))


def star_with_views(spark: SparkSession, sf_dir: str):
    """The star with the views that are worth their rows, each published once for the tables as they are."""
    s, top = star(spark, sf_dir), _top(spark, sf_dir)
    measured = _published(spark, sf_dir, "sizes", lambda: lattice.sizes(top))
    measured = {r["view"]: r["n_rows"] for r in measured.collect()}  # sixteen rows
    n = s.fact.count()  # from the file's footer
    return lattice.with_views(s, top, n, int(BUDGET * n), lambda name, rows: _published(spark, sf_dir, name, lambda: rows, ["year"]), measured)


def _routed(task: str, **params):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, given = star_with_views(spark, sf_dir), {"year": YEAR} | params
        return answer(s, task, "tiv", given, lattice.route(s.views, task, given))

    return build


#: The year whose urgent orders turn out to be of high priority.
CORRECTED = 1998


def families_after_republish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families after one year of orders was corrected, from that year's monthly rows before and after alone."""
    tables = [f"{sf_dir}/{t}.parquet" for t in ("orders", "customer", "nation")]
    published = shared.published(spark, "ads", tables, lambda: ads(spark, sf_dir), ["registration_year"])
    store = deltas.FamilyStore(spark, shared.scratch(spark, "families"))
    store.create(published)
    corrected = registered(spark, sf_dir, CORRECTED).withColumn("fuel", F.when(F.col("fuel") == "1-URGENT", "2-HIGH").otherwise(F.col("fuel")))
    store.republish(CORRECTED, published.where(F.col("registration_year") == CORRECTED), marginals.monthly(corrected))
    return store.read()


def serving_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maker, fuel and all registrations over every period between two months."""
    rows = snapshot(spark, sf_dir)
    asked = serving_batch.grid(rows)
    answers = serving_batch.totals(rows, asked)
    return asked.join(answers, "request").select("kind", F.coalesce("label", F.lit("ALL")).alias("label"), "start_month", "end_month", "months", "registrations")


QUERIES = {
    "lattice_sizes": lattice_sizes,
    "lattice_month_trend": _routed("month_trend", brand_id="Brand#1"),
    "lattice_brand_rank_month": _routed("brand_rank", month=6),
    "lattice_region_rank": _routed("region_rank"),
    "lattice_share_filtered": _routed("share", brand_id="Brand#2", origin="national", month=6),
    "families_after_republish": families_after_republish,
    "serving_grid": serving_grid,
}

_COLUMN = {"month": "month", "brand_id": "brand", "region_id": "region_id", "energy": "energy"}
_SIZES = " UNION ALL ".join(
    f"SELECT '{lattice.named(s)}' AS view, COUNT(*) AS n_rows FROM (SELECT DISTINCT {', '.join(['year', *[_COLUMN[d] for d in lattice.DIMENSIONS if d in s]])} FROM f)" for s in lattice.SETS
)
ORACLE_SQL = {
    "lattice_sizes": f"{_F} {_SIZES}",
    "lattice_month_trend": _rank("month", "AND brand = 'Brand#1'", "month"),
    "lattice_brand_rank_month": _rank("brand AS name", "AND month = 6", "brand"),
    "lattice_region_rank": _rank("region AS name, lower(region) AS name_zh", "", "region_id, region"),
    "lattice_share_filtered": _share_sql("AND brand = 'Brand#2'", "AND origin = 'national' AND month = 6"),
    "families_after_republish": f"""{_REG}, base AS (SELECT y, m, maker, state, ym, CASE WHEN y = {CORRECTED} AND fuel = '1-URGENT' THEN '2-HIGH' ELSE fuel END AS fuel FROM reg),
families AS (WITH reg AS (SELECT * FROM base) {_FAMILIES}) SELECT * FROM families""",
    "serving_grid": f"""{FAMILIES_SQL}, s AS (SELECT dimension AS kind, 'ALL' AS label, key1 || '-' || key2 AS ym, registrations AS n FROM families WHERE dimension = 'month'
  UNION ALL SELECT dimension, CASE WHEN dimension = 'month_maker' THEN upper(key2) ELSE key2 END, key1, registrations FROM families WHERE dimension IN ('month_maker', 'month_fuel')),
mo AS (SELECT ym FROM s WHERE kind = 'month'), la AS (SELECT DISTINCT kind, label FROM s)
SELECT la.kind, la.label, a.ym AS start_month, z.ym AS end_month, COUNT(DISTINCT c.ym) AS months, CAST(coalesce(SUM(s.n), 0) AS BIGINT) AS registrations
FROM la JOIN mo a ON true JOIN mo z ON a.ym <= z.ym JOIN mo c ON c.ym BETWEEN a.ym AND z.ym LEFT JOIN s ON s.kind = la.kind AND s.label = la.label AND s.ym = c.ym GROUP BY ALL""",
}
