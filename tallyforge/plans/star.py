"""The star that templates run over: a fact table, its dimensions and, where there is one, its brand-year aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class View:
    """A stored aggregate: the columns beside year by which it sums, what stores or reads its rows, and how many there are."""

    columns: frozenset[str]
    rows: Callable[[], DataFrame]
    n_rows: int


@dataclass
class Star:
    """fact: year, month, model_id, region_key, tiv_units, registration_units. model: model_id, brand_id, model_name, energy.
    brand: brand_id, brand_name, origin. region: region_key, region_id, region_name, region_name_zh.
    brand_year: year, brand_id and the two measures. of_years restricts the fact to years in a way the scan can use.
    views: further stored aggregates by name, see lattice.
    """

    fact: DataFrame
    model: DataFrame
    brand: DataFrame
    region: DataFrame
    brand_year: DataFrame | None = None
    of_years: Callable[[DataFrame, list[int]], DataFrame] | None = None
    views: dict[str, View] = field(default_factory=dict)

    def years(self, rows: DataFrame, years: list[int]) -> DataFrame:
        if self.of_years is not None and rows is self.fact:
            rows = self.of_years(rows, years)
        return rows.where(F.col("year").isin(*years) if len(years) > 1 else F.col("year") == years[0])
