"""The seven families kept up to date by signed deltas: a republished year's old counts go, its new ones come.

Only the year's own monthly rows, old and new, and the families are read. Each year's rows have a checksum that is stored with
the families, and so do the families themselves: old rows that aren't those which were counted, or families that aren't what
was stored, are refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files
from .marginals import FINEST, marginals

KEYS = ["dimension", "key1", "key2"]


def checksum(rows: DataFrame, columns: list[str]) -> dict:
    """Rows and the sum of their hashes, the same in any order; repeated rows count as often as they are there."""
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": found["rows"], "sum": str(found["sum"] or 0)}


def updated(families: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The families after the monthly rows `old` were replaced by `new`; groups that come to nothing vanish.

    Marginal counts are sums, so the change of each is the marginal of the change.
    """
    signed = old.select(*FINEST, (-F.col("registrations")).alias("registrations")).unionByName(new.select(*FINEST, "registrations"))
    change = marginals(signed.groupBy(*FINEST).agg(F.sum("registrations").alias("registrations")).where("registrations <> 0"))
    both = families.select(*KEYS, "registrations").unionByName(change.where("registrations is not null"))
    return both.groupBy(*KEYS).agg(F.sum("registrations").alias("registrations")).where("registrations <> 0")


class FamilyStore:
    """Families at root/version=<v>, and root/families.json with the version in use and the checksums of all years."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark), str(root).rstrip("/")

    def create(self, ads: DataFrame) -> dict:
        """Counts all monthly rows, once."""
        with self.files.locked(f"{self.root}/families.lock"):
            sums = ads.groupBy("registration_year").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*FINEST, "registrations").cast("decimal(38,0)")).alias("sum")).collect()  # a row a year
            return self._write(marginals(ads), {str(r["registration_year"]): {"rows": r["rows"], "sum": str(r["sum"])} for r in sums})

    def republish(self, year: int, old: DataFrame, new: DataFrame) -> dict:
        """Replaces a year. A year that is new has no old rows."""
        with self.files.locked(f"{self.root}/families.lock"):
            about = self.about()
            families = self._read(about)
            if checksum(families, [*KEYS, "registrations"]) != about["families"]:
                raise ValueError("FAMILIES_CORRUPTED")
            if checksum(old, [*FINEST, "registrations"]) != about["years"].get(str(year), {"rows": 0, "sum": "0"}):
                raise ValueError(f"WRONG_BASE:{year}")
            if not old.unionByName(new).where(~F.col("registration_year").eqNullSafe(F.lit(year))).isEmpty():
                raise ValueError(f"WRONG_YEAR:{year}")
            years = {**about["years"], str(year): checksum(new, [*FINEST, "registrations"])}
            return self._write(updated(families, old, new), {y: c for y, c in years.items() if c["rows"]})

    def about(self) -> dict:
        found = self.files.read_json(f"{self.root}/families.json")
        if found is None:
            raise ValueError("NO_FAMILIES")
        return found

    def read(self) -> DataFrame:
        return self._read(self.about())

    def _read(self, about: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/version={about['version']}")

    def _write(self, families: DataFrame, years: dict) -> dict:
        about = {"version": uuid.uuid4().hex, "years": years}
        families.write.parquet(f"{self.root}/version={about['version']}")
        about["families"] = checksum(self._read(about), [*KEYS, "registrations"])
        self.files.write_json(f"{self.root}/families.json", about)
        return about
