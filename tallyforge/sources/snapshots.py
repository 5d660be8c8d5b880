"""Versioned snapshots of marginal aggregates behind an active pointer that only verified versions reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import maker_key
from ..operators.marginals import FAMILIES, compare
from . import evidence
from .files import Files

KEYS = ["dimension", "key1", "key2"]
MONTH = r"^20\d{2}-(0[1-9]|1[0-2])$"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows as text, unquoted: dimension, key1, key2, registrations, and n_cells."""
    cells = F.split("value", "\t", -1)
    return spark.read.text(path).where(F.length("value") > 0).select(*[F.get(cells, i).alias(c) for i, c in enumerate([*KEYS, "registrations"])], F.size(cells).alias("n_cells"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", *KEYS, F.col("registrations").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Any rows as tab-separated files, each with a header; values are quoted where they hold a tab or a line end."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def _of_month() -> Column:
    kind = F.col("dimension")
    return F.when(kind == "month", F.concat("key1", F.lit("-"), "key2")).when(kind.startswith("month_"), F.col("key1"))


def row_rules(rows: DataFrame) -> list[tuple[str, Column]]:
    """Codes and what breaks them in a row, in the order in which they are reported. Rows as read_tsv() gives them."""
    label = lambda c: F.col(c).isNotNull() & (F.length(c) > 0) & (F.length(c) <= 128)
    kind = F.col("dimension")
    cells = F.col("n_cells") if "n_cells" in rows.columns else F.lit(4)
    broken = [
        ("INVALID_SCHEMA", cells != 4), ("INVALID_DIMENSION", ~(kind.isin(*FAMILIES) & label("key1") & label("key2"))),
        ("INVALID_COUNT", ~F.col("registrations").cast("string").rlike("^[1-9][0-9]*$")), ("INVALID_MONTH", kind.startswith("month") & ~_of_month().rlike(MONTH)),
    ]
    return [(code, F.coalesce(bad, F.lit(code != "INVALID_MONTH"))) for code, bad in broken]


def first_broken(rows: DataFrame) -> Column:
    """The first code that a row breaks, null for a good row."""
    return F.coalesce(*[F.when(bad, code) for code, bad in row_rules(rows)])


def validated(rows: DataFrame) -> DataFrame:
    """Rows with whole counts, or a ValueError with the first code that applies. All rules run as aggregates."""
    rules, count, of_month = row_rules(rows), F.col("registrations").cast("string"), _of_month()
    found = rows.agg(*[F.count_if(bad).alias(code) for code, bad in rules]).first()
    for code, _ in rules:
        if found[code]:
            raise ValueError(code)
    good = rows.select(*KEYS, count.cast("long").alias("registrations"), of_month.alias("year_month"))
    if not good.groupBy(*KEYS).count().where("count > 1").isEmpty():
        raise ValueError("DUPLICATE_AGGREGATE")
    sums = {r["dimension"]: r["n"] for r in good.groupBy("dimension").agg(F.sum("registrations").alias("n")).collect()}
    if set(sums) != set(FAMILIES):
        raise ValueError("MISSING_AGGREGATE_FAMILY")
    for name in FAMILIES:
        if sums[name] != sums["total"]:
            raise ValueError(f"TOTAL_MISMATCH:{name}")
    by_month = good.where("year_month is not null").groupBy("year_month").pivot("dimension", ["month", "month_maker", "month_fuel"]).agg(F.sum("registrations"))
    off = by_month.where(~(F.col("month").eqNullSafe(F.col("month_maker")) & F.col("month").eqNullSafe(F.col("month_fuel")))).orderBy("year_month").first()
    if off is not None:
        raise ValueError(f"MONTH_MISMATCH:{off['year_month']}")
    return good.drop("year_month")


def first_faults(rows: DataFrame, by: str) -> DataFrame:
    """(by, code): what validated() would say of each of many versions of the aggregates, null for a good one; in one plan.

    Rows as read_tsv() gives them, with a column that names their version.
    """
    rules, of_month = row_rules(rows), _of_month()
    count = F.col("registrations").cast("string").try_cast("long")
    named = rows.withColumns({"__n": count, "__month": of_month})
    known = {name: F.sum(F.when(F.col("dimension") == name, F.col("__n"))).alias(f"__{name}") for name in FAMILIES}
    per_row = named.groupBy(by).agg(*[F.count_if(bad).alias(code) for code, bad in rules], *known.values())
    twice = rows.groupBy(by, *KEYS).agg(F.count(F.lit(1)).alias("c")).groupBy(by).agg(F.max("c").alias("__most"))
    months = named.where("__month is not null").groupBy(by, "__month").pivot("dimension", ["month", "month_maker", "month_fuel"]).agg(F.sum("__n"))
    uneven = ~(F.col("month").eqNullSafe(F.col("month_maker")) & F.col("month").eqNullSafe(F.col("month_fuel")))
    months = months.where(uneven).groupBy(by).agg(F.min("__month").alias("__uneven"))
    whole = per_row.join(twice, by, "left").join(months, by, "left")
    missing = F.lit(False)
    for name in FAMILIES:
        missing = missing | F.col(f"__{name}").isNull()
    code = F.coalesce(
        *[F.when(F.col(c) > 0, F.lit(c)) for c, _ in rules], F.when(F.col("__most") > 1, "DUPLICATE_AGGREGATE"), F.when(missing, "MISSING_AGGREGATE_FAMILY"),
        *[F.when(F.col(f"__{name}") != F.col("__total"), F.lit(f"TOTAL_MISMATCH:{name}")) for name in FAMILIES], F.when(F.col("__uneven").isNotNull(), F.concat(F.lit("MONTH_MISMATCH:"), "__uneven")),
    )
    return whole.select(by, code.alias("code"))


def derived(rows: DataFrame) -> DataFrame:
    """With year_month, maker_norm and fuel, where the family has them."""
    kind = F.col("dimension")
    return rows.select(
        *KEYS, "registrations",
        F.when(kind == "month", F.concat("key1", F.lit("-"), "key2")).when(kind.startswith("month_"), F.col("key1")).alias("year_month"),
        F.when(kind == "month_maker", maker_key(F.col("key2"))).when(kind == "maker", maker_key(F.col("key1"))).alias("maker_norm"),
        F.when(kind == "month_fuel", F.col("key2")).when(kind == "fuel", F.col("key1")).alias("fuel"),
    )


class SnapshotStore:
    """Snapshots at root/version=<v>, their description beside, and root/active.json with the version in use."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark), str(root).rstrip("/")

    def publish(self, version: str, rows: DataFrame, source: dict | None = None, fail_before_activation: bool = False) -> dict:
        """Validates, writes, reads back and only then activates, under a lock. A version that is there must hold the same rows."""
        rows = validated(rows)
        with self.files.locked(f"{self.root}/import.lock"):
            return self._publish(version, rows, source, fail_before_activation)

    def publish_run(self, run: str, version: str | None = None) -> dict:
        """Publishes the aggregates of a kept warehouse run that passed, if they are still what the run wrote."""
        about = self.files.read_json(f"{run}/run.json")
        if about is None or about.get("status") != "passed" or not about.get("passed"):
            raise ValueError("UPSTREAM_NOT_PASSED")
        proof = self.files.read_json(f"{run}/evidence.json")
        if proof is None or not evidence.sound(proof) or self.files.sha256(f"{run}/evidence.json") != about.get("evidence_sha256"):
            raise ValueError("NO_EVIDENCE_OF_SUCCESS")
        at = f"{run}/aggregates"
        hashes = {f.rsplit("/", 1)[-1]: h for f, h in self.files.hashes([f"{at}/{x}" for x in self.files.listing(at)]).items()}
        if hashes != about["aggregates_sha256"]:
            raise ValueError("SOURCE_HASH_MISMATCH")
        source = {k: about[k] for k in ("run_id", "data_asof", "sources", "aggregates_sha256", "evidence")}
        return self.publish(version or about["run_id"], read_tsv(self.spark, at), source)

    def _publish(self, version: str, rows: DataFrame, source: dict | None, fail_before_activation: bool) -> dict:
        at = f"{self.root}/version={version}"
        existing = self.files.exists(f"{at}/_SUCCESS")
        if not existing:
            derived(rows).write.mode("overwrite").partitionBy("dimension").parquet(at)
        if not compare(rows, self._read(version), KEYS, "registrations").isEmpty():
            raise ValueError("EXISTING_VERSION_CORRUPTED" if existing else "SNAPSHOT_RECONCILIATION_FAILED")
        if fail_before_activation:
            raise RuntimeError("INJECTED_IMPORT_FAILURE")
        total = rows.where("dimension = 'total'").first()["registrations"]
        described = {"version": version, "rows": rows.count(), "represented_registration_rows": total, "source": (source or {}) | {"version": version}}
        self.files.write_json(f"{self.root}/active.json", described)
        return described | {"status": "unchanged" if existing else "imported"}

    def _read(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/version={version}")

    def active(self) -> tuple[dict, DataFrame] | None:
        """The active version's description and rows, resolved once for a query."""
        found = self.files.read_json(f"{self.root}/active.json")
        return None if found is None else (found, self._read(found["version"]))
