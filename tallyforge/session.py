"""The session the engine runs in: ANSI, UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tallyforge", driver_memory: str = "8g", more: dict[str, str] | None = None) -> SparkSession:
    return (
        SparkSession.builder.config(map=more or {})
        .master(master)
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
