"""Session settings that suit the engine's queries."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(master).appName("lorewell").config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
