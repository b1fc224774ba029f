"""Session defaults for local work; on a cluster the session comes from the launcher."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", memory: str = "20g") -> SparkSession:
    out = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return out
