"""Spark sessions for local runs and tests; on a cluster the caller brings its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC, adaptive execution and Arrow transfer."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftline")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
