"""Readers of the crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``{folder}/{name}.parquet``, a file or a folder of part files."""
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
