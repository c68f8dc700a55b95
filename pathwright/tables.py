"""Loading of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under sf_dir, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
