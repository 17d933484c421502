"""Reading the named parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name; the folder may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
