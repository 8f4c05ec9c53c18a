"""Tables of one data folder, each a parquet file or a folder of parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table of that name; the schema comes from the file footers, never inferred from values."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
