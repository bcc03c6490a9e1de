"""Reading the driver tables (one parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``{sf_dir}/{name}.parquet``; Catalyst prunes columns and pushes
    filters into this scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
