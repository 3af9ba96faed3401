"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table called name under sf_dir; columns are pruned by the caller's projection."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
