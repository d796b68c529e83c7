"""Readers of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table as a DataFrame; columns and filters are pruned into the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
