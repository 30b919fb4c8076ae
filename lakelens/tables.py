"""Loading of the parquet tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakelens.session import ship_package, spread


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; columns are pruned by the plans that use it."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for heavy map stages: over enough partitions to use all cores."""
    return spread(load(spark, folder, name))
