"""Session and input handling shared by the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoscore.sources import tables


def session(name: str) -> SparkSession:
    """The session spark-submit configures; cluster settings stay with the cluster."""
    return SparkSession.builder.appName(name).getOrCreate()


def read_observations(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return tables.read_csv(spark, path)
    return tables.read_parquet(spark, path)
