"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwood.sources.workspace import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, by any path that Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def live_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream. The pattern lets a table be one file or a folder of files."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")
