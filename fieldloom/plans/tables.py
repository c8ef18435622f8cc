"""The test tables, read with only the columns that a query asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.sources.documents import from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "documents"))
