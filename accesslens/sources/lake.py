"""The analytics lake: Parquet partitioned by year, month, day and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.schema import LAKE, LAKE_PARTITIONS, LAKE_WITH_VARIANTS
from accesslens.sources.store import data_files, read_table


def read_lake(spark: SparkSession, path: str, variants: bool = False) -> DataFrame:
    """The lake at ``path``; with ``variants``, one that was written with
    parsed requests and responses, whose JSON queries then read single fields."""
    return read_table(spark, path, LAKE_WITH_VARIANTS if variants else LAKE)


def register_lake(spark: SparkSession, table: str, path: str) -> None:
    """An external catalog table over the lake, with its partitions."""
    columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in LAKE.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"PARTITIONED BY ({', '.join(LAKE_PARTITIONS)}) LOCATION '{path}'"
    )
    refresh_partitions(spark, table)


def refresh_partitions(spark: SparkSession, table: str) -> None:
    """Find partitions written since the table was registered."""
    spark.catalog.recoverPartitions(table)


def lake_files(spark: SparkSession, path: str) -> DataFrame:
    """Data files with size, time and partition values; none is opened."""
    files = data_files(spark, path, LAKE_PARTITIONS)
    return files.withColumns({name: F.col(name).cast(LAKE[name].dataType) for name in LAKE_PARTITIONS})


def lake_dates(spark: SparkSession, path: str) -> DataFrame:
    """Dates that have at least one data file."""
    return (
        lake_files(spark, path)
        .where(F.col("year").isNotNull())
        .select(F.format_string("%04d-%02d-%02d", "year", "month", "day").alias("event_date"))
        .distinct()
    )
