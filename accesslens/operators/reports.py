"""Storage, retention and scan-cost reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.fixed import DEFAULT_STORAGE_CLASS, SCAN_PRICE_PER_TB, STORAGE_PRICES, STORAGE_TIERS

GB = 1024**3
TB = 1024**4


def tier_by_age(day: Column, as_of: dt.date) -> Column:
    """Storage class of data of ``day``: the coldest class its age reaches."""
    age = F.datediff(F.lit(as_of), day)
    tier = F.lit(DEFAULT_STORAGE_CLASS)
    for name, days in sorted(STORAGE_TIERS.items(), key=lambda item: item[1]):
        tier = F.when(age >= days, name).otherwise(tier)
    return tier


def with_tier(files: DataFrame, as_of: dt.date) -> DataFrame:
    """Lake files (``sources.lake.lake_files``) with size and storage class."""
    return files.select(
        "path",
        F.col("length").alias("size"),
        tier_by_age(F.make_date("year", "month", "day"), as_of).alias("storage_class"),
    )


def storage_by_class(files: DataFrame) -> DataFrame:
    """Bytes, objects and monthly cost per storage class; a class without a
    price costs the standard price."""
    price = F.lit(STORAGE_PRICES[DEFAULT_STORAGE_CLASS])
    for name, value in STORAGE_PRICES.items():
        price = F.when(F.col("storage_class") == name, value).otherwise(price)
    return (
        files.groupBy(F.coalesce("storage_class", F.lit(DEFAULT_STORAGE_CLASS)).alias("storage_class"))
        .agg(F.sum("size").alias("size_bytes"), F.count("*").alias("object_count"))
        .withColumn("size_gb", F.col("size_bytes") / F.lit(GB))
        .withColumn("monthly_cost_usd", F.col("size_gb") * price)
    )


def storage_total(by_class: DataFrame) -> DataFrame:
    """The report's totals."""
    return by_class.agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.coalesce(F.sum("object_count"), F.lit(0)).alias("object_count"),
        F.coalesce(F.sum("monthly_cost_usd"), F.lit(0.0)).alias("estimated_monthly_cost_usd"),
    ).withColumn("total_size_gb", F.col("total_size_bytes") / F.lit(GB))


def scan_cost(sizes: DataFrame, *keys: str) -> DataFrame:
    """Price of scanning the bytes in ``size``, per ``keys`` or in total."""
    return (
        sizes.groupBy(*keys)
        .agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_scanned"))
        .withColumn("scan_cost_usd", F.col("bytes_scanned") / F.lit(TB) * F.lit(SCAN_PRICE_PER_TB))
    )


def scanned_files(query: DataFrame, files: DataFrame) -> DataFrame:
    """The data files that a query opens, ``path, size``, after Spark has
    pruned partitions; sizes come from a listing (``sources.lake.lake_files``).

    Nothing is run.  Partitions are pruned where the query reads a catalog
    table (``sources.lake.register_lake``); of a plain folder all files count.
    """
    spark = query.sparkSession
    opened = spark.createDataFrame([(path,) for path in query.inputFiles()], "path string")
    # Listings and plans spell a local file's scheme differently.
    plain = lambda column: F.regexp_replace(F.url_decode(column), "^file:/+", "/")
    listed = files.select("path", F.col("length").alias("size"), plain(F.col("path")).alias("_plain"))
    return listed.join(opened.select(plain(F.col("path")).alias("_plain")).distinct(), "_plain", "left_semi").select("path", "size")
