"""Tables and files that operators keep between two of their steps."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from accesslens.session import shared_folder


BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes handed to Python at once: rows here are long, and a task holds a batch
#: in the JVM, in the worker and on the way.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_BYTES`` for what is run inside."""
    before = spark.conf.get(BATCH_LIMIT, None)
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_LIMIT)
        else:
            spark.conf.set(BATCH_LIMIT, before)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage: a lost executor costs the reading of a file, not
    the work before it.  The folder stays until the cluster clears its shared
    folder, because the returned frame reads from it.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def output_folder(spark: SparkSession, folder: str | None, purpose: str) -> str:
    """``folder``, or a fresh one under the shared folder; always a URI."""
    target = folder or shared_folder(spark, purpose)
    return target if "://" in target or target.startswith("file:") else f"file://{target}"
