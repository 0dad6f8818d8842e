"""The event store: Parquet partitioned by event date, plain or bucketed."""

from __future__ import annotations

from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.schema import EVENTS
from accesslens.session import child_folders, settings

#: Look-ups by user skip row groups by Bloom filter, those by action by the
#: sort order's statistics.
LOOK_UP_OPTIONS = {
    "parquet.bloom.filter.enabled#user_name": "true",
    "parquet.bloom.filter.expected.ndv#user_name": "100000",
}


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table; one that was never written reads as empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def data_files(spark: SparkSession, path: str, partitions: list[str]) -> DataFrame:
    """Parquet files with size, time and partition values (as text); none is
    opened.  A folder that was never written has none."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).drop("content")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length long")
    return files.withColumns({name: (F.col(name) if name in files.columns else F.lit(None)).cast("string") for name in partitions})


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, EVENTS).select(EVENTS.fieldNames())


def sized_by_date(rows: DataFrame) -> DataFrame:
    """Rows spread for a write by date: adaptive execution merges small dates
    and splits a date that is far above the rest."""
    return rows.hint("rebalance", "event_date").sortWithinPartitions("event_date", "event_name", "event_time")


@dataclass(frozen=True)
class EventStore:
    """Events in a folder, one sub-folder a date."""

    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        return read_events(spark, self.path)

    def write(self, rows: DataFrame, folder: str | None = None) -> None:
        """Append rows to the store, or to a copy of some of its dates."""
        sized_by_date(rows).write.partitionBy("event_date").options(**LOOK_UP_OPTIONS).mode("append").parquet(folder or self.path)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt out as the layout wants them written."""
        return rows

    def refresh(self, spark: SparkSession) -> None:
        """Notice folders that were moved into the store."""

    def files(self, spark: SparkSession) -> DataFrame:
        """Data files with size and ``event_date``; none is opened."""
        return data_files(spark, self.path, ["event_date"])

    def dates(self, spark: SparkSession) -> DataFrame:
        """Dates with stored events, from the listing."""
        return self.files(spark).select("event_date").where(F.col("event_date").isNotNull()).distinct()

    def least_files(self) -> int:
        """The files that a date has in any case."""
        return 1

    def aligned(self, spark: SparkSession) -> AbstractContextManager:
        """Settings under which joins on the event key use the layout."""
        return nullcontext()


@dataclass(frozen=True)
class BucketedStore(EventStore):
    """Events in a catalog table whose dates are bucketed, by event id unless
    another ``key`` is given.

    All rows of an id are in one bucket, so a join or a de-duplication on the
    event key deals out the batch alone and reads the store where it is; a
    look-up by the key opens one bucket a date.  There should be no fewer
    buckets than shuffle partitions; Spark deals out both sides of a join
    otherwise.  The number cannot change while the table has data.
    """

    table: str
    buckets: int = 200
    key: str = "event_id"

    def _declare(self, spark: SparkSession, table: str, folder: str) -> None:
        # The partition column comes last; NULL dates have no place in it.
        names = [*[c for c in EVENTS.fieldNames() if c != "event_date"], "event_date"]
        known = spark.catalog.tableExists(table)
        if known and spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()["data_type"] != str(self.buckets):
            raise ValueError(f"{table} has another number of buckets than {self.buckets}")
        if not known:
            spark.sql(
                f"CREATE TABLE {table} ({', '.join(f'{c} string' for c in names)}) USING parquet PARTITIONED BY (event_date) "
                f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
            )
            if child_folders(spark, folder):
                spark.catalog.recoverPartitions(table)

    def read(self, spark: SparkSession) -> DataFrame:
        self._declare(spark, self.table, self.path)
        return spark.table(self.table).select(EVENTS.fieldNames())

    def write(self, rows: DataFrame, folder: str | None = None) -> None:
        spark, table = rows.sparkSession, self.table
        if folder:
            table = f"{self.table}_copy"
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._declare(spark, table, folder or self.path)
        rows.select(spark.table(table).columns).write.insertInto(table)
        if folder:
            spark.sql(f"DROP TABLE {table}")  # the data stay: the table has a place of its own

    def dealt(self, rows: DataFrame) -> DataFrame:
        # A task writes a file a date then, not one for each of its buckets.
        if self.key == "event_id":
            return rows.repartition(self.buckets, "event_id")
        # Other keys can be hot: a bucket far above the rest is split.
        bucketed = rows.withColumn("_bucket", F.pmod(F.hash(self.key), F.lit(self.buckets)))
        return bucketed.hint("rebalance", "event_date", "_bucket").drop("_bucket")

    def overwrite(self, rows: DataFrame) -> None:
        """Replace the dates of ``rows`` by them."""
        self._declare(rows.sparkSession, self.table, self.path)
        with settings(rows.sparkSession, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            rows.select(rows.sparkSession.table(self.table).columns).write.insertInto(self.table, overwrite=True)

    def least_files(self) -> int:
        return self.buckets

    def refresh(self, spark: SparkSession) -> None:
        self._declare(spark, self.table, self.path)
        spark.catalog.recoverPartitions(self.table)
        spark.catalog.refreshTable(self.table)

    def aligned(self, spark: SparkSession) -> AbstractContextManager:
        # The key is id and date; rows that agree on both agree on the id.  And
        # buckets are read as such also where only the write wants them.
        names = ["spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.sources.bucketing.autoBucketedScan.enabled"]
        return settings(spark, dict.fromkeys(names, "false"))


def scan_date_range(df: DataFrame, start_date: str, end_date: str, limit: int | None = None) -> DataFrame:
    """Events between two dates, both included."""
    rows = df.where(F.col("event_date").between(start_date, end_date))
    return rows if limit is None else rows.orderBy("event_date", "event_id").limit(limit)


def _look_up(
    df: DataFrame, column: str, value: str, start_date: str | None, end_date: str | None, limit: int | None
) -> DataFrame:
    rows = df.where(F.col(column) == value)
    if start_date and end_date:
        rows = rows.where(F.col("event_date").between(start_date, end_date))
    rows = rows.orderBy("event_date", "event_id")
    return rows if limit is None else rows.limit(limit)


def events_by_user(
    df: DataFrame, user_name: str, start_date: str | None = None, end_date: str | None = None, limit: int | None = 100
) -> DataFrame:
    """Events of one user by date; dates count only when both are
    given.  ``limit=None`` gives all."""
    return _look_up(df, "user_name", user_name, start_date, end_date, limit)


def events_by_action(
    df: DataFrame, event_name: str, start_date: str | None = None, end_date: str | None = None, limit: int | None = 100
) -> DataFrame:
    """Events of one name by date; dates count only when both are
    given.  ``limit=None`` gives all."""
    return _look_up(df, "event_name", event_name, start_date, end_date, limit)
