"""Aggregates of a table that its writers keep up to date: counts and sketches.

An aggregate is a table of its own, partitioned by event date, that holds one
row for each group and write; reading it adds up the rows of a group.  So a
load appends the little it adds, and questions about months are answered
without opening an event.

A write and what it adds cannot be committed together, so every write notes
first what it is about to do (``prepare``), and takes the note away when both
are done (``settle``).  A note found by a later writer means that the one
before died somewhere in between; the dates it names are counted anew from the
table (``recover``), whatever had been reached.  Dates whose events changed,
where adding is not enough, take the same way.  One writer at a time, as for
the tables themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.fixed import UNKNOWN
from accesslens.functions.events import failed, known_user, with_identity
from accesslens.functions.keys import key_values, restrict_to
from accesslens.session import child_folders, is_complete, mark_complete, remove_folder
from accesslens.schema import EVENTS
from accesslens.sources.store import BucketedStore, read_table

#: Registers of a distinct-count sketch, as a power of two.  Its estimate has a
#: relative standard error of 1.04 / sqrt(2 ** 12), 1.6 %; up to an eighth of
#: the registers, the distinct values themselves are held and it is exact.
SKETCH_BITS = 12

DATE = T.StructField("event_date", T.StringType())
DATES = T.StructType([DATE])


@dataclass(frozen=True)
class Kind:
    """What an aggregate holds: its columns, how rows of the table are
    measured (one row a group, ``event_date`` among them), how rows of a group
    are added up."""

    schema: T.StructType
    measure: Callable[[DataFrame], DataFrame]
    add: Callable[[DataFrame], DataFrame]


def _region() -> F.Column:
    return F.coalesce("aws_region", F.lit(UNKNOWN)).alias("region")


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([DATE, *[T.StructField(name, kind) for name, kind in kinds.items()]])


#: Events per date and region.
COUNTS = Kind(
    _fields(region=T.StringType(), events=T.LongType()),
    lambda rows: rows.groupBy("event_date", _region()).agg(F.count("*").alias("events")),
    lambda rows: rows.groupBy("event_date", "region").agg(F.sum("events").alias("events")),
)

#: Events, failures and a sketch of the users per date, region and action.
ACTIVITY = Kind(
    _fields(region=T.StringType(), event_name=T.StringType(), events=T.LongType(), failed_events=T.LongType(), users=T.BinaryType()),
    lambda rows: rows.groupBy("event_date", _region(), "event_name").agg(
        F.count("*").alias("events"), F.count_if(failed()).alias("failed_events"), F.hll_sketch_agg("user_name", F.lit(SKETCH_BITS)).alias("users")
    ),
    lambda rows: rows.groupBy("event_date", "region", "event_name").agg(
        F.sum("events").alias("events"), F.sum("failed_events").alias("failed_events"), F.hll_union_agg("users").alias("users")
    ),
)

#: Who acted how often, exact: a sketch of the busiest names nobody once its
#: items are many and even.
BUSIEST = Kind(
    _fields(user_identity=T.StringType(), events=T.LongType()),
    lambda rows: with_identity(rows.where(known_user())).groupBy("event_date", "user_identity").agg(F.count("*").alias("events")),
    lambda rows: rows.groupBy("event_date", "user_identity").agg(F.sum("events").alias("events")),
)


@dataclass(frozen=True)
class Aggregate:
    """An aggregate kept at ``path``."""

    path: str
    kind: Kind

    @property
    def notes(self) -> str:
        return f"{self.path.rstrip('/')}-notes"

    def exists(self, spark: SparkSession) -> bool:
        """Whether it was ever written or noted."""
        return bool(child_folders(spark, self.path) or child_folders(spark, self.notes))

    def read(self, spark: SparkSession) -> DataFrame:
        """One row for each group, from whatever was written."""
        return self.kind.add(read_table(spark, self.path, self.kind.schema).select(self.kind.schema.fieldNames()))

    def prepare(self, added: DataFrame, changed: DataFrame) -> str:
        """Note a write that is about to add rows, and to change others of the
        dates in ``changed``; returns the note's name."""
        spark, name = added.sparkSession, uuid.uuid4().hex
        folder = f"{self.notes}/{name}"
        measured = self.kind.measure(added)
        measured.write.parquet(f"{folder}/added")
        changed.select("event_date").distinct().write.parquet(f"{folder}/changed")
        mark_complete(spark, folder)
        return name

    def settle(self, spark: SparkSession, name: str, table: DataFrame) -> None:
        """Enter what a write that is now done has added; ``table`` is what it
        wrote to."""
        folder = f"{self.notes}/{name}"
        changed = read_table(spark, f"{folder}/changed", DATES)
        added = read_table(spark, f"{folder}/added", self.kind.schema)
        self._write(added.join(changed, "event_date", "left_anti"), "append")
        self._count_anew(spark, changed, table)
        remove_folder(spark, folder)

    def recover(self, spark: SparkSession, table: DataFrame) -> None:
        """Count anew the dates of writes that were noted but not settled."""
        for name in child_folders(spark, self.notes):
            folder = f"{self.notes}/{name}"
            if is_complete(spark, folder):  # else the write itself had not begun
                dates = [read_table(spark, f"{folder}/{part}", schema).select("event_date") for part, schema in (("added", self.kind.schema), ("changed", DATES))]
                self._count_anew(spark, dates[0].unionByName(dates[1]).distinct(), table)
            remove_folder(spark, folder)

    def compact(self, spark: SparkSession, dates: DataFrame) -> None:
        """Replace the rows of these dates by one a group.  Noted like a
        write: a run that dies here leaves dates to be counted anew."""
        rows = restrict_to(read_table(spark, self.path, self.kind.schema), "event_date", dates)
        name = uuid.uuid4().hex
        folder = f"{self.notes}/{name}"
        dates.select("event_date").distinct().write.parquet(f"{folder}/changed")
        added = self.kind.add(rows.select(self.kind.schema.fieldNames()))
        added.write.parquet(f"{folder}/added")
        mark_complete(spark, folder)
        self._write(read_table(spark, f"{folder}/added", self.kind.schema), "overwrite")
        remove_folder(spark, folder)

    def rebuild(self, spark: SparkSession, table: DataFrame) -> None:
        """Count the whole table, for one that was there before its aggregate."""
        self._count_anew(spark, table.select("event_date").distinct(), table)

    def _count_anew(self, spark: SparkSession, dates: DataFrame, table: DataFrame) -> None:
        values = key_values(dates, "event_date")
        if values != []:
            self._write(self.kind.measure(restrict_to(table, "event_date", values)), "overwrite")

    def _write(self, rows: DataFrame, mode: str) -> None:
        # A date's rows are few: one file a date and write, more where they are not.
        (
            rows.select(self.kind.schema.fieldNames())
            .hint("rebalance", "event_date")
            .write.partitionBy("event_date")
            .option("partitionOverwriteMode", "dynamic")
            .mode(mode)
            .parquet(self.path)
        )


#: Events as they are: the kind of a second copy in another layout.
WHOLE = Kind(EVENTS, lambda rows: rows.select(EVENTS.fieldNames()), lambda rows: rows)


@dataclass(frozen=True)
class Copy(Aggregate):
    """A second copy of the events, bucketed and sorted by another column.

    Kept like an aggregate: noted, written, and dates in doubt copied anew.
    A look-up by ``layout.key`` opens one bucket of each date it asks for.
    """

    layout: BucketedStore

    @classmethod
    def by(cls, key: str, path: str, table: str, buckets: int = 64) -> Copy:
        return cls(path, WHOLE, BucketedStore(path, table, buckets, key))

    def read(self, spark: SparkSession) -> DataFrame:
        return self.layout.read(spark)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows = self.layout.dealt(rows.select(self.kind.schema.fieldNames()))
        self.layout.overwrite(rows) if mode == "overwrite" else self.layout.write(rows)
