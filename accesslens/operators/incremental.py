"""Incremental loading: checkpoints, the run over all sources, its summary."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.functions.time import as_utc, from_iso, literal
from accesslens.operators import derived
from accesslens.operators.alerts import find_alerts, notices, sent_records, unsent
from accesslens.operators.filters import ROLE, SERVICE, flag_noise
from accesslens.operators.normalize import UNPARSABLE, parse_records, to_events
from accesslens.operators.upsert import write_upsert
from accesslens.schema import CONTROL, EVENT_COLUMNS, EVENTS, SENT_ALERTS
from accesslens.session import remove_folder, staging
from accesslens.sources.routes import Routes, checkpoint_key, is_collected, route_table
from accesslens.sources.store import read_table

FIRST_LOOK_BACK = dt.timedelta(days=90)
SETTLE = dt.timedelta(minutes=5)
NOT_ROUTED, LATE, SETTLING = "not_routed", "late", "settling"
#: One row a finished run: when, and how long events had to settle.
RUNS = T.StructType([T.StructField("as_of", T.TimestampNTZType()), T.StructField("settle_seconds", T.DoubleType())])

#: The alert table: notification texts next to the sent-alert record.
ALERT_TABLE = T.StructType(
    SENT_ALERTS.fields
    + [
        T.StructField(name, T.StringType())
        for name in [
            "event_date", "event_time", "event_name", "user_name", "source_ip", "aws_region", "alert_message",
            "event_name_attribute", "subject", "body",
        ]
    ]
)


def latest_control(log: DataFrame) -> DataFrame:
    """Current row per source of the append-only control log."""
    newest = W.partitionBy("checkpoint_key").orderBy(
        F.desc("last_execution_time"), F.desc("last_processed_timestamp"), F.desc("events_processed_count")
    )
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def initialize_control(control: DataFrame, keys: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Control rows for all keys; unseen ones start 90 days back."""
    missing = keys.select("checkpoint_key").where(F.col("checkpoint_key").isNotNull()).distinct().join(
        control, "checkpoint_key", "left_anti"
    )
    fresh = missing.select(
        "checkpoint_key",
        literal(as_of - FIRST_LOOK_BACK).alias("last_processed_timestamp"),
        literal(as_of).alias("last_execution_time"),
        F.lit(0).cast("bigint").alias("events_processed_count"),
        F.lit("active").alias("processing_status"),
        F.lit("").alias("last_error"),
    )
    return control.unionByName(fresh)


def _reason(where: Column, reason: str) -> Column:
    """``reason`` for the rows of a condition, except unparsable ones."""
    return F.when(where & ~F.col("drop_reason").eqNullSafe(UNPARSABLE), reason).otherwise(F.col("drop_reason"))


def flag_range(records: DataFrame, control: DataFrame, as_of: dt.datetime, settle: dt.timedelta = SETTLE) -> DataFrame:
    """Parsed records, those outside their source's range with a reason:
    ``late`` before the checkpoint, ``settling`` within the settle time.

    The checkpoint itself is inside: keyed writes make the repeat harmless,
    and events of the same second are not lost.
    """
    starts = control.select("checkpoint_key", F.col("last_processed_timestamp").alias("_start"))
    start = F.coalesce("_start", literal(as_of - FIRST_LOOK_BACK))
    time = F.col("event_ts")
    return (
        records.withColumn("checkpoint_key", checkpoint_key())
        .join(starts, "checkpoint_key", "left")
        .withColumn("drop_reason", _reason(time < start, LATE))
        .withColumn("drop_reason", _reason(time > literal(as_of - settle), SETTLING))
        .drop("_start", "checkpoint_key")
    )


def since_checkpoint(records: DataFrame, control: DataFrame, as_of: dt.datetime, settle: dt.timedelta = SETTLE) -> DataFrame:
    """Parsed records from their source's checkpoint on, up to the settle time."""
    flagged = flag_range(records, control, as_of, settle)
    return flagged.where(~F.coalesce(F.col("drop_reason").isin(LATE, SETTLING), F.lit(False)))


def advance_control(control: DataFrame, events: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Control table after ``events`` were stored; sources without events keep
    their row.  A checkpoint never moves back."""
    seen = (
        events.select(checkpoint_key().alias("checkpoint_key"), from_iso(F.col("event_time")).alias("event_ts"))
        .where(F.col("checkpoint_key").isNotNull())
        .groupBy("checkpoint_key")
        .agg(F.max("event_ts").alias("_latest"), F.count("*").alias("_events"))
    )
    return control.join(seen, "checkpoint_key", "full").select(
        "checkpoint_key",
        F.greatest("last_processed_timestamp", "_latest").alias("last_processed_timestamp"),
        F.when(F.col("_events").isNotNull(), literal(as_of)).otherwise(F.col("last_execution_time")).alias(
            "last_execution_time"
        ),
        (F.coalesce("events_processed_count", F.lit(0)) + F.coalesce("_events", F.lit(0))).alias(
            "events_processed_count"
        ),
        F.when(F.col("_events").isNotNull(), "active").otherwise(F.col("processing_status")).alias("processing_status"),
        F.coalesce("last_error", F.lit("")).alias("last_error"),
    )


@dataclass(frozen=True)
class Tables:
    """Where a deployment keeps its tables."""

    events: str
    control: str
    alerts: str

    @classmethod
    def under(cls, folder: str) -> Tables:
        return cls(f"{folder}/events", f"{folder}/control", f"{folder}/alerts")

    @property
    def counts(self) -> derived.Aggregate:
        """Stored events per date and region."""
        return derived.Aggregate(f"{self.events.rstrip('/')}-counts", derived.COUNTS)

    @property
    def activity(self) -> derived.Aggregate:
        """Counts and user sketches per date, region and action."""
        return derived.Aggregate(f"{self.events.rstrip('/')}-activity", derived.ACTIVITY)

    @property
    def busiest(self) -> derived.Aggregate:
        """Events per date and user; a store from before them needs one ``rebuild``."""
        return derived.Aggregate(f"{self.events.rstrip('/')}-identities", derived.BUSIEST)

    @property
    def kept(self) -> list[derived.Aggregate]:
        """The aggregates that every load keeps up to date."""
        return [self.counts, self.activity, self.busiest]

    def read_control(self, spark: SparkSession) -> DataFrame:
        return latest_control(read_table(spark, self.control, CONTROL))

    @property
    def pending(self) -> str:
        """Stored events whose alerts could not be written yet."""
        return f"{self.alerts.rstrip('/')}-pending"

    @property
    def runs(self) -> str:
        return f"{self.control.rstrip('/')}-runs"

    def delivered_since(self, spark: SparkSession) -> dt.datetime | None:
        """Files modified before this time hold nothing for the next run.

        The last run read every file there was, and left out events younger
        than the settle time it ran with; their files are not older than they
        are.  None before the first run, and to be ignored when a source is
        added.
        """
        runs = read_table(spark, self.runs, RUNS)
        last = runs.agg(F.max(F.struct("as_of", "settle_seconds")).alias("last")).first()["last"]
        return last["as_of"] - dt.timedelta(seconds=last["settle_seconds"]) if last else None

    def read_alerts(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.alerts, ALERT_TABLE).select(ALERT_TABLE.fieldNames())


@dataclass(frozen=True)
class Options:
    """Switches of a collection run."""

    routes: Routes | None = None
    drop_services: bool = True
    roles: str | None = None
    role_marker: str = "/role/"
    alerts: bool = True
    own_account: str = ""
    strict_wildcards: bool = False
    settle: dt.timedelta = SETTLE
    from_checkpoint: bool = True


def send_alerts(
    spark: SparkSession, events: DataFrame, tables: Tables, as_of: dt.datetime, own_account: str, strict_wildcards: bool = False
) -> None:
    """Append the unsent alerts of these events to the alert table.

    A row is notification and sent record in one, so that a repeated run
    either finds an alert complete or not at all.
    """
    due = unsent(find_alerts(events, own_account, strict_wildcards), tables.read_alerts(spark), as_of)
    rows = sent_records(notices(due), as_of).select(ALERT_TABLE.fieldNames())
    rows.write.partitionBy("sent_date").mode("append").parquet(tables.alerts)


def _advance(spark: SparkSession, events: DataFrame, tables: Tables, as_of: dt.datetime, routes: Routes | None) -> None:
    """Append the control rows this run changed."""
    keys = route_table(spark, routes) if routes else events.select(checkpoint_key().alias("checkpoint_key"))
    control = initialize_control(tables.read_control(spark), keys, as_of)
    changed = advance_control(control, events, as_of).where(F.col("last_execution_time") == literal(as_of))
    changed.coalesce(1).write.mode("append").parquet(tables.control)


def run_batch(
    spark: SparkSession, records: DataFrame, tables: Tables, as_of: dt.datetime, options: Options = Options()
) -> DataFrame:
    """Load raw records of all sources once; returns a one-row summary.

    Raw records are parsed in one pass into a staged table, which feeds the
    store, the alerts and the checkpoints.  A dropped record is staged as its
    reason only.  Checkpoints advance only after the events are stored.
    Failing alerts do not stop the run: its events are kept aside, and the
    next run raises their alerts too.
    """
    started = time.monotonic()
    parsed = flag_noise(parse_records(records, None, options.role_marker), options.drop_services, options.roles)
    if options.from_checkpoint:
        parsed = flag_range(parsed, tables.read_control(spark), as_of, options.settle)
    if options.routes is not None:
        outside = ~F.coalesce(is_collected(options.routes), F.lit(False))
        parsed = parsed.withColumn("drop_reason", _reason(outside, NOT_ROUTED))
    with staging(spark, "records") as staged_path:
        to_events(parsed, "drop_reason").select(
            *[F.when(F.col("drop_reason").isNull(), F.col(name)).alias(name) for name in EVENT_COLUMNS], "drop_reason"
        ).write.parquet(staged_path)

        staged = spark.read.parquet(staged_path)
        dropped = {row["drop_reason"]: row["count"] for row in staged.groupBy("drop_reason").count().collect()}
        events = staged.where(F.col("drop_reason").isNull()).select(EVENT_COLUMNS)
        outcomes = write_upsert(spark, events, tables.events, tables.kept)
        errors = []
        if options.alerts:
            owed = read_table(spark, tables.pending, EVENTS).select(EVENT_COLUMNS)
            try:
                send_alerts(spark, events.unionByName(owed), tables, as_of, options.own_account, options.strict_wildcards)
                remove_folder(spark, tables.pending)
            except Exception as error:  # alerts must not hold back the checkpoint: the next run owes them
                errors.append(f"alerts: {error}")
                events.write.mode("append").parquet(tables.pending)
        _advance(spark, events, tables, as_of, options.routes)
        ran = spark.createDataFrame([(as_utc(as_of), options.settle.total_seconds())], RUNS)
        ran.coalesce(1).write.mode("append").parquet(tables.runs)
    return run_summary(spark, dropped, outcomes, time.monotonic() - started, errors)


#: Counts, duration and errors of a run.
SUMMARY = T.StructType(
    [T.StructField("status", T.IntegerType())]
    + [
        T.StructField(name, T.LongType())
        for name in (
            "total_events_processed", "filtered_by_role", "filtered_by_service", "unparsable",
            "not_routed", "late", "settling", "events_added", "events_changed",
        )
    ]
    + [T.StructField("execution_time_seconds", T.DoubleType()), T.StructField("errors", T.ArrayType(T.StringType()))]
)


def run_sources(
    spark: SparkSession, sources: Mapping[str, DataFrame], tables: Tables, as_of: dt.datetime, options: Options = Options()
) -> DataFrame:
    """Load several sources' raw records (alike columns); one summary row.

    All sources load in one run.  Only if that fails, they are loaded one by
    one, so that the broken ones leave the others loaded and their own
    checkpoints where they were; keyed writes make the repeat harmless.
    """
    if not sources:
        return run_summary(spark, {}, dict.fromkeys(("new", "changed"), 0), 0.0, [])
    try:
        return run_batch(spark, reduce(DataFrame.unionByName, sources.values()), tables, as_of, options)
    except Exception:
        if len(sources) == 1:
            raise
    rows, errors = [], []
    for name, records in sources.items():
        try:
            rows.append(run_batch(spark, records, tables, as_of, options).first())
        except Exception as error:
            errors.append(f"{name}: {error}")
    added = [sum(row[name] for row in rows) for name in SUMMARY.names[1:-1]]
    errors += [text for row in rows for text in row["errors"]]
    return spark.createDataFrame([(500 if errors else 200, *added, errors)], SUMMARY)


def run_summary(
    spark: SparkSession, by_reason: dict[str | None, int], outcomes: dict[str, int], seconds: float, errors: list[str]
) -> DataFrame:
    """Counts, duration and errors of a run as one row; kept and dropped
    records add up to the input."""
    row = (
        500 if errors else 200,
        by_reason.get(None, 0),
        by_reason.get(ROLE, 0),
        by_reason.get(SERVICE, 0),
        by_reason.get(UNPARSABLE, 0),
        by_reason.get(NOT_ROUTED, 0),
        by_reason.get(LATE, 0),
        by_reason.get(SETTLING, 0),
        outcomes["new"],
        outcomes["changed"],
        seconds,
        errors,
    )
    return spark.createDataFrame([row], SUMMARY)
