"""Export of stored events to the analytics lake."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.fixed import UNKNOWN
from accesslens.functions.events import failed
from accesslens.functions.json import is_object, key_present, open_once
from accesslens.functions.keys import key_values, restrict_to
from accesslens.functions.text import regexp_or_null
from accesslens.operators.derived import COUNTS, DATES, Aggregate
from accesslens.schema import EVENT_COLUMNS, EVENT_KEY, EVENTS, LAKE_PARTITIONS, VARIANTS
from accesslens.session import settings, staging
from accesslens.sources.lake import lake_dates, read_lake
from accesslens.sources.store import LOOK_UP_OPTIONS, EventStore


def _lifted(document: str, path: str) -> Column:
    """A field as text: '' when missing, NULL for a JSON null."""
    found = key_present(F.col(document), path)
    return F.when(found, F.try_variant_get(document, path, "string")).otherwise("")


def _identity() -> Column:
    session = F.try_variant_get("_request", "$.roleSessionName", "variant")
    nested = F.schema_of_variant(session).rlike("^(OBJECT|ARRAY)")
    return F.coalesce(
        regexp_or_null(F.col("user_name"), ":(.+)$"),
        F.when(~nested, F.try_variant_get(session, "$", "string")),
        "user_name",
    )


#: Settings under which the fields that most rows of a file have become columns.
SHREDDED = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}


def lake_rows(events: DataFrame, variants: bool = False) -> DataFrame:
    """Analytics rows: event columns, lifted JSON fields, flags, partitions;
    with ``variants`` also the parsed request and response.

    Each JSON text is parsed once.  ``user_identity`` is stored so that the
    queries that group by it do not read the JSON text at all.
    """
    has_response = ~key_present(F.col("_response"), "$.credentials") | is_object(F.col("_response"), "$.credentials")
    assumed = F.to_json(F.try_variant_get("_response", "$.assumedRoleUser", "variant"))
    return (
        events.select(EVENT_COLUMNS)
        .select("*", open_once(F.struct(*[F.try_parse_json(text) for text in VARIANTS]), "_request", "_response"))
        .select(
            *EVENT_COLUMNS,
            _lifted("_request", "$.roleArn").alias("role_arn"),
            _lifted("_request", "$.roleSessionName").alias("role_session_name"),
            _lifted("_request", "$.policyArn").alias("policy_arn"),
            _lifted("_request", "$.userName").alias("user_name_param"),
            _lifted("_request", "$.groupName").alias("group_name"),
            F.coalesce(F.when(has_response, assumed), F.lit("{}")).alias("assumed_role_user"),
            _lifted("_response", "$.credentials.expiration").alias("credentials_expiration"),
            _identity().alias("user_identity"),
            failed().alias("is_error"),
            *([F.col(f"_{name}").alias(name) for name in VARIANTS.values()] if variants else []),
            F.substring("event_date", 1, 4).try_cast("int").alias("year"),
            F.substring("event_date", 6, 2).try_cast("int").alias("month"),
            F.substring("event_date", 9, 2).try_cast("int").alias("day"),
            F.coalesce("aws_region", F.lit(UNKNOWN)).alias("region"),
        )
    )


def partition_columns(by_region: bool = True) -> list[str]:
    return LAKE_PARTITIONS if by_region else LAKE_PARTITIONS[:3]


def dealt_rows(events: DataFrame, by_region: bool = True) -> DataFrame:
    """Lake rows of events that are dealt out before their texts are parsed:
    less is shuffled, and the parsing is spread however the events came."""
    return lake_rows(events.hint("rebalance", "event_date", *(["aws_region"] if by_region else [])))


def write_lake(rows: DataFrame, path: str, by_region: bool = True, replace_dates: bool = False, dealt: bool = False) -> None:
    """Write lake rows as Snappy Parquet under year/month/day[/region].

    ``rebalance`` lets adaptive execution size the files: small partitions
    share tasks, and a region-day far above the rest is split over many;
    ``dealt`` rows went through it before (``dealt_rows``).
    Rows are sorted by event name and time inside a partition, so that
    row-group statistics can skip on both.  With ``replace_dates`` the written
    partitions replace older ones, which makes a retried export idempotent.
    """
    partitions = partition_columns(by_region)
    if not by_region:
        rows = rows.drop("region")
    with settings(rows.sparkSession, SHREDDED):
        (
            (rows if dealt else rows.hint("rebalance", *partitions))
            .sortWithinPartitions(*partitions, "event_name", "event_time")
            .write.partitionBy(*partitions)
            .option("compression", "snappy")
            .options(**LOOK_UP_OPTIONS)
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite" if replace_dates else "append")
            .parquet(path)
        )


def region_counts(events: DataFrame) -> DataFrame:
    """Events per export group."""
    return events.groupBy("event_date", F.coalesce("aws_region", F.lit(UNKNOWN)).alias("region")).agg(
        F.count("*").alias("events")
    )


def lake_counts(path: str) -> Aggregate:
    """Exported events per date and region, kept by every export."""
    return Aggregate(f"{path.rstrip('/')}-counts", COUNTS)


def of_dates(lake: DataFrame, dates: list | DataFrame) -> DataFrame:
    """Lake rows of event dates; a list of them prunes partitions."""
    if not isinstance(dates, list):
        return restrict_to(lake, "event_date", dates)
    day = F.format_string("%04d-%02d-%02d", "year", "month", "day")
    return lake.where(day.isin(dates))


def behind(stored: DataFrame, exported: DataFrame) -> DataFrame:
    """``event_date, stored, exported``: dates of which the lake holds fewer
    events than the store, from the counts alone.

    The lake only holds stored events, each once, so equal sums mean equal
    sets.  Regions may differ: a changed event keeps its exported region.
    """
    sums = lambda counts, name: counts.groupBy("event_date").agg(F.sum("events").alias(name))
    both = sums(stored, "stored").join(sums(exported, "exported"), "event_date", "left")
    held = F.coalesce("exported", F.lit(0)).alias("exported")
    return both.select("event_date", "stored", held).where("stored > exported")


def missing_dates(events: DataFrame, exported: DataFrame) -> DataFrame:
    """Dates with stored events and no exported file, in order."""
    return (
        events.select("event_date")
        .where(F.col("event_date").isNotNull())
        .distinct()
        .join(exported, "event_date", "left_anti")
        .orderBy("event_date")
    )


def missing_events(events: DataFrame, lake: DataFrame) -> DataFrame:
    """Stored events that the lake does not hold, also for exported dates.

    Both sides are sorted: from files' sizes Spark would take the keys for far
    smaller than they are, and send all of the lake's to every task."""
    return events.join(lake.select(EVENT_KEY).hint("merge"), EVENT_KEY, "left_anti")


def recent_dates(spark: SparkSession, as_of: dt.date, days_back: int = 1) -> DataFrame:
    """The last ``days_back`` dates before ``as_of``."""
    dates = [((as_of - dt.timedelta(days=n + 1)).isoformat(),) for n in range(days_back)]
    return spark.createDataFrame(dates, "event_date string")


def catch_up(spark: SparkSession, events: DataFrame, counts: Aggregate, path: str, by_region: bool = True) -> DataFrame:
    """Export what the lake misses, as the counts of store (``counts``) and
    lake tell; returns a one-row summary.

    Dates with equal sums are not opened at all.  A date the lake has nothing
    of is exported whole, and only for the others are keys compared.  A run
    that dies leaves its dates to be counted anew, so the next one exports
    the rest.  A lake from before its counts is counted once.
    """
    exported = lake_counts(path)
    _begin_export(spark, exported, path)
    gaps = behind(counts.read(spark), exported.read(spark))
    whole = key_values(gaps.where("exported = 0"), "event_date")
    partly = key_values(gaps.where("exported > 0"), "event_date")
    rows = missing_of(events, read_lake(spark, path), whole, partly)
    with staging(spark, "catch-up") as folder:
        rows.write.parquet(folder)
        rows = spark.read.schema(EVENTS).parquet(folder)
        total = _append_counted(spark, rows, exported, path, by_region)
    return spark.createDataFrame([("counts", total)], _EXPORTED)


def missing_of(events: DataFrame, lake: DataFrame, whole: list | DataFrame, partly: list | DataFrame) -> DataFrame:
    """All events of the ``whole`` dates and the missing ones of ``partly``."""
    rest = missing_events(restrict_to(events, "event_date", partly), of_dates(lake, partly))
    return restrict_to(events, "event_date", whole).select(EVENT_COLUMNS).unionByName(rest.select(EVENT_COLUMNS))


def _begin_export(spark: SparkSession, exported: Aggregate, path: str) -> None:
    if exported.exists(spark):
        exported.recover(spark, read_lake(spark, path))
    else:
        exported.rebuild(spark, read_lake(spark, path))


def _append_counted(spark: SparkSession, rows: DataFrame, exported: Aggregate, path: str, by_region: bool) -> int:
    """Append staged rows to the lake and enter them in its counts."""
    total = rows.count()
    if total:
        note = exported.prepare(rows, rows.limit(0))
        write_lake(dealt_rows(rows, by_region), path, by_region, dealt=True)
        exported.settle(spark, note, read_lake(spark, path))
    return total


_EXPORTED = "mode string, total_events_exported long"


def export(
    spark: SparkSession,
    events: DataFrame | EventStore,
    path: str,
    mode: str = "dates",
    by_region: bool = True,
    dates: DataFrame | None = None,
) -> DataFrame:
    """Export what the lake misses and return a one-row summary.

    ``mode='dates'`` exports dates without any file, in one write; ``dates``
    names others to export again, for example ``recent_dates``.
    ``mode='events'`` also adds events that arrived after their date was
    exported, and completes a date that a failed write left partial.  Of an
    ``EventStore`` the dates come from its listing.  ``catch_up`` does what
    ``mode='events'`` does without opening dates that are complete.
    """
    stored = events.read(spark) if isinstance(events, EventStore) else events
    counts = lake_counts(path)
    if mode == "dates":
        if dates is None:
            there = events.dates(spark) if isinstance(events, EventStore) else events
            dates = missing_dates(there, lake_dates(spark, path))
        chosen = key_values(dates, "event_date")
        rows = restrict_to(stored, "event_date", chosen)
        _begin_export(spark, counts, path)
        # Counted from the stored keys: exact also when tasks are repeated.
        exported = rows.count()
        listed = spark.createDataFrame([(date,) for date in chosen], DATES) if isinstance(chosen, list) else chosen
        note = counts.prepare(rows.limit(0), listed)
        write_lake(dealt_rows(rows, by_region), path, by_region, replace_dates=True, dealt=True)
        counts.settle(spark, note, read_lake(spark, path))
    elif mode == "events":
        _begin_export(spark, counts, path)
        lake = read_lake(spark, path)
        # Keys alone show which dates are incomplete; only the events of
        # those dates are shuffled whole.
        incomplete = key_values(missing_events(stored.select(EVENT_KEY), lake), "event_date")
        rows = missing_of(stored, lake, [], incomplete)
        # The anti-join runs once; the count and the write read its result.
        with staging(spark, "export") as folder:
            rows.write.parquet(folder)
            rows = spark.read.schema(EVENTS).parquet(folder)
            exported = _append_counted(spark, rows, counts, path, by_region)
    else:
        raise ValueError(f"Unknown export mode: {mode}. Available modes: dates, events")
    return spark.createDataFrame([(mode, exported)], _EXPORTED)
