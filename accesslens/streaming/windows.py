"""Stateful stream operators on parsed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.fixed import UNKNOWN
from accesslens.functions.events import failed
from accesslens.functions.time import instant_to_utc
from accesslens.operators.derived import ACTIVITY, SKETCH_BITS
from accesslens.operators.filters import flag_noise
from accesslens.operators.normalize import kept, parse_records, to_events

LATENESS = "5 minutes"


def event_stream(records: DataFrame, roles: str | None = None) -> DataFrame:
    """Event rows of a raw record stream, noise removed, timed for watermarks.

    A record without a readable time is left out, as by the loader: a time of
    the run would be another one when the micro-batch is repeated."""
    return timed(to_events(kept(flag_noise(parse_records(records, None), roles=roles))))


def timed(events: DataFrame) -> DataFrame:
    """Event rows with the instant ``event_instant``: watermarks need one."""
    return events.withColumn("event_instant", F.col("event_time").try_cast("timestamp"))


def deduplicated(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """First arrival per event key; keys are forgotten ``lateness`` after the
    newest event, which bounds the state."""
    return events.withWatermark("event_instant", lateness).dropDuplicatesWithinWatermark(["event_date", "event_id"])


def _estimate(column: str) -> F.Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(SKETCH_BITS)))


def _windowed(events: DataFrame, width: str, lateness: str) -> DataFrame:
    return (
        events.withWatermark("event_instant", lateness)
        .groupBy(F.window("event_instant", width))
        .agg(
            F.count("*").alias("total_events"),
            _estimate("user_name").alias("approx_users"),
            _estimate("event_name").alias("approx_actions"),
            F.count_if(failed()).alias("failed_events"),
        )
        .select(
            instant_to_utc(F.col("window.start")).alias("window_start"),
            "total_events", "approx_users", "approx_actions", "failed_events",
        )
    )


def activity_sketches(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Rows of the stored activity aggregate (``operators.derived``) per day,
    region and action: a stream's rows and a load's add up alike."""
    return (
        events.withWatermark("event_instant", lateness)
        .groupBy(F.window("event_instant", "1 day"), F.coalesce("aws_region", F.lit(UNKNOWN)).alias("region"), "event_name")
        .agg(
            F.count("*").alias("events"),
            F.count_if(failed()).alias("failed_events"),
            F.hll_sketch_agg("user_name", F.lit(SKETCH_BITS)).alias("users"),
        )
        .select(instant_to_utc(F.col("window.start")).cast("date").cast("string").alias("event_date"), "region", "event_name", "events", "failed_events", "users")
        .select(ACTIVITY.schema.fieldNames())
    )


def daily_counts(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Tumbling daily totals.  Distinct counts come from sketches (exact up to
    an eighth of their registers, then within 1.6 % on average): exact ones
    cannot be kept in a streaming aggregation."""
    return _windowed(events, "1 day", lateness)


def hourly_counts(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return _windowed(events, "1 hour", lateness)
