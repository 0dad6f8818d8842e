"""Several sources in one stream, each as late as it is, and what was too late.

Every source has a watermark of its own.  The stream's is the least of them
(Spark's default policy, demanded here): a slow source holds the windows open
that a fast one would close.  Rows older than that are dropped where they meet
the first state, row by row in the de-duplication; how many is part of every
micro-batch's report, next to what arrived and what went on.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from accesslens.schema import EVENT_COLUMNS, EVENT_KEY
from accesslens.streaming.windows import LATENESS, timed

POLICY = "spark.sql.streaming.multipleWatermarkPolicy"
ARRIVALS = "batch_id long, arrived long, kept long, repeated long, late long"


def merged_sources(sources: Mapping[str, DataFrame], lateness: str | Mapping[str, str] = LATENESS) -> DataFrame:
    """Event rows of all sources with ``source_name``, once per event key.

    ``lateness`` is how far a source's events may be out of order, for all or
    by source.  What arrives and what is kept is observed.  A source that
    delivers nothing at all holds everything back: leave it out.
    """
    spark = next(iter(sources.values())).sparkSession
    if spark.conf.get(POLICY) != "min":
        raise ValueError(f"{POLICY} must be min: with another policy a slow source's events are dropped as late")
    marked = []
    for name, events in sources.items():
        allowed = lateness if isinstance(lateness, str) else lateness[name]
        rows = timed(events).select(*EVENT_COLUMNS, "event_instant", F.lit(name).alias("source_name"))
        marked.append(rows.withWatermark("event_instant", allowed))
    arrived = reduce(DataFrame.unionByName, marked).observe("arrived", F.count(F.lit(1)).alias("rows"))
    return arrived.dropDuplicatesWithinWatermark(EVENT_KEY).observe("kept", F.count(F.lit(1)).alias("rows"))


def hourly_totals(events: DataFrame) -> DataFrame:
    """Events per hour and source, given out once the hour is closed."""
    return events.groupBy(F.window("event_instant", "1 hour"), "source_name").agg(F.count("*").alias("total_events")).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "source_name", "total_events"
    )


def arrivals(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Per micro-batch what arrived and what became of it, from the reports
    that the query still has (``spark.sql.streaming.numRecentProgressUpdates``);
    ``kept + repeated + late`` is ``arrived``."""
    rows = {}
    for progress in query.recentProgress:
        state = next((s for s in progress.stateOperators if s.operatorName == "dedupeWithinWatermark"), None)
        observed = progress.observedMetrics
        if state is not None and "arrived" in observed:
            repeated = state.customMetrics.get("numDroppedDuplicateRows", 0)
            rows[progress.batchId] = (progress.batchId, observed["arrived"].rows, observed["kept"].rows, repeated, state.numRowsDroppedByWatermark)
    return spark.createDataFrame(list(rows.values()), ARRIVALS)
