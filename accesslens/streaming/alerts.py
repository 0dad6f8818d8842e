"""Alerts of a stream, each once in thirty days, remembered in its state.

The state holds (event, severity) for thirty days of the watermark, which is
itself thirty days behind the newest event: it neither grows without end nor
needs the alert table, and what the table's retention would hold back is held
back here too.  The query's checkpoint keeps it over restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from accesslens.fixed import ALERT_RETENTION_DAYS
from accesslens.operators.alerts import find_alerts, notices
from accesslens.session import settings
from accesslens.streaming.windows import timed

#: State that outgrows the heap is kept on disk beside the executors.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def alert_stream(events: DataFrame, own_account: str, strict_wildcards: bool = False) -> DataFrame:
    """Notices of a stream of event rows, each (event, severity) once."""
    found = find_alerts(events, own_account, strict_wildcards)
    aged = timed(found).withWatermark("event_instant", f"{ALERT_RETENTION_DAYS} days")
    return notices(aged.dropDuplicatesWithinWatermark(["event_id", "alert_type"])).drop("event_instant")


def start_alerts(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the notices to Parquet files; exactly once, by the file sink's
    log.  Without ``every`` the query takes what is there and ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = rows.writeStream.queryName("alerts").format("parquet").outputMode("append")
    with settings(rows.sparkSession, STATE_STORE):  # a query keeps the settings it was started with
        return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
