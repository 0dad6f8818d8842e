"""Continuous collection: the batch run applied to every micro-batch."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from accesslens.operators.incremental import Options, Tables, run_batch


def start_ingest(
    records: DataFrame,
    tables: Tables,
    checkpoint: str,
    options: Options = Options(),
    as_of: dt.datetime | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Load a record stream into the tables.

    The stream's own checkpoint replaces the look-back window, so late events
    are loaded whenever their file arrives.  Every step of a run is keyed: a
    micro-batch repeated after a failure changes nothing.  Without ``every``
    the query loads what is there and ends.
    """
    stream_options = replace(options, from_checkpoint=False)

    def load(batch: DataFrame, batch_id: int) -> None:
        now = as_of or dt.datetime.now(dt.timezone.utc)
        summary = run_batch(batch.sparkSession, batch, tables, now, stream_options).first()
        if summary["errors"]:  # the micro-batch is repeated, and its alerts with it
            raise RuntimeError("; ".join(summary["errors"]))

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        records.writeStream.queryName("ingest")
        .foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
