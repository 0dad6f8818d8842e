"""Keyed writes to the event store: last write wins, or first write wins.

Every writer takes the store's folder or an ``EventStore``, and aggregates of
it (``operators.derived``) to keep.  Ids and dates of stored events are never
NULL; rows without them equal nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accesslens.functions.keys import key_values, restrict_to
from accesslens.operators.derived import Aggregate
from accesslens.schema import EVENT_COLUMNS, EVENT_KEY, EVENTS
from accesslens.session import child_folders, is_complete, mark_complete, remove_folder, replace_folder, staging
from accesslens.sources.store import EventStore

PAYLOAD = [name for name in EVENT_COLUMNS if name not in EVENT_KEY]


def _print(name: str) -> Column:
    """256 bits that tell payloads apart, NULL and '' included."""
    return F.sha2(F.to_json(F.struct(*PAYLOAD), {"ignoreNullFields": "false"}), 256).alias(name)


def _one_per_key(rows: DataFrame, *order: Column) -> DataFrame:
    """One row per event key, with its ``_print``; copies beyond the first go
    before the shuffle.

    The filter on the row number limits every group map-side, so a key with
    very many copies does not fill one task.
    """
    # A print of the payload settles what the order leaves open, so that a
    # retried task picks the same row.
    window = W.partitionBy("event_id", "event_date").orderBy(*order, "_print")
    ranked = rows.withColumn("_print", _print("_print")).withColumn("_n", F.row_number().over(window))
    return ranked.where("_n = 1").drop("_n")


def latest(batch: DataFrame, load_order: str = "event_time") -> DataFrame:
    """One row per key: the one loaded last."""
    return _one_per_key(batch, F.desc(load_order)).select(EVENT_COLUMNS)


def upsert_events(store: DataFrame, batch: DataFrame, load_order: str = "event_time") -> DataFrame:
    """Store contents after writing a batch; the batch replaces equal keys.

    What is stored is joined with the batch's keys and not sorted."""
    return _merged(store, latest(batch, load_order))


def _merged(store: DataFrame, new: DataFrame) -> DataFrame:
    kept = store.join(new.select(EVENT_KEY), EVENT_KEY, "left_anti")
    return kept.select(EVENT_COLUMNS).unionByName(new.select(EVENT_COLUMNS))


def insert_new_events(store: DataFrame, batch: DataFrame, load_order: str = "event_time") -> DataFrame:
    """Rows a conditional write would add: the first per key, none that exist."""
    first = _one_per_key(batch, F.asc(load_order)).select(EVENT_COLUMNS)
    return first.join(store.select(EVENT_KEY), EVENT_KEY, "left_anti").select(EVENT_COLUMNS)


def _as_store(place: str | EventStore) -> EventStore:
    return EventStore(place) if isinstance(place, str) else place


def _copy_path(store: EventStore) -> str:
    return f"{store.path.rstrip('/')}.rewrite"


def _finish_rewrite(spark: SparkSession, store: EventStore, expected: bool = False) -> None:
    """Move the dates of a complete copy into the store; where one is
    ``expected``, its absence is an error.  Dates already moved are gone from
    the copy, so this can be interrupted and repeated."""
    copy = _copy_path(store)
    if expected and not is_complete(spark, copy):
        raise RuntimeError(f"the copy for a rewrite is not complete: {copy}")
    if is_complete(spark, copy):
        for date in child_folders(spark, copy):
            if date.startswith("event_date="):
                replace_folder(spark, f"{copy}/{date}", f"{store.path.rstrip('/')}/{date}")
        store.refresh(spark)
        remove_folder(spark, copy)


def _replace_dates(spark: SparkSession, store: EventStore, rows: DataFrame) -> None:
    """Write rows once, next to the store, and put their dates in its place."""
    copy = _copy_path(store)
    remove_folder(spark, copy)
    store.write(rows, copy)
    mark_complete(spark, copy)
    _finish_rewrite(spark, store, expected=True)


def _begin(spark: SparkSession, store: EventStore, kept: Sequence[Aggregate]) -> None:
    """Complete what a writer that died has left."""
    _finish_rewrite(spark, store)
    for aggregate in kept:
        aggregate.recover(spark, store.read(spark))


def write_new_events(
    spark: SparkSession, batch: DataFrame, place: str | EventStore, load_order: str = "event_time", kept: Sequence[Aggregate] = ()
) -> None:
    """Append the events whose key the store does not hold."""
    store = _as_store(place)
    _begin(spark, store, kept)
    with staging(spark, "insert") as folder, store.aligned(spark):
        batch.write.parquet(f"{folder}/batch")
        staged = spark.read.parquet(f"{folder}/batch")
        held = restrict_to(store.read(spark), "event_date", staged)
        insert_new_events(held, staged, load_order).write.parquet(f"{folder}/new")
        new = spark.read.schema(EVENTS).parquet(f"{folder}/new")
        notes = [aggregate.prepare(new, new.limit(0)) for aggregate in kept]
        store.write(store.dealt(new))
        for aggregate, note in zip(kept, notes, strict=True):
            aggregate.settle(spark, note, store.read(spark))


def write_upsert(spark: SparkSession, batch: DataFrame, place: str | EventStore, kept: Sequence[Aggregate] = ()) -> dict[str, int]:
    """Upsert a batch into the event store; counts by outcome.

    Only the dates of the batch are read.  New events are appended and
    repeated ones skipped; a date is rewritten only when one of its events
    changed.  Replaying a batch therefore writes nothing, and a run that dies
    half-way is completed by running it again.  A rewritten date is written
    once, into a complete copy next to the store, whose folders then replace
    those of the store; a copy left by a run that died while replacing is
    moved first.  One writer at a time.
    """
    store = _as_store(place)
    _begin(spark, store, kept)
    with staging(spark, "upsert") as folder, store.aligned(spark):
        return _write_upsert(spark, batch, store, folder, kept)


def _compared(store: DataFrame, new: DataFrame) -> DataFrame:
    """Batch rows (with their print ``_new``) and what becomes of them.

    Of the store, only the rows of the batch's dates are read, and only key
    and payload print of the rows with its keys go on: the keys are the small
    side of that join, the payloads stay behind.
    """
    held = restrict_to(store, "event_date", new).join(new.select(EVENT_KEY), EVENT_KEY, "left_semi")
    old = held.select(*EVENT_KEY, _print("_old"))
    outcome = F.when(F.col("_old").isNull(), "new").when(F.col("_new") == F.col("_old"), "same").otherwise("changed")
    return new.join(old, EVENT_KEY, "left").withColumn("outcome", outcome).select(*EVENT_COLUMNS, "outcome")


def _outcomes(spark: SparkSession, store: DataFrame, new: DataFrame, folder: str) -> DataFrame:
    """Batch rows and what becomes of them.  Rows of dates that the store has
    are compared, once, into ``folder``; those of other dates are new as they
    are, and are neither joined nor written again."""
    held = key_values(restrict_to(store.select("event_date"), "event_date", new), "event_date")
    fresh = new.select(*EVENT_COLUMNS, F.lit("new").alias("outcome"))
    if held == []:
        return fresh
    _compared(store, restrict_to(new, "event_date", held)).write.parquet(folder)
    if isinstance(held, list):
        fresh = fresh.where(~F.coalesce(F.col("event_date").isin(held), F.lit(False)))
    else:
        fresh = fresh.join(held, "event_date", "left_anti")
    return spark.read.parquet(folder).unionByName(fresh)


def _write_upsert(
    spark: SparkSession, batch: DataFrame, store: EventStore, folder: str, kept: Sequence[Aggregate]
) -> dict[str, int]:
    # The batch is worked out once, prints and all.
    _one_per_key(batch, F.desc("event_time")).select(*EVENT_COLUMNS, F.col("_print").alias("_new")).write.parquet(f"{folder}/batch")
    staged = _outcomes(spark, store.read(spark), spark.read.parquet(f"{folder}/batch"), f"{folder}/compared")
    counts = {row["outcome"]: row["count"] for row in staged.groupBy("outcome").count().collect()}
    new, changed = staged.where("outcome = 'new'").select(EVENT_COLUMNS), staged.where("outcome = 'changed'")
    notes = [aggregate.prepare(new, changed) for aggregate in kept]
    if counts.get("changed"):
        dates = key_values(changed, "event_date")
        rows = restrict_to(staged, "event_date", dates).select(EVENT_COLUMNS)
        touched = restrict_to(store.read(spark), "event_date", dates)
        _replace_dates(spark, store, _merged(touched, store.dealt(rows)))
        new = new.where(~F.col("event_date").isin(dates)) if isinstance(dates, list) else new.join(dates, "event_date", "left_anti")
    if counts.get("new"):
        store.write(store.dealt(new))
    for aggregate, note in zip(kept, notes, strict=True):
        aggregate.settle(spark, note, store.read(spark))
    return {name: counts.get(name, 0) for name in ("new", "same", "changed")}


#: Bytes that a file of the store should have at least, where a date has them.
FILE_BYTES = 128 << 20


def compact(spark: SparkSession, place: str | EventStore, file_bytes: int = FILE_BYTES, spare: int = 4) -> int:
    """Write dates anew whose files are far more than their bytes need, after
    many small loads; returns how many dates.  Only the listing is read to
    choose them.  Like any rewrite, it can die and be completed."""
    store = _as_store(place)
    _finish_rewrite(spark, store)
    files = store.files(spark).groupBy("event_date").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    crowded = files.where(F.col("files") > spare * store.least_files() * F.ceil(F.col("bytes") / file_bytes))
    dates = key_values(crowded, "event_date")
    chosen = len(dates) if isinstance(dates, list) else dates.count()
    if chosen:
        with store.aligned(spark):
            _replace_dates(spark, store, store.dealt(restrict_to(store.read(spark), "event_date", dates)))
    return chosen
