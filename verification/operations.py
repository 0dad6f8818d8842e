"""Registered callables for sources, filters, loading, alerts, lake, reports."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens import run
from accesslens.functions.time import from_iso
from accesslens.operators import alerts, derived, incremental, lake, reports, results, upsert
from accesslens.plans import sketched, sql
from accesslens.operators.filters import filter_events, flag_noise
from accesslens.operators.normalize import kept, parse_records, to_events
from accesslens.schema import CONTROL
from accesslens.session import child_folders, set_modified, shared_folder
from accesslens.sources import lake as lake_source
from accesslens.sources import raw, routes, store
from accesslens.streaming import arrivals, ingest, windows
from accesslens.streaming import alerts as stream_alerting
from verification.raw_recipe import raw_from
from verification.recipe import AS_OF, EVENTS_SQL, OWN_ACCOUNT, events_from

NOW = dt.datetime(2024, 1, 31)
ROUTES = routes.Routes(regions=["us-east-1", "eu-west-1"], sso_region="eu-west-1")
ROLES = "Role1, *session-1*, issuer*, arn:aws:iam::111111111111:role/Role4"

Query = Callable[[SparkSession, str], DataFrame]


def _on_events(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(events_from(spark, sf_dir))


def _before(events: DataFrame, moment: str) -> DataFrame:
    return events.where(F.col("event_time") < moment)


def _from(events: DataFrame, moment: str) -> DataFrame:
    return events.where(F.col("event_time") >= moment)


# Sources and filters


def _routed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routes.select_by_table(events_from(spark, sf_dir), routes.route_table(spark, ROUTES))
    return rows.groupBy(routes.checkpoint_key().alias("checkpoint_key")).agg(F.count("*").alias("events"))


def _event_view(events: DataFrame) -> DataFrame:
    """Event rows without the JSON texts, which keep value but not layout."""
    bare = F.col("request_parameters").isin("null", "{}")
    return events.withColumn(
        "request_kind", F.when(bare, F.col("request_parameters")).otherwise(F.get_json_object("request_parameters", "$.roleArn"))
    ).drop("request_parameters", "response_elements")


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_records(raw.from_text(raw_from(spark, sf_dir)), NOW)
    return _event_view(to_events(kept(parsed)))


def _raw_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = flag_noise(parse_records(raw.from_text(raw_from(spark, sf_dir)), NOW), roles=ROLES)
    return _event_view(to_events(kept(parsed)))


def _raw_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = flag_noise(parse_records(raw.from_text(raw_from(spark, sf_dir)), NOW), roles=ROLES)
    return parsed.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("records"))


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = raw_from(spark, sf_dir).select(
        F.concat(F.lit("env-"), "event_id").alias("EventId"),
        from_iso(F.col("event_time")).alias("EventTime"),
        F.lit("Wrapped").alias("EventName"),
        F.col("raw").alias("CloudTrailEvent"),
    )
    parsed = parse_records(raw.unwrap(wrapped), NOW)
    return to_events(kept(parsed)).select("event_id", "event_time", "event_name", "user_name", "error_code")


# Lake


def _exported_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "lake")
    lake.export(spark, events_from(spark, sf_dir), path)
    return lake_source.read_lake(spark, path)


def _lake_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _exported_lake(spark, sf_dir)
        .groupBy("year", "month", "day", "region")
        .agg(F.count("*").alias("events"), F.count_if("is_error").alias("errors"))
    )


def _lake_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early export, then a repeat by dates and one by events."""
    path, events = shared_folder(spark, "lake"), events_from(spark, sf_dir)
    lake.export(spark, _before(events, "2024-01-25T12"), path)
    lake.export(spark, events, path, mode="dates")
    lake.export(spark, events, path, mode="events")
    return lake_source.read_lake(spark, path).groupBy("event_date").agg(F.count("*").alias("events"))


def _missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_from(spark, sf_dir)
    exported = _before(events, "2024-01-21").select("event_date").distinct()
    return lake.missing_dates(events, exported)


def _missing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_from(spark, sf_dir)
    exported = lake.lake_rows(_before(events, "2024-01-25T12"))
    return lake.missing_events(events, exported).select("event_date", "event_id", "event_time")


# Loading


def _store_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events to 20 January, and two loads that overlap it and each other."""
    events = events_from(spark, sf_dir)
    first = _from(events, "2024-01-15").withColumns({"error_message": F.lit("first load"), "load": F.lit(1)})
    second = _from(events, "2024-01-18T12").withColumns({"error_message": F.lit("second load"), "load": F.lit(2)})
    return _before(events, "2024-01-21"), first.unionByName(second)


_STORED = ["event_date", "event_id", "event_name", "error_message"]


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _store_and_batch(spark, sf_dir)
    return upsert.upsert_events(stored, batch, "load").select(_STORED)


def _insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _store_and_batch(spark, sf_dir)
    return upsert.insert_new_events(stored, batch, "load").select(_STORED)


def _written_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _store_and_batch(spark, sf_dir)
    path = shared_folder(spark, "events")
    upsert.write_upsert(spark, stored, path)
    upsert.write_upsert(spark, upsert.latest(batch, "load"), path)
    return store.read_events(spark, path).select(_STORED)


def _written_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _store_and_batch(spark, sf_dir)
    path = shared_folder(spark, "events")
    upsert.write_new_events(spark, stored, path)
    upsert.write_new_events(spark, batch, path, "load")
    return store.read_events(spark, path).select(_STORED)


def _bucketed(spark: SparkSession) -> store.BucketedStore:
    name = f"events_{uuid.uuid4().hex}"
    return store.BucketedStore(shared_folder(spark, "bucketed"), name, buckets=8)


def _bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _store_and_batch(spark, sf_dir)
    place = _bucketed(spark)
    upsert.write_upsert(spark, stored, place)
    upsert.write_upsert(spark, upsert.latest(batch, "load"), place)
    return place.read(spark).select(_STORED)


def _bucketed_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _store_and_batch(spark, sf_dir)
    place = _bucketed(spark)
    upsert.write_new_events(spark, stored, place)
    upsert.write_new_events(spark, batch, place, "load")
    return place.read(spark).select(_STORED)


def _loaded(spark: SparkSession, sf_dir: str) -> incremental.Tables:
    """All events, of which three days came in wrong and were corrected."""
    events, tables = events_from(spark, sf_dir), incremental.Tables.under(shared_folder(spark, "loaded"))
    wrong = {"user_name": F.concat(F.lit("wrong-"), "event_id"), "error_code": F.lit("wrong"), "aws_region": F.lit("nowhere")}
    early = _before(events, "2024-01-18").unionByName(_before(_from(events, "2024-01-18"), "2024-01-21").withColumns(wrong))
    for batch in (early, _from(events, "2024-01-17T12"), _from(events, "2024-01-29")):
        upsert.write_upsert(spark, batch, tables.events, tables.kept)
    return tables


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after two loads of every date, compacted."""
    events, path = events_from(spark, sf_dir), shared_folder(spark, "events")
    half = F.crc32(F.col("event_id").cast("binary")) % 2
    for part in (0, 1):
        upsert.write_upsert(spark, events.where(half == part), path)
    upsert.compact(spark, path, spare=1)
    files = store.EventStore(path).files(spark).groupBy("event_date").agg(F.count("*").alias("files"))
    return store.read_events(spark, path).groupBy("event_date").agg(F.count("*").alias("events")).join(files, "event_date")


def _ledger_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lake exported early, caught up by the counts of store and lake."""
    tables, path = _loaded(spark, sf_dir), shared_folder(spark, "lake")
    events = store.read_events(spark, tables.events)
    lake.export(spark, _before(events, "2024-01-25T12"), path)
    lake.catch_up(spark, events, tables.counts, path)
    held = lake_source.read_lake(spark, path).groupBy("event_date").agg(F.count("*").alias("events"))
    counted = lake.lake_counts(path).read(spark).groupBy("event_date").agg(F.sum("events").alias("counted"))
    return held.join(counted, "event_date")


def _by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up in the copy by user that three loads have kept."""
    events, folder = events_from(spark, sf_dir), shared_folder(spark, "copies")
    copy = derived.Copy.by("user_name", f"{folder}/by-user", f"by_user_{uuid.uuid4().hex}", 8)
    wrong = _before(_from(events, "2024-01-12"), "2024-01-14").withColumn("user_name", F.lit("user5"))
    for batch in (_before(events, "2024-01-12").unionByName(wrong), _from(events, "2024-01-11"), _from(events, "2024-01-25")):
        upsert.write_upsert(spark, batch, f"{folder}/events", [copy])
    return store.events_by_user(copy.read(spark), "user5", "2024-01-10", "2024-01-20")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region-days that a query over a week opens, with its cost: the bytes
    are those of the listing, and only their agreement can be stated."""
    path, table = shared_folder(spark, "lake"), f"lake_{uuid.uuid4().hex}"
    lake.export(spark, events_from(spark, sf_dir), path)
    lake_source.register_lake(spark, table, path)
    files = lake_source.lake_files(spark, path)
    opened = reports.scanned_files(run("hourly_activity", spark.table(table), AS_OF), files)
    week = files.where("make_date(year, month, day) >= DATE '2024-01-24'").agg(F.sum("length").alias("week"))
    cost = reports.scan_cost(opened).join(week).select((F.col("bytes_scanned") == F.col("week")).alias("all_bytes"))
    day = F.format_string("%04d-%02d-%02d", "year", "month", "day").alias("event_date")
    return files.join(opened.select("path"), "path").select(day, "region").distinct().join(cost)


def _sql_function(name: str) -> Query:
    """A library query called from SQL, over a catalog table of the lake."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, table = shared_folder(spark, "lake"), f"lake_{uuid.uuid4().hex}"
        lake.write_lake(lake.lake_rows(events_from(spark, sf_dir)), path)
        lake_source.register_lake(spark, table, path)
        sql.register_functions(spark, table, f"{table}_")
        return spark.sql(f"SELECT * FROM {table}_{name}(DATE '{AS_OF}')")

    return call


def _shredded(name: str) -> Query:
    """A JSON query over a lake that keeps parsed requests."""

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_folder(spark, "lake")
        lake.write_lake(lake.lake_rows(events_from(spark, sf_dir), variants=True), path)
        return run(name, lake_source.read_lake(spark, path, variants=True), AS_OF, "sql")

    return read


def _lake_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog table that finds the partitions of a later export."""
    events, path, table = events_from(spark, sf_dir), shared_folder(spark, "lake"), f"lake_{uuid.uuid4().hex}"
    lake.export(spark, _before(events, "2024-01-16"), path)
    lake_source.register_lake(spark, table, path)
    lake.export(spark, events, path)
    lake_source.refresh_partitions(spark, table)
    return spark.table(table).groupBy("event_date", "region").agg(F.count("*").alias("events"))


def _control(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Control table after the events to 20 January."""
    early = _before(events, "2024-01-21")
    keys = early.select(routes.checkpoint_key().alias("checkpoint_key"))
    moment = dt.datetime(2024, 1, 21)
    fresh = incremental.initialize_control(spark.createDataFrame([], CONTROL), keys, moment)
    return incremental.advance_control(fresh, early, moment)


def _checkpoint_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = events_from(spark, sf_dir).select(routes.checkpoint_key().alias("checkpoint_key"))
    return incremental.initialize_control(spark.createDataFrame([], CONTROL), keys, NOW)


def _checkpoint_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_from(spark, sf_dir)
    return incremental.advance_control(_control(spark, events), _from(events, "2024-01-21"), NOW)


def _incremental_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_from(spark, sf_dir)
    records = events.withColumns({"event_ts": from_iso(F.col("event_time")), "drop_reason": F.lit(None).cast("string")})
    control = _control(spark, events)
    return incremental.since_checkpoint(records, control, dt.datetime(2024, 1, 30, 12)).select(
        "event_id", "event_time", "event_source", "aws_region"
    )


def _collection_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = raw.from_text(raw_from(spark, sf_dir))
    tables = incremental.Tables.under(shared_folder(spark, "run"))
    options = incremental.Options(routes=ROUTES, roles=ROLES, own_account=OWN_ACCOUNT)
    summary = incremental.run_batch(spark, records, tables, NOW, options)
    return summary.drop("execution_time_seconds", "errors")


# Alerts


def _sent(events: DataFrame) -> DataFrame:
    """Alerts of the first half of the month, sent on 1 January and on the 20th."""
    due = alerts.notices(alerts.find_alerts(events, OWN_ACCOUNT))
    old = alerts.sent_records(_before(due, "2024-01-08"), dt.datetime(2024, 1, 1))
    recent = alerts.sent_records(_from(_before(due, "2024-01-16"), "2024-01-08"), dt.datetime(2024, 1, 20))
    return old.unionByName(recent)


def _alerts_deduped(events: DataFrame) -> DataFrame:
    found = alerts.find_alerts(events.unionByName(events), OWN_ACCOUNT)
    return alerts.unsent(found, _sent(events), NOW).select("event_id", "alert_type", "rule_id", "alert_title")


def _alert_notices(events: DataFrame) -> DataFrame:
    return alerts.notices(alerts.find_alerts(events, OWN_ACCOUNT)).select(
        "event_id", "event_name_attribute", "message_id", "subject", "body"
    )


# Reports


def _day_sizes(events: DataFrame) -> DataFrame:
    """One 'file' per day and region: its size is the JSON text it holds."""
    return (
        events.groupBy("event_date", "aws_region")
        .agg(F.sum(F.length("request_parameters") + F.length("response_elements")).alias("size"))
        .withColumn("storage_class", reports.tier_by_age(F.col("event_date").cast("date"), dt.date(2024, 4, 15)))
    )


def _tiers(events: DataFrame) -> DataFrame:
    day = F.col("event_date").cast("date")
    return events.select(
        "event_id",
        reports.tier_by_age(day, AS_OF).alias("tier_now"),
        reports.tier_by_age(day, dt.date(2024, 4, 15)).alias("tier_spring"),
        reports.tier_by_age(day, dt.date(2025, 1, 15)).alias("tier_next_year"),
    )


def _lake_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region-days of an exported lake with the class their files are reported
    in; the report's bytes are Parquet's and no statement can know them."""
    path = shared_folder(spark, "lake")
    lake.export(spark, events_from(spark, sf_dir), path)
    files = lake_source.lake_files(spark, path)
    tiers = reports.with_tier(files, dt.date(2024, 4, 15))
    day = F.format_string("%04d-%02d-%02d", "year", "month", "day").alias("event_date")
    return files.select("path", day, "region").join(tiers.where("size > 0"), "path").select("event_date", "region", "storage_class").distinct()


# Streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream.createOrReplaceTempView("events")
    return windows.timed(spark.sql(EVENTS_SQL))


def _stream_result(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all available data and read what it produced."""
    folder = shared_folder(spark, "stream")
    shape = stream.schema

    def keep(batch: DataFrame, batch_id: int) -> None:
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(shape).parquet(f"{folder}/out")


def _stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _stream_result(spark, windows.daily_counts(_event_stream(spark, sf_dir)), "complete")
    return counts.select("window_start", "total_events", "failed_events", "approx_users", "approx_actions")


def _stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _stream_result(spark, windows.hourly_counts(_event_stream(spark, sf_dir)), "complete")
    return counts.select("window_start", "total_events", "failed_events", "approx_users", "approx_actions")


def _stream_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the sketches that a stream made."""
    rows = _stream_result(spark, windows.activity_sketches(_event_stream(spark, sf_dir)), "complete")
    return sketched.distinct_counts(rows, AS_OF)


def _deliveries(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, DataFrame]:
    """Two sources' files in the order of their arrival.

    File n of ``fast`` has the days 3n+1 to 3n+3; ``slow`` is a file behind
    after the first day.  One event in 40 comes two files later than that.
    """
    events = events_from(spark, sf_dir)
    day, slow = F.day(F.col("event_date").cast("date")), F.col("event_type") == "sso"
    block = F.floor((day - 1) / 3) + F.when(slow & (day > 1), 1).otherwise(0)
    numbered = events.withColumn("file", block + F.when(F.col("event_id").cast("long") % 40 == 7, 2).otherwise(0))
    numbered = numbered.withColumn("source", F.when(slow, "slow").when(~slow, "fast")).where("source IS NOT NULL AND file BETWEEN 0 AND 12")
    # Every file is written by a task of its own, all in one pass.
    numbered.repartition("source", "file").write.partitionBy("source", "file").parquet(folder)
    streams, schema = {}, T.StructType([*events.schema.fields, T.StructField("file", T.LongType())])
    for name in ("fast", "slow"):
        for n in range(13):  # one after another: a stream reads files by their age
            part = f"{folder}/source={name}/file={n}"
            if f"file={n}" not in child_folders(spark, f"{folder}/source={name}"):
                numbered.select(events.columns).limit(0).coalesce(1).write.parquet(part)
            set_modified(spark, part, 1_700_000_000 + n)
        streams[name] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source={name}")
    return streams


def _stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hours by source, then the totals of what arrived, was kept and
    was too late under five minutes."""
    folder = shared_folder(spark, "late")
    stream = arrivals.hourly_totals(arrivals.merged_sources(_deliveries(spark, sf_dir, f"{folder}/in")))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    hours = spark.read.schema(stream.schema).parquet(f"{folder}/out").select("window_start", "source_name", "total_events")
    totals = arrivals.arrivals(spark, query).agg(*[F.sum(c).alias(c) for c in ("arrived", "kept", "repeated", "late")])
    summed = totals.select(F.lit("total").alias("window_start"), F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c))])).alias("source_name", "total_events"))
    return hours.unionByName(summed)


def _stream_alerts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered twice to an alerting stream that is restarted."""
    folder, events = shared_folder(spark, "alerts"), events_from(spark, sf_dir)
    for part in (_before(events, "2024-01-16"), events):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        rows = stream_alerting.alert_stream(stream, OWN_ACCOUNT)
        stream_alerting.start_alerts(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "alert_type")


def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _event_stream(spark, sf_dir)
    twice = stream.unionByName(stream)
    rows = _stream_result(spark, windows.deduplicated(twice, "40 days"), "append")
    return rows.groupBy("event_date").agg(F.count("*").alias("events"))


def _deliver(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Raw records as delivered files; broken text cannot be inside one."""
    records = raw_from(spark, sf_dir).where(F.col("shape") != 14)
    records.select(F.concat(F.lit('{"Records":['), F.coalesce("raw", F.lit("null")), F.lit("]}"))).write.text(folder)


def _raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "raw")
    _deliver(spark, sf_dir, folder)
    parsed = flag_noise(parse_records(raw.read_records(spark, folder, multi_line=False), NOW), roles=ROLES)
    return _event_view(to_events(kept(parsed)))


def _ingested(spark: SparkSession, sf_dir: str) -> incremental.Tables:
    """Files of raw records, loaded by the streaming query."""
    folder = shared_folder(spark, "ingest")
    _deliver(spark, sf_dir, f"{folder}/raw")
    tables = incremental.Tables.under(f"{folder}/tables")
    options = incremental.Options(roles=ROLES, own_account=OWN_ACCOUNT)
    ingest.start_ingest(
        raw.stream_records(spark, f"{folder}/raw", multi_line=False), tables, f"{folder}/checkpoint", options, as_of=NOW
    ).awaitTermination()
    return tables


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_view(store.read_events(spark, _ingested(spark, sf_dir).events))


def _stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ingested(spark, sf_dir).read_alerts(spark)
    return found.select("event_id", "alert_type", "rule_id", "alert_title", "alert_message")


OPERATION_QUERIES: dict[str, Query] = {
    "lookup_by_user": _on_events(lambda e: store.events_by_user(e, "user5", "2024-01-10", "2024-01-20")),
    "lookup_by_action": _on_events(lambda e: store.events_by_action(e, "CreateUser")),
    "scan_date_range": _on_events(lambda e: store.scan_date_range(e, "2024-01-05", "2024-01-20")),
    "source_routing": _on_events(
        lambda e: routes.select_sources(e, ROUTES).select("event_id", "event_source", "aws_region")
    ),
    "source_routing_table": _routed_counts,
    "role_filter": _on_events(lambda e: filter_events(e, ROLES).select("event_id", "user_name", "event_name")),
    "raw_files": _raw_files,
    "raw_normalized": _raw_events,
    "raw_kept_events": _raw_kept,
    "raw_drop_reasons": _raw_reasons,
    "raw_envelopes": _envelopes,
    "lake_row": _on_events(lake.lake_rows),
    "lake_export": _lake_export,
    "lake_catch_up": _lake_catch_up,
    "lake_region_counts": _on_events(lake.region_counts),
    "lake_daily_summary": lambda spark, sf_dir: run("daily_summary", _exported_lake(spark, sf_dir), AS_OF),
    "lake_user_lookup_full": lambda spark, sf_dir: run("user_lookup", _exported_lake(spark, sf_dir), AS_OF, "full"),
    "missing_dates": _missing_dates,
    "missing_events": _missing_events,
    "insert_new_events": _insert_new,
    "upsert_events": _upsert,
    "upsert_written": _written_upsert,
    "insert_written": _written_insert,
    "bucketed_upsert_written": _bucketed_upsert,
    "bucketed_insert_written": _bucketed_insert,
    "store_compacted": _compacted,
    "ledger_counts": lambda spark, sf_dir: _loaded(spark, sf_dir).counts.read(spark),
    "ledger_catch_up": _ledger_catch_up,
    "lake_refreshed": _lake_refreshed,
    "shredded_permission_sets": _shredded("sso_permission_sets"),
    "shredded_account_assignments": _shredded("sso_account_assignments"),
    "shredded_admin_policies": _shredded("sso_admin_policies"),
    "shredded_applications": _shredded("sso_applications"),
    "sql_failed_auth": _sql_function("failed_auth"),
    "sql_daily_summary": _sql_function("daily_summary"),
    "sql_role_assumptions": _sql_function("role_assumptions"),
    "sql_account_assignments": _sql_function("sso_account_assignments"),
    "lookup_in_user_copy": _by_user,
    "scanned_files": _scanned,
    "sketch_distinct_counts": lambda spark, sf_dir: sketched.distinct_counts(_loaded(spark, sf_dir).activity.read(spark), AS_OF),
    "sketch_daily_summary": lambda spark, sf_dir: sketched.daily_summary(_loaded(spark, sf_dir).activity.read(spark), AS_OF),
    "sketch_active_users": lambda spark, sf_dir: sketched.active_users(_loaded(spark, sf_dir).busiest.read(spark), AS_OF),
    "checkpoint_init": _checkpoint_init,
    "checkpoint_advance": _checkpoint_advance,
    "incremental_read": _incremental_read,
    "collection_run": _collection_run,
    "alerts_all": _on_events(lambda e: alerts.find_alerts(e, OWN_ACCOUNT)),
    "alerts_deduped": _on_events(_alerts_deduped),
    "alert_notices": _on_events(_alert_notices),
    "sent_alerts_active": _on_events(
        lambda e: alerts.active_sent(_sent(e), dt.datetime(2024, 2, 5)).select("event_id", "alert_type", "ttl")
    ),
    "tier_by_age": _on_events(_tiers),
    "storage_by_class": _on_events(lambda e: reports.storage_by_class(_day_sizes(e))),
    "storage_total": _on_events(lambda e: reports.storage_total(reports.storage_by_class(_day_sizes(e)))),
    "scan_cost": _on_events(lambda e: reports.scan_cost(_day_sizes(e), "event_date")),
    "lake_storage_report": _lake_storage,
    "json_export": _on_events(lambda e: results.json_rows(run("daily_summary", e, AS_OF))),
    "result_display": _on_events(lambda e: results.fetched(run("role_assumptions", e, AS_OF))),
    "stream_daily_counts": _stream_daily,
    "stream_hourly_counts": _stream_hourly,
    "stream_deduplicated": _stream_dedup,
    "stream_sketches": _stream_sketches,
    "stream_late_events": _stream_late,
    "stream_alerts_once": _stream_alerts_once,
    "stream_ingest": _stream_ingest,
    "stream_alerts": _stream_alerts,
}
