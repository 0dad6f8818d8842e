import datetime as dt
import json

from pyspark.sql import functions as F

from accesslens.operators.incremental import Options, Tables, run_batch
from accesslens.schema import EVENTS
from accesslens.sources.raw import read_records, stream_records
from accesslens.sources.store import read_events
from accesslens.streaming import windows
from accesslens.streaming.ingest import start_ingest

NOW = dt.datetime(2024, 1, 31, 12)


def record(i, day=30, name="CreateUser"):
    return {
        "eventID": str(i), "eventTime": f"2024-01-{day}T10:00:00Z", "eventName": name, "eventSource": "iam.amazonaws.com",
        "awsRegion": "us-east-1", "userIdentity": {"userName": "bob"}, "requestParameters": {"userName": "eve"},
    }


def deliver(folder, name, *records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"Records": list(records)}))


def sorted_rows(df):
    return sorted(tuple(row) for row in df.collect())


def test_stream_equals_batch_also_after_more_files(spark, tmp_path):
    raw, tables = tmp_path / "raw", Tables.under(str(tmp_path / "stream"))
    options = Options(from_checkpoint=False)

    def ingest():
        stream = stream_records(spark, str(raw), files_per_trigger=1)
        start_ingest(stream, tables, str(tmp_path / "checkpoint"), options, as_of=NOW).awaitTermination()

    deliver(raw, "a.json", record(1), record(2, name="ListUsers"))
    ingest()
    deliver(raw, "b.json", record(2, name="ListUsers"), record(3), record(9, day=12))
    ingest()
    batch = Tables.under(str(tmp_path / "batch"))
    run_batch(spark, read_records(spark, str(raw)), batch, NOW, options)
    assert sorted_rows(read_events(spark, tables.events)) == sorted_rows(read_events(spark, batch.events))
    keys = ["event_id", "alert_type", "message_id"]
    alerts = tables.read_alerts(spark).select(keys)
    assert sorted_rows(alerts) == sorted_rows(batch.read_alerts(spark).select(keys))
    assert alerts.count() == 3
    assert tables.read_control(spark).first()["events_processed_count"] == 5


def collect_stream(spark, stream, mode, folder):
    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/cp")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")


def stored_stream(spark, events, folder):
    events.write.parquet(f"{folder}/in")
    return windows.timed(spark.readStream.schema(EVENTS).parquet(f"{folder}/in"))


def test_daily_and_hourly_windows(spark, events, tmp_path):
    stream = stored_stream(spark, events, tmp_path)
    daily = collect_stream(spark, windows.daily_counts(stream), "complete", tmp_path / "d")
    expected = events.groupBy("event_date").count()
    assert sorted_rows(daily.select(F.date_format("window_start", "yyyy-MM-dd"), "total_events")) == sorted_rows(expected)
    hourly = collect_stream(spark, windows.hourly_counts(stream), "complete", tmp_path / "h")
    assert hourly.agg(F.sum("total_events")).first()[0] == events.count()


def test_repeats_inside_the_watermark_arrive_once(spark, events, tmp_path):
    stream = stored_stream(spark, events.unionByName(events), tmp_path)
    rows = collect_stream(spark, windows.deduplicated(stream, "40 days"), "append", tmp_path / "x")
    assert rows.count() == events.count()


def test_raw_records_to_events(spark, tmp_path):
    deliver(tmp_path / "raw", "a.json", record(1), record(2))
    stream = windows.event_stream(stream_records(spark, str(tmp_path / "raw")))
    rows = collect_stream(spark, windows.deduplicated(stream), "append", tmp_path / "x")
    assert rows.count() == 2
