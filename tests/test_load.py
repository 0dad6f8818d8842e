"""Upserts, checkpoints, whole runs and their repetition."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from accesslens.functions.time import literal
from accesslens.operators import incremental, upsert
from accesslens.operators.incremental import Options, Tables, run_batch
from accesslens.schema import CONTROL
from accesslens.sources.raw import from_text, read_records, stream_records
from accesslens.sources.routes import Routes
from accesslens.sources.store import events_by_action, events_by_user, read_events, scan_date_range

NOW = dt.datetime(2024, 1, 31, 12)


def ids(df):
    return sorted(row["event_id"] for row in df.collect())


def test_last_write_wins(make_events):
    store = make_events({"event_id": "a", "error_code": "old"}, {"event_id": "b"})
    batch = make_events({"event_id": "a", "error_code": "new"}, {"event_id": "c"})
    rows = {row["event_id"]: row["error_code"] for row in upsert.upsert_events(store, batch).collect()}
    assert rows == {"a": "new", "b": None, "c": None}


def test_key_is_date_and_id(make_events):
    store = make_events({"event_id": "a", "event_date": "2024-01-29"})
    batch = make_events({"event_id": "a", "event_date": "2024-01-30"})
    assert upsert.upsert_events(store, batch).count() == 2


def test_load_order_decides_inside_a_batch(make_events):
    batch = make_events({"error_code": "1"}, {"error_code": "2"}).withColumn("load", F.col("error_code").cast("int"))
    assert upsert.latest(batch, "load").first()["error_code"] == "2"
    assert upsert.insert_new_events(batch.where("false"), batch, "load").first()["error_code"] == "1"


def test_first_write_wins(make_events):
    store = make_events({"event_id": "a", "error_code": "old"})
    batch = make_events({"event_id": "a", "error_code": "new"}, {"event_id": "c"})
    assert ids(upsert.insert_new_events(store, batch)) == ["c"]


def test_written_upsert_touches_only_what_changed(spark, make_events, tmp_path):
    path = str(tmp_path / "events")
    day = lambda n, **row: {"event_date": f"2024-01-{n}", "event_time": f"2024-01-{n}T10:00:00+00:00", **row}
    first = make_events(day(29, event_id="a"), day(30, event_id="b"), day(30, event_id="c"))
    assert upsert.write_upsert(spark, first, path) == {"new": 3, "same": 0, "changed": 0}
    files = lambda n: {f.name for f in (tmp_path / "events" / f"event_date=2024-01-{n}").iterdir()}
    before = files(29)
    assert upsert.write_upsert(spark, first, path) == {"new": 0, "same": 3, "changed": 0}
    second = make_events(day(30, event_id="b", error_code="x"), day(30, event_id="d"), day(28, event_id="e"))
    assert upsert.write_upsert(spark, second, path) == {"new": 2, "same": 0, "changed": 1}
    rows = read_events(spark, path)
    assert ids(rows) == ["a", "b", "c", "d", "e"]
    assert rows.where("event_id = 'b'").first()["error_code"] == "x"
    assert files(29) == before


def test_an_interrupted_rewrite_is_completed(spark, make_events, tmp_path, monkeypatch):
    """The run dies after it dropped the old partition; the next one repairs it."""
    path = str(tmp_path / "events")
    upsert.write_upsert(spark, make_events({"event_id": "a"}, {"event_id": "b"}), path)
    changed = make_events({"event_id": "a", "error_code": "x"})

    def die(*args):
        for file in (tmp_path / "events" / "event_date=2024-01-30").iterdir():
            file.unlink()
        raise RuntimeError("killed")

    finish = upsert._finish_rewrite
    calls = []
    monkeypatch.setattr(upsert, "_finish_rewrite", lambda *a, **k: calls.append(1) or (finish(*a, **k) if len(calls) < 2 else die()))
    with pytest.raises(RuntimeError):
        upsert.write_upsert(spark, changed, path)
    assert read_events(spark, path).count() == 0
    monkeypatch.setattr(upsert, "_finish_rewrite", finish)
    assert upsert.write_upsert(spark, changed, path) == {"new": 0, "same": 1, "changed": 0}
    rows = {row["event_id"]: row["error_code"] for row in read_events(spark, path).collect()}
    assert rows == {"a": "x", "b": None}
    assert not (tmp_path / "events.rewrite").exists()


def test_copies_of_one_key_are_limited_before_the_shuffle(events):
    plan = upsert.upsert_events(events, events)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_one_key_holding_most_rows(spark, make_events):
    copies = make_events({"event_id": "hot"}).withColumn("error_code", F.explode(F.sequence(F.lit(1), F.lit(20000)).cast("array<string>")))
    row = upsert.latest(copies.unionByName(make_events({"event_id": "x"})))
    assert ids(row) == ["hot", "x"]


def test_look_ups(events):
    user = events_by_user(events, "user5", "2024-01-10", "2024-01-20", limit=1000)
    assert user.count() == events.where("user_name = 'user5' AND event_date BETWEEN '2024-01-10' AND '2024-01-20'").count()
    one_bound = events_by_user(events, "user5", start_date="2024-01-10", limit=1000)
    assert one_bound.count() == events.where("user_name = 'user5'").count()
    assert events_by_action(events, "CreateUser").count() == min(100, events.where("event_name = 'CreateUser'").count())
    assert scan_date_range(events, "2024-01-01", "2024-01-02", limit=3).count() == 3


def control_rows(spark, *rows):
    return spark.createDataFrame(rows, CONTROL)


def times(spark, *offsets, source="iam.amazonaws.com"):
    rows = [(str(i), source, "us-east-1", None) for i in range(len(offsets))]
    df = spark.createDataFrame(rows, "event_id string, event_source string, aws_region string, drop_reason string")
    moment = F.lit(None).cast("timestamp_ntz")
    for i, value in enumerate(offsets):
        moment = F.when(F.col("event_id") == str(i), literal(value)).otherwise(moment)
    return df.withColumn("event_ts", moment)


def test_read_range(spark):
    start = dt.datetime(2024, 1, 31, 11)
    control = control_rows(spark, ("iam-events", start, start, 5, "active", ""))
    second, settle = dt.timedelta(seconds=1), dt.timedelta(minutes=5)
    records = times(spark, start - second, start, NOW - settle, NOW - settle + second, NOW)
    assert ids(incremental.since_checkpoint(records, control, NOW)) == ["1", "2"]
    flagged = {r["event_id"]: r["drop_reason"] for r in incremental.flag_range(records, control, NOW).collect()}
    assert flagged == {"0": "late", "1": None, "2": None, "3": "settling", "4": "settling"}
    unseen = times(spark, NOW - dt.timedelta(days=90), NOW - dt.timedelta(days=91), source="sso.amazonaws.com")
    assert ids(incremental.since_checkpoint(unseen, control, NOW)) == ["0"]


def test_checkpoint_never_moves_back(spark, make_events):
    later = dt.datetime(2024, 1, 30, 11)
    control = control_rows(
        spark, ("iam-events", later, later, 5, "active", ""), ("sts-us-east-1", later, later, 7, "active", "")
    )
    rows = {r["checkpoint_key"]: r for r in incremental.advance_control(control, make_events({}, {}), NOW).collect()}
    assert (rows["iam-events"]["last_processed_timestamp"], rows["iam-events"]["events_processed_count"]) == (later, 7)
    assert rows["iam-events"]["last_execution_time"] == NOW
    assert rows["sts-us-east-1"]["last_execution_time"] == later
    empty = incremental.advance_control(control, make_events({}).where("false"), NOW)
    assert sorted(empty.collect()) == sorted(control.collect())


def record(i, **parts):
    base = {
        "eventID": str(i), "eventTime": "2024-01-31T10:00:00Z", "eventName": "CreateUser",
        "eventSource": "iam.amazonaws.com", "awsRegion": "us-east-1", "userIdentity": {"userName": "bob"},
        "requestParameters": {"userName": "eve"},
    }
    return json.dumps({**base, **parts})


def text_records(spark, *rows):
    return from_text(spark.createDataFrame([(row,) for row in rows], "raw string"))


def test_run_and_repeat(spark, tmp_path):
    tables = Tables.under(str(tmp_path))
    records = text_records(
        spark, record(1), record(2, userIdentity={"userName": "Scanner"}), "broken", record(3, eventTime="2024-01-31T11:59:00Z"),
        record(4, userIdentity={"sessionContext": {"sessionIssuer": {"arn": "x/aws-service-role/y"}}}),
        record(5, eventSource="ec2.amazonaws.com"),
    )
    options = Options(routes=Routes(), roles="Scanner")
    first = run_batch(spark, records, tables, NOW, options).first()
    assert (first["status"], first["total_events_processed"], first["events_added"]) == (200, 1, 1)
    assert (first["filtered_by_role"], first["filtered_by_service"], first["unparsable"]) == (1, 1, 1)
    assert (first["not_routed"], first["late"], first["settling"]) == (1, 0, 1)
    assert ids(read_events(spark, tables.events)) == ["1"]
    assert tables.read_alerts(spark).count() == 1
    control = {r["checkpoint_key"]: r for r in tables.read_control(spark).collect()}
    assert control["iam-events"]["last_processed_timestamp"] == dt.datetime(2024, 1, 31, 10)
    assert control["sso-us-east-1"]["last_processed_timestamp"] == NOW - dt.timedelta(days=90)

    later = NOW + dt.timedelta(minutes=10)
    second = run_batch(spark, records, tables, later, options).first()
    assert (second["total_events_processed"], second["events_added"]) == (2, 1)
    assert ids(read_events(spark, tables.events)) == ["1", "3"]
    assert tables.read_alerts(spark).count() == 2


def test_files_before_the_last_run_can_be_skipped(spark, tmp_path):
    tables = Tables.under(str(tmp_path))
    assert tables.delivered_since(spark) is None
    run_batch(spark, text_records(spark, record(1)), tables, NOW, Options())
    assert tables.delivered_since(spark) == NOW - dt.timedelta(minutes=5)
    run_batch(spark, text_records(spark, record(1)), tables, NOW + dt.timedelta(hours=2), Options(settle=dt.timedelta(hours=1)))
    assert tables.delivered_since(spark) == NOW + dt.timedelta(hours=1)


def test_run_without_events_changes_nothing(spark, tmp_path):
    tables = Tables.under(str(tmp_path))
    run_batch(spark, text_records(spark, record(1)), tables, NOW, Options())
    before = tables.read_control(spark).collect()
    empty = run_batch(spark, text_records(spark, "broken"), tables, NOW + dt.timedelta(hours=1), Options()).first()
    assert (empty["total_events_processed"], empty["unparsable"]) == (0, 1)
    assert tables.read_control(spark).collect() == before
    assert read_events(spark, tables.events).count() == 1


def test_failing_alerts_do_not_stop_a_run(spark, tmp_path, monkeypatch):
    def fail(*args):
        raise RuntimeError("no alerts today")

    monkeypatch.setattr(incremental, "send_alerts", fail)
    tables = Tables.under(str(tmp_path))
    row = run_batch(spark, text_records(spark, record(1)), tables, NOW, Options()).first()
    assert (row["status"], row["errors"]) == (500, ["alerts: no alerts today"])
    assert tables.read_control(spark).count() == 1


def test_checkpoint_stays_when_the_write_fails(spark, tmp_path, monkeypatch):
    def fail(*args):
        raise RuntimeError("disk full")

    monkeypatch.setattr(incremental, "write_upsert", fail)
    tables = Tables.under(str(tmp_path))
    with pytest.raises(RuntimeError):
        run_batch(spark, text_records(spark, record(1)), tables, NOW, Options())
    assert tables.read_control(spark).count() == 0


def test_an_unreadable_time_loses_no_other_event(spark, tmp_path):
    """It neither moves the checkpoint over settling events nor is stored anew each day."""
    tables = Tables.under(str(tmp_path))
    records = text_records(spark, record("A", eventTime="2024-01-31T11:00:00Z"), record("B", eventTime="2024-01-31T11:58:00Z"), record("G", eventTime="31.01.2024"))
    first = run_batch(spark, records, tables, NOW, Options()).first()
    assert (first["total_events_processed"], first["settling"], first["unparsable"]) == (1, 1, 1)
    for later in (dt.timedelta(hours=1), dt.timedelta(days=1)):
        run_batch(spark, records, tables, NOW + later, Options())
        assert ids(read_events(spark, tables.events)) == ["A", "B"]


def test_files_under_a_longer_settle_time_are_read_again(spark, tmp_path):
    import os

    tables, options = Tables.under(str(tmp_path / "t")), Options(settle=dt.timedelta(hours=1))
    file = tmp_path / "raw" / "one.json"
    file.parent.mkdir()
    file.write_text('{"Records": [' + record("E", eventTime="2024-01-31T11:30:00Z") + "]}")
    stamp = dt.datetime(2024, 1, 31, 11, 35, tzinfo=dt.timezone.utc).timestamp()
    os.utime(file, (stamp, stamp))
    for now in (NOW, NOW + dt.timedelta(hours=2)):
        records = read_records(spark, str(file.parent), modified_after=tables.delivered_since(spark))
        run_batch(spark, records, tables, now, options)
    assert ids(read_events(spark, tables.events)) == ["E"]


def test_a_rewrite_does_not_depend_on_success_markers(spark, make_events, tmp_path):
    path, hadoop = str(tmp_path / "events"), spark._jsc.hadoopConfiguration()
    upsert.write_upsert(spark, make_events({"event_id": "a"}), path)
    hadoop.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        counts = upsert.write_upsert(spark, make_events({"event_id": "a", "error_code": "x"}, {"event_id": "b"}), path)
    finally:
        hadoop.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert counts == {"new": 1, "same": 0, "changed": 1}
    assert {r["event_id"]: r["error_code"] for r in read_events(spark, path).collect()} == {"a": "x", "b": None}


def test_an_unmarked_copy_stops_the_run(spark, make_events, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    upsert.write_upsert(spark, make_events({"event_id": "a"}), path)
    monkeypatch.setattr(upsert, "mark_complete", lambda *args: None)
    with pytest.raises(RuntimeError, match="not complete"):
        upsert.write_upsert(spark, make_events({"event_id": "a", "error_code": "x"}), path)
    assert ids(read_events(spark, path)) == ["a"]


def test_a_stream_repeats_a_batch_whose_alerts_failed(spark, tmp_path, monkeypatch):
    from accesslens.streaming.ingest import start_ingest

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.json").write_text('{"Records": [' + record(1) + "]}")
    tables, send = Tables.under(str(tmp_path / "t")), incremental.send_alerts
    run = lambda: start_ingest(stream_records(spark, str(tmp_path / "raw")), tables, str(tmp_path / "c"), as_of=NOW).awaitTermination()

    def fail(*args):
        raise RuntimeError("no alerts today")

    monkeypatch.setattr(incremental, "send_alerts", fail)
    with pytest.raises(Exception, match="no alerts today"):
        run()
    monkeypatch.setattr(incremental, "send_alerts", send)
    run()
    assert tables.read_alerts(spark).count() == 1 and ids(read_events(spark, tables.events)) == ["1"]


def test_a_small_batch_is_compared_without_shuffling_payloads(spark, make_events, tmp_path):
    """Of the store, the join sees keys and a payload print only."""
    path = str(tmp_path / "events")
    upsert.write_upsert(spark, make_events(*({"event_id": str(i)} for i in range(50))), path)
    batch = make_events({"event_id": "3"})
    held = read_events(spark, path).join(batch.select("event_date", "event_id"), ["event_date", "event_id"], "left_semi")
    plan = held.select("event_date", "event_id", upsert._print("_old"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "LeftSemi" in plan


def test_alerts_of_a_failed_step_are_raised_by_the_next_run(spark, tmp_path, monkeypatch):
    def fail(*args):
        raise RuntimeError("no alerts today")

    tables, send = Tables.under(str(tmp_path)), incremental.send_alerts
    monkeypatch.setattr(incremental, "send_alerts", fail)
    run_batch(spark, text_records(spark, record(1)), tables, NOW, Options())
    monkeypatch.setattr(incremental, "send_alerts", send)
    later = text_records(spark, record(2, eventTime="2024-01-31T11:30:00Z"))
    assert run_batch(spark, later, tables, NOW + dt.timedelta(hours=1), Options()).first()["status"] == 200
    assert ids(tables.read_alerts(spark)) == ["1", "2"] and not (tmp_path / "alerts-pending").exists()


def test_expired_alert_days_are_removed(spark, tmp_path):
    from accesslens.operators.alerts import expire_alerts

    tables = Tables.under(str(tmp_path))
    assert expire_alerts(spark, tables.alerts, NOW) == []
    run_batch(spark, text_records(spark, record(1)), tables, NOW, Options())
    run_batch(spark, text_records(spark, record(2)), tables, NOW + dt.timedelta(days=20), Options())
    assert expire_alerts(spark, tables.alerts, NOW + dt.timedelta(days=40)) == ["2024-01-31"]
    assert ids(tables.read_alerts(spark)) == ["2"]


def test_a_broken_source_leaves_the_others_loaded(spark, tmp_path):
    tables = Tables.under(str(tmp_path))
    good = text_records(spark, record(1), record(2))
    broken = text_records(spark, record(3, eventSource="sts.amazonaws.com")).select(F.when(F.rand() < 2, F.raise_error("unreadable")).otherwise(F.col("rec")).alias("rec"))
    row = incremental.run_sources(spark, {"iam": good, "sts": broken}, tables, NOW).first()
    assert (row["status"], row["events_added"]) == (500, 2) and "sts" in row["errors"][0]
    assert ids(read_events(spark, tables.events)) == ["1", "2"]
    assert [r["checkpoint_key"] for r in tables.read_control(spark).collect()] == ["iam-events"]
    both = incremental.run_sources(spark, {"iam": good, "more": text_records(spark, record(4))}, tables, NOW).first()
    assert (both["status"], both["events_added"]) == (200, 1)
