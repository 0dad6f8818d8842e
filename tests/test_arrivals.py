"""Streams of several sources, late events, and alerts kept in state."""

import pytest
from pyspark.sql import functions as F

from accesslens.schema import EVENTS
from accesslens.session import settings
from accesslens.streaming import alerts, arrivals


def at(i, time, **row):
    return {"event_id": str(i), "event_date": time[:10], "event_time": f"{time}+00:00", **row}


def delivered(spark, make_events, folder, *files):
    for rows in files:
        make_events(*rows).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def ended(stream, folder):
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
    query = query.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_a_slow_source_is_waited_for(spark, make_events, tmp_path):
    """The fast source alone would have closed the hours of the slow one."""
    hours = [[at(f"f{n}", f"2024-01-10T{n:02}:30:00")] for n in range(6)]
    slow = [[at(f"s{n}", f"2024-01-10T0{max(0, n - 2)}:40:00")] for n in range(6)]
    late = [at("late", "2024-01-10T00:01:00")]
    sources = {
        "fast": delivered(spark, make_events, tmp_path / "fast", *hours[:5], [*hours[5], *late, at("f0", "2024-01-10T05:31:00")]),
        "slow": delivered(spark, make_events, tmp_path / "slow", *slow),
    }
    kept = arrivals.merged_sources(sources)
    query = ended(kept.select("event_id", "source_name"), tmp_path)
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert {r.event_id for r in rows.where("source_name = 'slow'").collect()} == {f"s{n}" for n in range(6)}
    assert "late" not in {r.event_id for r in rows.collect()}
    report = arrivals.arrivals(spark, query)
    assert report.where("arrived <> kept + repeated + late").count() == 0
    total = report.agg(*[F.sum(c).alias(c) for c in ("arrived", "kept", "repeated", "late")]).first()
    assert (total.arrived, total.late, total.kept) == (14, 1, rows.count())


def test_lateness_by_source(spark, make_events, tmp_path):
    files = [[at(1, "2024-01-10T10:00:00")], [at(2, "2024-01-10T12:00:00")], [at(3, "2024-01-10T13:00:00")], [at(4, "2024-01-10T11:30:00")]]
    sources = {"one": delivered(spark, make_events, tmp_path / "one", *files)}
    kept = {}
    for name, lateness in (("short", {"one": "5 minutes"}), ("long", {"one": "3 hours"})):
        ended(arrivals.merged_sources(sources, lateness).select("event_id"), tmp_path / name)
        kept[name] = spark.read.parquet(f"{tmp_path / name}/out").count()
    assert kept == {"short": 3, "long": 4}


def test_another_policy_is_refused(spark, make_events, tmp_path):
    sources = {"one": delivered(spark, make_events, tmp_path / "one", [at(1, "2024-01-10T10:00:00")])}
    with settings(spark, {arrivals.POLICY: "max"}), pytest.raises(ValueError, match="min"):
        arrivals.merged_sources(sources)


def test_alerts_survive_restarts_and_state_shrinks(spark, make_events, tmp_path):
    create = {"event_name": "CreateUser", "request_parameters": '{"userName":"eve"}'}
    files = [[at(i, "2024-01-10T10:00:00", **create) for i in range(5)], [at(i, "2024-01-12T10:00:00", **create) for i in range(4, 7)]]
    held = []
    for rows in [*files, [at(50, "2024-06-01T10:00:00", **create)], [at(51, "2024-06-01T11:00:00", **create)]]:
        stream = delivered(spark, make_events, tmp_path / "in", rows)
        query = alerts.start_alerts(alerts.alert_stream(stream, "1111"), f"{tmp_path}/out", f"{tmp_path}/c")
        query.awaitTermination()
        held.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)
    sent = spark.read.parquet(f"{tmp_path}/out")
    assert sent.count() == sent.select("event_id", "alert_type").distinct().count() == 9
    assert held == [5, 7, 1, 2]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_deliveries_are_written_in_one_pass_and_come_in_order(spark, sf_dir, tmp_path):
    from verification.operations import _deliveries, events_from

    _deliveries(spark, sf_dir, str(tmp_path / "in"))
    times = {}
    for name in ("fast", "slow"):
        files = {n: list((tmp_path / "in" / f"source={name}" / f"file={n}").glob("*.parquet")) for n in range(13)}
        assert all(len(found) == 1 for found in files.values())
        times[name] = [files[n][0].stat().st_mtime for n in range(13)]
        assert times[name] == sorted(set(times[name]))
    assert times["fast"] == times["slow"]
    due = events_from(spark, sf_dir).where("NOT (event_type = 'sso' AND CAST(event_id AS long) % 40 = 7 AND event_date > '2024-01-30')")
    assert abs(spark.read.parquet(str(tmp_path / "in")).count() - due.count()) <= due.count() // 20
