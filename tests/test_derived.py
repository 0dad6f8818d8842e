"""Aggregates kept by loads and exports, and what is answered from them."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from accesslens.operators import derived, lake, upsert
from accesslens.operators.derived import ACTIVITY, BUSIEST, COUNTS, Aggregate
from accesslens.operators.incremental import Tables
from accesslens.plans import sketched
from accesslens.sources.lake import read_lake
from accesslens.session import settings
from accesslens.sources.store import EventStore, events_by_user, read_events
from accesslens.streaming import windows

AS_OF = dt.date(2024, 1, 31)


class Killed(RuntimeError):
    pass


def day(n, i, **row):
    return {"event_id": f"{n}-{i}", "event_date": f"2024-01-{n:02}", "event_time": f"2024-01-{n:02}T10:00:00+00:00", **row}


def counted(rows):
    return sorted(map(tuple, rows.select("event_date", "region", "events").collect()))


def expected(events):
    return counted(COUNTS.measure(events))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(tmp_path):
    return Tables.under(str(tmp_path / "t"))


@pytest.fixture
def batches(make_events):
    """A first load, and one with new, repeated and changed events."""
    first = make_events(*(day(n, i, aws_region=["us-east-1", None][i % 2]) for n in (20, 21) for i in range(6)))
    second = make_events(day(21, 0, aws_region="eu-west-1", user_name="eve"), day(21, 1, aws_region=None), day(21, 9), day(22, 0))
    return first, second


def test_counts_follow_loads_changes_and_repeats(spark, tables, batches):
    for batch in (*batches, batches[1]):
        upsert.write_upsert(spark, batch, tables.events, tables.kept)
        assert counted(tables.counts.read(spark)) == expected(read_events(spark, tables.events))
    users = tables.activity.read(spark).where("event_date = '2024-01-21' AND region = 'eu-west-1'")
    assert users.select(F.hll_sketch_estimate("users")).first()[0] == 1


@pytest.mark.parametrize("where", ["prepare", "write", "replace", "settle", "settled"])
def test_a_killed_load_cannot_make_counts_drift(spark, tables, batches, monkeypatch, where):
    first, second = batches
    upsert.write_upsert(spark, first, tables.events, tables.kept)

    def after(function):
        def run(*args, **named):
            function(*args, **named)
            raise Killed

        return run

    def before(*args, **named):
        raise Killed

    with monkeypatch.context() as patch:
        if where == "prepare":
            patch.setattr(derived, "mark_complete", before)
        elif where == "write":
            patch.setattr(EventStore, "write", after(EventStore.write))
        elif where == "replace":
            patch.setattr(upsert, "replace_folder", after(upsert.replace_folder))
        elif where == "settle":
            patch.setattr(Aggregate, "settle", before)
        else:
            patch.setattr(Aggregate, "_write", after(Aggregate._write))
        with pytest.raises(Killed):
            upsert.write_upsert(spark, second, tables.events, tables.kept)
    upsert.write_upsert(spark, second, tables.events, tables.kept)
    stored = read_events(spark, tables.events)
    assert stored.count() == 14 and stored.where("user_name = 'eve'").count() == 1
    assert counted(tables.counts.read(spark)) == expected(stored)
    assert tables.activity.read(spark).agg(F.sum("events")).first()[0] == 14


def test_inserts_keep_aggregates_too(spark, tables, batches):
    for batch in batches:
        upsert.write_new_events(spark, batch, tables.events, kept=tables.kept)
    stored = read_events(spark, tables.events)
    assert stored.where("user_name = 'eve'").count() == 0
    assert counted(tables.counts.read(spark)) == expected(stored)


def test_compaction_keeps_sums_also_when_killed(spark, tables, make_events, monkeypatch, tmp_path):
    for i in range(4):
        upsert.write_upsert(spark, make_events(day(20, i), day(21, i)), tables.events, tables.kept)
    files = lambda: len(list((tmp_path / "t" / "events-counts").glob("event_date=*/*.parquet")))
    before, dates = files(), spark.createDataFrame([("2024-01-20",)], "event_date string")
    write = Aggregate._write
    with monkeypatch.context() as patch:
        patch.setattr(Aggregate, "_write", lambda *args: (write(*args), (_ for _ in ()).throw(Killed))[1])
        with pytest.raises(Killed):
            tables.counts.compact(spark, dates)
    upsert.write_upsert(spark, make_events(day(20, 0)), tables.events, tables.kept)
    tables.counts.compact(spark, dates)
    assert files() == before - 3 and counted(tables.counts.read(spark)) == expected(read_events(spark, tables.events))


def test_an_aggregate_of_an_older_store(spark, tables, batches):
    upsert.write_upsert(spark, batches[0], tables.events)
    assert not tables.counts.exists(spark)
    tables.counts.rebuild(spark, read_events(spark, tables.events))
    assert counted(tables.counts.read(spark)) == expected(batches[0])


# Sketches


def test_windows_are_answered_without_events(spark, events, tables):
    upsert.write_upsert(spark, events, tables.events, tables.kept)
    answer = sketched.distinct_counts(tables.activity.read(spark), AS_OF)
    text = plan(answer)
    assert text.count("FileScan") == 1 and "request_parameters" not in text and "PartitionFilters: [isnotnull(event_date" in text
    assert answer.inputFiles() and all("/events-activity/" in file for file in answer.inputFiles())
    exact = events.where("event_date >= '2024-01-24'").agg(F.count("*"), F.countDistinct("user_name")).first()
    week = answer.where("days = 7").first()
    assert (week.total_events, week.unique_users) == tuple(exact)


def test_estimates_stay_within_the_stated_error(spark, make_events):
    """30,000 users over 30 days and two regions, some of them on every day."""
    one = make_events(day(1, 0))
    number = F.col("n").cast("string")
    rows = one.drop("event_id", "user_name", "event_date", "aws_region").crossJoin(spark.range(60_000).withColumnRenamed("id", "n")).select(
        "*", number.alias("event_id"), F.concat(F.lit("u"), (F.col("n") % 30_000).cast("string")).alias("user_name"),
        F.format_string("2024-01-%02d", (F.col("n") % 30 + 1).cast("int")).alias("event_date"), (F.col("n") % 2).cast("string").alias("aws_region"),
    )
    found = sketched.distinct_counts(ACTIVITY.measure(rows), AS_OF, (90,)).first()
    assert found.total_events == 60_000 and found.unique_users == pytest.approx(30_000, rel=0.05)
    ranked = sketched.active_users(BUSIEST.add(BUSIEST.measure(rows)), AS_OF, 90, 5).collect()
    assert all(2 <= row.total_actions <= 2 + 60_000 * 8 / 3 / 2**14 for row in ranked)


def test_busiest_users_of_few(spark, events, tables):
    upsert.write_upsert(spark, events, tables.events, [tables.busiest])
    from accesslens import run

    want = run("active_users", events, AS_OF, "table").select("user_identity", "total_actions").collect()
    assert sketched.active_users(tables.busiest.read(spark), AS_OF).collect() == want


def test_busiest_users_of_very_many(spark, make_events, tables):
    """20,000 users act twice, one of them three times: all are ranked, exactly."""
    one = make_events(day(20, 0)).drop("event_id", "user_name")
    number = F.col("id").cast("string")
    rows = one.crossJoin(spark.range(40_001)).select("*", number.alias("event_id"), F.format_string("u%05d", F.col("id") % 20_000).alias("user_name")).drop("id")
    upsert.write_upsert(spark, rows.where("event_id < 30000"), tables.events, [tables.busiest])
    upsert.write_upsert(spark, rows.where("event_id >= 30000"), tables.events, [tables.busiest])
    found = [tuple(row) for row in sketched.active_users(tables.busiest.read(spark), AS_OF, 30, 3).collect()]
    assert found == [("u00000", 3), ("u00001", 2), ("u00002", 2)]


def test_sketches_of_a_stream_and_of_loads_add_up(spark, events, tmp_path):
    early, late = (events.where(f"event_date {sign} '2024-01-16'") for sign in ("<", ">="))
    late.write.parquet(str(tmp_path / "in"))
    stream = windows.activity_sketches(windows.timed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))))
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(str(tmp_path / "out"))
    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    both = spark.read.parquet(str(tmp_path / "out")).unionByName(ACTIVITY.measure(early))
    found = sketched.distinct_counts(both, AS_OF, (90,)).first()
    assert found.unique_users == events.select("user_name").distinct().count() and found.total_events == events.count()


# The lake's counts


def test_catch_up_opens_only_dates_whose_sums_differ(spark, tables, make_events, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    upsert.write_upsert(spark, make_events(*(day(n, 0) for n in (18, 19, 20))), tables.events, tables.kept)
    lake.catch_up(spark, read_events(spark, tables.events), tables.counts, path)
    upsert.write_upsert(spark, make_events(day(19, 1), day(21, 0)), tables.events, tables.kept)
    opened = {}
    missing_of = lake.missing_of

    def noted(events, held, whole, partly):
        opened.update(whole=whole, partly=partly, plan=plan(missing_of(events, held, whole, partly)))
        return missing_of(events, held, whole, partly)

    monkeypatch.setattr(lake, "missing_of", noted)
    done = lake.catch_up(spark, read_events(spark, tables.events), tables.counts, path).first()
    assert (opened["whole"], opened["partly"], done.total_events_exported) == (["2024-01-21"], ["2024-01-19"], 2)
    scans = [line for line in opened["plan"].splitlines() if "PartitionFilters" in line]
    assert len(scans) == 3 and all("2024-01-18" not in s and ("2024-01-19" in s or "2024-01-21" in s) for s in scans)
    assert lake.catch_up(spark, read_events(spark, tables.events), tables.counts, path).first().total_events_exported == 0
    assert read_lake(spark, path).count() == 5


@pytest.mark.parametrize("where", ["before", "half", "after"])
def test_a_killed_catch_up_is_completed(spark, tables, make_events, tmp_path, monkeypatch, where):
    path, write = str(tmp_path / "lake"), lake.write_lake
    upsert.write_upsert(spark, make_events(*(day(n, i) for n in (18, 19) for i in range(3))), tables.events, tables.kept)
    events = read_events(spark, tables.events)

    def die(rows, *args, **named):
        if where != "before":
            write(rows.where("event_id <> '19-1'") if where == "half" else rows, *args, **named)
        raise Killed

    with monkeypatch.context() as patch:
        patch.setattr(lake, "write_lake", die)
        with pytest.raises(Killed):
            lake.catch_up(spark, events, tables.counts, path)
    lake.catch_up(spark, events, tables.counts, path)
    assert sorted(r.event_id for r in read_lake(spark, path).collect()) == sorted(r.event_id for r in events.collect())
    assert counted(lake.lake_counts(path).read(spark)) == expected(events)


def test_every_export_keeps_the_lake_counts(spark, make_events, tmp_path):
    path, counts = str(tmp_path / "lake"), lake.lake_counts(str(tmp_path / "lake"))
    early, all_ = make_events(day(18, 0)), make_events(day(18, 0), day(18, 1), day(19, 0, aws_region=None))
    for events, mode in ((early, "dates"), (all_, "dates"), (all_, "events"), (all_, "events")):
        lake.export(spark, events, path, mode)
        held = read_lake(spark, path)
        assert counted(counts.read(spark)) == sorted(map(tuple, held.groupBy("event_date", "region").count().collect()))
    assert held.count() == 3


def test_store_dates_come_from_the_listing(spark, tables, make_events, tmp_path):
    upsert.write_upsert(spark, make_events(day(18, 0), day(19, 0)), tables.events)
    store = EventStore(tables.events)
    assert sorted(r.event_date for r in store.dates(spark).collect()) == ["2024-01-18", "2024-01-19"]
    assert "content" not in plan(store.dates(spark))
    assert lake.export(spark, store, str(tmp_path / "lake")).first().total_events_exported == 2
    assert EventStore(str(tmp_path / "none")).dates(spark).count() == 0


# A second copy of the events


@pytest.fixture
def by_user(tmp_path):
    return derived.Copy.by("user_name", str(tmp_path / "by-user"), f"by_user_{uuid.uuid4().hex}", 8)


def test_a_look_up_opens_one_bucket(spark, events, tables, by_user):
    upsert.write_upsert(spark, events, tables.events, [by_user])
    found = events_by_user(by_user.read(spark), "user5", limit=None)
    with by_user.layout.aligned(spark):  # else the plan prunes the files and does not say so
        assert "SelectedBucketsCount: 1 out of 8" in plan(events_by_user(by_user.read(spark), "user5", limit=None))
    assert found.count() == events.where("user_name = 'user5'").count() > 0


@pytest.mark.parametrize("where", ["write", "settle", "copied"])
def test_the_copy_stays_equal_after_a_killed_load(spark, tables, batches, by_user, monkeypatch, where):
    upsert.write_upsert(spark, batches[0], tables.events, [by_user])

    def die(*args, **named):
        raise Killed

    with monkeypatch.context() as patch:
        if where == "write":
            patch.setattr(EventStore, "write", die)
        elif where == "settle":
            patch.setattr(derived.Copy, "settle", die)
        else:
            write = derived.Copy._write
            patch.setattr(derived.Copy, "_write", lambda *args: (write(*args), die()))
        with pytest.raises(Killed):
            upsert.write_upsert(spark, batches[1], tables.events, [by_user])
    upsert.write_upsert(spark, batches[1], tables.events, [by_user])
    rows = lambda df: sorted(map(tuple, df.select("event_date", "event_id", "user_name", "aws_region").collect()), key=str)
    assert rows(by_user.read(spark)) == rows(read_events(spark, tables.events))


def test_a_hot_user_is_spread_over_files(spark, make_events, by_user):
    rows = make_events(day(20, 0)).drop("event_id", "request_parameters").crossJoin(spark.range(40_000)).withColumn("event_id", F.col("id").cast("string"))
    rows = rows.withColumn("request_parameters", F.sha2("event_id", 512)).drop("id")
    with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}):
        by_user.settle(spark, by_user.prepare(rows, rows.limit(0)), rows)
    assert by_user.layout.files(spark).count() > 1 and by_user.read(spark).count() == 40_000
