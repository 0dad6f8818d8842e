"""The bucketed store, rewrites and compaction."""

import uuid

import pytest
from pyspark.sql import functions as F

from accesslens.operators import upsert
from accesslens.session import settings
from accesslens.sources.store import BucketedStore, EventStore, read_events


@pytest.fixture
def store(tmp_path):
    return BucketedStore(str(tmp_path / "events"), f"events_{uuid.uuid4().hex}", buckets=8)


def rows_of(df):
    return sorted((r.event_date, r.event_id, r.error_code) for r in df.collect())


def batch(make_events, n, **row):
    return make_events(*({"event_id": str(i), "event_date": f"2024-01-{20 + i % 3}", **row} for i in range(n)))


def above_store(df, table):
    """The plan nodes between the scans of a table and the top."""
    chain, found = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        chain = [x for x in chain if x[0] < depth] + [(depth, line)]
        if "FileScan" in line and table in line:
            found.append([x[1] for x in chain])
    return found


def test_bucketed_store_equals_the_plain_one(spark, make_events, store, tmp_path):
    for one in (store, str(tmp_path / "plain")):
        upsert.write_upsert(spark, batch(make_events, 30), one)
        counts = upsert.write_upsert(spark, batch(make_events, 40, error_code="x").where("event_id > '2'"), one)
        assert counts["changed"] + counts["new"] == batch(make_events, 40).where("event_id > '2'").count()
    assert rows_of(store.read(spark)) == rows_of(read_events(spark, str(tmp_path / "plain")))


def test_comparison_and_merge_leave_the_store_where_it_is(spark, make_events, store):
    upsert.write_upsert(spark, batch(make_events, 60), store)
    new = batch(make_events, 20).withColumn("_new", upsert._print("_new"))
    with store.aligned(spark), settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        for made in (upsert._compared(store.read(spark), new), upsert._merged(store.read(spark), store.dealt(new))):
            scans = above_store(made, store.table)
            assert scans and "Bucketed: true" in scans[0][-1]
        merged = above_store(upsert._merged(store.read(spark), store.dealt(new)), store.table)
        assert not any("Exchange" in line for scan in merged for line in scan)
        held = store.read(spark).join(new.select("event_date", "event_id"), ["event_date", "event_id"], "left_semi")
        assert not any("Exchange" in line for scan in above_store(held, store.table) for line in scan)


def test_a_task_writes_one_file_a_date_and_bucket(spark, make_events, store):
    upsert.write_upsert(spark, batch(make_events, 60), store)
    assert store.files(spark).groupBy("event_date").count().agg(F.max("count")).first()[0] <= 8


def test_a_store_unknown_to_the_catalog_is_found(spark, make_events, store):
    upsert.write_upsert(spark, batch(make_events, 30), store)
    spark.sql(f"DROP TABLE {store.table}")
    assert store.read(spark).count() == 30
    with pytest.raises(ValueError, match="buckets"):
        BucketedStore(store.path, store.table, buckets=4).read(spark)


def test_a_killed_bucketed_rewrite_is_completed(spark, make_events, store, monkeypatch):
    upsert.write_upsert(spark, batch(make_events, 30), store)
    changed, move, moved = batch(make_events, 30, error_code="x"), upsert.replace_folder, []

    def die(*args):
        if moved:
            raise RuntimeError("killed")
        moved.append(move(*args))

    with monkeypatch.context() as patch:
        patch.setattr(upsert, "replace_folder", die)
        with pytest.raises(RuntimeError):
            upsert.write_upsert(spark, changed, store)
    assert upsert.write_upsert(spark, changed, store) == {"new": 0, "same": 30, "changed": 0}
    assert {r.error_code for r in store.read(spark).collect()} == {"x"}


@pytest.mark.parametrize("bucketed", [False, True])
def test_compaction_after_many_loads(spark, make_events, store, tmp_path, bucketed):
    place = store if bucketed else EventStore(str(tmp_path / "plain"))
    all_ = batch(make_events, 60)
    for part in range(6):
        upsert.write_upsert(spark, all_.where(F.col("event_id").cast("int") % 6 == part).where("event_date <> '2024-01-22' OR event_id % 6 = 2"), place)
    before, files = rows_of(place.read(spark)), place.files(spark).count()
    assert upsert.compact(spark, place, spare=1) > 0
    assert rows_of(place.read(spark)) == before and place.files(spark).count() < files
    assert upsert.compact(spark, place, spare=1) == 0


def test_a_changed_event_is_written_once(spark, make_events, tmp_path, monkeypatch):
    path, writes = str(tmp_path / "events"), []
    upsert.write_upsert(spark, batch(make_events, 30), path)
    write = EventStore.write
    monkeypatch.setattr(EventStore, "write", lambda self, rows, folder=None: (writes.append(rows.count()), write(self, rows, folder)))
    upsert.write_upsert(spark, batch(make_events, 1, error_code="x"), path)
    assert writes == [10]


def test_only_dates_that_the_store_has_are_compared(spark, make_events, tmp_path, monkeypatch):
    path, seen, compared = str(tmp_path / "events"), [], upsert._compared
    monkeypatch.setattr(upsert, "_compared", lambda store, new: (seen.extend(r.event_date for r in new.collect()), compared(store, new))[1])
    first = batch(make_events, 6).where("event_date <> '2024-01-22'")
    assert upsert.write_upsert(spark, first, path) == {"new": 4, "same": 0, "changed": 0} and seen == []
    second = batch(make_events, 7).unionByName(make_events({"event_id": "0", "event_date": "2024-01-20", "event_time": "2024-01-31", "error_code": "x"}))
    assert upsert.write_upsert(spark, second, path) == {"new": 3, "same": 3, "changed": 1}
    assert sorted(seen) == ["2024-01-20"] * 3 + ["2024-01-21"] * 2
    assert len(rows_of(read_events(spark, path))) == 7 and ("2024-01-20", "0", "x") in rows_of(read_events(spark, path))
