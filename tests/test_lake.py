import datetime as dt
import glob
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from accesslens import run
from accesslens.operators import lake
from accesslens.sources.lake import lake_dates, lake_files, read_lake, refresh_partitions, register_lake

AS_OF = dt.date(2024, 1, 31)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lake_path(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake"))
    lake.export(spark, events, path)
    return path


@pytest.mark.parametrize(
    "params, response, expected",
    [
        ('{"roleArn":"r","userName":null}', '{"assumedRoleUser":{"a":1},"credentials":{"expiration":"t"}}', ("r", None, '{"a":1}', "t")),
        ("null", "null", ("", "", "{}", "")),
        ("{}", "{}", ("", "", "{}", "")),
        ("broken", "broken", ("", "", "{}", "")),
        ('{"roleArn":"r"}', '{"assumedRoleUser":{"a":1},"credentials":null}', ("r", "", "{}", "")),
        ("[1]", '{"credentials":{}}', ("", "", "{}", "")),
    ],
)
def test_lifted_fields(make_events, params, response, expected):
    row = lake.lake_rows(make_events({"request_parameters": params, "response_elements": response})).first()
    assert (row["role_arn"], row["user_name_param"], row["assumed_role_user"], row["credentials_expiration"]) == expected


@pytest.mark.parametrize("error, flag", [(None, False), ("", False), ("x", True)])
def test_error_flag_and_partitions(make_events, error, flag):
    row = lake.lake_rows(make_events({"event_date": "2024-03-05", "aws_region": None, "error_code": error})).first()
    assert row["is_error"] is flag
    assert row["error_code"] == error
    assert (row["year"], row["month"], row["day"], row["region"]) == (2024, 3, 5, "unknown")


def test_partition_folders_are_not_padded(lake_path):
    folders = {re.search(r"year=.*/region=[^/]+", path)[0] for path in glob.glob(f"{lake_path}/*/*/*/*/*.parquet")}
    assert "year=2024/month=1/day=3/region=us-east-1" in folders


def test_export_round_trip_and_repeat(spark, events, lake_path):
    assert read_lake(spark, lake_path).count() == events.count()
    before = sorted(glob.glob(f"{lake_path}/**/*.parquet", recursive=True))
    for mode in ("dates", "events"):
        assert lake.export(spark, events, lake_path, mode).first()["total_events_exported"] == 0
    assert sorted(glob.glob(f"{lake_path}/**/*.parquet", recursive=True)) == before


def test_late_events_reach_the_lake_in_events_mode(spark, events, tmp_path):
    path = str(tmp_path)
    lake.export(spark, events.where("event_time < '2024-01-05T12'"), path)
    late = events.where("event_date <= '2024-01-05'")
    assert lake.export(spark, late, path).first()["total_events_exported"] == 0
    lake.export(spark, late, path, mode="events")
    assert read_lake(spark, path).count() == late.count()


def test_export_without_region(spark, events, tmp_path):
    lake.write_lake(lake.lake_rows(events), str(tmp_path), by_region=False)
    assert not glob.glob(f"{tmp_path}/**/region=*", recursive=True)
    assert spark.read.parquet(str(tmp_path)).count() == events.count()


def test_unknown_export_mode(spark, events, tmp_path):
    with pytest.raises(ValueError, match="dates, events"):
        lake.export(spark, events, str(tmp_path), mode="all")


def test_listing_does_not_open_files(spark, lake_path):
    files = lake_files(spark, lake_path)
    assert files.where("length > 0 AND year = 2024 AND region IS NOT NULL").count() == files.count() > 0
    assert "content" not in plan(files)
    assert lake_dates(spark, lake_path).count() == 30
    assert lake_dates(spark, lake_path + "/nowhere").count() == 0


def test_missing_dates_are_sorted(spark, events):
    exported = events.where("event_date > '2024-01-04'").select("event_date").distinct()
    found = [row["event_date"] for row in lake.missing_dates(events, exported).collect()]
    assert found == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    recent = lake.recent_dates(spark, AS_OF, 2).collect()
    assert [row["event_date"] for row in recent] == ["2024-01-30", "2024-01-29"]


def test_windowed_query_prunes_partitions(spark, lake_path):
    df = run("user_lookup", read_lake(spark, lake_path), dt.date(2024, 2, 28))
    text = plan(df)
    assert re.search(r"PartitionFilters: \[.*year#\d+ > 2024", text)
    assert "GreaterThanOrEqual(event_time,2024-01-29)" in text
    scan = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert "request_parameters" not in scan and "user_identity" in scan
    scan = df._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    assert scan.selectedPartitions().partitionCount() == 2 * 3  # two days, three regions


def test_default_date_prunes_partitions_too(spark, lake_path):
    df = run("daily_summary", read_lake(spark, lake_path))
    scan = df._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    assert scan.selectedPartitions().partitionCount() == 0  # the data is years old
    assert df.count() == 0


@pytest.mark.parametrize("name", ["user_lookup", "active_users", "off_hours", "role_assumptions", "sso_admin_policies"])
@pytest.mark.parametrize("variant", ["full", "sql"])
def test_lake_and_store_give_the_same_answers(spark, events, lake_path, name, variant):
    stored = run(name, events, AS_OF, variant)
    assert run(name, read_lake(spark, lake_path), AS_OF, variant).collect() == stored.collect()


def test_files_carry_statistics_and_bloom_filters(lake_path):
    path = glob.glob(f"{lake_path}/**/*.parquet", recursive=True)[0]
    group = pq.ParquetFile(path).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert columns["event_name"].compression == "SNAPPY"
    assert columns["event_time"].statistics.has_min_max


def test_catalog_table(spark, events, lake_path):
    register_lake(spark, "lake_table", lake_path)
    try:
        refresh_partitions(spark, "lake_table")
        assert spark.table("lake_table").count() == events.count()
        assert spark.table("lake_table").where("day = 3").count() == events.where("event_date = '2024-01-03'").count()
    finally:
        spark.sql("DROP TABLE lake_table")


def test_a_region_day_holding_most_rows_is_written_by_several_tasks(spark, make_events, tmp_path):
    """Adaptive execution splits the hot partition of the rebalanced write."""
    copies = F.explode(F.sequence(F.lit(1), F.lit(60000)).cast("array<string>"))
    hot = make_events({}).withColumn("event_id", copies)
    hot = hot.repartition(8).withColumn("user_agent", F.concat(F.sha2("event_id", 512), F.sha2(F.reverse("event_id"), 512)))
    rest = make_events({"event_date": "2024-01-02", "event_id": "x"})
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        lake.write_lake(lake.lake_rows(hot.unionByName(rest)), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(glob.glob(f"{tmp_path}/year=2024/month=1/day=30/region=us-east-1/*.parquet")) > 2
    assert spark.read.parquet(str(tmp_path)).count() == 60001


def test_recent_dates_are_exported_again(spark, events, tmp_path):
    path = str(tmp_path)
    lake.export(spark, events, path)
    again = lake.export(spark, events, path, dates=lake.recent_dates(spark, AS_OF, 2)).first()
    assert again["total_events_exported"] == events.where("event_date >= '2024-01-29'").count()
    assert read_lake(spark, path).count() == events.count()


def test_missing_events_never_broadcasts_the_lake(spark, make_events, tmp_path):
    """Key texts worked out from a narrow file look small to Spark, whatever their number."""
    spark.range(20_000).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids")).withColumn("event_id", F.col("id").cast("string")).drop("id")
    events = make_events({}).drop("event_id").crossJoin(ids)
    missing = lake.missing_events(events, lake.lake_rows(events.where("event_id >= 3")))
    assert "LeftAnti" in plan(missing) and "BroadcastHashJoin" not in plan(missing)
    assert sorted(row.event_id for row in missing.collect()) == ["0", "1", "2"]


def test_events_are_dealt_out_before_they_are_parsed(spark, make_events):
    rows = lake.dealt_rows(make_events({}, {"event_id": "e2", "aws_region": None}))
    nodes = [line for line in plan(rows).splitlines() if "Generate" in line or "Exchange" in line]
    assert "Generate" in nodes[0] and "Exchange" in nodes[-1]
    assert sorted(row.region for row in rows.collect()) == ["unknown", "us-east-1"]
