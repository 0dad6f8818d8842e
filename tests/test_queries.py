"""Registry behaviour, plan shapes and properties of the query library."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from accesslens import catalogue, run
from accesslens.operators import reports, results
from accesslens.plans.registry import QUERIES

AS_OF = dt.date(2024, 1, 31)
ALL = [(name, variant) for name, query in QUERIES.items() for variant in query.variants]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fifteen_named_queries_and_more(spark):
    names = {row["name"] for row in catalogue(spark).collect()}
    assert len(names) == 19
    assert {"user_lookup", "sso_activity_summary", "table_statistics"} <= names


def test_unknown_names(events):
    with pytest.raises(ValueError, match="Available queries: .*user_lookup"):
        run("nothing", events)
    with pytest.raises(ValueError, match="Available: "):
        run("failed_auth", events, variant="json")


def test_default_variant(events):
    columns = lambda **kw: run("sso_account_assignments", events, AS_OF, **kw).columns
    assert columns() == columns(variant="table")
    assert columns(output="json") == columns(variant="json")
    assert run("user_lookup", events, AS_OF, output="json").columns == run("user_lookup", events, AS_OF).columns
    assert run("failed_auth", events, AS_OF).columns == run("failed_auth", events, AS_OF, "full").columns


@pytest.mark.parametrize("name, variant", ALL)
def test_plan_shape(spark, events, name, variant, tmp_path_factory):
    text = plan(run(name, events, AS_OF, variant))
    for operator in ("SortAggregate", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text


@pytest.mark.parametrize("name, variant", ALL)
def test_default_date_runs(events, name, variant):
    assert run(name, events, None, variant).count() >= 0


@pytest.mark.parametrize("limit", [1, 7])
def test_parameters(events, limit):
    assert run("user_lookup", events, AS_OF, limit=limit).count() == limit
    assert run("failed_auth", events, AS_OF, days=30).count() >= run("failed_auth", events, AS_OF, days=1).count()


def test_latest_rows_are_found_without_a_shuffle(events):
    text = plan(run("permission_changes", events, AS_OF))
    assert "TakeOrderedAndProject" in text
    assert "hashpartitioning" not in text and "rangepartitioning" not in text
    assert text.index("from_json") < text.index("TakeOrderedAndProject")  # parsed after the limit


def test_totals_add_up(events):
    daily = run("daily_summary", events, AS_OF).agg(F.sum("total_events"), F.sum("failed_events")).first()
    inside = events.where("event_date >= '2023-11-02'")
    failures = inside.where("error_code <> ''").count()
    assert tuple(daily) == (inside.count(), failures)
    hourly = run("hourly_activity", events, AS_OF)
    assert hourly.agg(F.sum("total_events")).first()[0] == events.where("event_date >= '2024-01-24'").count()
    assert hourly.where("error_events > total_events OR error_rate_pct > 100").count() == 0


@pytest.mark.parametrize("hour, off", [("05:59", True), ("06:00", False), ("22:59", False), ("23:00", True)])
def test_off_hours_bounds(make_events, hour, off):
    rows = make_events({"event_time": f"2024-01-30T{hour}:00+00:00"})
    assert run("off_hours", rows, AS_OF).count() == int(off)
    assert run("off_hours", rows, AS_OF, day_starts=0, day_ends=23).count() == 0


def test_short_permission_set_arns(make_events):
    rows = make_events(
        *[
            {"event_id": str(i), "event_type": "sso", "event_name": "CreateAccountAssignment", "request_parameters": p}
            for i, p in enumerate(['{"permissionSetArn":"short"}', "{}", '{"permissionSetArn":"abcdefghijklmnopq"}'])
        ]
    )
    found = run("sso_account_assignments", rows, AS_OF).collect()
    assert [row["permission_set"] for row in found] == ["ps-", None, "ps-bcdefghijklmnopq"]


def test_assumption_of_a_service_without_user(make_events):
    rows = make_events(
        *[
            {
                "event_id": str(i), "event_name": "AssumeRole", "user_name": "unknown",
                "user_agent": "ec2.amazonaws.com", "request_parameters": '{"roleArn":"arn:aws:iam::1:role/p/R"}',
            }
            for i in range(6)
        ]
    )
    row = run("role_assumptions", rows, AS_OF).first()
    assert (row["role_name"], row["assumed_by"], row["assumption_count"]) == (None, "ec2", 6)
    assert run("role_assumptions", rows, AS_OF, more_than=6).count() == 0


@pytest.mark.parametrize("name", ["user_lookup", "active_users", "daily_summary", "hourly_activity", "table_statistics"])
def test_approximate_counts_are_close(events, name):
    exact = run(name, events, AS_OF, "full").collect()
    close = run(name, events, AS_OF, "full", approximate=True).collect()
    for left, right in zip(exact, close, strict=True):
        for column in left.asDict():
            if isinstance(left[column], int):
                assert right[column] == pytest.approx(left[column], rel=0.2, abs=1)
            else:
                assert right[column] == left[column]


def test_empty_table(make_events):
    empty = make_events({}).where("false")
    row = run("table_statistics", empty).first()
    assert (row["total_events"], row["error_events"], row["earliest_event"]) == (0, 0, None)


def test_result_output(spark, make_events, tmp_path):
    rows = make_events({"error_code": None}).select("event_id", "error_code")
    assert json.loads(results.json_rows(rows).first()["document"]) == {"event_id": "e1", "error_code": None}
    results.write_json(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"event_id":"e1","error_code":null}'
    assert tuple(results.fetched(rows).first()) == ("e1", "")
    assert results.fetched(spark.range(1500)).count() == 1500
    assert results.fetched(spark.range(1500), results.FETCH_ROWS).count() == 1000


def test_storage_report(spark):
    gb = 1024**3
    files = spark.createDataFrame(
        [("a", gb, "GLACIER"), ("b", gb, None), ("c", gb, "NEW_CLASS"), ("d", gb, "STANDARD")],
        "path string, size long, storage_class string",
    )
    by_class = reports.storage_by_class(files)
    cost = {row["storage_class"]: row["monthly_cost_usd"] for row in by_class.collect()}
    assert cost == {"GLACIER": 0.004, "STANDARD": 0.046, "NEW_CLASS": 0.023}
    total = reports.storage_total(by_class).first()
    assert (total["object_count"], total["total_size_gb"]) == (4, 4.0)
    assert total["estimated_monthly_cost_usd"] == pytest.approx(0.073)
    assert reports.scan_cost(files).first()["scan_cost_usd"] == pytest.approx(4 * 5 / 1024)


@pytest.mark.parametrize("age, tier", [(0, "STANDARD"), (29, "STANDARD"), (30, "STANDARD_IA"), (90, "GLACIER"), (365, "DEEP_ARCHIVE")])
def test_tiers(spark, age, tier):
    day = F.lit(AS_OF - dt.timedelta(days=age))
    assert spark.range(1).select(reports.tier_by_age(day, AS_OF).alias("t")).first()["t"] == tier


def test_one_user_with_most_events(spark, events):
    """A hot user is counted map-side; the answer stays exact."""
    copies = F.explode(F.sequence(F.lit(1), F.lit(200)))
    hot = events.where("user_name = 'user5'").withColumn("_n", copies).drop("_n")
    both = events.where("user_name <> 'user5'").unionByName(hot)
    counts = {r["user_identity"]: r["total_actions"] for r in run("active_users", both, AS_OF, "full", limit=1000).collect()}
    single = {r["user_identity"]: r["total_actions"] for r in run("active_users", events, AS_OF, "full", limit=1000).collect()}
    hot_names = {r["user_identity"] for r in run("active_users", events.where("user_name = 'user5'"), AS_OF, limit=1000).collect()}
    assert {k: v for k, v in counts.items() if k not in hot_names} == {k: v for k, v in single.items() if k not in hot_names}
    assert sum(counts[k] for k in hot_names) > 100 * sum(single[k] for k in hot_names) / 2
