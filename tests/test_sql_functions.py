"""The SQL table functions against the registered forms."""

import datetime as dt
import uuid

import pytest

from accesslens import run
from accesslens.operators.lake import lake_rows, write_lake
from accesslens.plans import sql
from accesslens.sources.lake import register_lake

AS_OF = dt.date(2024, 1, 31)


@pytest.fixture(scope="module")
def table(spark, events, tmp_path_factory):
    path, name = str(tmp_path_factory.mktemp("lake") / "lake"), f"lake_{uuid.uuid4().hex}"
    write_lake(lake_rows(events), path)
    register_lake(spark, name, path)
    assert sql.register_functions(spark, name, "audit_") == [f"audit_{n}" for n in sql.FUNCTIONS]
    return name


@pytest.mark.parametrize("name", sql.FUNCTIONS)
def test_rows_equal_the_registered_form(spark, table, name):
    found, want = spark.sql(f"SELECT * FROM audit_{name}(DATE '2024-01-31')"), run(name, spark.table(table), AS_OF, "sql")
    assert found.columns == want.columns and found.collect() == want.collect()


def test_days_restrict_partitions(spark, table):
    week, all_ = (spark.sql(f"SELECT * FROM audit_hourly_activity(DATE '2024-01-31', {n})") for n in (7, 400))
    assert 0 < len(week.inputFiles()) < len(all_.inputFiles())
    assert "event_time,2024-01-24" in week._jdf.queryExecution().executedPlan().toString()


def test_defaults_are_today_and_the_window_of_the_library(spark, table):
    assert spark.sql("SELECT * FROM audit_failed_auth()").count() == 0
    assert spark.sql("SELECT * FROM audit_failed_auth(days => 100000)").count() > 0


def test_nested_and_odd_values(spark, make_events, tmp_path):
    name = f"lake_{uuid.uuid4().hex}"
    texts = ['{"name":{"a":1},"description":"{text"}', '{"name":null,"description":7}', "broken", None, '{"name":["x"],"sessionDuration":""}']
    rows = make_events(*({"event_id": str(i), "event_type": "sso", "event_name": "CreatePermissionSet", "request_parameters": t} for i, t in enumerate(texts)))
    write_lake(lake_rows(rows), str(tmp_path / "lake"))
    register_lake(spark, name, str(tmp_path / "lake"))
    sql.register_functions(spark, name, "odd_")
    found = spark.sql("SELECT * FROM odd_sso_permission_sets(DATE '2024-01-31')").collect()
    assert found == run("sso_permission_sets", spark.table(name), AS_OF, "sql").collect()
    assert [r.description for r in found][:2] == ["{text", "7"]
