"""A lake that keeps requests and responses as parsed, shredded values."""

import datetime as dt

import pytest

from accesslens import run
from accesslens.operators.lake import lake_rows, write_lake
from accesslens.session import settings
from accesslens.sources.lake import read_lake

AS_OF = dt.date(2024, 1, 31)
JSON_QUERIES = ["sso_permission_sets", "sso_account_assignments", "sso_admin_policies", "sso_applications"]


@pytest.fixture(scope="module")
def lakes(spark, events, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lakes")
    write_lake(lake_rows(events, variants=True), f"{folder}/shredded")
    write_lake(lake_rows(events), f"{folder}/plain")
    return read_lake(spark, f"{folder}/shredded", variants=True), read_lake(spark, f"{folder}/plain")


@pytest.mark.parametrize("name", [*JSON_QUERIES, "role_assumptions", "permission_changes"])
def test_rows_equal_those_of_the_texts(lakes, name):
    shredded, plain = (run(name, lake, AS_OF, "sql") for lake in lakes)
    assert shredded.columns == plain.columns and shredded.collect() == plain.collect()


@pytest.mark.parametrize("name", JSON_QUERIES)
def test_single_fields_are_read(spark, lakes, name):
    with settings(spark, {"spark.sql.maxMetadataStringLength": "5000"}):
        text = run(name, lakes[0], AS_OF, "sql")._jdf.queryExecution().executedPlan().toString()
    schema = text[text.index("ReadSchema") :]
    assert "request_parameters" not in text and "request:struct<0:" in schema and "from_json" not in text


def test_fields_of_most_rows_are_columns_of_the_file(lakes, spark):
    import pyarrow.parquet as pq

    typed = set()
    for file in lakes[0].inputFiles()[:40]:
        schema = pq.ParquetFile(file.replace("file://", "")).schema
        typed |= {schema.column(i).path for i in range(len(schema)) if schema.column(i).path.startswith("request.typed_value")}
    assert any(path.startswith("request.typed_value.roleArn") for path in typed)


def test_odd_values(spark, make_events, tmp_path):
    texts = ['{"name":{"a":1},"description":"{text"}', '{"name":null,"description":7}', "broken", None, '{"name":["x"],"sessionDuration":""}', "[1]"]
    rows = make_events(*({"event_id": str(i), "event_type": "sso", "event_name": "CreatePermissionSet", "request_parameters": t} for i, t in enumerate(texts)))
    write_lake(lake_rows(rows, variants=True), str(tmp_path / "lake"))
    found = [run("sso_permission_sets", read_lake(spark, str(tmp_path / "lake"), variants=v), AS_OF, "sql").collect() for v in (True, False)]
    assert found[0] == found[1] and [r.description for r in found[0]][:2] == ["{text", "7"]
