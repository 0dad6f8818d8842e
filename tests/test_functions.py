import datetime as dt

import pytest
from pyspark.sql import functions as F

from accesslens.functions.events import event_hour, percentage, since_days, with_identity
from accesslens.functions.json import json_fields
from accesslens.functions.keys import restrict_to
from accesslens.functions.text import fill, last_chars_or_empty, not_blank, regexp_or_null
from accesslens.functions.time import instant_to_utc, iso, parse_time


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{name} string" for name in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"k":"v"}', "v"), ('{"k":""}', ""), ('{"k":7}', "7"), ('{"k":true}', "true"), ('{"k":null}', None),
        ('{"k":{"a":1}}', None), ('{"k":[1]}', None), ('{"k":"{\\"a\\":1}"}', '{"a":1}'), ('{"k":"[x"}', "[x"),
        ("{}", None), ("null", None), ("[1]", None), ("broken{", None), (None, None),
    ],
)
def test_json_scalar(spark, text, expected):
    df = spark.createDataFrame([(text,)], "request_parameters string")
    assert [row["v"] for row in json_fields(df, {"v": "k"}).collect()] == [expected]


def test_json_parse_happens_once(spark, events):
    fields = json_fields(events, {"a": "userName", "b": "roleName", "c": "policyArn"}).where("a IS NOT NULL AND b = 'x'")
    plan = fields._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


@pytest.mark.parametrize(
    "user, params, expected",
    [
        ("AROA1:session", '{"roleSessionName":"s"}', "session"),
        ("bob", '{"roleSessionName":"s"}', "s"),
        ("bob", '{"roleSession\\u004eame":"s"}', "s"),
        ("bob", '{"roleSessionName":{"x":1}}', "bob"),
        ("bob", "null", "bob"),
        ("bob:", "{}", "bob:"),
        (None, "{}", None),
    ],
)
def test_identity(spark, make_events, user, params, expected):
    df = make_events({"user_name": user, "request_parameters": params})
    assert with_identity(df).first()["user_identity"] == expected


@pytest.mark.parametrize("text, expected", [("0123456789abcdefXY", "23456789abcdefXY"), ("short", ""), (None, None)])
def test_last_chars(spark, text, expected):
    assert one(spark, last_chars_or_empty(F.col("t"), 16), t=text) == expected


def test_no_match_is_null(spark):
    assert one(spark, regexp_or_null(F.col("t"), ":(.+)$"), t="abc") is None


@pytest.mark.parametrize("text, expected", [(None, False), ("", False), ("x", True)])
def test_not_blank(spark, text, expected):
    assert one(spark, not_blank(F.col("t")), t=text) is expected


def test_fill_prints_null(spark):
    assert one(spark, fill("a {x} b {y}", x=F.col("t"), y=F.lit(1)), t=None) == "a None b 1"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2025-08-10T18:26:07Z", "2025-08-10T18:26:07+00:00"),
        ("2025-08-10T18:26:07.5Z", "2025-08-10T18:26:07.500000+00:00"),
        ("2025-08-10 18:26:07", "2025-08-10T18:26:07+00:00"),
        ("2025-08-10", None), ("later", None), ("2025-13-10T18:26:07Z", None), (None, None),
    ],
)
def test_times(spark, text, expected):
    assert one(spark, iso(parse_time(F.col("t"))), t=text) == expected


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, iso(parse_time(F.col("t"))), t="2024-03-10T02:30:00Z") == "2024-03-10T02:30:00+00:00"
        instant = F.col("t").cast("timestamp")
        assert one(spark, iso(instant_to_utc(instant)), t="2024-03-10T02:30:00.25Z") == "2024-03-10T02:30:00.250000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("hour", ["05:59", "06:00", "22:59", "23:00"])
def test_hour(make_events, hour):
    df = make_events({"event_time": f"2024-01-30T{hour}:00+00:00"})
    assert df.select(event_hour().alias("h")).first()["h"] == int(hour[:2])


def test_day_window_is_inclusive(make_events):
    times = ["2024-01-23T23:59:59+00:00", "2024-01-24T00:00:00+00:00", "2024-01-30T10:00:00+00:00"]
    df = make_events(*[{"event_time": t} for t in times])
    assert since_days(df, dt.date(2024, 1, 31), 7).count() == 2


def test_day_window_defaults_to_today(make_events):
    today = dt.date.today()
    df = make_events(*[{"event_time": f"{today - dt.timedelta(days=n)}T00:00:00+00:00"} for n in (1, 40)])
    assert since_days(df, None, 30).count() == 1


@pytest.mark.parametrize("part, whole, expected", [(1, 3, 33.33), (201, 20000, 1.01), (1, 800, 0.13), (0, 5, 0.0)])
def test_percentage_rounds_exactly(spark, part, whole, expected):
    df = spark.createDataFrame([(part, whole)], "a long, b long")
    assert df.select(percentage(F.col("a"), F.col("b")).alias("x")).first()["x"] == expected


def test_restriction_gives_the_same_rows_listed_and_joined(spark, events):
    dates = events.where("event_date < '2024-01-05'").select("event_date")
    listed = restrict_to(events, "event_date", dates)
    joined = restrict_to(events, "event_date", dates, max_listed=2)
    assert listed.count() == joined.count() > 0
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in listed._jdf.queryExecution().optimizedPlan().toString()
