"""Questions about weeks and months, answered from stored sketches.

The tables are aggregates that loads keep (``operators.derived``); no event is
opened.  Counts of events, actions and days are exact, and so are those of
``active_users``, which come from counts per date and user.  How many users
there are is estimated: ``users`` with a relative standard error of
1.04 / sqrt(2 ** SKETCH_BITS), 1.6 % (within 5 % in 99.8 of 100 cases), and
exactly up to 2 ** SKETCH_BITS / 8 users.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.functions.events import since_days
from accesslens.plans.rollup import total

WINDOWS = (7, 30, 90)


def estimated(sketch: Column | str) -> Column:
    """Distinct values of all sketches of a group."""
    return F.hll_sketch_estimate(F.hll_union_agg(sketch))


def distinct_counts(activity: DataFrame, as_of: dt.date | None = None, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Totals and distinct users, actions and days of several windows, in one
    pass over the sketches of the longest."""
    today = F.current_date() if as_of is None else F.lit(as_of)
    rows = since_days(activity, as_of, max(windows), "event_date").withColumn("days", F.explode(F.array(*map(F.lit, windows))))
    rows = rows.where(F.col("event_date") >= F.date_sub(today, F.col("days")).cast("string"))
    return (
        rows.groupBy("days")
        .agg(
            F.sum("events").alias("total_events"),
            F.sum("failed_events").alias("failed_events"),
            estimated("users").alias("unique_users"),
            F.countDistinct("event_name").alias("unique_actions"),
            F.countDistinct("event_date").alias("active_days"),
        )
        .orderBy("days")
    )


def daily_summary(activity: DataFrame, as_of: dt.date | None = None, days: int = 90, limit: int = 30) -> DataFrame:
    """The daily summary of the query library, users estimated."""
    name = F.lower("event_name")
    return (
        since_days(activity, as_of, days, "event_date")
        .groupBy(F.col("event_date").alias("activity_date"))
        .agg(
            F.sum("events").alias("total_events"),
            estimated("users").alias("unique_users"),
            F.countDistinct("event_name").alias("unique_actions"),
            F.sum("failed_events").alias("failed_events"),
            total("events", name.contains("create") & name.contains("user")).alias("users_created"),
            total("events", name.contains("delete") & name.contains("user")).alias("users_deleted"),
            total("events", name.contains("policy")).alias("policy_changes"),
            total("events", name.contains("assume")).alias("role_assumptions"),
        )
        .orderBy(F.desc_nulls_last("activity_date"))
        .limit(limit)
    )


def active_users(busiest: DataFrame, as_of: dt.date | None = None, days: int = 30, limit: int = 30) -> DataFrame:
    """The users with the most actions, from one count a day and user."""
    counts = since_days(busiest, as_of, days, "event_date").groupBy("user_identity").agg(F.sum("events").alias("total_actions"))
    return counts.orderBy(F.desc("total_actions"), F.asc_nulls_last("user_identity")).limit(limit)
