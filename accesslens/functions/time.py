"""UTC wall-clock times, independent of the session time zone.

Event times are handled as ``TIMESTAMP_NTZ`` holding UTC and stored as ISO
text with ``+00:00``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted time formats (ISO with Z, with or without a
# fraction; date and time with a blank).
TIME_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?Z| \d{1,2}:\d{1,2}:\d{1,2})$"


def as_utc(moment: dt.datetime) -> dt.datetime:
    """A naive UTC datetime; a naive input already counts as UTC."""
    return moment.astimezone(dt.timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def literal(moment: dt.datetime) -> Column:
    return F.lit(as_utc(moment).isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_seconds(moment: dt.datetime) -> int:
    return int(as_utc(moment).replace(tzinfo=dt.timezone.utc).timestamp())


def parse_time(text: Column) -> Column:
    """UTC time of an accepted format, NULL for anything else."""
    return F.when(text.rlike(TIME_PATTERN), text.try_cast("timestamp_ntz"))


def instant_to_utc(instant: Column) -> Column:
    """UTC wall-clock time of a ``TIMESTAMP``."""
    seconds = (F.unix_micros(instant) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def iso(time: Column) -> Column:
    """``2025-08-10T18:26:07+00:00``; six fraction digits unless zero."""
    text = F.replace(time.cast("string"), F.lit(" "), F.lit("T"))
    return F.concat(F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text), F.lit("+00:00"))


def from_iso(text: Column) -> Column:
    """The UTC time of a stored ``event_time`` (always ``+00:00``)."""
    return text.try_cast("timestamp_ntz")
