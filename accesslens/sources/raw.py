"""Raw audit records from files: one ``rec`` VARIANT per record.

Delivery files are small (a few MB), so one array per file is a bounded row;
``explode`` spreads it into records.  The reader splits a file into the texts of
its records, and each text is parsed on its own: a record that cannot be parsed
gives a NULL ``rec`` and leaves its neighbours alone.  So does, as one NULL, a
file that holds no records array at all; both are counted as unparsable.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.functions.json import once
from accesslens.functions.time import as_utc
from accesslens.schema import ENVELOPE, RAW_FILE


def read_records(
    spark: SparkSession, path: str, modified_after: dt.datetime | None = None, multi_line: bool = True
) -> DataFrame:
    """Records of ``{"Records": [...]}`` files below ``path``.

    ``modified_after`` skips files that were delivered earlier, so that an
    incremental run lists but does not open them.  With ``multi_line=False`` a
    file may hold one such document per line, and large files are split.
    """
    reader = spark.read.schema(RAW_FILE).option("multiLine", multi_line).option("recursiveFileLookup", True)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", as_utc(modified_after).strftime("%Y-%m-%dT%H:%M:%S")).option(
            "timeZone", "UTC"
        )
    return _split(reader.json(path))


def stream_records(
    spark: SparkSession, path: str, files_per_trigger: int = 1000, multi_line: bool = True
) -> DataFrame:
    """The same records as a stream of newly delivered files.

    With ``multi_line=False`` a file may hold one such document per line.
    """
    return _split(
        spark.readStream.schema(RAW_FILE)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def _split(files: DataFrame) -> DataFrame:
    unreadable = F.array(F.lit(None).cast("string"))
    return from_text(files.select(F.explode(F.coalesce("Records", unreadable)).alias("raw")))


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Look-up results, one JSON envelope per line around the record text."""
    return unwrap(spark.read.schema(ENVELOPE).json(path))


def unwrap(df: DataFrame) -> DataFrame:
    """Parse the record inside an envelope; the envelope's own id, time and
    name stay next to it and win during normalisation."""
    return df.select("EventId", "EventTime", "EventName", once(F.try_parse_json("CloudTrailEvent")).alias("rec"))


def from_text(df: DataFrame, column: str = "raw") -> DataFrame:
    """Bare records held as JSON text, for example a topic's messages."""
    return df.select(once(F.try_parse_json(column)).alias("rec"))
