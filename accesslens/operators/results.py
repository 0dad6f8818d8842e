"""Result output: row caps for display and JSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: rows the reporting tool fetches.
FETCH_ROWS = 1000


def fetched(result: DataFrame, rows: int | None = None) -> DataFrame:
    """A result as a display shows it: every value text, NULL as '', and only
    the first ``rows`` where that is asked for."""
    result = result if rows is None else result.limit(rows)
    return result.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in result.columns])


def json_rows(result: DataFrame) -> DataFrame:
    """One JSON document per row, NULL fields included."""
    document = F.to_json(F.struct(*result.columns), {"ignoreNullFields": "false"})
    return result.select(document.alias("document"))


def write_json(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
