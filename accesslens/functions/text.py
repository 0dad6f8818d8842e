"""String helpers with the SQL dialect's edge cases made explicit."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_blank(value: Column) -> Column:
    """True for a value that is neither NULL nor ''; never NULL itself."""
    return value.isNotNull() & (value != "")


def regexp_or_null(value: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``, NULL where it does not match."""
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, group))


def last_chars_or_empty(value: Column, n: int) -> Column:
    """The last ``n`` characters; '' when the text is shorter, NULL for NULL."""
    return F.when(F.length(value) >= n, F.right(value, F.lit(n))).when(value.isNotNull(), F.lit(""))


def fill(template: str, /, **values: Column) -> Column:
    """``template`` with its ``{name}`` slots filled; a NULL prints as None."""
    pieces = re.split(r"\{(\w+)\}", template)
    columns = [
        F.coalesce(values[piece].cast("string"), F.lit("None")) if position % 2 else F.lit(piece)
        for position, piece in enumerate(pieces)
        if piece
    ]
    return F.concat(*columns)
