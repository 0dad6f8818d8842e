"""JSON access: every document is parsed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.schema import VARIANTS


def once(value: Column) -> Column:
    """Evaluate an expensive expression once per row.

    ``explode`` of a one-element array keeps the row and gives the optimizer a
    plain attribute: filters and projections that use it several times are not
    rewritten into several copies of the parse.
    """
    return F.explode(F.array(value))


def open_once(value: Column, *names: str) -> Column:
    """The fields of a struct as columns ``names``, worked out once per row;
    a NULL struct gives NULL fields."""
    return F.inline(F.array(value)).alias(*names)


def key_present(variant: Column, path: str) -> Column:
    """True when the key exists, also with a JSON null as its value."""
    return F.try_variant_get(variant, path, "variant").isNotNull()


def is_text(variant: Column, path: str = "$") -> Column:
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.coalesce(kind == "STRING", F.lit(False))


def is_object(variant: Column, path: str = "$") -> Column:
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def json_fields(
    df: DataFrame, fields: dict[str, str], source: str = "request_parameters", guard: Column | None = None
) -> DataFrame:
    """Add top-level scalar fields of a JSON text column, from one parse.

    ``fields`` maps new column name to JSON key.  Objects, arrays, null and
    missing keys give NULL, and of a repeated key the last value counts.  ``guard`` skips the parse for rows it rejects.
    """
    if holds_variant(df, source):
        parsed = F.col(VARIANTS[source])
        return df.withColumns({name: _scalar_of(parsed, f"$.{key}") for name, key in fields.items()})
    keys = list(dict.fromkeys(fields.values()))
    held = {key: f"_json_{key}" for key in keys}
    parsed = F.from_json(F.col(source), T.StructType([T.StructField(key, T.StringType()) for key in keys]))
    if guard is not None:
        parsed = F.when(guard, parsed)
    generated = open_once(parsed, *held.values())
    return (
        df.select("*", generated)
        .withColumns({name: _scalar(F.col(held[key]), source, key) for name, key in fields.items()})
        .drop(*held.values())
    )


def holds_variant(df: DataFrame, source: str = "request_parameters") -> bool:
    """Whether a table has a JSON text's parsed value next to it.  Its fields
    are then columns of the file, best taken before rows are chosen; a text
    that is no JSON, or repeats a key, has none."""
    return VARIANTS[source] in df.columns


def _scalar_of(variant: Column, path: str) -> Column:
    value = F.try_variant_get(variant, path, "string")
    return F.when(~F.substring(value, 1, 1).isin("{", "[") | is_text(variant, path), value)


def _scalar(value: Column, source: str, key: str) -> Column:
    # The parse returns nested values as text.  A text that merely starts
    # like one is rare; only then look at the value's real type.
    starts_nested = F.substring(value, 1, 1).isin("{", "[")
    return F.when(~starts_nested | is_text(F.try_parse_json(F.col(source)), f"$.{key}"), value)
