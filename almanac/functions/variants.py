"""Reading loosely typed JSON objects held as VARIANT."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from almanac.functions.text import non_empty


def _path(key: str) -> str:
    return f"$['{key}']" if key.startswith("@") else f"$.{key}"


def field(item: Column, key: str) -> Column:
    """The value under a key as VARIANT; SQL NULL when the key is missing."""
    return F.try_variant_get(item, _path(key), "variant")


def text(value: Column) -> Column:
    """A VARIANT as text: scalars as written, objects and arrays as JSON, null as NULL."""
    return F.try_variant_get(value, "$", "string")


def get(item: Column, key: str) -> Column:
    """The value under a key as text, NULL when it is missing or null."""
    return F.try_variant_get(item, _path(key), "string")


def get_or(item: Column, key: str, default: str = "") -> Column:
    """Like ``get`` with a default for a missing key only: a null stays NULL."""
    return F.when(field(item, key).isNull(), default).otherwise(get(item, key))


def get_truthy(item: Column, key: str) -> Column:
    """Like ``get`` with NULL for the empty string."""
    return non_empty(get(item, key))


def fields(item: Column, types: str) -> Column:
    """Some fields of an object as a struct, NULL where missing, each as ``get`` (``string``) or ``field`` (``variant``) reads it; NULL for no object.

    The object is walked once, and a missing key costs nothing, while each path that leads nowhere is an exception inside Spark.
    """
    return F.try_variant_get(item, "$", f"struct<{types}>")


def text_or(value: Column, default: str = "") -> Column:
    """``get_or`` of a value that ``fields`` read as VARIANT."""
    return F.when(value.isNull(), default).otherwise(text(value))


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, VOID, ...; NULL for SQL NULL."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
