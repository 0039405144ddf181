"""Identifiers and keys."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from almanac.functions.text import let
from almanac.functions.urls import host


def external_id(page_url: Column, title: Column, start: Column) -> Column:
    """``host:`` and 16 hex digits over host, title and start."""
    parts = F.struct(host(page_url).alias("h"), title.alias("t"), start.alias("s"))
    return let(parts, "x -> concat(x.h, ':', left(sha1(concat_ws('|', x.h, coalesce(x.t, 'None'), coalesce(x.s, ''))), 16))")


def content_key(text: Column) -> Column:
    """Join key that stands for a long text."""
    return F.sha2(text, 256)
