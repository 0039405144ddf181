"""Reading a few pages out of a table of very many.

Which pages are wanted is settled on narrow rows, addresses and page numbers, without the HTML.  Then a filter on the
numbers goes into the scan of the HTML, and only what passes it is joined: HTML that nobody asked for is neither shuffled
nor, where the files' statistics allow, read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from almanac.functions import urls as U
from almanac.functions.joins import dealt, lookup
from almanac.operators.sieve import passing

LISTED = 1_000  # so many page numbers are written into the filter itself


def newest_pages(pages: DataFrame, addresses: DataFrame) -> DataFrame:
    """``address, page_id``: the newest page (greatest ``page_id``) of each wanted ``address`` that was fetched.

    Addresses are URLs without fragments.  Reads two columns of ``pages``.
    """
    known = pages.select(U.address(F.col("url")).alias("address"), "page_id")
    wanted = addresses.select("address").distinct()
    return known.join(dealt(wanted), "address", "left_semi").groupBy("address").agg(F.max("page_id").alias("page_id"))


def only(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``pages`` whose ``page_id`` is among ``ids``, and a few more where the ids are many.

    A few ids are a list in the filter, which the scan gets as well; more of them are a sieve.  Either way no row of
    ``pages`` moves.  ``ids`` is read more than once, so let it be a stored table.
    """
    listed = [r["page_id"] for r in ids.select("page_id").filter(F.col("page_id").isNotNull()).distinct().limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        return pages.filter(F.col("page_id").isin(listed))
    return passing(pages, ids.select("page_id"), ["page_id"])


def fetched(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """The wanted rows of ``pages`` with the columns of ``ids``, which has one row per ``page_id``."""
    return lookup(only(pages, ids), ids, ["page_id"])
