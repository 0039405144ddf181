"""All registered queries."""
from __future__ import annotations

from almanac.workloads import answers, crawling, markup, reporting, structured

_MODULES = [structured, markup, crawling, answers, reporting]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}


def build_fixtures(spark, sf_dir) -> None:
    """Write the pages that several queries read, which otherwise the first of them does."""
    for build in (
        structured.order_pages, structured.spoilt_pages, markup.section_pages, crawling.framed_pages, crawling.calendar_pages,
        crawling.part_pages, crawling.towns,
    ):
        build(spark, sf_dir)
