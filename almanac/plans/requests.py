"""From extraction requests to responses (S2, C7, C11): only what the requests lead to is read.

A request names a page, and may bring selectors, an expected number of events and the fields it needs.  The newest
page of each requested address is found on narrow rows and read once, whoever asks for it; frames, month pages and linked
pages are found the same way from the addresses that turn up.  Requests keep their identity: two requests for one page
with different selectors are answered apart, and each is measured by its own requirements.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions import urls as U
from almanac.functions.joins import lookup
from almanac.operators import contract, crawl, models
from almanac.operators.fetch import fetched, newest_pages
from almanac.operators.hints import resolve_hints
from almanac.plans.extract import PART_SIZE, by_model, found_behind, method_of, model_events, responses, surveyed, without_events
from almanac.plans.staging import write_once

UNKNOWN_TITLE = "Unknown"  # fixed value: the title of a page that was not read
VARIANT = ["page_id", "asked_with"]


@dataclass
class Served:
    """``responses``: a row per request and part of its events.  ``events``: those that meet the contract, a row per
    event, page and list of selectors (``asked_with``).  ``rejected``: the others, with ``reasons``."""

    responses: DataFrame
    events: DataFrame
    rejected: DataFrame


def identified(requests: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """Requests with ``request_id``, address, selectors (their own or ``discovered`` ones) and required fields, stored.

    A ``request_id`` column is kept; without one, rows are numbered, so equal requests are two requests.
    """
    rows = requests if "request_id" in requests.columns else requests.withColumn("request_id", F.monotonically_increasing_id())
    rows = write_once(rows.select("request_id", "url", "extraction_hints", "schema_requirements"))
    asked = F.col("extraction_hints.content_selectors")
    own = rows.withColumn("selectors", F.when(F.size(asked) > 0, asked))
    if discovered is not None:
        found = resolve_hints(rows.select("url", F.lit(None).cast(rows.schema["extraction_hints"].dataType).alias("extraction_hints")).distinct(), discovered)
        own = lookup(own, found.groupBy("url").agg(F.min("selectors").alias("_found")), ["url"], "left")
        own = own.withColumn("selectors", F.coalesce("selectors", "_found"))
    return write_once(own.select(
        "request_id", "url", U.address(F.col("url")).alias("address"), "selectors",
        F.coalesce(F.to_json("selectors"), F.lit("")).alias("asked_with"),
        F.col("extraction_hints.expected_event_count").alias("expected_event_count"), *contract.requirements(),
    ))


def serve(
    requests: DataFrame,
    pages: DataFrame,
    as_of: Column,
    answers: DataFrame | None = None,
    discovered: DataFrame | None = None,
    on_error: str = "page",
    repair: bool = False,
    follow_links: bool = True,
    fallback_when_no_links: bool = False,
    months: int = 2,
    part_size: int = PART_SIZE,
) -> Served:
    """The response to every request, out of a table of fetched ``pages`` of any size.

    A response says whether events were found, by which method, the page's title, how many events there are and how many
    were expected, how many have all required and all optional fields, which required ones are missing anywhere, how many events were
    set aside because they break the contract, and holds the events, in several rows (``part``) if they are very many.
    A request whose page was not fetched has ``failed``.  ``discovered`` is ``url, event_containers``; other arguments are those of
    ``extract``.
    """
    asked = identified(requests, discovered)
    start = write_once(newest_pages(pages, asked))
    of_request = write_once(lookup(asked, start, ["address"], "left"))
    wanted = [c for c in ("page_id", "url", "html", "rendered") if c in pages.columns]
    seen = surveyed(fetched(pages.select(*wanted), start).drop("address"), as_of, on_error, months)
    keep = ["page_id", "page_url"]

    links = seen.filter("follows").select(*keep, F.inline("links"))
    followed = write_once(crawl.followed_events(links, found_behind(links, pages.select(*wanted), as_of, on_error), as_of, keep, repair))
    structured = crawl.own_events(seen, keep, on_error).unionByName(followed)
    variants = of_request.filter(F.col("page_id").isNotNull()).select(*VARIANT, "selectors").distinct()
    events, asked_model = variants.drop("selectors").join(structured, "page_id"), None
    if answers is not None:
        misses = lookup(variants, without_events(seen, followed, keep), ["page_id"])
        by_answers, _ = model_events(misses, pages, answers, None, VARIANT, follow_links, fallback_when_no_links)
        asked_model = write_once(by_answers)
        events = events.unionByName(asked_model.filter(~F.col("failed")).drop("failed"), allowMissingColumns=True)
    checked = write_once(contract.violations(models.with_scores(events, answers)))
    good = contract.valid(checked)
    return Served(_responses(of_request, seen, good, checked, asked_model, part_size), good, contract.rejected(checked))


def _responses(
    of_request: DataFrame, seen: DataFrame, good: DataFrame, checked: DataFrame, asked_model: DataFrame | None, part_size: int,
) -> DataFrame:
    """Requests with how their page fared under their selectors.  All that is joined is reduced to a row per page and selectors first."""
    counted = checked.groupBy(*VARIANT).agg(
        F.count(F.when(F.size("reasons") == 0, 1)).alias("total_found"), F.count(F.when(F.size("reasons") > 0, 1)).alias("set_aside"))
    fared = of_request.select(*VARIANT).distinct().filter(F.col("page_id").isNotNull()).join(counted, VARIANT, "left")
    if asked_model is None:
        fared = fared.withColumns({"by_model": F.lit(0), "model_failed": F.lit(False)})
    else:
        fared = fared.join(by_model(asked_model, VARIANT), VARIANT, "left")
    fared = fared.join(seen.groupBy("page_id").agg(F.max("title").alias("title")), "page_id")
    fared = fared.withColumn("total_found", F.coalesce("total_found", F.lit(0))).withColumn("method", method_of(F.col("total_found")))
    parts = responses(good.withColumn("page_id", F.struct(*VARIANT)), fared.select(
        F.struct(*VARIANT).alias("page_id"), "total_found", "set_aside", "method", "title"), part_size)
    parts = parts.select("page_id.*", "total_found", "set_aside", "method", "title", "part", "events")
    shapes = contract.field_shapes(good, page_id=F.col("page_id"), asked_with=F.col("asked_with"))
    needs = of_request.select(*VARIANT, "required_fields", "optional_fields").filter(F.col("page_id").isNotNull()).distinct()
    fields = contract.conformance(needs, shapes, VARIANT).withColumnRenamed("events", "_n").drop("_n")
    known = of_request.join(fields, [*VARIANT, "required_fields", "optional_fields"], "left")
    zero = F.lit(0).cast("long")
    nothing = F.from_json(F.lit("[]"), parts.schema["events"].dataType.simpleString())
    total = F.coalesce("total_found", zero)
    return known.join(parts, VARIANT, "left").select(
        "request_id", "url",
        (total > 0).alias("success"),
        F.coalesce("method", F.lit("failed")).alias("extraction_method"),
        F.coalesce("title", F.lit(UNKNOWN_TITLE)).alias("page_title"),
        total.alias("total_found"),
        "expected_event_count",
        (total == F.col("expected_event_count")).alias("as_expected"),
        F.coalesce("conforming", zero).alias("conforming"), F.coalesce("complete", zero).alias("complete"),
        F.coalesce("missing_required", F.expr("cast(array() as array<string>)")).alias("missing_required"),
        F.coalesce("set_aside", zero).alias("set_aside"),
        F.coalesce("part", zero).alias("part"),
        F.coalesce("events", nothing).alias("events"),
    )
