"""The whole way from pages to responses: structured data first, the model path only for the rest.

The HTML is read once (``crawl.survey``); the narrow result is stored, and every later step joins
narrow tables on an address, a page number or a content key.  Where another page's HTML is needed, its number is found first
and only that page is read (``operators.fetch``).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.functions import urls as U
from almanac.functions.html import page_nodes
from almanac.functions.joins import lookup
from almanac.operators import crawl, models
from almanac.operators.fetch import fetched, newest_pages
from almanac.operators.hints import hint_html, hinted_links, page_text
from almanac.plans.staging import write_once

PART_SIZE = 10_000  # events of one source page per response row; larger pages give several rows


@dataclass
class Extraction:
    """``events``: one row per event.  ``pages``: one row per page with method, title and success.  ``needs``: ``page_id,
    address`` of what each page's events depend on besides the page itself, fetched or not."""

    events: DataFrame
    pages: DataFrame
    needs: DataFrame

    def responses(self, part_size: int = PART_SIZE) -> DataFrame:
        return responses(self.events, self.pages, part_size)


def extract(
    pages: DataFrame,
    as_of: Column,
    answers: DataFrame | None = None,
    hints: DataFrame | None = None,
    on_error: str = "page",
    repair: bool = False,
    follow_links: bool = True,
    fallback_when_no_links: bool = False,
    months: int = 2,
    of: DataFrame | None = None,
) -> Extraction:
    """Events of every page and how each page fared.

    ``answers`` holds recorded model answers, ``hints`` is ``url, selectors`` (see ``hints.resolve_hints``).
    ``months`` is the number of month pages followed of a calendar.  ``of`` (``page_id``, each once, a stored table) names the pages to
    extract if not all are; of the others only those that are followed get read.  For the pages of requests, see ``plans.requests``.
    """
    ids = ["page_id"] + [c for c in ("source_id",) if c in pages.columns]
    keep = ids + ["page_url"]
    seen = surveyed(pages if of is None else fetched(pages, of), as_of, on_error, months)
    links = seen.filter("follows").select(*keep, F.inline("links"))
    behind = crawl.targets(seen, pages, crawl.addresses(links)) if of is None else found_behind(links, pages, as_of, on_error)
    followed = write_once(crawl.followed_events(links, behind, as_of, keep, repair))
    needs = links.select("page_id", U.address(F.col("target_url")).alias("address")).unionByName(
        seen.filter(F.col("frame_url").isNotNull()).select("page_id", U.address(F.col("frame_url")).alias("address")))
    found = crawl.own_events(seen, keep, on_error).unionByName(followed)
    later = followed.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    status = seen.select(*keep, "title", "failed", "own_events")

    if answers is not None:
        misses = without_events(seen, followed, keep)
        by_answers, read_for_it = model_events(misses, pages, answers, hints, ids, follow_links, fallback_when_no_links)
        asked, needs = write_once(by_answers), needs.unionByName(read_for_it)
        found = found.unionByName(asked.filter(~F.col("failed")).drop("failed"), allowMissingColumns=True)
        status = status.join(later, "page_id", "left").join(by_model(asked, ["page_id"]), "page_id", "left")
    else:
        status = status.join(later, "page_id", "left").withColumns(
            {"by_model": F.lit(0), "model_failed": F.lit(False)}
        )
    total = F.col("own_events") + F.coalesce("n", F.lit(0)) + F.coalesce("by_model", F.lit(0))
    summary = status.select(
        *keep,
        (total > 0).alias("success"),
        method_of(total).alias("extraction_method"),
        F.col("title").alias("page_title"),
        total.alias("total_found"),
        F.col("failed").alias("jsonld_failed"),
    )
    return Extraction(models.with_scores(found, answers), summary, needs.distinct())


def found_behind(links: DataFrame, pages: DataFrame, as_of: Column, on_error: str = "page") -> DataFrame:
    """What links find where not all pages are surveyed: theirs are fetched and read, others are not."""
    wanted = write_once(crawl.addresses(links))
    there = fetched(pages, write_once(newest_pages(pages, wanted))).drop("address")
    read = write_once(crawl.survey(there, as_of, on_error).select("page_id", "url", "items"))
    return crawl.targets(read, pages, wanted)


def surveyed(pages: DataFrame, as_of: Column, on_error: str = "page", months: int = 2) -> DataFrame:
    """What one pass over the HTML tells about each page, stored, without the HTML."""
    keep = ["page_id"] + [c for c in ("source_id",) if c in pages.columns] + ["page_url"]
    return write_once(
        crawl.survey(pages, as_of, on_error, with_text=True, months=months)
        .withColumn("page_url", F.col("url"))
        .withColumn("prompt_keys", models.prompt_keys(F.col("url"), F.col("text")))
        .withColumn("own_events", F.size(crawl.own_items(F.col("items"), on_error)))
        .withColumn("follows", F.size("links") > 0)
        .select(*keep, "url", "title", "failed", "own_events", "follows", "links", "items", "frame_url", "prompt_keys")
    )


def without_events(seen: DataFrame, followed: DataFrame, keep: list[str]) -> DataFrame:
    """Surveyed pages that structured data gave nothing for: ``keep, frame_url, prompt_keys``.

    Pages without events of their own that follow nothing are known to need the model; only those that follow
    something must be checked against what was found there.
    """
    empty = seen.filter(F.col("own_events") == 0).select(*keep, "follows", "frame_url", "prompt_keys")
    return empty.filter(~F.col("follows")).unionByName(
        empty.filter("follows").join(followed.select("page_id").distinct(), "page_id", "left_anti")
    ).drop("follows")


def by_model(asked: DataFrame, ids: list[str]) -> DataFrame:
    """How the model path went for each of ``ids``: number of events, whether any answer was unusable."""
    return asked.groupBy(*ids).agg(
        F.count(F.when(~F.col("failed"), 1)).alias("by_model"), F.max("failed").alias("model_failed")
    )


def method_of(total: Column) -> Column:
    return (
        F.when(F.col("by_model") > 0, "llm").when(total > 0, "jsonld").when(F.col("model_failed"), "failed").otherwise("none")
    )


def with_readable_text(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Settle what a model reads of each row's page: ``prompt_keys``, or ``event_links`` for a page with ``selectors``.

    ``rows`` has ``page_url, frame_url, selectors, prompt_keys``, a key for each window of the text.  A page with a frame is read through it, and
    selectors apply to what is read.  Only such rows need HTML again: the newest page of each address is fetched by its number, and each distinct (address, selectors)
    pair is read once, however many pages share it.  An address that was not fetched marks its rows ``unreachable``.
    """
    direct = F.col("frame_url").isNull() & F.col("selectors").isNull()
    plain = rows.filter(direct).withColumn("event_links", F.lit(None).cast("array<string>")).withColumn("unreachable", F.lit(False))
    again = rows.filter(~direct).withColumn("address", U.address(F.coalesce("frame_url", "page_url"))).drop("prompt_keys")
    ways = write_once(again.select("address", "selectors").distinct())
    inside = fetched(pages.select("page_id", "url", "html"), write_once(newest_pages(pages, ways)))
    nodes, selectors = F.col("_nodes"), F.col("selectors")
    read = (
        lookup(ways, inside, ["address"])
        .withColumn("_nodes", page_nodes(F.col("html")))
        .select(
            "page_id", F.col("address").alias("_url"), selectors.alias("_selectors"),
            page_text(nodes, selectors).alias("text"),
            hinted_links(F.when(selectors.isNotNull(), nodes), selectors, F.col("url")).alias("event_links"),
        )
    )
    read = crawl.newest(read, ["_url", "_selectors"], ["text", "event_links"])
    joined = again.join(read, (F.col("address") == F.col("_url")) & selectors.eqNullSafe(F.col("_selectors")), "left")
    return plain.unionByName(
        joined.withColumn("prompt_keys", models.prompt_keys(F.col("page_url"), F.col("text")))
        .withColumn("unreachable", F.col("_url").isNull())
        .select(*rows.columns, "event_links", "unreachable")
    )


def hint_prompts(pages: DataFrame) -> DataFrame:
    """M3 with frames: a page that has a frame is asked about by the HTML of that frame, if it was fetched.

    Of several pages of a frame's address the newest counts.  Each frame is read and cut into windows once; what
    is joined with the pages that embed it are the windows.  Pages without a frame are asked about as they are read.
    """
    html = F.col("html")
    nodes = page_nodes(F.when(crawl.has_frame(html), html))
    seen = pages.select("page_id", "url", "html").withColumn("frame_url", crawl.first_frame(nodes, F.col("url")))
    framed = write_once(seen.filter(F.col("frame_url").isNotNull()).select("page_id", "url", U.address(F.col("frame_url")).alias("address")))
    inner = write_once(newest_pages(pages, framed))
    windows = fetched(pages.select("page_id", "html"), inner).dropDuplicates(["address"]).select("address", hint_html(html).alias("windows"))
    lost = write_once(framed.join(inner.select("address"), "address", "left_anti").select("page_id").distinct())
    own = seen.filter(F.col("frame_url").isNull()).select("page_id", "url", "html").unionByName(
        fetched(pages.select("page_id", "url", "html"), lost).select("page_id", "url", "html"))
    return models.hint_prompts(own).unionByName(models.prompts_of_windows(lookup(framed, windows, ["address"])))


def model_events(
    misses: DataFrame, pages: DataFrame, answers: DataFrame, hints: DataFrame | None, ids: list[str],
    follow_links: bool = True, fallback_when_no_links: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Events of the pages structured data gave nothing for; rows with ``failed`` mark unusable answers.  And the ``page_id,
    address`` of what was read, or would have been, on their behalf.

    A page with hints is not read itself: the pages its hinted links lead to are (C9), without hints of
    their own.  A long text is read window by window (``piece``): a window whose answer cannot be used
    costs its own events only.  An empty list of hints is a hint too, and yields nothing unless ``fallback_when_no_links``.
    Several hints for one address count together, so that a page asked for twice is read once and loses none; rows
    that have ``selectors`` already keep them.
    """
    keep = ids + ["page_url"]
    hinted = misses if "selectors" in misses.columns else with_selectors(misses, hints)
    ready = write_once(with_readable_text(hinted, pages))
    follows = F.col("selectors").isNotNull() if follow_links else F.lit(False)
    if fallback_when_no_links:
        follows = follows & (F.coalesce(F.size("event_links"), F.lit(0)) > 0)

    plain = ready.filter(~follows).select(*keep, F.posexplode("prompt_keys").alias("piece", "prompt_key"))
    own = _answered(plain.withColumnRenamed("page_url", "url"), answers)
    own = own.withColumn("source_ord", F.lit(0)).withColumn("target_url", F.col("page_url"))

    led = ready.filter(follows).select(*keep, F.posexplode("event_links").alias("source_ord", "target_url"))
    led = led.withColumn("address", U.address(F.col("target_url")))
    details = detail_pages(led.select("address").distinct(), pages)
    detail = detail_prompts(details, pages).withColumnRenamed("address", "url")
    read = _answered(detail, answers).filter(~F.col("failed")).withColumnRenamed("page_url", "address")

    lost = ready.filter("unreachable").select(*keep, F.lit(True).alias("failed"))
    events = (
        own.unionByName(led.join(read, "address").drop("address"))
        .unionByName(lost, allowMissingColumns=True)
        .withColumn("method", F.lit("llm"))
    )
    framed = details.filter(F.col("frame_url").isNotNull()).select("address", U.address(F.col("frame_url")).alias("_frame"))
    inner = led.select("page_id", "address").join(framed, "address").select("page_id", F.col("_frame").alias("address"))
    hinted_again = ready.filter(F.col("selectors").isNotNull()).select(
        "page_id", U.address(F.coalesce("frame_url", "page_url")).alias("address"))  # the newest version of the page itself
    return events, led.select("page_id", "address").unionByName(inner).unionByName(hinted_again)


def with_selectors(misses: DataFrame, hints: DataFrame | None) -> DataFrame:
    if hints is None:
        return misses.withColumn("selectors", F.lit(None).cast("array<string>"))
    return misses.join(
        hints.groupBy(F.col("url").alias("page_url")).agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("selectors")))).alias("selectors"),
            F.count("selectors").alias("_lists"),
        ).withColumn("selectors", F.when(F.col("_lists") > 0, F.col("selectors"))).drop("_lists"), "page_url", "left"
    )


def _answered(keyed: DataFrame, answers: DataFrame) -> DataFrame:
    return models.page_answer_events(models.with_answers(keyed, answers, "page").drop("prompt_key"))


def detail_pages(addresses: DataFrame, pages: DataFrame) -> DataFrame:
    """``address, page_url, frame_url, prompt_keys`` of linked pages, each in its newest version, stored."""
    nodes, frame = F.col("_nodes"), F.col("frame_url")
    rows = (
        fetched(pages.select("page_id", "url", "html"), write_once(newest_pages(pages, addresses)))
        .withColumn("_nodes", page_nodes(F.col("html")))
        .withColumn("frame_url", crawl.first_frame(nodes, F.col("url")))
        .withColumn("prompt_keys", models.prompt_keys(F.col("url"), page_text(F.when(frame.isNull(), nodes))))
        .select("page_id", "address", F.col("url").alias("page_url"), "frame_url", "prompt_keys")
    )
    return write_once(crawl.newest(rows, ["address"], ["page_url", "frame_url", "prompt_keys"]))


def detail_prompts(details: DataFrame, pages: DataFrame) -> DataFrame:
    """``address, piece, prompt_key`` of ``detail_pages``, each read through its frame if it has one, without hints."""
    ready = with_readable_text(details.withColumn("selectors", F.lit(None).cast("array<string>")), pages)
    return ready.select("address", F.posexplode("prompt_keys").alias("piece", "prompt_key"))


EVENT_ORDER = [
    "source_ord", "seq", "method", "external_id", "title", "description", "location", "start_time", "end_time",
    "url", "organizer", "event_status", "event_attendance_mode", "validation_score", "tags",
]


def responses(events: DataFrame, pages: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """C11: events put back into arrays, one row per page.

    A page is split into several rows (``part``) before any array can outgrow its bound: its events are
    numbered through, source by source and window by window, and cut into runs of ``part_size``.  Only the sources of a page, not
    its events, are put in order for that.  Pages without events give one row with an empty array.
    """
    piece = F.coalesce("piece", F.lit(0)) if "piece" in events.columns else F.lit(0)
    events = events.withColumn("piece", piece)
    source = ["page_id", "source_ord", "method", "piece"]
    spans = events.groupBy(*source).agg((F.max(F.coalesce("seq", F.lit(0))) + 1).alias("_span"))
    before = Window.partitionBy("page_id").orderBy("source_ord", "method", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(*source, F.coalesce(F.sum("_span").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.coalesce("seq", F.lit(0))
    parts = lookup(events, offsets, source).select(
        "page_id", F.floor(place / part_size).alias("part"), F.struct(*EVENT_ORDER).alias("event")
    ).groupBy("page_id", "part").agg(F.sort_array(F.collect_list("event")).alias("events"))
    joined = pages.join(parts, "page_id", "left")
    empty = F.from_json(F.lit("[]"), parts.schema["events"].dataType.simpleString())
    return joined.select(
        *pages.columns, F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("events", empty).alias("events")
    )
