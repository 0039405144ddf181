"""Reports over crawls: how sources fared, what to improve, where following pages failed.

All of them are plain aggregates, so hot keys are reduced before they are shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.html import anchors, elements, inside, page_nodes, title
from almanac.functions.urls import host

# The reasons and texts of the improvement list.
NOTHING_FOUND = "no_events_found"
PARTLY_POSTED = "partial_success"
NOTHING_FOUND_DETAILS = "Scraper completed successfully but found no events. May need different scraping strategy."


def crawl_summary(results: DataFrame) -> DataFrame:
    """Totals over ``source results`` (``status, events_found, events_posted, events_eligible, minutes``)."""
    done = F.col("status") == "completed"
    short = F.col("reason").isNotNull()
    found, posted = F.sum("events_found"), F.sum("events_posted")
    return with_reason(results).agg(
        F.count(F.lit(1)).alias("sources_total"),
        F.count(F.when(done, 1)).alias("sources_processed"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("sources_failed"),
        F.count(F.when(short, 1)).alias("sources_needing_improvement"),
        found.alias("total_events_found"),
        posted.alias("current_future_events_posted"),
        F.round(F.try_divide(100 * posted, found), 1).alias("success_rate_percent"),
        F.round(F.sum("minutes"), 1).alias("total_time_minutes"),
    )


def with_reason(results: DataFrame) -> DataFrame:
    """Why a source should be looked at, NULL when it need not be."""
    done = F.col("status") == "completed"
    reason = F.when(done & (F.col("events_found") == 0), NOTHING_FOUND).when(
        done & (F.col("events_posted") < F.col("events_eligible")), PARTLY_POSTED
    )
    return results.withColumn("reason", reason)


def improvement_list(results: DataFrame) -> DataFrame:
    """The sources to improve with reason and details."""
    details = F.when(F.col("reason") == NOTHING_FOUND, NOTHING_FOUND_DETAILS).otherwise(
        F.format_string("Posted %d/%d events successfully", F.col("events_posted"), F.col("events_eligible"))
    )
    return with_reason(results).filter(F.col("reason").isNotNull()).select(
        "source", "url", "type", "city", "reason", details.alias("details"), "events_found", "events_posted"
    )


def improvement_rollup(entries: DataFrame) -> DataFrame:
    """Entries per type and city with subtotals; ``type_total`` and ``city_total`` mark the subtotal rows."""
    return entries.rollup("type", "city").agg(
        F.grouping("type").alias("type_total"),
        F.grouping("city").alias("city_total"),
        F.count(F.lit(1)).alias("entries"),
        F.count(F.when(F.col("reason") == NOTHING_FOUND, 1)).alias(NOTHING_FOUND),
        F.count(F.when(F.col("reason") == PARTLY_POSTED, 1)).alias(PARTLY_POSTED),
        F.sum("events_found").alias("events_found"),
        F.sum("events_posted").alias("events_posted"),
    )


def failure_rollup(failures: DataFrame) -> DataFrame:
    """Failures per domain and how often each sign of following pages was seen."""
    signs = F.col("potential_pagination_indicators")

    def times(name: str) -> Column:
        return F.count(F.when(signs[name], 1))

    return failures.groupBy("domain").agg(
        F.count(F.lit(1)).alias("failures"),
        times("has_numbered_links").alias("numbered_links"),
        times("has_next_prev_text").alias("next_prev_text"),
        times("has_javascript_calendar").alias("javascript_calendar"),
        times("has_load_more_buttons").alias("load_more_buttons"),
        F.max("content_length").alias("largest_page"),
    )


def strategy_counts(failures: DataFrame) -> DataFrame:
    """How many failing pages each strategy was tried on."""
    return failures.select(F.explode("context.strategies_attempted").alias("strategy")).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("failures")
    )


# Rules of the page profile.  They are this project's own: only the shape of the record is given.
EVENT_LINK = r"(?i)event|calendar"
NUMBERED_LINK = r"^\s*\d{1,3}\s*$"
NEXT_PREV = r"(?i)\b(?:next|prev|previous)\b"
SCRIPT_CALENDAR = r"(?i)fullcalendar|datepicker|calendar\s*\("
LOAD_MORE = r"(?i)(?:load|show|view)\s+more"
PAGE_PARAMETER = r"[?&](?:page|p|offset|start)=\d+"
SCRIPT_HINT = r"(?i)(?:page|offset)\w*\s*[:=]\s*['\"]?\w+"
HASH_LENGTH = 12


def page_profile(pages: DataFrame) -> DataFrame:
    """One record per page about its size, links and signs of following pages.  Narrow: no shuffle."""
    html = F.col("html")
    trees = pages.withColumn("_nodes", page_nodes(html)).withColumn("_links", F.filter(
        anchors(F.col("_nodes")), lambda a: F.coalesce(a["href"], F.lit("")) != ""
    ))
    links = F.col("_links")
    return trees.select(
        "page_id",
        "url",
        host(F.col("url")).alias("domain"),
        F.substring(F.sha2(html, 256), 1, HASH_LENGTH).alias("content_hash"),
        F.length(html).cast("bigint").alias("content_length"),
        title(html).alias("title"),
        F.transform(
            F.filter(links, lambda a: a["text"].rlike(EVENT_LINK) | a["href"].rlike(EVENT_LINK)),
            lambda a: F.struct(a["text"].alias("text"), a["href"].alias("href")),
        ).alias("navigation_links"),
        F.array_distinct(F.flatten(F.transform(
            F.filter("_nodes", lambda n: n["kind"] == "script"),
            lambda n: F.regexp_extract_all(n["text"], F.lit(SCRIPT_HINT), F.lit(0)),
        ))).alias("javascript_hints"),
        F.size(links).alias("links"),
        F.exists(links, lambda a: a["text"].rlike(NUMBERED_LINK)).alias("has_numbered_links"),
        F.exists(links, lambda a: a["text"].rlike(NEXT_PREV)).alias("has_next_prev_text"),
        html.rlike(SCRIPT_CALENDAR).alias("has_javascript_calendar"),
        (F.exists(links, lambda a: a["text"].rlike(LOAD_MORE))
         | F.exists(elements(F.col("_nodes"), "button"), lambda b: F.exists(
             inside(F.col("_nodes"), b), lambda t: (t["kind"] == "text") & t["text"].rlike(LOAD_MORE)
         ))).alias("has_load_more_buttons"),
        F.array_sort(F.array_distinct(F.filter(
            F.transform(links, lambda a: F.regexp_extract(a["href"], PAGE_PARAMETER, 0)), lambda p: p != ""
        ))).alias("url_patterns"),
    )


def failing_sources(failures: DataFrame, entries: DataFrame) -> DataFrame:
    """X11: entries of the improvement list whose page also failed to be followed."""
    return entries.join(failures.select("url", F.col("timestamp").alias("failed_at"), "content_length"), "url")
