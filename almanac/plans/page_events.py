"""Section by section reading of pages, with bounded following of links."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions import variants as V
from almanac.functions.joins import lookup
from almanac.operators import models
from almanac.operators.crawl import page_frames
from almanac.operators.sections import page_sections
from almanac.plans.staging import write_once


def section_prompts(pages: DataFrame, as_of: Column) -> DataFrame:
    """Sections of all pages with the prompt that stands for each; what a model run needs as input."""
    keep = [c for c in ("source_id",) if c in pages.columns]
    return models.section_prompts(page_sections(pages.select("page_id", "url", "html", *keep)), as_of)


def frames(pages: DataFrame) -> DataFrame:
    """``url, frame_url`` of the pages with a calendar frame."""
    found = page_frames(pages).select("url", F.col("calendar_frame_url").alias("frame_url"))
    return found.filter(F.col("frame_url").isNotNull())


def dictionary(pages: DataFrame) -> DataFrame:
    """``url, id``: a number for every page address, the least ``page_id`` it was fetched under; stored."""
    return write_once(pages.groupBy("url").agg(F.min("page_id").alias("id")))


def numbered(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """``rows`` with the address in ``column`` replaced by its number; rows that name an address that was not fetched lead nowhere and go."""
    return lookup(rows, known.select(F.col("url").alias(column), F.col("id").alias("_id")), [column]).withColumn(column, F.col("_id")).drop("_id")


def reachable(start: DataFrame, edges: DataFrame, calendar_frames: DataFrame, with_events: DataFrame, max_depth: int) -> DataFrame:
    """``root, page``: which pages are read on behalf of which, within ``max_depth`` steps.

    All inputs are pairs of numbers: ``start(url)``, ``edges(url, target)``, ``calendar_frames(url, frame_url)``,
    ``with_events(url)``; no address is joined, compared or moved here.  One round per level; a page's frame counts only when nothing else reachable
    from it had an event.  Each (root, page) pair is kept once, which also ends cycles.
    """
    start = start.select(F.col("url").alias("root"), F.col("url").alias("page"))
    reach = start if max_depth > 0 else start.limit(0)
    for _ in range(max_depth - 1):
        below = write_once(reach)
        # equal targets meet once per page that names them; the reach side is looked up by its root
        by_link = edges.join(below, edges["target"] == below["root"]).select(edges["url"].alias("root"), below["page"])
        here = write_once(start.unionByName(by_link).distinct())
        fruitful = lookup(here, with_events.select(F.col("url").alias("page")), ["page"], "left_semi").select("root").distinct()
        lonely = calendar_frames.join(fruitful, calendar_frames["url"] == fruitful["root"], "left_anti")
        by_frame = lonely.join(below, lonely["frame_url"] == below["root"]).select(lonely["url"].alias("root"), below["page"])
        reach = here.unionByName(by_frame).distinct()
    return reach


def crawl_sections(
    pages: DataFrame, answers: DataFrame, as_of: Column, max_depth: int = 2, roots: DataFrame | None = None,
) -> DataFrame:
    """Events of sections of each root page and of the pages its event-less sections name.

    Pages are read once, whatever the number of roots that reach them; the HTML is not joined.
    Reading goes level by level, so a page gets the greatest depth any path to it leaves.
    """
    sections = section_prompts(pages, as_of).drop("section", "context", "prompt", "html")
    answered = write_once(models.with_answers(sections, answers, "section"))
    events = models.section_events(answered)
    has_event = F.coalesce(V.get_truthy(F.try_parse_json(models.unfenced(F.col("content"))), "title").isNotNull(), F.lit(False))
    known = dictionary(pages)
    named = answered.filter(~has_event).select("url", F.explode("text_urls").alias("target"))
    edges = write_once(numbered(numbered(named.distinct(), known, "target"), known, "url").distinct())
    embedding = write_once(numbered(numbered(frames(pages), known, "frame_url"), known, "url").distinct())
    fruitful = write_once(numbered(events.select(F.col("page_url").alias("url")).distinct(), known, "url"))
    reach = reachable(known.select(F.col("id").alias("url")), edges, embedding, fruitful, max_depth)
    wanted = known if roots is None else known.join(roots.select("url").distinct(), "url", "left_semi")
    reach = lookup(reach, wanted.select(F.col("id").alias("root"), F.col("url").alias("_root")), ["root"])
    pairs = lookup(reach, known.select(F.col("id").alias("page"), F.col("url").alias("page_url")), ["page"]).select(F.col("_root").alias("root"), "page_url")
    return pairs.join(events, "page_url").select("root", *[c for c in events.columns if c != "prompt_key"])
