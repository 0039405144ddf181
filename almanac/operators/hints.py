"""Selector hints: who gives them, what they select, which links they name."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions import selectors as SEL
from almanac.functions.arrays import each
from almanac.functions.html import page_nodes
from almanac.functions.text import bind, strip, windows
from almanac.functions.urls import resolve
from almanac.operators.sections import body_text, element_text, noise_free, within_any

# How chunks of hinted text are put together, and the sizes that count.
CHUNK_MARK = "\n\n---EVENT-CHUNK---\n\n"
CHUNK_LONGER_THAN = 50
SHORTEST_PAGE_TEXT = 200
LONGEST_PAGE_TEXT = 120_000
LONGEST_HINT_HTML = 50_000


def resolve_hints(requests: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """``url, selectors, origin``.  Selectors of the request win over discovered ones.

    ``discovered`` is ``url, event_containers``; a row with an empty list is a discovery that found
    nothing, which is not the same as no row.  Counts, date formats and other hints decide nothing.
    """
    asked = F.col("extraction_hints.content_selectors")
    rows = requests.select("url", F.when(F.size(asked) > 0, asked).alias("_asked"))
    if discovered is None:
        return rows.select("url", F.col("_asked").alias("selectors"), F.when(F.col("_asked").isNotNull(), "request").alias("origin"))
    return rows.join(discovered.select("url", "event_containers"), "url", "left").select(
        "url",
        F.coalesce("_asked", "event_containers").alias("selectors"),
        F.when(F.col("_asked").isNotNull(), "request")
        .when(F.col("event_containers").isNotNull(), "discovered").alias("origin"),
    )


def unsupported_hints(hints: DataFrame) -> DataFrame:
    """Selectors that cannot be used, one row each, so that none is dropped in silence."""
    return hints.select("url", F.posexplode("selectors").alias("selector_pos", "selector")).filter(
        ~F.coalesce(SEL.is_supported(F.col("selector")), F.lit(False))
    )


def _selected(nodes: Column, selector: Column, removed: Column) -> Column:
    hits = SEL.select(nodes, SEL.parse(selector))
    return F.filter(hits, lambda n: ~within_any(n, removed))


def hinted_chunks(nodes: Column, selectors: Column) -> Column:
    """Texts of the hinted elements, selector by selector; an element hit twice appears twice."""

    def of(removed: Column) -> Column:
        per_selector = F.transform(selectors, lambda s: F.transform(
            F.coalesce(_selected(nodes, s, removed), F.slice(nodes, 1, 0)), lambda n: element_text(nodes, n)
        ))
        return F.filter(F.flatten(per_selector), lambda t: F.length(t) > CHUNK_LONGER_THAN)

    return bind(noise_free(nodes), of)


def page_text(nodes: Column, selectors: Column | None = None) -> Column:
    """Hinted chunks when there are any, else the text of the body."""
    plain = strip(body_text(nodes, noise_free(nodes)))
    if selectors is None:
        return plain
    return bind(
        hinted_chunks(nodes, selectors),
        lambda chunks: F.when(F.size(chunks) > 0, F.array_join(chunks, CHUNK_MARK)).otherwise(plain),
    )


def within_budget(text: Column, shortest: int = SHORTEST_PAGE_TEXT, longest: int = LONGEST_PAGE_TEXT) -> Column:
    """The whole text in windows a model can read; NULL for a text too short to hold events."""
    return F.when(F.length(text) >= shortest, windows(text, longest))


def hint_html(html: Column, longest: int = LONGEST_HINT_HTML) -> Column:
    """HTML for hint discovery, without scripts and styles, in windows; one empty window if nothing is left."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)(?=[\s/>])[^>]*+>.*?</\1\s*+>", "")
    return bind(windows(bare, longest), lambda w: F.when(F.size(w) > 0, w).when(html.isNotNull(), F.array(F.lit(""))))


def hinted_links(nodes: Column, selectors: Column, page_url: Column) -> Column:
    """Addresses of links inside hinted containers, absolute, each once, in order of first sight."""
    inside = F.transform(selectors, lambda s: F.transform(
        F.coalesce(
            SEL.select(nodes, F.array_append(SEL.parse(s), SEL.link_inside())),
            F.slice(nodes, 1, 0),
        ),
        lambda n: n["attrs"]["href"],
    ))
    hrefs = F.filter(F.flatten(inside), lambda h: F.coalesce(h, F.lit("")) != "")
    # Equal links would be resolved once each; dropping repeats first keeps the first-seen order as well.
    return F.array_distinct(F.transform(F.array_distinct(hrefs), lambda h: resolve(page_url, h)))


def page_links(pages: DataFrame) -> DataFrame:
    """H19 as rows: pages with ``selectors`` give ``page_id, url, link_pos, event_url``."""
    found = (
        pages.withColumn("_nodes", page_nodes(F.col("html")))
        .withColumn("_links", hinted_links(F.col("_nodes"), F.col("selectors"), F.col("url")))
        .withColumn("_links", F.transform("_links", lambda u: F.struct(u.alias("event_url"))))
    )
    return each(found, ["page_id", "url"], "_links", pos="link_pos")
