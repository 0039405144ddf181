"""Following frames and month pages: which page leads to which, and the events found there."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions import urls
from almanac.functions.html import elements, page_nodes, read_page, title
from almanac.functions.joins import dealt, lookup
from almanac.functions.text import bind, each_item, non_empty
from almanac.operators import jsonld
from almanac.operators.hints import page_text

_LINKS = "array<struct<target_url:string,method:string,source_ord:int>>"


def has_frame(html: Column) -> Column:
    return html.rlike(r"(?i)<iframe[\s/>]")


def first_frame(nodes: Column, page_url: Column) -> Column:
    """H3: address of the first frame of a page; NULL when that one frame has no source."""
    src = F.try_element_at(elements(nodes, "iframe"), F.lit(1))["attrs"]["src"]
    return urls.resolve(page_url, non_empty(src))


def calendar_frame(nodes: Column, page_url: Column) -> Column:
    """H4: address of the first frame whose source names a calendar."""
    hits = F.filter(
        F.transform(elements(nodes, "iframe"), lambda n: n["attrs"]["src"]),
        lambda s: (F.coalesce(s, F.lit("")) != "") & urls.is_calendar_frame(s),
    )
    return urls.resolve(page_url, F.try_element_at(hits, F.lit(1)))


def page_frames(pages: DataFrame) -> DataFrame:
    """H3, H4: ``page_id, url, frame_url, calendar_frame_url`` of the pages that have a frame."""
    trees = pages.filter(has_frame(F.col("html"))).withColumn("_nodes", page_nodes(F.col("html")))
    return trees.select(
        "page_id", "url",
        first_frame(F.col("_nodes"), F.col("url")).alias("frame_url"),
        calendar_frame(F.col("_nodes"), F.col("url")).alias("calendar_frame_url"),
    )


def outgoing(page_url: Column, frame_url: Column, as_of: Column, months: int = 2) -> Column:
    """Links a page follows: its frame, then the month pages of its calendar.

    The frame is the calendar if it looks like one, else the page itself is.
    """
    frame = F.when(
        frame_url.isNotNull(),
        F.array(F.struct(frame_url.alias("target_url"), F.lit("iframe").alias("method"), F.lit(1).alias("source_ord"))),
    )
    base = F.when(urls.is_calendar(frame_url), frame_url).when(urls.is_calendar(page_url), page_url)
    monthly = bind(base, lambda b: F.transform(
        urls.month_urls(b, as_of, months),
        lambda u, i: F.struct(u.alias("target_url"), F.lit("calendar").alias("method"), (i + 2).alias("source_ord")),
    ))
    none = F.expr(f"cast(array() as {_LINKS})")
    return F.concat(F.coalesce(frame, none), F.coalesce(monthly, none)).cast(_LINKS)


def survey(pages: DataFrame, as_of: Column, on_error: str = "page", with_text: bool = False, months: int = 2) -> DataFrame:
    """One pass over the HTML.  A narrow row per page with everything the joins need:

    ``items`` (event objects found, with their times under the direct rule; ``own_items`` picks the page's
    own events out of them), ``failed``, ``links`` (what to follow, nothing when the page failed), ``frame_url``.  ``with_text`` adds the ``title`` and, for
    pages without events of their own and without a frame, the ``text`` a model would read.
    """
    html, nodes, blocks = F.col("html"), F.col("_nodes"), F.col("_blocks")

    def is_spoilt(timed: Column) -> Column:
        return F.coalesce(F.exists(timed, lambda t: t["error"].isNotNull()) if on_error == "page" else F.lit(False), F.lit(False))

    def is_barren(items: Column, failed: Column) -> Column:
        return failed | (F.coalesce(F.size(items), F.lit(0)) <= 0)

    # What the strict parser makes of a page decides whether its nodes are needed; pages with a refused block
    # get them in any case, as their second reading comes with the same trip to Python.
    read = (
        pages.withColumn("_blocks", jsonld.marked_blocks(html))
        .withColumn("items", jsonld.items_of(blocks))
        .withColumn("_refused", jsonld.refused(blocks))
        .withColumn("_timed", jsonld.read_times(F.col("items"), "direct"))
        .withColumn("_barren", is_barren(F.col("items"), is_spoilt(F.col("_timed"))))
    )
    needs_nodes = has_frame(html)
    if with_text:
        needs_nodes = needs_nodes | F.col("_refused") | F.col("_barren")
    needs_links = F.col("_refused") | jsonld.wants_link(F.col("items"))
    read = (
        read.withColumn("_read", read_page(
            F.when(needs_nodes | needs_links, html), jsonld.refused_texts(blocks), F.when(~F.col("_refused"), jsonld.many_titles(F.col("items"))),
            F.coalesce(needs_nodes, F.lit(False))))
        .withColumn("_nodes", F.col("_read.nodes"))
        .withColumn("items", F.when(F.col("_refused"), jsonld.items_of(jsonld.mended_blocks(blocks, F.col("_read.again")))).otherwise(F.col("items")))
        .withColumn("_timed", F.when(F.col("_refused"), jsonld.read_times(F.col("items"), "direct")).otherwise(F.col("_timed")))
        .withColumn("failed", is_spoilt(F.col("_timed")))
        .withColumn("_barren", is_barren(F.col("items"), F.col("failed")))
        .withColumn("frame_url", first_frame(nodes, F.col("url")))
    )
    if with_text:
        asks = F.when(F.col("_barren") & F.col("frame_url").isNull(), nodes)
        read = read.withColumn("title", title(html)).withColumn("text", page_text(asks))
    linked = (
        read.withColumn("items", jsonld.put_links(F.col("_timed"), jsonld.item_links(F.col("items"), F.col("_read.links"), F.col("_read.hrefs"))))
        .withColumn("links", F.when(
            F.col("failed"), F.expr(f"cast(array() as {_LINKS})")
        ).otherwise(outgoing(F.col("url"), F.col("frame_url"), as_of, months)))
    )
    return linked.drop("_timed", "_barren", "_blocks", "_read", "_nodes", "_refused", "html")


def own_items(items: Column, on_error: str = "page") -> Column:
    """The items of a surveyed page that are events of its own."""
    return jsonld.surviving(items, "direct", on_error)


def newest(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One row for each ``by``, that of the greatest ``page_id``: a page fetched again replaces the earlier one."""
    chosen = F.max_by(F.struct(*values), F.col("page_id")).alias("_newest")
    return rows.groupBy(*by).agg(chosen).select(*by, *(F.col(f"_newest.{v}").alias(v) for v in values))


def latest_of(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The rows of the newest page of each address, with ``address``; only of ``wanted`` ones, if any are named.

    Which page that is gets settled on page numbers alone, so what the rows hold is neither sorted nor shuffled for pages
    that are passed over.
    """
    addressed = rows.withColumn("address", urls.address(F.col("url")))
    numbers = addressed.select("address", "page_id")
    if wanted is not None:
        numbers = numbers.join(dealt(wanted.select("address").distinct()), "address", "left_semi")
    numbers = numbers.groupBy("address").agg(F.max("page_id").alias("page_id"))
    return addressed.join(dealt(numbers), ["address", "page_id"]).dropDuplicates(["address", "page_id"])


def targets(surveyed: DataFrame, pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """What a followed link finds, one row for each ``address``, with ``items, frame_items, frame_rule``.

    Of several pages of one address the newest counts, also where it holds no items.  A framed page counts as rendered.  When ``pages`` has a ``rendered`` column it is read instead, and
    pages without a rendered form are read by the direct rule.  ``wanted`` (``address``) names the addresses that links lead to;
    other pages are then left alone.
    """
    bare = "i -> named_struct('block_pos', i.block_pos, 'item_pos', i.item_pos, 'item', i.item, 'href', i.href)"
    latest = latest_of(surveyed.select("url", "page_id", "items"), wanted)
    plain = latest.filter(F.size("items") > 0).select("address", each_item(F.col("items"), bare).alias("items"))
    if "rendered" not in pages.columns:
        return plain.select("address", "items", F.col("items").alias("frame_items"), F.lit("iframe").alias("frame_rule"))
    drawn_pages = pages.filter(F.col("rendered").isNotNull()).select("page_id", "url", "rendered")
    drawn = jsonld.with_items(latest_of(drawn_pages, wanted), html="rendered").select(
        "address", F.col("items").alias("_drawn"), F.lit(True).alias("_is_drawn"))
    is_drawn = F.coalesce("_is_drawn", F.lit(False))
    return plain.join(drawn, "address", "full_outer").select(
        "address", "items",
        F.when(is_drawn, F.col("_drawn")).otherwise(F.col("items")).alias("frame_items"),
        F.when(is_drawn, "iframe").otherwise("direct").alias("frame_rule"),
    )


def addresses(links: DataFrame) -> DataFrame:
    """The different addresses that links lead to."""
    return links.select(urls.address(F.col("target_url")).alias("address")).distinct()


def followed_events(links: DataFrame, found: DataFrame, as_of: Column, keep: list[str], repair: bool = False) -> DataFrame:
    """Events behind the links.  One equi-join on the address, without fragments, serves frames and months alike.

    Each target is one row, so a calendar that a third of all pages embed is hot on the link side only;
    adaptive execution splits that side.  Each month page is met under the calendar rule.
    """
    joined = lookup(links.withColumn("address", urls.address(F.col("target_url"))), found, ["address"])
    frame = F.col("method") == "iframe"
    by_rule = (
        F.when(frame & (F.col("frame_rule") == "iframe"), jsonld.surviving(jsonld.read_linked(F.col("frame_items"), "iframe"), "iframe"))
        .when(frame, jsonld.surviving(jsonld.read_linked(F.col("frame_items"), "direct"), "direct"))
        .otherwise(jsonld.recent(jsonld.surviving(jsonld.read_linked(F.col("items"), "calendar", repair), "calendar"), as_of))
    )
    timed = joined.withColumn("_t", by_rule)
    return jsonld.explode_events(
        timed, "_t", "target_url", keep + ["target_url", "method", "source_ord"],
        link=~(frame & (F.col("frame_rule") == "iframe")),
    )


def own_events(surveyed: DataFrame, keep: list[str], on_error: str = "page") -> DataFrame:
    rows = surveyed.withColumns({
        "target_url": F.col("page_url"), "method": F.lit("jsonld"), "source_ord": F.lit(0),
        "_own": own_items(F.col("items"), on_error),
    })
    return jsonld.explode_events(rows, "_own", "page_url", keep + ["target_url", "method", "source_ord"])


def all_jsonld_events(
    surveyed: DataFrame, pages: DataFrame, as_of: Column, repair: bool = False, on_error: str = "page",
) -> DataFrame:
    """Events of a page, of its frame and of its month pages, one under the other, none removed.

    ``on_error`` is the one the survey was made with.
    """
    keep = ["page_id", "page_url"] + [c for c in ("source_id",) if c in surveyed.columns]
    named = surveyed.withColumn("page_url", F.col("url"))
    links = named.select(*keep, F.inline("links"))
    return own_events(named, keep, on_error).unionByName(
        followed_events(links, targets(surveyed, pages, addresses(links)), as_of, keep, repair)
    )
