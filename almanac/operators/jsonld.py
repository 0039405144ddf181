"""Structured-data events: from script blocks to normalised rows, without a shuffle.

All work on a page happens while its row is in hand.  The events of a page stay in one array until
the rules that look at neighbours (one bad date spoils the page) have been applied, then the array is
exploded into rows.  The HTML itself is dropped before that.

Three reading rules exist, chosen by where the page was met:

* ``direct``   - the page itself: durations count, one unreadable date loses the whole page;
* ``iframe``   - a framed page: no durations, an unreadable date ends its block;
* ``calendar`` - a month page: day-only starts, everything else is left out item by item.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac import schemas
from almanac.functions import variants as V
from almanac.functions.arrays import each
from almanac.functions.html import JSONLD_MARK, jsonld_blocks, read_page, repair_entities
from almanac.functions.ids import external_id
from almanac.functions.isotime import (
    local_time, sql_add_seconds, sql_counts_seconds, sql_duration_seconds, sql_normalise,
)
from almanac.functions.plain import plain_events
from almanac.functions.text import bind, each_item, let, non_empty, strip
from almanac.functions.tolerant import reread
from almanac.functions.urls import resolve

# Fixed value: the one type of object that is an event; subtypes and lists of types are not.
EVENT_TYPE = "Event"
MANY_TITLES = 200  # of a page, beyond which they are not compared with its links one by one
DAYS_BACK = 7  # fixed value: how far before the reference date a month page's events may lie


def _objects(doc: str) -> str:
    """Event objects of a parsed block, as SQL over its name."""
    listed = f"try_variant_get({doc}, '$', 'array<variant>')"
    candidates = (
        f"CASE WHEN {listed} IS NOT NULL THEN {listed}"
        f" WHEN try_variant_get({doc}, \"$['@type']\", 'string') = '{EVENT_TYPE}' THEN array({doc})"
        f" ELSE try_variant_get({doc}, \"$['@graph']\", 'array<variant>') END"
    )
    is_event = f"try_variant_get(o, \"$['@type']\", 'string') = '{EVENT_TYPE}'"
    return f"filter(coalesce({candidates}, CAST(array() AS ARRAY<VARIANT>)), o -> {is_event})"


def event_objects(doc: Column) -> Column:
    """Event objects of one parsed block: of a list, the object itself, or of its ``@graph`` list."""
    return let(doc, f"d -> {_objects('d')}")


def parsed_blocks(html: Column) -> Column:
    """``STRUCT<block_pos, block, doc>`` per block; ``doc`` is NULL where the JSON is broken."""
    return F.transform(
        jsonld_blocks(html),
        lambda b, i: F.struct(i.alias("block_pos"), b.alias("block"), F.try_parse_json(repair_entities(b)).alias("doc")),
    )


def refused(blocks: Column) -> Column:
    """Does the page have a block that the strict parser refuses?"""
    return F.exists(blocks, lambda b: b["doc"].isNull())


def refused_texts(blocks: Column) -> Column:
    """E1, what is read a second time: the refused blocks by their places among all; NULL for pages without any."""
    texts = F.transform(blocks, lambda b: F.when(b["doc"].isNull(), repair_entities(b["block"])))
    return F.when(refused(blocks), texts)


def mended_blocks(blocks: Column, again: Column) -> Column:
    """Blocks with the documents of the second reading (``again``) put in; ``recovered`` marks them."""
    second = lambda i: F.try_parse_json(F.get(again, i))
    return F.transform(blocks, lambda b, i: F.struct(
        b["block_pos"].alias("block_pos"), b["block"].alias("block"), F.coalesce(b["doc"], second(i)).alias("doc"),
        (b["doc"].isNull() & second(i).isNotNull()).alias("recovered"),
    ))


def marked_blocks(html: Column) -> Column:
    """``parsed_blocks`` of pages that name the media type; others are not searched."""
    return parsed_blocks(F.when(html.contains(JSONLD_MARK), html).otherwise(""))


def items_of(blocks: Column) -> Column:
    """E2 for all blocks of a page: ``ARRAY<STRUCT<block_pos, item_pos, item>>``."""
    return F.flatten(each_item(
        blocks,
        f"b -> transform({_objects('b.doc')}, (o, j) -> named_struct('block_pos', b.block_pos, 'item_pos', j, 'item', o))",
    ))


def wants_link(items: Column) -> Column:
    """Is there an event with a title and no URL?  Only then the links of the page matter."""
    return F.coalesce(F.exists(titles_wanted(items), lambda t: t.isNotNull()), F.lit(False))


def titles_wanted(items: Column) -> Column:
    """Per item the title to look for among the links, NULL where the item has an address or no title."""
    read = F.transform(items, lambda i: V.fields(i["item"], "url: string, name: string"))
    return F.transform(read, lambda f: F.when(non_empty(f["url"]).isNull(), F.lower(strip(non_empty(f["name"])))))


def page_links(links: Column) -> Column:
    """Links with an address, in document order, with their lower-case texts."""
    return F.transform(links, lambda a: F.struct(a["href"].alias("href"), F.lower(a["text"]).alias("text")))


def many_titles(items: Column) -> Column:
    """The titles to look for, on pages that have so many that comparing each with every link is no way to do it."""
    return F.when((F.size(items) > MANY_TITLES) & wants_link(items), titles_wanted(items))


def item_links(items: Column, links: Column, hrefs: Column) -> Column:
    """H20 for a whole page: per item the address of the first link that holds its title, NULL where not needed.

    Links and events of a page meet inside its row, so no pairs are written anywhere.  ``hrefs`` are those that were found
    already for ``many_titles``; items of a page that has refused blocks have other places, so they are compared here.
    """
    one_by_one = bind(titles_wanted(items), lambda titles: bind(
        page_links(F.when(F.exists(titles, lambda t: t.isNotNull()), links)), lambda links: F.transform(titles, lambda t: link_for_title(links, t))))
    return F.coalesce(hrefs, one_by_one)


def put_links(items: Column, hrefs: Column) -> Column:
    """Give each item of an array its ``href``; the two arrays run in parallel."""
    return bind(hrefs, lambda h: F.transform(items, lambda i, n: i.withField("href", h[n])))


def with_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``items`` ARRAY<STRUCT<block_pos, item_pos, item, href>>: the page's event objects.

    Only blocks that the strict parser refuses, and pages with an event that needs a link, are handed to Python.
    """
    blocks, strict = F.col("_blocks"), F.col("_strict")
    return (
        pages.withColumn("_blocks", marked_blocks(F.col(html)))
        .withColumn("_strict", items_of(blocks))
        .withColumn("_read", read_page(
            F.when(refused(blocks) | wants_link(strict), F.col(html)), refused_texts(blocks), F.when(~refused(blocks), many_titles(strict)), F.lit(False)))
        .withColumn("items", F.when(refused(blocks), items_of(mended_blocks(blocks, F.col("_read.again")))).otherwise(strict))
        .withColumn("items", put_links(F.col("items"), item_links(F.col("items"), F.col("_read.links"), F.col("_read.hrefs"))))
        .drop("_blocks", "_strict", "_read")
    )


def link_for_title(links: Column, title: Column) -> Column:
    """``href`` of the first of ``page_links`` whose text holds a title in lower case."""
    hits = F.filter(links, lambda a: a["text"].contains(title))
    return F.try_element_at(hits, F.lit(1))["href"]


# ---- times -------------------------------------------------------------------------------------
#
# Each rule is a chain of small steps over the page's array of items; every step is one SQL lambda that
# hands a struct to the next, so nothing is computed twice.


def _text(item: str, key: str) -> str:
    """Value under a key as SQL text, NULL for the empty string."""
    return f"nullif(try_variant_get({item}, '$.{key}', 'string'), '')"


_NAMES = ("startDate", "endDate", "startTime", "doorTime", "endTime", "duration")
_FIELDS = [
    "i -> named_struct('i', i, 'f', try_variant_get(i.item, '$', 'struct<" + ", ".join(f"{n}: string" for n in _NAMES) + ">'))",
    "s -> named_struct('block_pos', s.i.block_pos, 'item_pos', s.i.item_pos, 'item', s.i.item,"
    " 'start_date', nullif(s.f.startDate, ''), 'end_date', nullif(s.f.endDate, ''),"
    " 'start_clock', coalesce(nullif(s.f.startTime, ''), nullif(s.f.doorTime, '')), 'end_clock', nullif(s.f.endTime, ''),"
    " 'duration', nullif(s.f.duration, ''),"
    " 'odd_duration', CASE WHEN s.f.duration IS NULL THEN false ELSE schema_of_variant(try_variant_get(s.i.item, '$.duration', 'variant')) <> 'STRING' END)",
]


def _merge_clock(date: str, clock: str) -> str:
    """Put a separate clock time behind a date that has none."""
    return f"CASE WHEN NOT contains({date}, 'T') AND {clock} IS NOT NULL THEN concat({date}, 'T', {clock}) ELSE {date} END"


def _timed(i: str, start: str, end: str, error: str) -> str:
    return (
        f"named_struct('block_pos', {i}.block_pos, 'item_pos', {i}.item_pos, 'item', {i}.item,"
        f" 'start_time', {start}, 'end_time', {end}, 'error', {error})"
    )


def _merged_steps(durations: bool) -> list[str]:
    """E3-E6 for pages themselves (``durations``) and for framed pages."""
    steps = [f"i -> named_struct('i', i, 'start_raw', {_merge_clock('i.start_date', 'i.start_clock')})"]
    if durations:
        in_seconds = sql_counts_seconds("s.i.duration")
        steps += [
            # a duration counts when nothing else says when the event ends
            "s -> named_struct('i', s.i, 'start_raw', s.start_raw,"
            " 'counted', s.i.end_clock IS NULL AND s.i.duration IS NOT NULL AND s.start_raw IS NOT NULL,"
            f" 'seconds', CASE WHEN NOT s.i.odd_duration AND {in_seconds} THEN {sql_duration_seconds('s.i.duration')} END)",
            "s -> named_struct('i', s.i, 'start_raw', s.start_raw,"
            f" 'bad_duration', s.counted AND (s.i.odd_duration OR ({in_seconds} AND s.seconds IS NULL)),"
            f" 'day', coalesce(CASE WHEN s.counted AND s.seconds IS NOT NULL AND contains(s.start_raw, 'T') THEN {sql_add_seconds('s.start_raw', 's.seconds')} END, s.i.end_date))",
        ]
        own_day = "concat(split(s.start_raw, 'T')[0], 'T', s.i.end_clock)"
    else:
        steps.append("s -> named_struct('i', s.i, 'start_raw', s.start_raw, 'bad_duration', false, 'day', s.i.end_date)")
        own_day = "CAST(NULL AS STRING)"
    return steps + [
        "s -> named_struct('i', s.i, 'start_raw', s.start_raw, 'bad_duration', s.bad_duration,"
        f" 'end_raw', CASE WHEN s.day IS NULL THEN {own_day} ELSE {_merge_clock('s.day', 's.i.end_clock')} END)",
        "s -> named_struct('i', s.i, 'start_raw', s.start_raw, 'bad_duration', s.bad_duration, 'end_raw', s.end_raw,"
        f" 'start_time', {sql_normalise('s.start_raw')}, 'end_time', {sql_normalise('s.end_raw', end=True)})",
        "s -> " + _timed(
            "s.i", "s.start_time", "s.end_time",
            "CASE WHEN coalesce(s.start_raw, '') <> '' AND s.start_time IS NULL THEN 'unreadable_start'"
            " WHEN s.bad_duration THEN 'unreadable_duration'"
            " WHEN coalesce(s.end_raw, '') <> '' AND s.end_time IS NULL THEN 'unreadable_end' END",
        ),
    ]


def _calendar_steps(repair: bool) -> list[str]:
    """Day-only starts.  With ``repair`` other readable starts are normalised instead of left out."""
    by_duration = f"CASE WHEN {sql_counts_seconds('s.i.duration')} THEN concat({sql_add_seconds('s.start_time', 's.seconds')}, '+00:00') END"
    day = "coalesce(s.i.end_date, s.i.start_date)"
    end = (
        f"CASE WHEN s.i.end_clock IS NOT NULL THEN concat({day}, 'T', s.i.end_clock, '+00:00')"
        f" ELSE coalesce({by_duration}, concat({day}, 'T23:59:59+00:00')) END"
    )
    error = (
        "CASE WHEN s.i.start_date IS NULL THEN 'no_start' WHEN NOT s.simple THEN 'unsupported_start'"
        " WHEN s.i.end_clock IS NULL AND s.i.duration IS NOT NULL AND s.i.odd_duration THEN 'unreadable_duration' END"
    )
    steps = [
        "i -> named_struct('i', i, 'simple', length(i.start_date) = 10 AND length(replace(i.start_date, '-', '')) = 8,"
        f" 'seconds', {sql_duration_seconds('i.duration')},"
        " 'start_time', concat(i.start_date, 'T', coalesce(i.start_clock, '00:00:00'), '+00:00'))",
        "s -> " + _timed("s.i", "s.start_time", end, error) if not repair
        else f"s -> named_struct('i', s.i, 'start_time', s.start_time, 'end_time', {end}, 'error', {error},"
             f" 'start_raw', {_merge_clock('s.i.start_date', 's.i.start_clock')}, 'end_raw', {_merge_clock('s.i.end_date', 's.i.end_clock')})",
    ]
    if repair:
        steps += [
            "s -> named_struct('i', s.i, 'start_time', s.start_time, 'end_time', s.end_time, 'error', s.error, 'end_raw', s.end_raw,"
            f" 'mended', CASE WHEN s.error = 'unsupported_start' THEN {sql_normalise('s.start_raw')} END)",
            "s -> " + _timed(
                "s.i", "coalesce(s.mended, s.start_time)",
                f"CASE WHEN s.mended IS NULL THEN s.end_time ELSE {sql_normalise('s.end_raw', end=True)} END",
                "CASE WHEN s.mended IS NULL THEN s.error END",
            ),
        ]
    return steps


def read_times(items: Column, rule: str, repair: bool = False) -> Column:
    """Items with ``start_time``, ``end_time`` and ``error`` under one of the three reading rules, in parallel to ``items``."""
    steps = _calendar_steps(repair) if rule == "calendar" else _merged_steps(durations=rule == "direct")
    for step in [*_FIELDS, *steps]:
        items = each_item(items, step)
    return items


def read_linked(items: Column, rule: str, repair: bool = False) -> Column:
    """``read_times`` for items that have their ``href`` already."""
    return bind(items, lambda all_items: put_links(
        read_times(all_items, rule, repair), F.transform(all_items, lambda i: i["href"])
    ))


def surviving(timed: Column, rule: str, on_error: str = "page") -> Column:
    """The items that stay once the reading rule's view of errors is applied."""

    def apply(all_items: Column) -> Column:
        good = F.filter(all_items, lambda t: t["error"].isNull())
        if rule == "direct" and on_error == "page":
            return F.when(F.exists(all_items, lambda t: t["error"].isNotNull()), F.slice(all_items, 1, 0)).otherwise(all_items)
        if rule == "iframe":
            # items come in order, so the first bad one of a block is the bad one that follows another block's
            bad = F.filter(all_items, lambda t: t["error"].isNotNull())
            ends = bind(bad, lambda spoilt: F.map_from_entries(F.transform(
                F.filter(spoilt, lambda b, i: (i == 0) | (F.get(spoilt, i - 1)["block_pos"] != b["block_pos"])),
                lambda b: F.struct(b["block_pos"], b["item_pos"]),
            )))
            return bind(ends, lambda end: F.filter(good, lambda t: F.coalesce(t["item_pos"] < F.try_element_at(end, t["block_pos"]), F.lit(True))))
        return good

    return bind(timed, apply)


def recent(timed: Column, as_of: Column) -> Column:
    """Leave out month-page events more than a week before ``as_of``; an unreadable start stays."""
    floor = as_of.cast("timestamp_ntz") - F.expr(f"INTERVAL {DAYS_BACK} DAYS")
    return F.filter(timed, lambda t: F.coalesce(local_time(t["start_time"]) >= floor, F.lit(True)))


# ---- the record --------------------------------------------------------------------------------


_IS_PLACE = "schema_of_variant(s) LIKE 'OBJECT%' AND try_variant_get(s, \"$['@type']\", 'string') = 'Place'"
_PLACE = (
    "named_struct('type', try_variant_get(s, \"$['@type']\", 'string'), "
    + ", ".join(f"'{k}', try_variant_get(s, '$.{k}', 'string')" for k in ("name", "address", "telephone", "url"))
    + ", 'raw', to_json(s))"
)
_NAMED = (
    f"coalesce({_text('s', 'name')}, CASE WHEN try_variant_get(s, '$.address', 'variant') IS NULL THEN ''"
    " ELSE try_variant_get(s, '$.address', 'string') END)"
)
_LOCATION = (
    f"s -> CASE WHEN {_IS_PLACE} THEN named_struct('kind', 'place', 'text', CAST(NULL AS STRING), 'place', {_PLACE})"
    f" ELSE named_struct('kind', 'text', 'text', CASE WHEN schema_of_variant(s) LIKE 'OBJECT%' THEN {_NAMED}"
    f" WHEN schema_of_variant(s) = 'STRING' THEN try_variant_get(s, '$', 'string') ELSE '' END, 'place', CAST(NULL AS {schemas.PLACE})) END"
)
_SPOT = (
    "v -> CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN CASE WHEN schema_of_variant(try_variant_get(v, '$[0]', 'variant')) LIKE 'OBJECT%'"
    " THEN try_variant_get(v, '$[0]', 'variant') END ELSE v END"
)


def location(value: Column) -> Column:
    """Text, or a whole Place; of a list the first object counts."""
    return let(let(value, _SPOT), _LOCATION)


def organizer(value: Column) -> Column:
    """The name of an object, a text as it is, '' for anything else."""
    return F.when(V.kind(value) == "OBJECT", V.get_or(value, "name")).when(
        V.kind(value) == "STRING", V.text(value)
    ).otherwise("")


_RECORD = "`@id`: string, url: string, name: variant, description: string, location: variant, organizer: variant, eventStatus: variant, eventAttendanceMode: variant"


def explode_events(df: DataFrame, timed: str, base_url: str, keep: list[str], link: Column | None = None) -> DataFrame:
    """One row per item of the array column ``timed``, with the event's fields.

    ``seq`` is the event's position on the page it was read from.  ``link`` says where an event without
    a URL may take the one of a link with its title (E10).
    """
    link = F.lit(True) if link is None else link
    rows = each(df, [*keep, F.col(base_url).alias("_base"), link.alias("_link")], timed, pos="seq").withColumn("_f", V.fields(F.col("item"), _RECORD))
    return _records(rows, keep)


def _records(rows: DataFrame, keep: list[str], plain: str | None = None) -> DataFrame:
    """The fields of events, out of the object ``_f`` or, where it is there, out of the struct ``plain`` that has them already."""
    read, start, title = F.col("_f"), F.col("start_time"), F.col("_title")
    own, by_title = F.col("_own"), F.when(F.col("_link"), resolve(F.col("_base"), F.col("href")))

    def either(field: str, other: Column) -> Column:
        return other if plain is None else F.when(F.col(plain).isNotNull(), F.col(plain)[field]).otherwise(other)

    spot = location(read["location"])
    if plain is not None:
        written = F.col(plain)["location_text"]
        spot = F.when(written.isNotNull(), F.struct(F.lit("text").alias("kind"), written.alias("text"), F.lit(None).cast(schemas.PLACE).alias("place"))).otherwise(
            location(F.coalesce(read["location"], F.try_parse_json(F.col(plain)["location_json"]))))
    rows = rows.withColumns({"_title": either("title", V.text_or(read["name"])), "_own": either("own_url", non_empty(read["url"]))})
    return rows.select(
        *keep,
        "seq",
        "block_pos",
        "item_pos",
        F.coalesce(either("id", non_empty(read["@id"])), own, external_id(F.col("_base"), title, start)).alias("external_id"),
        title.alias("title"),
        F.coalesce(either("description", read["description"]), F.lit("")).alias("description"),
        spot.alias("location"),
        "start_time",
        "end_time",
        F.coalesce(own, by_title, F.col("_base")).alias("url"),
        either("organizer", organizer(read["organizer"])).alias("organizer"),
        either("event_status", V.text_or(read["eventStatus"])).alias("event_status"),
        either("event_attendance_mode", V.text_or(read["eventAttendanceMode"])).alias("event_attendance_mode"),
    )


def page_events(pages: DataFrame, on_error: str = "page") -> DataFrame:
    """Events that pages carry themselves (E1-E11): scan, regular expression, JSON, explode.  No shuffle.

    ``on_error='page'`` gives up a page with an unreadable date, ``'item'`` only the event concerned.  Plain pages, which have
    no such date, are read by ``plain_events``; what it leaves goes through ``with_items`` and the reading rule.
    """
    keep = [c for c in pages.columns if c not in ("html", "url")]
    marked = pages.filter(F.col("html").contains(JSONLD_MARK)).withColumnRenamed("url", "page_url")
    plain, timed = F.col("_plain"), F.col("_t")
    odd = marked.withColumn("_plain", plain_events(F.col("html"))).withColumn("html", F.when(plain.isNull(), F.col("html")))
    read = with_items(odd).withColumn("_t", F.when(plain.isNull(), surviving(read_linked(F.col("items"), "direct"), "direct", on_error)))
    # each event is either of the two; the other is NULL
    both = F.when(plain.isNull(), F.transform(timed, lambda t: F.struct(t.alias("t"), F.get(plain, F.lit(-1)).alias("p")))).otherwise(
        F.transform(plain, lambda p: F.struct(F.get(timed, F.lit(-1)).alias("t"), p.alias("p"))))
    rows = each(read.withColumn("_e", both), [*keep, "page_url", F.col("page_url").alias("_base"), F.lit(True).alias("_link")], "_e", pos="seq")
    shared = {c: F.coalesce(F.col("p")[c], F.col("t")[c]) for c in ("block_pos", "item_pos", "start_time", "end_time", "href")}
    return _records(rows.withColumns(shared | {"_f": V.fields(F.col("t.item"), _RECORD)}), keep + ["page_url"], "p")


def rejected_events(pages: DataFrame) -> DataFrame:
    """Quarantine: broken blocks and events with unreadable times, one row each with the reason.

    Blocks that only the second reading could make sense of are listed too, as ``recovered``; their events are used.
    """
    marked = pages.filter(F.col("html").contains(JSONLD_MARK)).select("page_id", "url", "html")
    read = marked.withColumn("_blocks", parsed_blocks(F.col("html"))).withColumn("_again", reread(refused_texts(F.col("_blocks"))))
    blocks = read.withColumn("_blocks", mended_blocks(F.col("_blocks"), F.col("_again")))
    broken = F.transform(
        F.filter("_blocks", lambda b: b["doc"].isNull() | b["recovered"]),
        lambda b: F.struct(b["block_pos"].alias("block_pos"), F.lit(None).cast("int").alias("item_pos"),
                           F.when(b["recovered"], "recovered").otherwise("strict_json").alias("reason"), b["block"].alias("content")),
    )
    items = items_of(F.col("_blocks"))
    late = F.transform(
        F.filter(read_times(items, "direct"), lambda t: t["error"].isNotNull()),
        lambda t: F.struct(t["block_pos"].alias("block_pos"), t["item_pos"].alias("item_pos"),
                           t["error"].alias("reason"), F.to_json(t["item"]).alias("content")),
    )
    return each(blocks.withColumn("_rejects", F.concat(broken, late)), ["page_id", "url"], "_rejects")
