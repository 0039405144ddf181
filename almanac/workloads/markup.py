"""Pages as markup: links, titles, addresses on the supplied pages; sections, hints and frames on written ones."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.functions import urls
from almanac.functions.arrays import each
from almanac.functions.html import anchors, page_nodes, title
from almanac.functions.text import names_a_date
from almanac.operators import hints, sections
from almanac.sources.tables import read_pages
from almanac.workloads.common import derived, table, text

# ---- the supplied pages -----------------------------------------------------------------------


def page_source(spark, sf_dir):
    table(spark, sf_dir, "pages")
    return read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", F.length("html").alias("length"))


def page_anchors(spark, sf_dir):
    trees = table(spark, sf_dir, "pages").withColumn("nodes", page_nodes(F.col("html"))).withColumn("links", anchors(F.col("nodes")))
    return each(trees, ["page_id"], "links", pos="link_pos").select("page_id", "link_pos", "href", "text")


def node_table(spark, sf_dir):
    """The node table of all pages, summed up per kind and tag."""
    trees = table(spark, sf_dir, "pages").withColumn("nodes", page_nodes(F.col("html")))
    nodes = each(trees, ["page_id"], "nodes").filter(F.col("kind") == "element")
    return nodes.groupBy("tag").agg(F.count(F.lit(1)).alias("elements"), F.count_distinct("page_id").alias("pages"))


def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", title(F.col("html")).alias("title"))


def page_body_text(spark, sf_dir):
    trees = table(spark, sf_dir, "pages").withColumn("nodes", page_nodes(F.col("html")))
    return trees.select("page_id", sections.body_text(F.col("nodes"), sections.noise_free(F.col("nodes"))).alias("text"))


def text_budget(spark, sf_dir):
    """Hashes of the windows in which a model would get texts; long texts are each document eight times over."""
    doc = F.col("text")
    long = F.concat(*[doc] * 8)
    kinds = {
        "plain": hints.within_budget(doc), "long": hints.within_budget(long),
        "html": hints.hint_html(F.concat(F.lit("<script>s</script>"), long)),
    }
    read = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), w.alias("pieces")) for k, w in kinds.items()])).alias("k")
    )
    pieces = read.select("doc_id", "k.kind", F.posexplode("k.pieces").alias("piece", "text"))
    return pieces.select("doc_id", "kind", "piece", F.sha2("text", 256).alias("content_key"))


_BARE = "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs')"
_BODY = f"regexp_replace(regexp_replace(regexp_extract({_BARE}, '<body>(.*)', 1, 's'), '<nav>.*?</nav>', '<x>', 's'), '<footer>.*?</footer>', '<x>', 's')"


def _unescape(expression: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        expression = f"replace({expression}, '{entity}', '{char}')"
    return expression


_WINDOW = """CASE WHEN {at} + size > length(t) THEN length(t) - {at} + 1
  ELSE size - greatest(strpos(reverse(substr(t, {at}, size)), chr(10)) - 1, 0) END"""
_PIECE_STRIP = "'^\\s+|\\s+$'"

# ---- addresses --------------------------------------------------------------------------------

C = text("c_custkey")
BASE = f"'https://host' || {text('c_custkey % 40')} || '.example.org/a/b/' || {C} || '?page=2'"
_SITE = f"'https://host' || {text('c_custkey % 40')} || '.example.org'"
REFERENCE = f"""CASE c_custkey % 12 WHEN 0 THEN 'http://other.example.com/x?q=1#top' WHEN 1 THEN '//cdn.example.com/x' WHEN 2 THEN '/root/' || {C}
  WHEN 3 THEN 'leaf' WHEN 4 THEN '../up' WHEN 5 THEN '../../../over' WHEN 6 THEN '?q=' || {C} WHEN 7 THEN '#part' WHEN 8 THEN ''
  WHEN 9 THEN 'mailto:x@example.org' WHEN 10 THEN './x/../y//z/' ELSE 'HTTPS:' || '//Host/Path/../p' END"""


def url_resolution(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{BASE} AS base", f"{REFERENCE} AS ref")
    return rows.select("id", urls.resolve(F.col("base"), F.col("ref")).alias("resolved"))


CALENDAR_URL = f"""CASE c_custkey % 6 WHEN 0 THEN {_SITE} || '/calendar/' || {C} WHEN 1 THEN {_SITE} || '/events' WHEN 2 THEN {_SITE} || '/EVENTS/' || {C}
  WHEN 3 THEN 'https://town.AssabetInteractive.com/x' WHEN 4 THEN {_SITE} || '/calendar' ELSE {_SITE} || '/calendars/' END"""


def calendar_addresses(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{CALENDAR_URL} AS url")
    return rows.select("id", urls.is_calendar(F.col("url")).alias("is_calendar"))


MONTH_BASE = """CASE o_orderkey % 4 WHEN 0 THEN 'https://cal.example.org/events/' WHEN 1 THEN 'https://cal.example.org/events'
  WHEN 2 THEN 'https://cal.example.org/events/2024/may/' ELSE 'https://cal.example.org/events/2025-october/' END"""


def month_addresses(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{MONTH_BASE} AS base", "CAST(o_orderdate AS DATE) AS as_of")
    return rows.select("id", F.posexplode(urls.month_urls(F.col("base"), F.col("as_of"))).alias("month_pos", "month_url"))


# ---- dates and addresses in text ---------------------------------------------------------------

E = text("event_id")
PHRASES = [
    ("due 12/25/2024", True), ("due 1-2-24", True), ("at 2:30 PM", True), ("at 14:05", True), ("in OCTOBER", True), ("on Thu", True),
    ("the 3rd", True), ("we may", True), ("sunshine", False), ("ratio 1:2", False), ("marching", False), ("in 2024", False),
    ("Monday''s", True), ("x12:30y", False),
]
PHRASE = f"CASE event_id % {len(PHRASES)} " + " ".join(f"WHEN {n} THEN 'Note {p} '" for n, (p, _) in enumerate(PHRASES)) + f" END || 'no ' || {E}"


def date_words(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{PHRASE} AS phrase")
    return rows.select("event_id", names_a_date(F.col("phrase")).alias("names_a_date"))


URL_TEXT = f"'See http://a.example.org/x~' || {E} || ' and \"https://b.example.org/p?q=' || {E} || '#z\", https://b.example.org/p?q=' || {E} || '. Or https://b.example.org/p?q=' || {E} || ' {{again}} httpx://no'"


def text_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{URL_TEXT} AS t")
    return rows.select("event_id", F.posexplode(urls.in_text(F.col("t"))).alias("url_pos", "found"))


# ---- sections ---------------------------------------------------------------------------------

# Opening and closing tag of the main container, by rank of the selector it meets.
CONTAINERS = [
    ('<article class="x calendar-y">', "</article>"), ('<div class="calendar-item">', "</div>"), ('<div class="a event-item">', "</div>"),
    ('<p class="b views-row">', "</p>"), ('<p class="node-event">', "</p>"), ('<span class="myevent">', "</span>"),
    ('<p class="calendarish">', "</p>"), ('<p class="schedule">', "</p>"), ('<p class="program">', "</p>"), ('<p class="activity">', "</p>"),
    ('<p id="event-1">', "</p>"), ('<p id="calendar-1">', "</p>"), ('<p id="schedule-1">', "</p>"),
    ("<article>", "</article>"), ("<section>", "</section>"), ("<li>", "</li>"),
]
RANK = "(1 + event_id % 16)"
LENGTHS = [49, 50, 51, 5000, 5001]
LENGTH = "CASE user_id % 5 " + " ".join(f"WHEN {n} THEN {size}" for n, size in enumerate(LENGTHS)) + " END"
MAIN = f"rpad('Concert ' || {E} || ' on 12/25/2024 ', {LENGTH}, 'x')"
PAGE_URL = f"'https://town' || {text('event_id % 30')} || '.example.org/news/' || {E}"
_OPEN = f"CASE {RANK} " + " ".join(f"WHEN {n + 1} THEN '{o}'" for n, (o, _) in enumerate(CONTAINERS)) + " END"
_CLOSE = f"CASE {RANK} " + " ".join(f"WHEN {n + 1} THEN '{c}'" for n, (_, c) in enumerate(CONTAINERS)) + " END"
ITEM = f"'Reading no ' || {E} || ' on Friday evening in the old library hall'"
LINKS = [
    '<a href="mailto:m@x">m@x</a><a href="#top">Top</a><a href="/plain/1">Plain</a><a href="d/1">Event <i>details</i></a>',
    '<a href="#top">Top</a><a href="../plain/1">Plain</a>',
    '<a href="/other">Other</a><a href="https://city.example.org/node/7">More</a>',
    '<a href="tel:1">Call</a><a>nowhere</a><a href=""></a>',
]
LINK_TEXTS = ["m@x|Top|Plain|Event|details", "Top|Plain", "Other|More", "Call|nowhere"]
_LINK_HTML = "CASE event_id % 4 " + " ".join(f"WHEN {n} THEN '{markup}'" for n, markup in enumerate(LINKS)) + " END"
TALK = f"'Talk ' || {E} || ' on Monday 10:00, see http://t.example.org/' || {E} || '~b and https://u.example.org/p?q=' || {E} || '#z'"
_BEFORE = "CASE event_id % 3 WHEN 0 THEN '<h3>Sunday</h3>' WHEN 1 THEN '<h3>Sunday</h3> <p>a</p> ' ELSE '<h3>June 3rd</h3><h4>10:30 am</h4>' END"
_TWIN = f"'<section class=\"s\">' || {TALK} || '<noscript>Tuesday</noscript></section>'"
SECTION_HTML = (
    f"'<html><body>' || {_OPEN} || {MAIN} || {_CLOSE} || '<li>' || rpad('', 60, 'z') || '</li><hr><hr><hr>'"
    f" || '<div class=\"event-outer\"><script>June</script><li class=\"inner part\">' || {ITEM} || '</li>' || {_LINK_HTML} || '</div><hr><hr><hr>'"
    f" || {_BEFORE} || {_TWIN} || {_TWIN} || '</body></html>'"
)
SELECTORS = "array('div.event-outer', '[class*=inner]', 'section', 'main > x', '.event-outer li.part')"


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return table(spark, sf_dir, "events").selectExpr("event_id AS page_id", f"{PAGE_URL} AS url", f"{SECTION_HTML} AS html")

    return derived(spark, sf_dir, "section_pages", build)


def hinted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_pages(spark, sf_dir).withColumn("selectors", F.expr(SELECTORS))


def container_candidates(spark, sf_dir):
    trees = section_pages(spark, sf_dir).withColumn("nodes", page_nodes(F.col("html"), signatures=True))
    found = trees.withColumn("found", sections.candidates(F.col("nodes")))
    return each(found, ["page_id"], "found").groupBy("page_id", "rank").agg(F.count(F.lit(1)).alias("n"))


def passed_over_sections(spark, sf_dir):
    return sections.passed_over_sections(section_pages(spark, sf_dir)).select("page_id", "rank", "length", "reason")


def section_ranks(spark, sf_dir):
    return sections.page_sections(section_pages(spark, sf_dir)).select("page_id", "section_pos", "rank", "tag")


def section_texts(spark, sf_dir):
    return sections.page_sections(section_pages(spark, sf_dir)).select("page_id", "section_pos", "section")


def section_texts_over_50(spark, sf_dir):
    found = sections.page_sections(section_pages(spark, sf_dir), min_length=sections.SECTION_MIN_TEXT)
    return found.select("page_id", "section_pos", F.length("section").alias("length"))


def outermost_sections(spark, sf_dir):
    trees = section_pages(spark, sf_dir).withColumn("nodes", page_nodes(F.col("html"), signatures=True))
    found = trees.withColumn("found", sections.candidates(F.col("nodes"))).withColumn("found", sections.outermost_candidates(F.col("found")))
    return each(found, ["page_id"], "found").groupBy("page_id", "rank").agg(F.count(F.lit(1)).alias("n"))


def section_links(spark, sf_dir):
    return sections.page_sections(section_pages(spark, sf_dir)).select("page_id", "section_pos", "link_url")


def section_contexts(spark, sf_dir):
    return sections.page_sections(section_pages(spark, sf_dir)).select("page_id", "section_pos", "context")


def section_urls(spark, sf_dir):
    found = sections.page_sections(section_pages(spark, sf_dir))
    return found.select("page_id", "section_pos", F.explode("text_urls").alias("found"))


def hinted_chunks(spark, sf_dir):
    trees = hinted_pages(spark, sf_dir).withColumn("nodes", page_nodes(F.col("html")))
    return trees.select("page_id", hints.page_text(F.col("nodes"), F.col("selectors")).alias("text"))


def hinted_links(spark, sf_dir):
    return hints.page_links(hinted_pages(spark, sf_dir)).select("page_id", "link_pos", "event_url")


def unsupported_hints(spark, sf_dir):
    return hints.unsupported_hints(hinted_pages(spark, sf_dir)).select("url", "selector_pos", "selector")


_FITS = f"{LENGTH} BETWEEN 50 AND 5000"
_SECTIONS = f"""
  SELECT event_id, {RANK} AS rank, 0 AS ord, {MAIN} AS section, regexp_extract({_OPEN}, '<([a-z]+)', 1) AS tag FROM events WHERE {_FITS}
  UNION ALL SELECT event_id, 6, 1, {ITEM} || chr(10) || replace(CASE event_id % 4 """ + " ".join(
    f"WHEN {n} THEN '{t}'" for n, t in enumerate(LINK_TEXTS)
) + f""" END, '|', chr(10)), 'div' FROM events
  UNION ALL SELECT event_id, 15, 2, {TALK}, 'section' FROM events"""
NUMBERED_SECTIONS = f"SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY rank, ord) - 1 AS INTEGER) AS section_pos FROM ({_SECTIONS})"
_TOWN = f"'https://town' || {text('event_id % 30')} || '.example.org'"
SECTION_LINK_URL = f"CASE event_id % 4 WHEN 0 THEN {_TOWN} || '/news/d/1' WHEN 1 THEN {_TOWN} || '/plain/1' WHEN 2 THEN 'https://city.example.org/node/7' END"
_OUTER = f"{ITEM} || chr(10) || replace(CASE event_id % 4 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(LINK_TEXTS)) + " END, '|', chr(10))"
_MARK = "chr(10) || chr(10) || '---EVENT-CHUNK---' || chr(10) || chr(10)"
_TALK_CHUNK = f"{_MARK} || {TALK}"

QUERIES = {
    "page_source": page_source,
    "page_anchors": page_anchors,
    "node_table": node_table,
    "page_hosts": page_hosts,
    "page_titles": page_titles,
    "page_body_text": page_body_text,
    "text_budget": text_budget,
    "url_resolution": url_resolution,
    "calendar_addresses": calendar_addresses,
    "month_addresses": month_addresses,
    "date_words": date_words,
    "text_urls": text_urls,
    "container_candidates": container_candidates,
    "passed_over_sections": passed_over_sections,
    "section_ranks": section_ranks,
    "section_texts": section_texts,
    "section_texts_over_50": section_texts_over_50,
    "outermost_sections": outermost_sections,
    "section_links": section_links,
    "section_contexts": section_contexts,
    "section_urls": section_urls,
    "hinted_chunks": hinted_chunks,
    "hinted_links": hinted_links,
    "unsupported_hints": unsupported_hints,
}

_MONTH_ROOT = """CASE o_orderkey % 4 WHEN 0 THEN 'https://cal.example.org/events' WHEN 1 THEN 'https://cal.example.org/events'
  WHEN 2 THEN 'https://cal.example.org/events' ELSE 'https://cal.example.org/events/2025-october' END"""
_NOISY = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
_TAG_RANKS = f"SELECT event_id AS page_id, {RANK} AS rank FROM events WHERE {_FITS} UNION ALL SELECT event_id, r FROM events, (VALUES (6), (15), (15)) AS v(r)"

ORACLES = {
    "page_source": "SELECT page_id, url, length(html) AS length FROM pages",
    "page_anchors": f"""SELECT page_id, CAST(pos - 1 AS INTEGER) AS link_pos, {_unescape("href")} AS href, regexp_replace({_unescape("txt")}, {_PIECE_STRIP}, '', 'g') AS text FROM (
      SELECT page_id, unnest(regexp_extract_all({_BARE}, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all({_BARE}, '<a href="([^"]*)">([^<]*)</a>', 2)) AS txt,
      generate_subscripts(regexp_extract_all({_BARE}, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS pos FROM pages)""",
    "node_table": f"""SELECT tag, count(*) AS elements, count(DISTINCT page_id) AS pages FROM (
      SELECT page_id, unnest(regexp_extract_all(regexp_replace({_NOISY}, '<(script|style)>.*?</(script|style)>', '<\\1>', 'gs'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag""",
    "page_hosts": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages",
    "page_titles": f"SELECT page_id, trim(regexp_replace({_unescape(chr(39).join(['regexp_extract(html, ', '<title>(.*?)</title>', ', 1, ', 's', ')']))}, '\\s+', ' ', 'g')) AS title FROM pages",
    "page_body_text": f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex({_BODY}, '<[^>]*>'),
      lambda x: regexp_replace({_unescape("x")}, {_PIECE_STRIP}, '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM pages""",
    "text_budget": f"""WITH RECURSIVE whole AS (SELECT doc_id, 'plain' AS kind, 120000 AS size, text AS t FROM documents WHERE length(text) >= 200
        UNION ALL SELECT doc_id, 'long', 120000, repeat(text, 8) FROM documents WHERE 8 * length(text) >= 200
        UNION ALL SELECT doc_id, 'html', 50000, repeat(text, 8) FROM documents),
      cut AS (SELECT doc_id, kind, size, t, 0 AS piece, 1 AS first, {_WINDOW.format(at="1")} AS width FROM whole
        UNION ALL SELECT doc_id, kind, size, t, piece + 1, first + width, {_WINDOW.format(at="(first + width)")} FROM cut WHERE first + width <= length(t))
      SELECT doc_id, kind, CAST(piece AS INTEGER) AS piece, sha256(substr(t, first, width)) AS content_key FROM cut""",
    "url_resolution": f"""SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN 'http://other.example.com/x?q=1#top' WHEN 1 THEN 'https://cdn.example.com/x'
      WHEN 2 THEN {_SITE} || '/root/' || {C} WHEN 3 THEN {_SITE} || '/a/b/leaf' WHEN 4 THEN {_SITE} || '/a/up' WHEN 5 THEN {_SITE} || '/over'
      WHEN 6 THEN {_SITE} || '/a/b/' || {C} || '?q=' || {C} WHEN 7 THEN {BASE} || '#part' WHEN 8 THEN {BASE} WHEN 9 THEN 'mailto:x@example.org'
      WHEN 10 THEN {_SITE} || '/a/b/y/z/' ELSE 'https://Host/Path/../p' END AS resolved FROM customer""",
    "calendar_addresses": "SELECT c_custkey AS id, c_custkey % 6 IN (0, 2, 3) AS is_calendar FROM customer",
    "month_addresses": f"""SELECT o_orderkey AS id, i AS month_pos, {_MONTH_ROOT} || '/' || lower(strftime(date_trunc('month', o_orderdate) + to_months(i), '%Y-%B')) || '/' AS month_url
      FROM orders, (VALUES (0), (1)) AS v(i)""",
    "date_words": f"SELECT event_id, event_id % {len(PHRASES)} IN ({', '.join(str(n) for n, (_, yes) in enumerate(PHRASES) if yes)}) AS names_a_date FROM events",
    "text_urls": f"""SELECT event_id, i AS url_pos, CASE i WHEN 0 THEN 'http://a.example.org/x' WHEN 1 THEN 'https://b.example.org/p?q=' || {E} ELSE 'https://b.example.org/p?q=' || {E} || '.' END AS found
      FROM events, (VALUES (0), (1), (2)) AS v(i)""",
    "container_candidates": f"""SELECT page_id, rank, count(*) AS n FROM ({_TAG_RANKS} UNION ALL SELECT event_id, 16 FROM events) GROUP BY ALL""",
    "passed_over_sections": f"""SELECT event_id AS page_id, {RANK} AS rank, {LENGTH} AS length, CASE WHEN {LENGTH} < 50 THEN 'too_short' ELSE 'too_long' END AS reason
      FROM events WHERE NOT ({_FITS})""",
    "section_ranks": f"SELECT event_id AS page_id, section_pos, rank, tag FROM ({NUMBERED_SECTIONS})",
    "section_texts": f"SELECT event_id AS page_id, section_pos, section FROM ({NUMBERED_SECTIONS})",
    "section_texts_over_50": f"SELECT event_id AS page_id, section_pos, length(section) AS length FROM ({NUMBERED_SECTIONS}) WHERE length(section) > 50",
    "outermost_sections": f"SELECT page_id, rank, count(*) AS n FROM ({_TAG_RANKS}) GROUP BY ALL",
    "section_links": f"SELECT event_id AS page_id, section_pos, CASE WHEN ord = 1 THEN {SECTION_LINK_URL} END AS link_url FROM ({NUMBERED_SECTIONS})",
    "section_contexts": f"""SELECT event_id AS page_id, section_pos, CASE WHEN ord = 2 THEN CASE event_id % 3 WHEN 0 THEN 'Sunday' WHEN 2 THEN 'June 3rd' || chr(10) || '10:30 am' END END AS context
      FROM ({NUMBERED_SECTIONS})""",
    "section_urls": f"""SELECT event_id AS page_id, section_pos, CASE i WHEN 0 THEN 'http://t.example.org/' || {E} ELSE 'https://u.example.org/p?q=' || {E} END AS found
      FROM ({NUMBERED_SECTIONS}), (VALUES (0), (1)) AS v(i) WHERE ord = 2""",
    "hinted_chunks": f"SELECT event_id AS page_id, {_OUTER} || {_MARK} || {ITEM} || CASE WHEN {RANK} = 15 AND {LENGTH} > 50 THEN {_MARK} || {MAIN} ELSE '' END || {_TALK_CHUNK} || {_TALK_CHUNK} || {_MARK} || {ITEM} AS text FROM events",
    "hinted_links": f"""SELECT event_id AS page_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY n) - 1 AS INTEGER) AS link_pos, event_url FROM (
      SELECT event_id, v.* FROM events, (VALUES (0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0)) AS v(k, n) WHERE event_id % 4 = v.k) AS t
      JOIN (SELECT event_id AS e, CASE event_id % 4 WHEN 0 THEN ['mailto:m@x', {PAGE_URL} || '#top', {_TOWN} || '/plain/1', {_TOWN} || '/news/d/1']
        WHEN 1 THEN [{PAGE_URL} || '#top', {_TOWN} || '/plain/1'] WHEN 2 THEN [{_TOWN} || '/other', 'https://city.example.org/node/7'] ELSE ['tel:1'] END AS us FROM events) AS u ON u.e = t.event_id,
      LATERAL (SELECT us[n + 1] AS event_url)""",
    "unsupported_hints": f"SELECT {PAGE_URL} AS url, 3 AS selector_pos, 'main > x' AS selector FROM events",
}
