"""Structured data: one page per order, with a block whose form depends on the order's number."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.functions import variants as V
from almanac.functions.html import jsonld_blocks, repair_entities
from almanac.functions.ids import external_id
from almanac.functions.isotime import add_seconds, duration_seconds, normalise
from almanac.operators import jsonld
from almanac.workloads.common import day, derived, flat_location, script, table, text

K = text("o_orderkey")
D = day("o_orderdate")
D1 = day("o_orderdate", 1)
FORM = "(o_orderkey % 12)"
HOST = f"'host' || {text('o_orderkey % 25')} || '.example.org'"
URL = f"'https://' || {HOST} || '/shows/' || {K}"
SECONDS = "(600 + o_orderkey % 5000)"

_NAME = f"'\"name\":\"Order ' || {K} || '\"'"
_HEAD = f"'{{\"@type\":\"Event\",' || {_NAME} || ',"
_OWN_URL = f"\"url\":\"https://tickets.example.org/' || {K} || '\""

# First block of the page, by form.
BLOCK = f"""CASE {FORM}
  WHEN 0 THEN {_HEAD}"startDate":"' || {D} || '"}}'
  WHEN 1 THEN {_HEAD}"startDate":"' || {D} || '","endDate":""}}'
  WHEN 2 THEN {_HEAD}"startDate":"' || {D} || '","startTime":"18:30:00","endTime":"20:00:00","eventStatus":"EventScheduled",{_OWN_URL}}}'
  WHEN 3 THEN {_HEAD}"startDate":"' || {D} || '","doorTime":"19:00","endDate":"' || {D1} || '","eventAttendanceMode":"OfflineEventAttendanceMode",{_OWN_URL}}}'
  WHEN 4 THEN {_HEAD}"startDate":"' || {D} || '","startTime":"10:00:00","duration":"PT' || {text(SECONDS)} || 'S",{_OWN_URL}}}'
  WHEN 5 THEN {_HEAD}"@id":"urn:order:' || {K} || '","startDate":"' || {D} || 'T10:15:00-05:00","endDate":"' || {D} || 'T12:00:00Z",{_OWN_URL}}}'
  WHEN 6 THEN {_HEAD}"description":null,"startDate":"' || {D} || '","location":{{"@type":"Place","name":"Room ' || {K} || '","address":"1 Main Street"}},"organizer":{{"name":"Org ' || {K} || '"}},{_OWN_URL}}}'
  WHEN 7 THEN {_HEAD}"description":"About ' || {K} || '","startDate":"' || {D} || '","location":[{{"name":"","address":"Hall ' || {K} || '"}},"x"],"organizer":"Club",{_OWN_URL}}}'
  WHEN 8 THEN '{{"@graph":[{{"@type":"WebPage","name":"w"}},' || {_HEAD}"@id":"urn:graph:' || {K} || '","startDate":"' || {D} || '","location":"Town Hall","organizer":["a"]}},"text"]}}'
  WHEN 9 THEN '{{"@type":"MusicEvent",' || {_NAME} || ',"startDate":"' || {D} || '"}}'
  WHEN 10 THEN {_HEAD}"startDate":'
  ELSE '{{"@type":"Event","name":"Order ' || {K} || ' &amp; Co&#039;s","startDate":"' || {D} || '",{_OWN_URL}}}'
END"""

# Second block: a list with two events among other things.
LIST = (
    f"'[{{\"@type\":\"Event\",\"@id\":\"urn:a:' || {K} || '\",\"name\":\"Extra A ' || {K} || '\",\"startDate\":\"' || {D} || '\"}},"
    f"7,{{\"@type\":\"Thing\"}},{{\"@type\":\"Event\",\"@id\":\"urn:b:' || {K} || '\",\"name\":\"Extra B ' || {K} || '\",\"startDate\":\"' || {D} || '\"}}]'"
)
_DECOYS = (
    "'<html><head><title>Orders</title></head><body>"
    "<!-- <script type=\"application/ld+json\">{\"@type\":\"Event\",\"name\":\"hidden\",\"startDate\":\"2020-01-01\"}</script> -->"
    "<script type=\"application/ld+json; charset=utf-8\">{\"@type\":\"Event\",\"name\":\"typed\",\"startDate\":\"2020-01-01\"}</script>'"
)
_ANCHORS = (
    f"'<a name=\"x\">Order ' || {K} || '</a>' || CASE WHEN {FORM} = 0 THEN "
    f"'<a href=\"../tickets/' || {K} || '\"><b>See</b> ORDER ' || {K} || '  </a>' ELSE '' END"
)
HTML = f"{_DECOYS} || {_ANCHORS} || {script(BLOCK)} || '<p>and</p><SCRIPT id=\"b\" type=''application/ld+json'' >' || {LIST} || '</SCRIPT></body></html>'"


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS page_id", f"{URL} AS url", f"{HTML} AS html")

    return derived(spark, sf_dir, "order_pages", build)


# Orders of the lowest priority carry a second block with a date that cannot be read.
SPOILT = "o_orderpriority = '5-LOW'"


_SPOILT_BLOCK = f"{_HEAD}\"startDate\":\"soon\"}}'"


def spoilt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        bad = f"CASE WHEN {SPOILT} THEN {script(_SPOILT_BLOCK)} ELSE '' END"
        return table(spark, sf_dir, "orders").selectExpr(
            "o_orderkey AS page_id", f"{URL} AS url", f"{script(LIST)} || {bad} AS html"
        )

    return derived(spark, sf_dir, "spoilt_pages", build)


def _events(df: DataFrame) -> DataFrame:
    return df.select(
        "page_id", "block_pos", "item_pos", "external_id", "title", "description", *flat_location(),
        "start_time", "end_time", "url", "organizer", "event_status", "event_attendance_mode",
    )


def jsonld_events(spark, sf_dir):
    return _events(jsonld.page_events(order_pages(spark, sf_dir)))


def _hash_id(title: str) -> str:
    return f"{HOST} || ':' || substr(sha1({HOST} || '|' || {title} || '|' || {D} || 'T00:00:00+00:00'), 1, 16)"


_MIDNIGHT = f"{D} || 'T00:00:00+00:00'"
EXPECTED_EVENTS = f"""
SELECT o_orderkey AS page_id, 0 AS block_pos, 0 AS item_pos,
  CASE WHEN {FORM} IN (0, 1) THEN {_hash_id(f"'Order ' || {K}")}
       WHEN {FORM} = 5 THEN 'urn:order:' || {K} WHEN {FORM} = 8 THEN 'urn:graph:' || {K}
       ELSE 'https://tickets.example.org/' || {K} END AS external_id,
  'Order ' || {K} || CASE WHEN {FORM} = 11 THEN ' & Co''s' ELSE '' END AS title,
  CASE WHEN {FORM} = 7 THEN 'About ' || {K} ELSE '' END AS description,
  CASE WHEN {FORM} = 6 THEN 'place' ELSE 'text' END AS location_kind,
  CASE WHEN {FORM} = 6 THEN NULL WHEN {FORM} = 7 THEN 'Hall ' || {K} WHEN {FORM} = 8 THEN 'Town Hall' ELSE '' END AS location_text,
  CASE WHEN {FORM} = 6 THEN 'Room ' || {K} END AS place_name,
  CASE WHEN {FORM} = 6 THEN '1 Main Street' END AS place_address,
  CASE {FORM} WHEN 2 THEN {D} || 'T18:30:00+00:00' WHEN 3 THEN {D} || 'T19:00:00+00:00'
    WHEN 4 THEN {D} || 'T10:00:00+00:00' WHEN 5 THEN {D} || 'T10:15:00-05:00' ELSE {_MIDNIGHT} END AS start_time,
  CASE {FORM} WHEN 2 THEN {D} || 'T20:00:00+00:00' WHEN 3 THEN {D1} || 'T23:59:59+00:00'
    WHEN 4 THEN strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 10 HOUR + to_seconds({SECONDS}), '%Y-%m-%dT%H:%M:%S+00:00')
    WHEN 5 THEN {D} || 'T12:00:00+00:00' END AS end_time,
  CASE WHEN {FORM} = 0 THEN 'https://' || {HOST} || '/tickets/' || {K} WHEN {FORM} IN (1, 8) THEN {URL}
       ELSE 'https://tickets.example.org/' || {K} END AS url,
  CASE WHEN {FORM} = 6 THEN 'Org ' || {K} WHEN {FORM} = 7 THEN 'Club' ELSE '' END AS organizer,
  CASE WHEN {FORM} = 2 THEN 'EventScheduled' ELSE '' END AS event_status,
  CASE WHEN {FORM} = 3 THEN 'OfflineEventAttendanceMode' ELSE '' END AS event_attendance_mode
FROM orders WHERE {FORM} NOT IN (9, 10)
UNION ALL
SELECT o_orderkey, 1, item, 'urn:' || letter || ':' || {K}, 'Extra ' || upper(letter) || ' ' || {K}, '', 'text', '', NULL, NULL,
  {_MIDNIGHT}, NULL, {URL}, '', '', ''
FROM orders, (VALUES (0, 'a'), (1, 'b')) AS extra(item, letter)
"""


def jsonld_block_text(spark, sf_dir):
    return order_pages(spark, sf_dir).select("page_id", F.posexplode(jsonld_blocks(F.col("html"))).alias("block_pos", "block"))


def entity_repair(spark, sf_dir):
    worn = F.replace(F.col("text"), F.lit(" "), F.lit(" &amp;quot;&#039;"))
    return table(spark, sf_dir, "documents").select("doc_id", repair_entities(worn).alias("repaired"))


def block_quarantine(spark, sf_dir):
    return jsonld.rejected_events(order_pages(spark, sf_dir)).select("page_id", "block_pos", "reason", "content")


# JSON that only a tolerant parser reads, and some that none does.
CUSTOMER = text("c_custkey")
LOOSE = f"""CASE c_custkey % 6
  WHEN 0 THEN '{{"@type":"Event","@id":"urn:twice:' || {CUSTOMER} || '","name":"first","name":"last","startDate":"2025-05-01"}}'
  WHEN 1 THEN '{{"@type":"Event","@id":"urn:nan:' || {CUSTOMER} || '","name":"n","startDate":"2025-05-01","description":NaN}}'
  WHEN 2 THEN '[{{"@type":"Event","@id":"urn:far:' || {CUSTOMER} || '","name":"f","startDate":"2025-05-01","offers":{{"price":-Infinity}}}}]'
  WHEN 3 THEN '{{"@type":"Event","name":"comma","startDate":"2025-05-01",}}'
  WHEN 4 THEN '{{&quot;@type&quot;:&quot;Event&quot;,&quot;@id&quot;:&quot;urn:both:' || {CUSTOMER} || '&quot;,&quot;@id&quot;:&quot;urn:late:' || {CUSTOMER} || '&quot;}}'
  ELSE '{{"@type":"Event","@id":"urn:good:' || {CUSTOMER} || '","name":"g","startDate":"2025-05-01"}}' END"""


def _loose_pages(spark, sf_dir):
    return derived(spark, sf_dir, "loose_pages", lambda: table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS page_id", f"'https://loose.example.org/' || {CUSTOMER} AS url", f"{script(LOOSE)} AS html"))


def recovered_events(spark, sf_dir):
    """Events of blocks that need the second reading, next to those of good ones."""
    return jsonld.page_events(_loose_pages(spark, sf_dir)).select("page_id", "external_id", "title", "description", "start_time")


def recovered_blocks(spark, sf_dir):
    return jsonld.rejected_events(_loose_pages(spark, sf_dir)).select("page_id", "block_pos", "reason")


def event_objects(spark, sf_dir):
    blocks = order_pages(spark, sf_dir).select("page_id", F.inline(jsonld.parsed_blocks(F.col("html"))))
    return blocks.select("page_id", "block_pos", F.posexplode(jsonld.event_objects(F.col("doc"))).alias("item_pos", "item")).select(
        "page_id", "block_pos", "item_pos", V.get("item", "name").alias("title")
    )


def spoilt_page_policy(spark, sf_dir):
    return jsonld.page_events(spoilt_pages(spark, sf_dir)).select("page_id", "external_id", "start_time")


def spoilt_item_policy(spark, sf_dir):
    return jsonld.page_events(spoilt_pages(spark, sf_dir), on_error="item").select("page_id", "external_id", "start_time")


def date_quarantine(spark, sf_dir):
    return jsonld.rejected_events(spoilt_pages(spark, sf_dir)).select("page_id", "block_pos", "item_pos", "reason")


_EXTRAS = f"SELECT o_orderkey AS page_id, 'urn:' || letter || ':' || {K} AS external_id, {_MIDNIGHT} AS start_time FROM orders, (VALUES ('a'), ('b')) AS extra(letter)"

# Date texts in every form the normaliser knows, and some it must refuse.
ISO_TEXT = f"""CASE {FORM} WHEN 0 THEN {D} WHEN 1 THEN {D} || 'T18:30' WHEN 2 THEN {D} || 'T18:30:15.25' WHEN 3 THEN {D} || 'T18:30:00Z'
  WHEN 4 THEN {D} || 'T18:30:00-0500' WHEN 5 THEN replace({D}, '-', '') || 'T183000+05:30' WHEN 6 THEN {D} || ' 18:30'
  WHEN 7 THEN {D} || 'T7:30' WHEN 8 THEN {D} || 'T25:00:00' WHEN 9 THEN '' WHEN 10 THEN '1999-2-30' ELSE '1999-2-3' END"""


def iso_normaliser(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{ISO_TEXT} AS raw")
    return rows.select("id", normalise(F.col("raw")).alias("start_iso"), normalise(F.col("raw"), end=True).alias("end_iso"))


def zone_offsets(spark, sf_dir):
    zone = "CASE o_orderkey % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Kolkata' END"
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{D} || 'T12:00:00' AS raw", f"{zone} AS zone")
    return rows.select("id", normalise(F.col("raw"), F.col("zone")).alias("iso"))


def duration_ends(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", f"{D} || 'T10:00:00-05:00' AS start_raw", f"'PT' || {text(SECONDS)} || CASE WHEN {FORM} = 0 THEN 'M0S' ELSE 'S' END AS duration"
    )
    seconds = duration_seconds(F.col("duration"))
    return rows.select("id", F.coalesce(seconds, F.lit(-1)).alias("seconds"), add_seconds(F.col("start_raw"), seconds).alias("end_raw"))


def external_ids(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    return pages.select("page_id", external_id(F.col("url"), name, F.lit("2025-08-11T00:00:00+00:00")).alias("external_id"))


LOCATION_JSON = f"""CASE o_orderkey % 7 WHEN 0 THEN '{{"@type":"Place","name":"N' || {K} || '","address":"A","telephone":"1"}}' WHEN 1 THEN '{{"name":"N' || {K} || '","address":"A"}}'
  WHEN 2 THEN '{{"name":"","address":"A' || {K} || '"}}' WHEN 3 THEN '"T' || {K} || '"' WHEN 4 THEN '[{{"@type":"Place","name":"P' || {K} || '"}},{{"name":"x"}}]'
  WHEN 5 THEN '["T' || {K} || '"]' ELSE 'null' END"""


def locations_and_organizers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"try_parse_json({LOCATION_JSON}) AS v")
    return rows.select("id", jsonld.location(F.col("v")).alias("location"), jsonld.organizer(F.col("v")).alias("organizer")).select(
        "id", *flat_location(), "organizer"
    )


def title_links(spark, sf_dir):
    """Addresses of events after looking for a link with their title."""
    return jsonld.page_events(order_pages(spark, sf_dir)).select("page_id", "block_pos", "item_pos", "url")


def event_columns(spark, sf_dir):
    """Record assembly (E11): how many events leave each text column empty."""
    events = jsonld.page_events(order_pages(spark, sf_dir))
    names = ["description", "organizer", "event_status", "event_attendance_mode", "end_time"]
    return events.groupBy("block_pos").agg(
        F.count(F.lit(1)).alias("events"), *[F.count(F.when(F.coalesce(F.col(n), F.lit("")) == "", 1)).alias(f"no_{n}") for n in names]
    )


QUERIES = {
    "jsonld_events": jsonld_events,
    "jsonld_block_text": jsonld_block_text,
    "entity_repair": entity_repair,
    "block_quarantine": block_quarantine,
    "recovered_events": recovered_events,
    "recovered_blocks": recovered_blocks,
    "event_objects": event_objects,
    "spoilt_page_policy": spoilt_page_policy,
    "spoilt_item_policy": spoilt_item_policy,
    "date_quarantine": date_quarantine,
    "iso_normaliser": iso_normaliser,
    "zone_offsets": zone_offsets,
    "duration_ends": duration_ends,
    "external_ids": external_ids,
    "locations_and_organizers": locations_and_organizers,
    "title_links": title_links,
    "event_columns": event_columns,
}

_LOC = "o_orderkey % 7"
ORACLES = {
    "jsonld_events": EXPECTED_EVENTS,
    "jsonld_block_text": f"SELECT o_orderkey AS page_id, 0 AS block_pos, {BLOCK} AS block FROM orders UNION ALL SELECT o_orderkey, 1, {LIST} FROM orders",
    "entity_repair": "SELECT doc_id, replace(replace(replace(replace(text, ' ', ' &amp;quot;&#039;'), '&#039;', ''''), '&quot;', '\"'), '&amp;', '&') AS repaired FROM documents",
    "block_quarantine": f"SELECT o_orderkey AS page_id, 0 AS block_pos, 'strict_json' AS reason, {BLOCK} AS content FROM orders WHERE {FORM} = 10",
    "recovered_events": f"""SELECT c_custkey AS page_id, 'urn:' || split_part('twice,nan,far,,late,good', ',', CAST(c_custkey % 6 + 1 AS INT)) || ':' || {CUSTOMER} AS external_id,
      split_part('last,n,f,,,g', ',', CAST(c_custkey % 6 + 1 AS INT)) AS title, '' AS description,
      CASE WHEN c_custkey % 6 <> 4 THEN '2025-05-01T00:00:00+00:00' END AS start_time FROM customer WHERE c_custkey % 6 <> 3""",
    "recovered_blocks": "SELECT c_custkey AS page_id, 0 AS block_pos, CASE WHEN c_custkey % 6 = 3 THEN 'strict_json' ELSE 'recovered' END AS reason FROM customer WHERE c_custkey % 6 < 5",
    "event_objects": f"SELECT page_id, block_pos, item_pos, title FROM ({EXPECTED_EVENTS})",
    "spoilt_page_policy": _EXTRAS + f" WHERE NOT ({SPOILT})",
    "spoilt_item_policy": _EXTRAS,
    "date_quarantine": f"SELECT o_orderkey AS page_id, 1 AS block_pos, 0 AS item_pos, 'unreadable_start' AS reason FROM orders WHERE {SPOILT}",
    "iso_normaliser": f"""SELECT o_orderkey AS id,
      CASE {FORM} WHEN 0 THEN {_MIDNIGHT} WHEN 11 THEN '1999-02-03T00:00:00+00:00' ELSE full_text END AS start_iso,
      CASE {FORM} WHEN 0 THEN {D} || 'T23:59:59+00:00' WHEN 11 THEN '1999-02-03T23:59:59+00:00' ELSE full_text END AS end_iso
      FROM (SELECT *, CASE {FORM} WHEN 1 THEN {D} || 'T18:30:00+00:00' WHEN 2 THEN {D} || 'T18:30:15.250000+00:00' WHEN 3 THEN {D} || 'T18:30:00+00:00'
        WHEN 4 THEN {D} || 'T18:30:00-05:00' WHEN 5 THEN {D} || 'T18:30:00+05:30' END AS full_text FROM orders)""",
    # Noon is never inside a clock change; US summer time ran from the first Sunday of April to the last of October until 2006.
    "zone_offsets": f"""SELECT o_orderkey AS id, {D} || 'T12:00:00' || CASE o_orderkey % 3 WHEN 1 THEN '+05:30' WHEN 2 THEN '+00:00'
        ELSE CASE WHEN d >= april AND d < october THEN '-04:00' ELSE '-05:00' END END AS iso
      FROM (SELECT *, CAST(o_orderdate AS DATE) AS d,
        make_date(year(o_orderdate), 4, 1) + CAST((7 - dayofweek(make_date(year(o_orderdate), 4, 1))) % 7 AS INTEGER) AS april,
        make_date(year(o_orderdate), 10, 31) - CAST(dayofweek(make_date(year(o_orderdate), 10, 31)) AS INTEGER) AS october FROM orders)""",
    "duration_ends": f"""SELECT o_orderkey AS id, CASE WHEN {FORM} = 0 THEN -1 ELSE {SECONDS} END AS seconds,
      CASE WHEN {FORM} <> 0 THEN strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 10 HOUR + to_seconds({SECONDS}), '%Y-%m-%dT%H:%M:%S') END AS end_raw FROM orders""",
    "external_ids": """SELECT page_id, host || ':' || substr(sha1(host || '|Page ' || page_id || '|2025-08-11T00:00:00+00:00'), 1, 16) AS external_id
      FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)""",
    "locations_and_organizers": f"""SELECT o_orderkey AS id, CASE WHEN {_LOC} IN (0, 4) THEN 'place' ELSE 'text' END AS location_kind,
      CASE WHEN {_LOC} IN (0, 4) THEN NULL WHEN {_LOC} = 1 THEN 'N' || {K} WHEN {_LOC} = 2 THEN 'A' || {K} WHEN {_LOC} = 3 THEN 'T' || {K} ELSE '' END AS location_text,
      CASE {_LOC} WHEN 0 THEN 'N' || {K} WHEN 4 THEN 'P' || {K} END AS place_name, CASE WHEN {_LOC} = 0 THEN 'A' END AS place_address,
      CASE {_LOC} WHEN 0 THEN 'N' || {K} WHEN 1 THEN 'N' || {K} WHEN 3 THEN 'T' || {K} ELSE '' END AS organizer FROM orders""",
    "title_links": f"SELECT page_id, block_pos, item_pos, url FROM ({EXPECTED_EVENTS})",
    "event_columns": "SELECT block_pos, count(*) AS events, "
    + ", ".join(f"count(*) FILTER (coalesce({n}, '') = '') AS no_{n}" for n in ["description", "organizer", "event_status", "event_attendance_mode", "end_time"])
    + f" FROM ({EXPECTED_EVENTS}) GROUP BY block_pos",
}
