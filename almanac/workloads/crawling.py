"""Frames, month pages, fallback to model answers, following of links, streams."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.operators import crawl
from almanac.plans import extract as plan, requests
from almanac.plans.page_events import crawl_sections, section_prompts
from almanac.plans.staging import shared_folder, write_once
from almanac.sources.tables import write_events
from almanac.streaming import continuous, extraction
from almanac.workloads.common import derived, script, table, text
from almanac.workloads.structured import EXPECTED_EVENTS, order_pages

C = text("c_custkey")
_SITE = f"'https://host' || {text('c_custkey % 40')} || '.example.org'"
_FRAME_HOST = "frames.example.org"

# ---- frames: even page numbers embed odd ones ---------------------------------------------------

PARENT = f"{_SITE} || '/a/b/' || {C} || '.html'"
_SRC = f"""CASE c_custkey % 7 WHEN 0 THEN 'src="https://{_FRAME_HOST}/calendar/' || {C} || '?a=1&amp;b=2"' WHEN 1 THEN 'src="//{_FRAME_HOST}/Booking/' || {C} || '"'
  WHEN 2 THEN 'src="/root/event/' || {C} || '"' WHEN 3 THEN 'src="frame/' || {C} || '"' WHEN 4 THEN 'SRC=../frame/' || {C}
  WHEN 5 THEN 'src=''?frame=' || {C} || '''' ELSE 'title="no source"' END"""
FRAME_URL = f"""CASE c_custkey % 7 WHEN 0 THEN 'https://{_FRAME_HOST}/calendar/' || {C} || '?a=1&b=2' WHEN 1 THEN 'https://{_FRAME_HOST}/Booking/' || {C}
  WHEN 2 THEN {_SITE} || '/root/event/' || {C} WHEN 3 THEN {_SITE} || '/a/b/frame/' || {C} WHEN 4 THEN {_SITE} || '/a/frame/' || {C}
  WHEN 5 THEN {PARENT} || '?frame=' || {C} END"""
_SECOND = "CASE WHEN c_custkey % 7 = 6 THEN 'schedule.html' ELSE 'late-event.html' END"
PARENT_HTML = f"'<body><!-- <iframe src=\"no.html\"> --><iframe ' || {_SRC} || '></iframe><iframe src=\"' || {_SECOND} || '\"></iframe></body>'"
_FRAMED = f"""'{{"@type":"Event","name":"Framed ' || {C} || '","startDate":"2025-08-11","startTime":"10:00:00","duration":"PT600S"}}'"""
_MIXED = f"""'[{{"@type":"Event","@id":"urn:g:' || {C} || '","startDate":"2025-08-12"}},{{"@type":"Event","startDate":"soon"}},{{"@type":"Event","@id":"urn:lost","startDate":"2025-08-13"}}]'"""
_LAST = f"""'{{"@type":"Event","@id":"urn:z:' || {C} || '","startDate":"2025-08-14","endDate":"2025-08-15","endTime":"18:00:00"}}'"""
FRAME_HTML = f"{script(_FRAMED)} || {script(_MIXED)} || {script(_LAST)}"
AS_OF = "1998-06-15"


def _as_of():
    return F.lit(AS_OF).cast("date")


def framed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        customers = table(spark, sf_dir, "customer")
        parents = customers.selectExpr("2 * c_custkey AS page_id", f"{PARENT} AS url", f"{PARENT_HTML} AS html")
        frames = customers.selectExpr(
            "2 * c_custkey + 1 AS page_id", f"coalesce({FRAME_URL}, {_SITE} || '/unused/' || {C}) AS url", f"{FRAME_HTML} AS html"
        )
        return parents.unionByName(frames)

    return derived(spark, sf_dir, "framed_pages", build)


def _with_methods(pages: DataFrame, repair: bool = False) -> DataFrame:
    return crawl.all_jsonld_events(write_once(crawl.survey(pages, _as_of()).drop("html")), pages, _as_of(), repair)


def page_frames(spark, sf_dir):
    return crawl.page_frames(framed_pages(spark, sf_dir)).select("page_id", "frame_url", "calendar_frame_url")


_FOLLOWED = ["page_id", "method", "target_url", "external_id", "title", "start_time", "end_time", "url"]


def frame_events(spark, sf_dir):
    return _with_methods(framed_pages(spark, sf_dir)).select(*_FOLLOWED)


def rendered_frames(spark, sf_dir):
    """Frames of odd customers have no rendered form and are read by the direct rule, which one bad date ends."""
    pages = framed_pages(spark, sf_dir)
    is_drawn = F.floor(F.col("page_id") / 2) % 2 == 0
    return _with_methods(pages.withColumn("rendered", F.when(is_drawn, F.col("html")))).select(*_FOLLOWED)


# ---- month pages: one calendar per customer ------------------------------------------------------

CALENDAR = f"'https://cal' || {text('c_custkey % 40')} || '.example.org/' || {C} || '/events/'"
_EV = '{"@type":"Event",'
JUNE = f"""'[{_EV}"@id":"urn:1:' || {C} || '","startDate":"1998-06-07"}},{_EV}"@id":"urn:2:' || {C} || '","startDate":"1998-06-08"}},'
  || '{_EV}"name":"Walk ' || {C} || '","startDate":"1998-06-20","startTime":"18:30:00","endDate":"1998-06-21","endTime":"20:00:00"}},'
  || '{_EV}"@id":"urn:4:' || {C} || '","startDate":"1998-06-20T10:00:00"}},{_EV}"@id":"urn:5:' || {C} || '","startDate":"1998-06-22","startTime":"25:99"}},'
  || '{_EV}"@id":"urn:6:' || {C} || '","startDate":"1998-06-23","startTime":"10:00:00","duration":"PT1H30M"}},'
  || '{_EV}"@id":"urn:7:' || {C} || '","startDate":"1998-06-24","duration":"PT' || {text('600 + c_custkey % 1000')} || 'S"}},'
  || '{_EV}"@id":"urn:8:' || {C} || '","startDate":"1998-06-25","endDate":"1998-06-26","duration":"PT1H0M0S"}},{_EV}"@id":"urn:9"}}]'"""
JULY = f"""'{_EV}"@id":"urn:j:' || {C} || '","startDate":"1998-07-04"}}'"""
OWN = f"""'{_EV}"@id":"urn:own:' || {C} || '","startDate":"1997-01-01"}}'"""


def calendar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        customers = table(spark, sf_dir, "customer")
        base = customers.selectExpr("3 * c_custkey AS page_id", f"{CALENDAR} AS url", f"{script(OWN)} AS html")
        june = customers.selectExpr(
            "3 * c_custkey + 1 AS page_id", f"{CALENDAR} || '1998-june/' AS url", f"'<a href=\"../walk\">Go: walk ' || {C} || '</a>' || {script(JUNE)} AS html"
        )
        july = customers.selectExpr(
            "3 * c_custkey + 2 AS page_id",
            f"CASE WHEN c_custkey % 5 = 0 THEN 'https://elsewhere.example.org/' || {C} ELSE {CALENDAR} || '1998-july/' END AS url",
            f"{script(JULY)} AS html",
        )
        return base.unionByName(june).unionByName(july)

    return derived(spark, sf_dir, "calendar_pages", build)


def calendar_events(spark, sf_dir):
    return _with_methods(calendar_pages(spark, sf_dir)).filter(F.col("method") == "calendar").select(*_FOLLOWED)


def calendar_repair(spark, sf_dir):
    found = _with_methods(calendar_pages(spark, sf_dir), repair=True)
    return found.filter(F.col("method") == "calendar").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("start_time").alias("last_start"),
        F.count(F.when(F.col("start_time").endswith("T10:00:00+00:00"), 1)).alias("at_ten"),
    )


def method_union(spark, sf_dir):
    return _with_methods(calendar_pages(spark, sf_dir)).groupBy("page_id", "method").agg(F.count(F.lit(1)).alias("events"))


def event_sink(spark, sf_dir):
    """Events written by method and read back."""
    tuned = calendar_pages(spark, sf_dir)
    folder = f"{shared_folder(spark)}/almanac/{uuid.uuid4().hex}"
    write_events(_with_methods(tuned), folder)
    return spark.read.parquet(folder).groupBy("method").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("external_id").alias("ids"))


# ---- fallback: six kinds of towns ----------------------------------------------------------------

TOWN = f"{_SITE} || '/town/' || {C}"
DETAIL = f"{_SITE} || '/detail/' || {C}"
FRAME = f"{_SITE} || '/inner/' || {C}"
WORDS = f"'Programme of ' || {C} || ' ' || rpad('', 300, 'w')"
_HEAD = f"'<html><head><title> Town &amp;  ' || {C} || '</title></head><body><nav>menu</nav>'"
KIND = "(c_custkey % 6)"
TOWN_HTML = f"""{_HEAD} || CASE {KIND} WHEN 0 THEN {script(OWN)} WHEN 1 THEN '<p>' || {WORDS} || '</p>' WHEN 2 THEN '<p>' || {WORDS} || '</p>'
  WHEN 3 THEN '<p>too little</p>' WHEN 4 THEN '<div class="c"><a href="/detail/' || {C} || '">d</a><a href="/gone">g</a></div>' ELSE '<iframe src="/inner/' || {C} || '"></iframe>' END || '</body></html>'"""
PLAIN_HTML = f"'<body><p>' || {WORDS} || '</p></body>'"


def _prompt(url: str) -> str:
    return f"'URL: ' || {url} || chr(10) || chr(10) || 'PAGE_TEXT:' || chr(10) || {WORDS}"


GOOD = f"""'{{"source":null,"events":[{{"title":"Fair ' || {C} || '","start":"2025-07-04","end":"2025-07-05","timezone":"America/New_York"}},
  {{"title":"Talk","start":"2025-12-01T10:00:00","external_id":"talk:' || {C} || '","url":"https://talks.example.org/","description":"d","location":"Hall"}}]}}'"""
LATE = f"""'{{"events":[{{"title":"Walk ' || {C} || '","start":"2025-03-01T09:00:00Z"}}]}}'"""


def towns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, recorded answers, hints."""
    customers = table(spark, sf_dir, "customer")
    pages = derived(spark, sf_dir, "towns", lambda: customers.selectExpr(
        "10 * c_custkey AS page_id", f"{TOWN} AS url", f"{TOWN_HTML} AS html"
    ).unionByName(customers.selectExpr(
        "10 * c_custkey + 1 AS page_id", f"CASE WHEN {KIND} = 5 THEN {FRAME} ELSE {DETAIL} END AS url", f"{PLAIN_HTML} AS html"
    )))
    answers = customers.selectExpr(
        "'page' AS kind",
        f"sha2(CASE WHEN {KIND} = 4 THEN {_prompt(DETAIL)} ELSE {_prompt(TOWN)} END, 256) AS key",
        f"CASE {KIND} WHEN 1 THEN {GOOD} WHEN 2 THEN 'not json' WHEN 4 THEN {LATE} WHEN 5 THEN {LATE} ELSE '' END AS content",
        "'ok' AS status",
    )
    hinted = customers.selectExpr(f"{TOWN} AS url", f"CASE WHEN {KIND} = 4 THEN array('.c') END AS selectors")
    return pages, answers, hinted


def _extraction(spark, sf_dir):
    pages, answers, hinted = towns(spark, sf_dir)
    return plan.extract(pages, _as_of(), answers, hinted)


def extraction_status(spark, sf_dir):
    return _extraction(spark, sf_dir).pages.select("page_id", "success", "extraction_method", "page_title", "total_found")


def extraction_events(spark, sf_dir):
    return _extraction(spark, sf_dir).events.select(
        "page_id", "method", "source_ord", "seq", "target_url", "external_id", "title", "description", "start_time", "end_time", "url"
    )


def extraction_responses(spark, sf_dir):
    rows = _extraction(spark, sf_dir).responses()
    return rows.select(
        "page_id", "success", "part", F.size("events").alias("events"), F.try_element_at("events", F.lit(1))["external_id"].alias("first_id"),
        F.try_element_at("events", F.lit(-1))["title"].alias("last_title"),
    )


# ---- requests: every order asks for its customer's town, half of them with selectors --------------

REQUEST = [
    "o_orderkey AS request_id", f"{TOWN} || CASE WHEN o_orderkey % 10 = 9 THEN '/gone' ELSE '' END AS url",
    """named_struct('expected_event_count', CAST(o_orderkey % 3 AS INT), 'date_format_hints', CAST(NULL AS ARRAY<STRING>),
      'content_selectors', CASE WHEN o_orderkey % 2 = 0 THEN array('.c') END, 'additional_hints', CAST(NULL AS STRING)) AS extraction_hints""",
    """CASE WHEN o_orderkey % 3 > 0 THEN named_struct('required_fields', CASE WHEN o_orderkey % 3 = 1 THEN array('title', 'end') ELSE array('start', 'location') END,
      'optional_fields', CAST(NULL AS ARRAY<STRING>)) END AS schema_requirements""",
]


def request_responses(spark, sf_dir):
    pages, answers, _ = towns(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").selectExpr(*REQUEST)
    return requests.serve(asked, pages, _as_of(), answers).responses.select(
        "request_id", "success", "extraction_method", "page_title", "total_found", "as_expected", "set_aside", "conforming",
        F.array_join("missing_required", ",").alias("missing"), "part", F.array_join(F.transform("events", lambda e: e["external_id"]), ",").alias("ids"),
    )


# ---- links named in sections: parts that point at other parts ------------------------------------

P = text("p_partkey")
PART_URL = f"'https://parts.example.org/' || {P}"
NEXT = "(3 * p_partkey + 1)"
_TARGET = f"'https://parts.example.org/' || {text(NEXT)}"
_LIVE = "p_partkey % 4 = 1"
PART_HTML = f"""'<body><div class="event-item">Meeting ' || {P} || ' on Monday, details at ' || {_TARGET} || ' and again ' || {_TARGET} || ' there</div>'
  || CASE WHEN p_partkey % 4 = 2 THEN '<iframe src="/calendar/' || {P} || '"></iframe>' ELSE '' END || '</body>'"""
FRAMED_PART_HTML = f"""'<body><div class="event-item">Framed meeting ' || {P} || ' on Monday in the big room of the mill</div></body>'"""


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        parts = table(spark, sf_dir, "part")
        return parts.selectExpr("2 * p_partkey AS page_id", f"{PART_URL} AS url", f"{PART_HTML} AS html").unionByName(
            parts.filter("p_partkey % 4 = 2").selectExpr(
                "2 * p_partkey + 1 AS page_id", f"'https://parts.example.org/calendar/' || {P} AS url", f"{FRAMED_PART_HTML} AS html"
            )
        )

    return derived(spark, sf_dir, "part_pages", build)


def _part_answers(pages: DataFrame) -> DataFrame:
    """Sections of every fourth part, and of the framed pages, hold an event; the others are answered with null."""
    number = F.floor(F.col("page_id") / 2)
    live = (number % 4 == 1) | (F.col("page_id") % 2 == 1)
    event = F.concat(F.lit('```json\n{"title":"Meeting of '), F.col("page_id").cast("string"), F.lit('","start_time":"2025-01-06"}\n```'))
    return section_prompts(pages, _as_of()).select(
        F.lit("section").alias("kind"), F.col("prompt_key").alias("key"), F.when(live, event).otherwise("null").alias("content"), F.lit("ok").alias("status")
    )


def link_expansion(spark, sf_dir):
    pages = part_pages(spark, sf_dir)
    return crawl_sections(pages, _part_answers(pages), _as_of()).select("root", "page_url", "title", "url", "start_time")


def link_expansion_deep(spark, sf_dir):
    pages = part_pages(spark, sf_dir)
    found = crawl_sections(pages, _part_answers(pages), _as_of(), max_depth=3)
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("events"), F.min("title").alias("first_title"))


# ---- streams -------------------------------------------------------------------------------------


def _arrivals(spark, pages: DataFrame, copies: int = 1) -> str:
    folder = f"{shared_folder(spark)}/almanac/{uuid.uuid4().hex}"
    for n in range(copies):
        pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_750_000_000 + 60 * n))).write.mode("append").parquet(folder)
    return folder


def _files_per_batch(spark) -> int:
    """A batch of fewer files than the session has cores leaves cores without work."""
    return max(4, spark.sparkContext.defaultParallelism)


def _streamed(spark, events: DataFrame) -> DataFrame:
    out = f"{shared_folder(spark)}/almanac/{uuid.uuid4().hex}"
    continuous.write_available(events, f"{out}/events", f"{out}/state").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{out}/events")


def continuous_events(spark, sf_dir):
    folder = _arrivals(spark, order_pages(spark, sf_dir))
    found = _streamed(spark, continuous.continuous_events(continuous.arriving_pages(spark, folder, _files_per_batch(spark))))
    return found.select("page_id", "block_pos", "item_pos", "external_id", "title", "start_time", "end_time", "url")


def continuous_extraction(spark, sf_dir):
    """Towns first, what they need after them: three batches, each of which changes what is known of earlier pages."""
    pages, answers, hinted = towns(spark, sf_dir)
    folder, store = (f"{shared_folder(spark)}/almanac/{uuid.uuid4().hex}" for _ in "ab")
    first = F.col("page_id") % 10 == 0
    even = F.floor(F.col("page_id") / 10) % 2 == 0
    for part in (first & even, ~first, first & ~even):
        pages.filter(part).withColumn("fetched_at", F.timestamp_seconds(F.lit(1_750_000_000))).write.mode("append").parquet(folder)
        arriving = continuous.arriving_pages(spark, folder, 10_000)
        extraction.extraction_stream(arriving, store, f"{store}/state", _as_of(), answers, hinted).start().awaitTermination()
    return extraction.current_events(spark, store).select(
        "page_id", "method", "source_ord", "seq", "target_url", "external_id", "title", "description", "start_time", "end_time", "url"
    )


def repeat_suppression(spark, sf_dir):
    folder = _arrivals(spark, order_pages(spark, sf_dir), copies=2)
    events = continuous.continuous_events(continuous.arriving_pages(spark, folder, _files_per_batch(spark)))
    return _streamed(spark, continuous.without_repeats(events)).groupBy("external_id").agg(F.count(F.lit(1)).alias("events"))


QUERIES = {
    "page_frames": page_frames,
    "frame_events": frame_events,
    "rendered_frames": rendered_frames,
    "calendar_events": calendar_events,
    "calendar_repair": calendar_repair,
    "method_union": method_union,
    "event_sink": event_sink,
    "extraction_status": extraction_status,
    "extraction_events": extraction_events,
    "extraction_responses": extraction_responses,
    "link_expansion": link_expansion,
    "link_expansion_deep": link_expansion_deep,
    "continuous_events": continuous_events,
    "repeat_suppression": repeat_suppression,
    "request_responses": request_responses,
    "continuous_extraction": continuous_extraction,
}

_HOST_OF = "regexp_extract({u}, '^https://([^/?#]*)', 1)"


def _hash_id(url: str, title: str, start: str) -> str:
    host = _HOST_OF.format(u=url)
    return f"{host} || ':' || substr(sha1({host} || '|' || {title} || '|' || {start}), 1, 16)"


_FRAME_ROWS = f"""
  SELECT 2 * c_custkey AS page_id, 'iframe' AS method, frame_url AS target_url,
    CASE i WHEN 0 THEN {_hash_id('frame_url', f"'Framed ' || {C}", "'2025-08-11T10:00:00+00:00'")} WHEN 1 THEN 'urn:g:' || {C} ELSE 'urn:z:' || {C} END AS external_id,
    CASE WHEN i = 0 THEN 'Framed ' || {C} ELSE '' END AS title,
    CASE i WHEN 0 THEN '2025-08-11T10:00:00+00:00' WHEN 1 THEN '2025-08-12T00:00:00+00:00' ELSE '2025-08-14T00:00:00+00:00' END AS start_time,
    CASE WHEN i = 2 THEN '2025-08-15T18:00:00+00:00' END AS end_time, frame_url AS url
  FROM (SELECT *, {FRAME_URL} AS frame_url FROM customer) AS c, (VALUES (0), (1), (2)) AS v(i) WHERE frame_url IS NOT NULL"""
_JUNE_URL = f"({CALENDAR} || '1998-june/')"
_CALENDAR_ROWS = f"""
  SELECT 3 * c_custkey AS page_id, 'calendar' AS method, {_JUNE_URL} AS target_url,
    CASE WHEN n = '3' THEN {_hash_id(_JUNE_URL, f"'Walk ' || {C}", "'1998-06-20T18:30:00+00:00'")} ELSE 'urn:' || n || ':' || {C} END AS external_id,
    CASE WHEN n = '3' THEN 'Walk ' || {C} ELSE '' END AS title, start_time,
    CASE WHEN n = '7' THEN strftime(TIMESTAMP '1998-06-24 00:00:00' + to_seconds(600 + c_custkey % 1000), '%Y-%m-%dT%H:%M:%S+00:00') ELSE end_time END AS end_time,
    CASE WHEN n = '3' THEN {CALENDAR} || 'walk' ELSE {_JUNE_URL} END AS url
  FROM customer, (VALUES ('2', '1998-06-08T00:00:00+00:00', '1998-06-08T23:59:59+00:00'), ('3', '1998-06-20T18:30:00+00:00', '1998-06-21T20:00:00+00:00'),
    ('5', '1998-06-22T25:99+00:00', '1998-06-22T23:59:59+00:00'), ('6', '1998-06-23T10:00:00+00:00', '1998-06-23T23:59:59+00:00'),
    ('7', '1998-06-24T00:00:00+00:00', NULL), ('8', '1998-06-25T00:00:00+00:00', '1998-06-26T23:59:59+00:00')) AS v(n, start_time, end_time)
  UNION ALL SELECT 3 * c_custkey, 'calendar', {CALENDAR} || '1998-july/', 'urn:j:' || {C}, '', '1998-07-04T00:00:00+00:00', '1998-07-04T23:59:59+00:00', {CALENDAR} || '1998-july/'
  FROM customer WHERE c_custkey % 5 <> 0"""
_ALL_METHODS = f"""SELECT page_id, method, external_id FROM ({_CALENDAR_ROWS}) UNION ALL SELECT 3 * c_custkey, 'jsonld', 'urn:own:' || {C} FROM customer
  UNION ALL SELECT 3 * c_custkey + 2, 'jsonld', 'urn:j:' || {C} FROM customer"""
_TOWN_EVENTS = f"""
  SELECT 10 * c_custkey AS page_id, 'jsonld' AS method, 0 AS source_ord, 0 AS seq, {TOWN} AS target_url, 'urn:own:' || {C} AS external_id, '' AS title, '' AS description,
    '1997-01-01T00:00:00+00:00' AS start_time, NULL AS end_time, {TOWN} AS url FROM customer WHERE {KIND} = 0
  UNION ALL SELECT 10 * c_custkey, 'llm', 0, 0, {TOWN}, {_hash_id(TOWN, f"'Fair ' || {C}", "'2025-07-04T00:00:00-04:00'")}, 'Fair ' || {C}, '',
    '2025-07-04T00:00:00-04:00', '2025-07-05T23:59:59-04:00', NULL FROM customer WHERE {KIND} = 1
  UNION ALL SELECT 10 * c_custkey, 'llm', 0, 1, {TOWN}, 'talk:' || {C}, 'Talk', 'd', '2025-12-01T10:00:00+00:00', NULL, 'https://talks.example.org/' FROM customer WHERE {KIND} = 1
  UNION ALL SELECT 10 * c_custkey + own, 'llm', 0, 0, {DETAIL}, {_hash_id(DETAIL, f"'Walk ' || {C}", "'2025-03-01T09:00:00+00:00'")}, 'Walk ' || {C}, '',
    '2025-03-01T09:00:00+00:00', NULL, NULL FROM customer, (VALUES (0), (1)) AS v(own) WHERE {KIND} = 4
  UNION ALL SELECT 10 * c_custkey, 'llm', 0, 0, {TOWN}, {_hash_id(TOWN, f"'Walk ' || {C}", "'2025-03-01T09:00:00+00:00'")}, 'Walk ' || {C}, '',
    '2025-03-01T09:00:00+00:00', NULL, NULL FROM customer WHERE {KIND} = 5"""
_TOWN_PAGES = f"""SELECT p.page_id, coalesce(n, 0) > 0 AS success, CASE WHEN m IS NOT NULL THEN m WHEN broken THEN 'failed' ELSE 'none' END AS extraction_method, p.page_title, coalesce(n, 0) AS total_found
  FROM (SELECT 10 * c_custkey AS page_id, 'Town & ' || {C} AS page_title, {KIND} = 2 AS broken FROM customer UNION ALL SELECT 10 * c_custkey + 1, 'Unknown', false FROM customer) AS p
  LEFT JOIN (SELECT page_id, count(*) AS n, max(method) AS m FROM ({_TOWN_EVENTS}) GROUP BY page_id) AS e ON e.page_id = p.page_id"""

_EDGES = f"SELECT p_partkey AS a, {NEXT} AS b FROM part WHERE NOT ({_LIVE})"
# What each part reaches: itself, the part its section names if it has no event, and its frame if nothing else had one.
_REACH2 = f"""
  SELECT root, page, framed FROM (
    WITH here AS (SELECT p_partkey AS root, p_partkey AS page FROM part UNION SELECT a, b FROM ({_EDGES}) JOIN part ON p_partkey = b)
    SELECT root, page, false AS framed FROM here
    UNION ALL SELECT p_partkey, p_partkey, true FROM part WHERE p_partkey % 4 = 2 AND p_partkey NOT IN (SELECT root FROM here WHERE page % 4 = 1))"""
_REACH3 = f"""
  SELECT root, page, framed FROM (
    WITH two AS ({_REACH2}), here AS (SELECT p_partkey AS root, p_partkey AS page, false AS framed FROM part UNION SELECT a, page, framed FROM ({_EDGES}) JOIN two ON root = b)
    SELECT root, page, framed FROM here
    UNION ALL SELECT p_partkey, p_partkey, true FROM part WHERE p_partkey % 4 = 2 AND p_partkey NOT IN (SELECT root FROM here WHERE page % 4 = 1 OR framed))"""
_PART_EVENT = "'Meeting of ' || CAST(2 * page + CASE WHEN framed THEN 1 ELSE 0 END AS STRING)"

ORACLES = {
    "page_frames": f"""SELECT 2 * c_custkey AS page_id, {FRAME_URL} AS frame_url, CASE WHEN c_custkey % 7 IN (0, 1, 2) THEN {FRAME_URL}
      WHEN c_custkey % 7 = 6 THEN {_SITE} || '/a/b/schedule.html' ELSE {_SITE} || '/a/b/late-event.html' END AS calendar_frame_url FROM customer""",
    "frame_events": _FRAME_ROWS,
    "rendered_frames": f"SELECT * FROM ({_FRAME_ROWS}) WHERE (page_id / 2) % 2 = 0",
    "calendar_events": _CALENDAR_ROWS,
    "calendar_repair": f"""SELECT page_id, count(*) + 1 AS events, max(start_time) AS last_start, 2 AS at_ten FROM ({_CALENDAR_ROWS}) GROUP BY page_id""",
    "method_union": f"SELECT page_id, method, count(*) AS events FROM ({_ALL_METHODS}) GROUP BY ALL",
    "event_sink": f"SELECT method, count(*) AS events, count(DISTINCT external_id) AS ids FROM ({_ALL_METHODS}) GROUP BY method",
    "extraction_status": _TOWN_PAGES,
    "extraction_events": _TOWN_EVENTS,
    "continuous_extraction": _TOWN_EVENTS,
    "request_responses": f"""SELECT request_id, total_found > 0 AS success, extraction_method, CASE WHEN gone THEN 'Unknown' ELSE 'Town & ' || {C} END AS page_title, total_found,
        total_found = request_id % 3 AS as_expected, set_aside,
        CASE WHEN {KIND} = 1 AND total_found = 1 AND request_id % 3 <> 1 THEN 1 ELSE 0 END AS conforming,
        CASE WHEN total_found = 0 THEN '' WHEN {KIND} = 1 THEN CASE WHEN request_id % 3 = 1 THEN 'end' ELSE '' END
          ELSE CASE request_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'end,title' ELSE 'location' END END AS missing,
        0 AS part, CASE WHEN total_found = 0 THEN '' WHEN {KIND} = 0 THEN 'urn:own:' || {C} ELSE 'talk:' || {C} END AS ids
      FROM (SELECT *, CASE WHEN gone THEN 'failed' WHEN {KIND} = 0 THEN 'jsonld' WHEN {KIND} = 1 AND NOT hinted THEN 'llm' WHEN {KIND} = 2 AND NOT hinted THEN 'failed'
            WHEN {KIND} = 4 AND hinted THEN 'llm' WHEN {KIND} = 5 AND NOT hinted THEN 'llm' ELSE 'none' END AS extraction_method,
          CASE WHEN NOT gone AND ({KIND} = 0 OR ({KIND} = 1 AND NOT hinted)) THEN 1 ELSE 0 END AS total_found,
          CASE WHEN NOT gone AND (({KIND} IN (1, 5) AND NOT hinted) OR ({KIND} = 4 AND hinted)) THEN 1 ELSE 0 END AS set_aside
        FROM (SELECT o_orderkey AS request_id, o_custkey AS c_custkey, o_orderkey % 2 = 0 AS hinted, o_orderkey % 10 = 9 AS gone FROM orders))""",
    "extraction_responses": f"""SELECT s.page_id, success, 0 AS part, total_found AS events, f.external_id AS first_id, l.title AS last_title FROM ({_TOWN_PAGES}) AS s
      LEFT JOIN ({_TOWN_EVENTS}) AS f ON f.page_id = s.page_id AND f.seq = 0 LEFT JOIN ({_TOWN_EVENTS}) AS l ON l.page_id = s.page_id AND l.seq = s.total_found - 1""",
    "link_expansion": f"""SELECT 'https://parts.example.org/' || CAST(root AS STRING) AS root, u AS page_url, {_PART_EVENT} AS title,
        u AS url, '2025-01-06' AS start_time FROM (SELECT *, 'https://parts.example.org/' || CASE WHEN framed THEN 'calendar/' ELSE '' END || CAST(page AS STRING) AS u FROM ({_REACH2}))
      WHERE framed OR page % 4 = 1
      UNION ALL SELECT u, u, 'Meeting of ' || CAST(2 * p_partkey + 1 AS STRING), u, '2025-01-06' FROM (SELECT *, 'https://parts.example.org/calendar/' || {P} AS u FROM part WHERE p_partkey % 4 = 2)""",
    "link_expansion_deep": f"""SELECT 'https://parts.example.org/' || CAST(root AS STRING) AS root, count(*) AS events, min({_PART_EVENT}) AS first_title FROM ({_REACH3})
      WHERE framed OR page % 4 = 1 GROUP BY root
      UNION ALL SELECT 'https://parts.example.org/calendar/' || {P}, 1, 'Meeting of ' || CAST(2 * p_partkey + 1 AS STRING) FROM part WHERE p_partkey % 4 = 2""",
    "continuous_events": f"SELECT page_id, block_pos, item_pos, external_id, title, start_time, end_time, url FROM ({EXPECTED_EVENTS})",
    "repeat_suppression": f"SELECT DISTINCT external_id, 1 AS events FROM ({EXPECTED_EVENTS})",
}
