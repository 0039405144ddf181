"""Structured data on literal pages."""
import json

import pytest
from pyspark.sql import functions as F, types as T

from almanac.functions.html import jsonld_blocks, page_nodes, title
from almanac.functions.plain import MOST_ITEMS, PLAIN, plain_events
from almanac.operators import crawl, jsonld
from almanac.plans.extract import extract

def script(*objects, kind="application/ld+json"):
    return "".join(f'<script type="{kind}">{o if isinstance(o, str) else json.dumps(o)}</script>' for o in objects)


def event(**fields):
    return {"@type": "Event", **{k.replace("at_", "@"): v for k, v in fields.items()}}


def pages_of(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")


def read(spark, html, url="https://town.example.org/a/b", **options):
    return jsonld.page_events(pages_of(spark, (url, html)), **options).orderBy("seq").collect()


HALL = "https://hall.example/programme/spring"
BOOKINGS = "https://hall.example/programme/embedded?season=2"


def test_event_of_a_frame(spark):
    recital = event(name="Organ recital", startDate="2031-04-09", url="/recitals/17")
    pages = pages_of(
        spark,
        (HALL, '<p>Doors open early.</p><iframe width="300" src="embedded?season=2">none</iframe>'),
        (BOOKINGS, "<h1>Season</h1>" + script(recital)),
    )
    found = extract(pages, F.lit("2031-04-10").cast("date"))
    rows = found.events.filter(F.col("page_id") == 0).collect()
    assert [(r.title, r.url, r.start_time, r.method) for r in rows] == [
        ("Organ recital", "/recitals/17", "2031-04-09T00:00:00+00:00", "iframe")
    ]
    assert {(r.page_url, r.extraction_method, r.total_found) for r in found.pages.collect()} == {(HALL, "jsonld", 1), (BOOKINGS, "jsonld", 1)}
    # without a model to ask there is no rating
    assert rows[0].validation_score is None and rows[0].tags is None


def test_separate_times(spark):
    (row,) = read(spark, script(event(name="Night market", startDate="2031-10-30", startTime="21:15:10", endTime="23:05:00")))
    assert (row.title, row.start_time, row.end_time) == ("Night market", "2031-10-30T21:15:10+00:00", "2031-10-30T23:05:00+00:00")


PLACE = {
    "@type": "Place", "name": "Boathouse \"Tern\" <upper deck>", "address": {"streetAddress": "Weir path", "postalCode": "00-417"},
    "geo": [54.1, 18.6], "maximumAttendeeCapacity": 40,
}


@pytest.mark.parametrize("value, kind, text, place", [
    (PLACE, "place", None, "Boathouse \"Tern\" <upper deck>"),
    ([{"@type": "Place", "name": "Glasshouse"}, {"@type": "Place", "name": "Second"}], "place", None, "Glasshouse"),
    ("by the weir", "text", "by the weir", None),
    ({"name": "Orchard", "address": "Mill lane"}, "text", "Orchard", None),
    ({"name": "", "address": "Mill lane"}, "text", "Mill lane", None),
    ({"other": 1}, "text", "", None),
    (["by the weir"], "text", "", None),
    ([], "text", "", None),
    (7, "text", "", None),
    (None, "text", "", None),
])
def test_locations(spark, value, kind, text, place):
    (row,) = read(spark, script(event(startDate="2025-01-01", location=value)))
    assert (row.location.kind, row.location.text, row.location.place and row.location.place.name) == (kind, text, place)
    if value is PLACE:
        assert json.loads(row.location.place.raw) == PLACE


@pytest.mark.parametrize("value, expected", [
    ("Rowing club", "Rowing club"), ({"@type": "Person", "name": "A. Miller", "email": "a@weir.example"}, "A. Miller"),
    (None, ""), ("", ""), ({}, ""), ([{"name": "x"}], ""),
])
def test_organizers(spark, value, expected):
    (row,) = read(spark, script(event(startDate="2025-01-01", organizer=value)))
    assert row.organizer == expected


@pytest.mark.parametrize("data, names", [
    ([event(name="a"), {"@type": "Thing"}, 3, None, event(name="b")], ["a", "b"]),
    (event(name="a", at_graph=[event(name="b")]), ["a"]),
    ({"@graph": [event(name="a"), "x", {"@graph": [event(name="b")]}]}, ["a"]),
    ({"@type": ["Event"], "name": "a"}, []),
    ({"@type": "MusicEvent", "name": "a"}, []),
    ("text", []), (7, []), ([[event(name="a")]], []),
])
def test_event_objects(spark, data, names):
    assert [r.title for r in read(spark, script(json.dumps(data)))] == names


@pytest.mark.parametrize("fields, start, end", [
    (dict(startDate="2025-01-01"), "2025-01-01T00:00:00+00:00", None),
    (dict(startDate="2025-01-01", doorTime="18:00"), "2025-01-01T18:00:00+00:00", None),
    (dict(startDate="2025-01-01", startTime="", doorTime="18:00"), "2025-01-01T18:00:00+00:00", None),
    (dict(startDate="2025-01-01T10:00:00", startTime="18:00"), "2025-01-01T10:00:00+00:00", None),
    (dict(startDate="2025-01-01", endDate="2025-01-02"), "2025-01-01T00:00:00+00:00", "2025-01-02T23:59:59+00:00"),
    (dict(startDate="2025-01-01", endDate="2025-01-02T08:00:00Z", endTime="9"), "2025-01-01T00:00:00+00:00", "2025-01-02T08:00:00+00:00"),
    (dict(startDate="2025-01-01", endTime="09:00:00"), "2025-01-01T00:00:00+00:00", "2025-01-01T09:00:00+00:00"),
    (dict(startDate="2025-01-01", duration="PT60S"), "2025-01-01T00:00:00+00:00", None),
    (dict(startDate="2025-01-01T10:00:00", duration="PT60S", endDate="2025-01-09"), "2025-01-01T10:00:00+00:00", "2025-01-01T10:01:00+00:00"),
    # the offset of the start is lost when a duration is added
    (dict(startDate="2025-01-01T10:00:00-05:00", duration="PT60S"), "2025-01-01T10:00:00-05:00", "2025-01-01T10:01:00+00:00"),
    (dict(startDate="2025-01-01T10:00:00", duration="PT1H"), "2025-01-01T10:00:00+00:00", None),
    (dict(startDate="2025-01-01T10:00:00", duration="PT60S", endTime="11:00:00"), "2025-01-01T10:00:00+00:00", "2025-01-01T11:00:00+00:00"),
    (dict(duration="PT1H0M0S"), None, None),
    (dict(), None, None),
    (dict(startDate=None, endDate=""), None, None),
])
def test_times(spark, fields, start, end):
    (row,) = read(spark, script(event(**fields)))
    assert (row.start_time, row.end_time) == (start, end)


@pytest.mark.parametrize("fields, reason", [
    (dict(startDate="soon"), "unreadable_start"),
    (dict(startDate="2025-01-01", startTime="7:30"), "unreadable_start"),
    (dict(startDate=20250101), "unreadable_start"),
    (dict(startDate="2025-01-01", endDate="later"), "unreadable_end"),
    (dict(startDate="2025-01-01T10:00:00", duration="PT1H30M0S"), "unreadable_duration"),
    (dict(startDate="2025-01-01", duration=90), "unreadable_duration"),
])
def test_one_bad_date_loses_the_page(spark, fields, reason):
    html = script(event(at_id="a", startDate="2025-01-01")) + script(event(**fields))
    assert read(spark, html) == []
    assert [r.external_id for r in read(spark, html, on_error="item")] == ["a"]
    rejects = jsonld.rejected_events(pages_of(spark, ("u", html))).collect()
    assert [(r.block_pos, r.reason) for r in rejects] == [(1, reason)]


@pytest.mark.parametrize("html, count", [
    ("<!-- " + script(event(name="a")) + " -->", 0),
    (script(event(name="a"), kind="application/LD+json"), 0),
    (script(event(name="a"), kind="application/ld+json;charset=utf-8"), 0),
    ("<SCRIPT data-x='>' TYPE = application/ld+json >" + json.dumps(event(name="a")) + "</SCRIPT >", 1),
    ("<script>var s = '<script type=\"application/ld+json\">';</script>", 0),
    ("<style>/* <!-- */</style>" + script(event(name="a")), 1),
    ("<script type='application/ld+json'>" + json.dumps(event(name="<!-- a -->")) + "</script>", 1),
    ("<script type='application/ld+json'>" + json.dumps(event(name="a")), 0),
    (script("{broken", event(name="a")), 1),
    ("<script type='application/ld&#x2B;json'>" + json.dumps(event(name="a")) + "</script>", 1),
    ("<scripture type='application/ld+json'>" + json.dumps(event(name="a")) + "</scripture>", 0),
])
def test_blocks(spark, html, count):
    assert len(read(spark, html)) == count


def test_large_block_with_large_comment(spark):
    html = "<!--" + "y<" * 500_000 + "-->" + script(event(name="n", description="x" * 2_000_000)) + "<div " + 'a="b" ' * 50_000 + ">"
    (row,) = read(spark, html)
    assert len(row.description) == 2_000_000


def test_title_link(spark):
    html = '<a>Concert</a><a href="">Concert</a><a href="#">other</a><a href="../c"><b>Big</b> CONCERT tonight</a><a href="/d">concert</a>'
    rows = read(spark, html + script([event(name=" concert "), event(name="missing"), event(name=""), event(name="concert", url="https://own.example.org/")]))
    assert [r.url for r in rows] == [
        "https://town.example.org/c", "https://town.example.org/a/b", "https://town.example.org/a/b", "https://own.example.org/"
    ]


def test_null_and_missing_names(spark):
    rows = read(spark, script([event(name=None), event()]))
    assert [r.title for r in rows] == [None, ""]
    assert rows[0].external_id != rows[1].external_id


def test_titles_of_pages(spark):
    rows = pages_of(spark, ("a", "<title>\n A &amp; \n B &#039;s</title>"), ("b", "<p>none</p>"), ("c", "<TITLE lang=x></TITLE>"))
    assert [r.t for r in rows.select(title(F.col("html")).alias("t")).collect()] == ["A & B 's", "Unknown", ""]


def test_frames(spark):
    pages = pages_of(
        spark,
        ("http://e.org/a/", '<iframe></iframe><iframe src="x"></iframe><iframe src="/My-EVENTS?a=1&amp;b=2"></iframe>'),
        ("http://e.org/b/", "<!-- <iframe src=no> --><iframe src=x></iframe>"),
        ("http://e.org/c/", "<p>iframe</p>"),
    )
    found = {r.page_id: (r.frame_url, r.calendar_frame_url) for r in crawl.page_frames(pages).collect()}
    assert found == {0: (None, "http://e.org/My-EVENTS?a=1&b=2"), 1: ("http://e.org/b/x", None)}


def test_nodes(spark):
    html = "<div><p>a<p>b<br>c</div></b> d &amp; e<script>x<p></script><li/>f"
    (row,) = spark.createDataFrame([(html,)], "html string").select(page_nodes(F.col("html")).alias("n")).collect()
    shown = [(n.pre, n.last, n.parent, n.depth, n.kind, n.tag or n.text) for n in row.n]
    assert shown == [
        (0, 6, -1, 0, "element", "div"), (1, 6, 0, 1, "element", "p"), (2, 2, 1, 2, "text", "a"), (3, 6, 1, 2, "element", "p"),
        (4, 4, 3, 3, "text", "b"), (5, 5, 3, 3, "element", "br"), (6, 6, 3, 3, "text", "c"), (7, 7, -1, 0, "text", " d & e"),
        (8, 9, -1, 0, "element", "script"), (9, 9, 8, 1, "script", "x<p>"), (10, 10, -1, 0, "element", "li"), (11, 11, -1, 0, "text", "f"),
    ]


def test_block_extraction_is_stable_on_no_script(spark):
    (row,) = spark.createDataFrame([("<p>x</p>",)], "html string").select(jsonld_blocks(F.col("html")).alias("b")).collect()
    assert row.b == []


def test_no_shuffle_for_page_events(spark):
    plan = jsonld.page_events(pages_of(spark, ("u", "h")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_fields_of_an_event_are_read_by_one_walk_over_it(spark):
    events = [
        {"@type": "Event", "name": None, "startDate": "2025-01-01", "duration": "PT60S", "url": "", "eventStatus": {"a": 1}, "location": None},
        {"@type": "Event", "startDate": "2025-01-01", "duration": 60, "description": 7, "organizer": {"name": "Org"}, "@id": "urn:1"},
        {"@type": "Event", "name": "Fair", "startDate": "2025-01-01", "doorTime": "18:00", "duration": None, "endTime": "", "eventStatus": None},
    ]
    html = '<a href="/fair">The FAIR</a>' + "".join(f'<script type="application/ld+json">{json.dumps(e)}</script>' for e in events)
    pages = spark.createDataFrame([(1, "https://a.example/x", html)], "page_id long, url string, html string")
    found = jsonld.page_events(pages, on_error="item")
    rows = {r.block_pos: (r.title, r.external_id, r.description, r.event_status, r.organizer, r.start_time, r.url) for r in found.collect()}
    assert sorted(rows) == [0, 2]  # a duration that is a number cannot be read
    assert rows[0][0] is None and rows[0][2:5] == ("", '{"a":1}', "")
    assert rows[2][0] == "Fair" and rows[2][3:] == (None, "", "2025-01-01T18:00:00+00:00", "https://a.example/fair")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f"$.{name}," in plan for name in ("startDate", "endDate", "doorTime", "eventStatus"))


CRAFT = event(name="Basket weaving", startDate="2031-05-06")
PLAIN_PAGES = [
    script(CRAFT), script([CRAFT, 7, {"@type": "Thing"}, event(at_id="urn:w:2", startDate="2031-05-07T09:00Z", duration="PT5400S")]), script({"@graph": [CRAFT, None]}),
    script(event(name="Loom", startDate="2031-05-06", doorTime="18:00", endDate="2031-05-07", location="Mill", organizer={"name": "Guild"}), CRAFT),
    script(event(name="Loom", startDate="2031-05-06T10:00:00-05:00", endTime="11:30", location=[{"name": "", "address": "Yard"}], organizer=["x"], duration="PT2H")),
    script(event(name="Loom", startDate="2031-05-06", location={"@type": "Place", "name": "Mill", "address": {"streetAddress": "Weir path"}}, description=None)),
    script(event(name=" loom ", startDate="2031-05-06")) + '<a href="../x?a=1&amp;b=2"><b>To the</b> LOOM</a>', script('{"@type":"Event",'), script(CRAFT).replace('"Basket', '"A &amp;quot; B'),
    script({"offers": [{"price": 12.5}], **CRAFT}), "<!-- " + script(CRAFT) + " --->" + script(CRAFT).replace("script", "SCRIPT"), script(event(name="no start")), script(3, None, "x"),
]
ODD_PAGES = [
    script(event(name="Loom", startDate=day)) for day in ("2031-5-6", "2031-02-30", "soon", "2031-05-06T25:00", "2031-05-06T10:00:00.5", "2031-W05-1", 2031)
] + [
    script('{"@type":"Event","name":"a","name":"b","startDate":"2031-05-06"}'), script('{"@type":"Event","name":"a","startDate":"2031-05-06","n":NaN}'), script("{} {}"),
    script(event(name=None, startDate="2031-05-06")), script(event(name=4, startDate="2031-05-06")), script({"@type": "Event", "location": {"geo": 1.50}}), script(event(name="\U0001f3ad")),
    script(event(name="Loom", startDate="2031-05-06", duration="PT-5S")), script(event(name="\u03a3\u0391\u03a3")) + "<a href=x>\u03c3</a>", script([CRAFT] * (MOST_ITEMS + 1)), script("[" * 600 + "]" * 600),
]


def test_plain_pages_are_told_from_odd_ones(spark):
    pages = pages_of(spark, *[("u", h) for h in [*PLAIN_PAGES, *ODD_PAGES, None]])
    rows = pages.select("page_id", plain_events(F.col("html")).alias("p")).orderBy("page_id").collect()
    assert [r.p is not None for r in rows] == [True] * len(PLAIN_PAGES) + [False] * (len(ODD_PAGES) + 1)


@pytest.mark.parametrize("on_error", ["page", "item"])
def test_plain_pages_read_the_same_by_expressions(spark, monkeypatch, on_error):
    pages = pages_of(spark, *[(u, h) for h in PLAIN_PAGES + ODD_PAGES + [a + b for a, b in zip(PLAIN_PAGES, ODD_PAGES)] for u in ("https://h.example/a/b", None)])
    found = jsonld.page_events(pages, on_error)
    monkeypatch.setattr(jsonld, "plain_events", lambda html: F.lit(None).cast(T.ArrayType(PLAIN)))
    expected = jsonld.page_events(pages, on_error)
    assert found.schema == expected.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_plain_pages_do_not_go_through_the_expressions(spark, monkeypatch):
    monkeypatch.setattr(jsonld, "read_linked", lambda items, rule: F.when(F.size(items) > 0, F.raise_error(F.lit("read as an odd page"))).otherwise(items))
    monkeypatch.setattr(jsonld, "surviving", lambda timed, rule, on_error: F.transform(timed, lambda t: F.struct(
        *[t[c].alias(c) for c in ("block_pos", "item_pos", "item", "href")], *[F.lit(None).cast("string").alias(c) for c in ("start_time", "end_time", "error")])))
    assert jsonld.page_events(pages_of(spark, *[("u", h) for h in PLAIN_PAGES])).count() == 13
