"""The fallback plan, branch by branch."""
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from almanac import schemas
from almanac.operators.hints import resolve_hints
from almanac.plans.extract import extract

AS_OF = "2025-01-01"
WORDS = "words " * 60
SITE = "https://town.example.org"


def as_of():
    return F.lit(AS_OF).cast("date")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pages_of(spark, *rows):
    return table(spark, [(i, SITE + u, h) for i, (u, h) in enumerate(rows)], schemas.PAGES)


def answer(url, text, *events, content=None):
    key = hashlib.sha256(f"URL: {SITE}{url}\n\nPAGE_TEXT:\n{text}".encode()).hexdigest()
    return ("page", key, json.dumps({"events": list(events)}) if content is None else content, "ok")


def event(title):
    return {"title": title, "start": "2025-05-01"}


def run(spark, pages, answers, hints=None, **options):
    recorded = table(spark, answers, schemas.RESPONSES)
    given = None if hints is None else table(spark, [(SITE + u, s) for u, s in hints], "url string, selectors array<string>")
    found = extract(pages, as_of(), recorded, given, **options)
    methods = {r.page_id: r.extraction_method for r in found.pages.collect()}
    titles = sorted((r.page_id, r.title) for r in found.events.collect())
    return methods, titles


TEXT = WORDS.strip()
PLAIN = f"<body><p>{WORDS}</p></body>"
HINTED = f'<body><div class="e"><p>{WORDS}</p><a href="/d">d</a></div><p>rest</p></body>'


def test_short_and_missing_answers_give_none(spark):
    pages = pages_of(spark, ("/a", PLAIN), ("/b", "<p>short</p>"))
    assert run(spark, pages, [answer("/x", TEXT, event("x"))]) == ({0: "none", 1: "none"}, [])


def test_hints_lead_to_detail_pages_only(spark):
    pages = pages_of(spark, ("/a", HINTED), ("/d", PLAIN))
    answers = [answer("/d", TEXT, event("detail")), answer("/a", f"{TEXT}\nd\nrest", event("whole"))]
    assert run(spark, pages, answers, [("/a", [".e"])]) == ({0: "llm", 1: "llm"}, [(0, "detail"), (1, "detail")])
    assert run(spark, pages, answers, [("/a", [".e"]), ("/a", None), ("/a", [".e"])])[1] == [(0, "detail"), (1, "detail")]
    assert run(spark, pages, answers, [("/a", [])]) == ({0: "none", 1: "llm"}, [(1, "detail")])
    assert run(spark, pages, answers, [("/a", [".none"])]) == ({0: "none", 1: "llm"}, [(1, "detail")])
    assert run(spark, pages, answers, [("/other", [".e"])]) == ({0: "llm", 1: "llm"}, [(0, "whole"), (1, "detail")])


def test_hints_narrow_the_text_when_links_are_not_followed(spark):
    pages = pages_of(spark, ("/a", HINTED))
    answers = [answer("/a", f"{TEXT}\nd", event("chunk")), answer("/a", f"{TEXT}\nd\nrest", event("whole"))]
    assert run(spark, pages, answers, [("/a", [".e"])], follow_links=False) == ({0: "llm"}, [(0, "chunk")])
    assert run(spark, pages, answers, [("/a", [".none"])], fallback_when_no_links=True) == ({0: "llm"}, [(0, "whole")])


def test_model_reads_through_frames(spark):
    pages = pages_of(
        spark, ("/a", '<iframe src="/f"></iframe>'), ("/b", '<iframe src="/gone"></iframe>'), ("/f", PLAIN),
        ("/c", '<iframe src="/g"></iframe>'), ("/g", '<div class="e"><a href="/f">f</a></div>'),
    )
    answers = [answer("/a", TEXT, event("framed")), answer("/f", TEXT, event("own"))]
    methods, titles = run(spark, pages, answers, [("/c", [".e"])])
    assert methods == {0: "llm", 1: "failed", 2: "llm", 3: "llm", 4: "none"}
    assert titles == [(0, "framed"), (2, "own"), (3, "own")]


def test_failed_answers(spark):
    pages = pages_of(spark, ("/a", PLAIN), ("/b", PLAIN), ("/c", PLAIN))
    answers = [
        answer("/a", TEXT, content="not json"), answer("/b", TEXT, event("ok"), {"title": "bad", "start": "soon"}),
        ("page", "nobody", "x", "ok"), answer("/c", TEXT, event("fine")), (*answer("/c", TEXT)[:2], None, "timeout"),
    ]
    assert run(spark, pages, answers) == ({0: "failed", 1: "failed", 2: "llm"}, [(2, "fine")])


def test_a_page_with_a_bad_date_goes_to_the_model(spark):
    bad = '<script type="application/ld+json">[{"@type":"Event","name":"a","startDate":"2025-01-01"},{"@type":"Event","startDate":"soon"}]</script>'
    pages = pages_of(spark, ("/events/", bad + PLAIN), ("/events/2025-january/", bad.replace("soon", "2025-01-03")))
    assert run(spark, pages, [answer("/events/", TEXT, event("model"))])[1] == [(0, "model"), (1, ""), (1, "a")]
    # item by item the good event stays, and the month page is followed
    methods, titles = run(spark, pages, [answer("/events/", TEXT, event("model"))], on_error="item")
    assert methods == {0: "jsonld", 1: "jsonld"} and titles == [(0, ""), (0, "a"), (0, "a"), (1, ""), (1, "a")]


@pytest.mark.parametrize("asked, found, expected", [
    ([".a"], [".b"], ([".a"], "request")), ([], [".b"], ([".b"], "discovered")), (None, [], ([], "discovered")), (None, None, (None, None)),
])
def test_who_gives_the_hints(spark, asked, found, expected):
    requests = table(spark, [("u", (None, None, asked, None), None)], schemas.REQUESTS)
    discovered = table(spark, [] if found is None else [("u", found)], "url string, event_containers array<string>")
    row = resolve_hints(requests, discovered).first()
    assert (row.selectors, row.origin) == expected



def test_failed_calls_fail_their_page(spark):
    from almanac.operators.models import page_answer_events

    rows = [("u1", None, "timeout"), ("u2", '{"events":[{"title":"t","start":"2025-01-01","timezone":"EST"}]}', "ok"), ("u3", None, None)]
    found = page_answer_events(spark.createDataFrame(rows, "url string, content string, status string")).orderBy("page_url").collect()
    assert [(r.page_url, r.failed, r.start_time) for r in found] == [("u1", True, None), ("u2", False, "2025-01-01T00:00:00-05:00")]


def test_addresses_without_fragments_and_pages_fetched_again(spark):
    def frame(name):
        return f'<script type="application/ld+json">{{"@type": "Event", "name": "{name}", "startDate": "2025-02-0{len(name)}"}}</script>'

    led = f'<body><div class="e"><p>{WORDS}</p><a href="/d#part">d</a></div></body>'
    pages = pages_of(
        spark, ("/a", '<iframe src="/f#week"></iframe>'), ("/f", frame("old")), ("/f", frame("later")), ("/l", led),
        ("/d", f"<body><p>earlier {WORDS}</p></body>"), ("/d#top", PLAIN),
    )
    answers = [answer("/d#top", TEXT, event("detail")), answer("/d", f"earlier {TEXT}", event("outdated"))]
    methods, titles = run(spark, pages, answers, [("/l", [".e"])])
    assert [t for p, t in titles if p == 0] == ["later"] and [t for p, t in titles if p == 3] == ["detail"]
    assert methods[0] == "jsonld" and methods[3] == "llm"
