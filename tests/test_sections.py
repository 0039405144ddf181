"""Sections, hints and model answers on literal pages."""
import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from almanac.functions import selectors as SEL
from almanac.functions.html import page_nodes
from almanac.functions.text import DATE_PATTERN, names_a_date, windows
from almanac.operators import hints, models, sections
from almanac.plans.page_events import crawl_sections, section_prompts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HARBOUR_URL = "https://quay.example/visit/"
HARBOUR = (
    '<nav><a href="/">Start</a> <a href="mailto:desk@quay.example">Write to us</a></nav>'
    '<div id="schedule-of-tours">Lantern walk to the lighthouse<style>b{color:red}</style>'
    "<p>Boats leave on Friday, June 5 from pier nine; <b>bring a coat</b></p>"
    '<a href="tel:+3725550101">Call</a><a href="tours/lantern">Book a seat</a></div>'
    "<footer>The harbour office answers letters within a fortnight, as a rule</footer>"
)
KITCHEN_URL = "https://kitchen.example/courses"
KITCHEN = (
    "<ol><li>Knife skills, held in the small kitchen on Tuesday evening by the head cook</li>"
    "<li>Sourdough for the patient: starts on 3 May and ends when the loaf is done</li>"
    "<li>The pantry is closed for building work and nobody knows for how long</li></ol>"
)
WALK = {
    "external_id": "walk-5", "title": "Lantern walk", "description": "By boat, then on foot", "location": "Pier nine",
    "start_time": "2026-06-05T21:30:00+03:00", "metadata_tags": ["boats", "night"],
}
BREAD = {"external_id": "bread", "title": "Sourdough", "description": "", "location": "Small kitchen", "start_time": "2026-05-03T10:00:00+03:00"}
DAY = "2025-01-01"


def as_of():
    return F.lit(DAY).cast("date")


def pages_of(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")


@pytest.fixture()
def pages(spark):
    return pages_of(spark, (HARBOUR_URL, HARBOUR), (KITCHEN_URL, KITCHEN))


def reply(prompts):
    known = {"Lantern": json.dumps(WALK), "Sourdough": "```json\n" + json.dumps(BREAD) + "\n```"}
    return [next((answer for word, answer in known.items() if word in p), "null") for p in prompts]


def test_sections(spark, pages):
    found = sorted(sections.page_sections(pages).collect(), key=lambda r: (r.page_id, r.section_pos))
    assert [(r.page_id, r.rank, r.section.split("\n")[0][:9], r.link_url) for r in found] == [
        (0, 13, "Lantern w", HARBOUR_URL + "tours/lantern"), (1, 16, "Knife ski", None), (1, 16, "Sourdough", None),
    ]
    assert found[0].section.split("\n")[1:] == ["Boats leave on Friday, June 5 from pier nine;", "bring a coat", "Call", "Book a seat"]


def test_model_over_sections(spark, pages):
    prompts = section_prompts(pages, as_of())
    answers = models.run_model(prompts, reply, "section")
    events = crawl_sections(pages, answers, as_of()).collect()
    assert sorted((e.root, e.title, e.url, e.metadata_tags) for e in events) == [
        (KITCHEN_URL, "Sourdough", KITCHEN_URL, []), (HARBOUR_URL, "Lantern walk", HARBOUR_URL + "tours/lantern", ["boats", "night"]),
    ]


def test_no_answers_no_events(spark, pages):
    nothing = spark.createDataFrame([], "kind string, key string, content string, status string")
    assert crawl_sections(pages, nothing, as_of()).count() == 0


def test_failing_model_is_recorded(spark, pages):
    def model(prompts):
        return [OSError("line is dead") if "Sourdough" in p else "null" for p in prompts]

    rows = models.run_model(section_prompts(pages, as_of()), model, "section").collect()
    assert sorted((r.status, r.content) for r in rows if r.content) == [("ok", "null")] * 2
    assert [r.status for r in rows if r.content is None] == ["OSError: line is dead"]


def test_prompts(spark, pages):
    prompt = next(r.prompt for r in section_prompts(pages, as_of()).collect() if "Lantern" in r.prompt)
    assert prompt == models.SECTION_PROMPT.replace("{as_of}", DAY).replace("{url}", HARBOUR_URL).replace(
        "{content}", "Lantern walk to the lighthouse\nBoats leave on Friday, June 5 from pier nine;\nbring a coat\nCall\nBook a seat"
    )
    event = spark.createDataFrame([("T", None, None)], "title string, description string, start_time string").withColumn(
        "location", F.lit(None).cast("struct<kind:string,text:string,place:struct<raw:string>>")
    )
    assert event.select(models.score_prompt().alias("p")).first().p.endswith("Title: T\nDescription: N/A\nLocation: N/A\nDate/Time: N/A")


def test_length_limits_of_containers(spark):
    def li(size):
        return "<li>" + "Monday ".ljust(size, "x") + "</li>"

    pages = pages_of(spark, ("u", "".join(li(n) for n in (49, 50, 5000, 5001))))
    assert [len(r.section) for r in sections.page_sections(pages).orderBy("section_pos").collect()] == [50, 5000]


def naive_cover(spans):
    """Greedy choice written out pair by pair: what the fold over a page's candidates must equal."""
    kept = []
    for rank, pre, last, markup, parts in sorted(spans):
        clash = any(k[1] <= last and pre <= k[2] for k in kept)
        twin = any(markup in k[4] or k[3] in parts or markup == k[3] for k in kept)
        if not (clash or twin):
            kept.append((rank, pre, last, markup, parts))
    return [(k[0], k[1]) for k in kept]


def test_nesting_against_brute_force(spark):
    import random

    random.seed(5)

    def tree(depth):
        text = f"Monday {random.randint(1, 4)} at the old mill by the river, free entry for all"
        if depth == 0 or random.random() < 0.3:
            return text
        tag, cls = random.choice([("li", ""), ("div", ' class="event"'), ("article", ""), ("section", ""), ("div", ""), ("p", ' class="program x"')])
        return f"<{tag}{cls}>" + "".join(tree(depth - 1) for _ in range(random.randint(1, 3))) + f"</{tag}>"

    rows = [("u", "".join(tree(4) for _ in range(4))) for _ in range(40)]
    trees = pages_of(spark, *rows).withColumn("nodes", page_nodes(F.col("html"), signatures=True))
    got = trees.withColumn("ranked", sections.candidates(F.col("nodes"))).withColumn(
        "kept", sections.without_nested(F.col("nodes"), F.col("ranked"))
    ).select("nodes", "ranked", "kept").collect()
    dropped = 0
    for r in got:
        def parts(c):
            return {n.sig for n in r.nodes[c.pre + 1:c.last + 1] if n.kind == "element"}
        expected = naive_cover([(c.rank, c.pre, c.last, c.sig, parts(c)) for c in r.ranked])
        assert [(k.rank, k.pre) for k in r.kept] == expected
        dropped += len(r.ranked) - len(expected)
    assert dropped > 100


def test_scripts_with_event_classes_show_their_own_text(spark):
    html = '<script class="event-data">' + "var day = 'Monday'; // long enough to count as a container of text" + "</script>"
    (row,) = sections.page_sections(pages_of(spark, ("u", html))).collect()
    assert row.section.startswith("var day") and row.tag == "script"


def test_date_context_takes_three_nodes(spark):
    block = "<li>" + "Reading on a quiet Friday evening in the old library hall" + "</li>"
    pages = pages_of(
        spark,
        ("a", "<h3>June 3rd</h3><h4>9:30</h4><!-- c -->" + block),
        ("b", "<h3>June 3rd</h3> <p>x</p> " + block),
        ("c", "on Monday" + block),
    )
    assert {r.url: r.context for r in sections.page_sections(pages).collect()} == {"a": "June 3rd\n9:30", "b": None, "c": "on Monday"}


@pytest.mark.parametrize("links, expected", [
    ('<a href="mailto:a">x</a><a href="tel:1">x</a><a href="#a">Event Details</a><a href="/b">b</a>', "https://e.org/p#a"),
    ('<a href="/a">a</a><a href="/b">visit the Event Website</a>', "https://e.org/b"),
    ('<a href="">a</a><a href="#x">x</a><a href="c">c</a>', "https://e.org/c"),
    ('<a href="/a">a</a><a href="/x/node/1">b</a>', "https://e.org/x/node/1"),
    ('<a href="#x">x</a><a>y</a>', None),
    ('<noscript><a href="/n">event details</a></noscript><a href="/m">m</a>', "https://e.org/m"),
])
def test_section_links(spark, links, expected):
    html = "<li>Reading on a quiet Friday evening in the old library hall" + links + "</li>"
    (row,) = sections.page_sections(pages_of(spark, ("https://e.org/p", html))).collect()
    assert row.link_url == expected


SAMPLE = '<body id="top"><div class="media s-lc-c-evt" data-event="1"><a href="a">A</a><p><a href="b">B</a></p></div><ul class="eventItem x"><li id="one">1</li></ul></body>'


@pytest.mark.parametrize("selector, tags", [
    (".media.s-lc-c-evt", ["div"]), (".media.other", []), ("[data-event]", ["div"]), ("[data-event=1]", ["div"]), ('[class*="Item"]', ["ul"]),
    ("ul li", ["li"]), ("div a", ["a", "a"]), ("p a", ["a"]), ("#one", ["li"]), ("[class*=event]:not(ul)", []), ("body .eventItem", ["ul"]), ("*#one", ["li"]),
    ("[class^=media]", ["div"]), ('[class$="x"]', ["ul"]), ("LI", ["li"]),
])
def test_selectors(spark, selector, tags):
    df = spark.createDataFrame([(SAMPLE, selector)], "html string, s string").withColumn("n", page_nodes(F.col("html")))
    (row,) = df.select(SEL.is_supported(F.col("s")).alias("ok"), F.transform(SEL.select(F.col("n"), SEL.parse(F.col("s"))), lambda n: n["tag"]).alias("t")).collect()
    assert row.ok and row.t == tags


@pytest.mark.parametrize("selector", ["ul > li", "a:hover", "a, b", "", "li:nth-child(2)", "a + b", "::before", "[x"])
def test_unsupported_selectors_are_reported(spark, selector):
    rows = hints.unsupported_hints(spark.createDataFrame([("u", [selector, "li"])], "url string, selectors array<string>")).collect()
    assert [(r.selector_pos, r.selector) for r in rows] == [(0, selector)]


def test_hint_html_windows(spark):
    long = "<script>" + "s" * 60_000 + "</script>" + "x" * 60_000
    df = spark.createDataFrame([("<script>s</script>short",), (long,), ("<style>a</style>",), (None,)], "html string")
    out = [r.h for r in df.select(hints.hint_html(F.col("html")).alias("h")).collect()]
    assert out == [["short"], ["x" * 50_000, "x" * 10_000], [""], None]


@pytest.mark.parametrize("text, pieces", [
    ("", []), (None, None), ("abc", ["abc"]), ("abcdefgh", ["abcdefgh"]), ("abcdefghi", ["abcdefgh", "i"]),
    ("ab\ncd\nefghij", ["ab\ncd\n", "efghij"]), ("\nabcdefghijk", ["\n", "abcdefgh", "ijk"]),
    ("\n" * 20, ["\n" * 8, "\n" * 8, "\n" * 4]), ("é😀\n" * 4, ["é😀\né😀\n"] * 2),
    ("\nabcdefgh\nabcdefgh", ["\n", "abcdefgh", "\n", "abcdefgh"]),
])
def test_windows_hold_the_whole_text(spark, text, pieces):
    assert spark.createDataFrame([(text,)], "t string").select(windows(F.col("t"), 8).alias("w")).first().w == pieces


def test_events_in_the_last_line_of_a_long_page_are_asked_for(spark):
    html = "<body>" + "<p>words of a long page</p>" * 15_000 + "<p>Evening concert on 3 May</p></body>"
    prompts = models.page_prompts(spark.createDataFrame([(1, "https://long.example.org/", html)], "page_id long, url string, html string")).collect()
    assert [p.piece for p in prompts] == list(range(len(prompts))) and len(prompts) > 2
    assert "Evening concert on 3 May" in prompts[-1].prompt and sum(p.prompt.count("words of a long page") for p in prompts) == 15_000


@pytest.mark.parametrize("content, expected", [
    ('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), (' ```\n{"a":1}\n``` ', '{"a":1}'), ("null", "null"),
])
def test_fences(spark, content, expected):
    assert spark.createDataFrame([(content,)], "c string").select(models.unfenced(F.col("c")).alias("u")).first().u == expected


def test_signatures_are_equal_for_equal_markup_only(spark):
    html = '<li class="a  b" id="x">t<b>u</b></li><li id="x" class="a b">t<b>u</b></li><li class="b a" id="x">t<b>u</b></li><li class="a b" id="x">t <b>u</b></li>'
    (row,) = spark.createDataFrame([(html,)], "h string").select(page_nodes(F.col("h"), signatures=True).alias("n")).collect()
    sigs = [n.sig for n in row.n if n.tag == "li"]
    assert sigs[0] == sigs[1] and len(set(sigs)) == 3
    assert re.fullmatch(r"-?\d+", str(sigs[0]))


def test_a_raising_model_is_asked_once(spark, tmp_path):
    def model(prompts):
        with open(tmp_path / "asked", "a") as log:
            log.write("x" * len(prompts))
        raise TimeoutError("slow")

    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(20)], "prompt_key string, prompt string")
    rows = models.run_model(prompts, model, "page", partitions=1).collect()
    assert [r.status for r in rows] == ["TimeoutError: slow"] * 20 and (tmp_path / "asked").read_text() == "x" * 20


def test_unknown_marked_sections_cost_nothing(spark):
    bad = ["<p>a</p><![foo[bar]]><li>Monday</li>", "<p>a</p><![ x><li>Monday</li>", "<p>a</p><![if IE]><li>Monday</li>"]
    pages = pages_of(spark, *[(f"u{i}", html) for i, html in enumerate(bad)])
    tags = pages.select(F.transform(F.filter(page_nodes(F.col("html")), lambda n: n["kind"] == "element"), lambda n: n["tag"]).alias("t"))
    assert [r.t for r in tags.collect()] == [["p", "li"]] * 3


def test_containers_that_do_not_fit_are_listed(spark):
    html = f"<li>on Monday</li><li>{'on Monday ' + 'x' * 60}</li><li>{'y' * 60}</li><li>{'on Friday ' + 'z' * 5000}</li>"
    pages = spark.createDataFrame([(1, "https://a.org/", html), (2, "https://a.org/b", "<p>on Monday</p>")], "page_id bigint, url string, html string")
    rows = sections.passed_over_sections(pages).orderBy("pre").collect()
    assert [(r.page_id, r.rank, r.length, r.reason) for r in rows] == [(1, 16, 9, "too_short"), (1, 16, 5010, "too_long")]
    assert sections.passed_over_sections(pages, 5, 6000).count() == 0
    assert sections.page_sections(pages).count() == 1 and sections.page_sections(pages, shortest=60, longest=6000).count() == 2


def test_a_date_is_looked_for_once_in_each_text(spark, pages):
    def searches(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("(?iU)")

    trees = pages.withColumn("nodes", page_nodes(F.col("html")))
    node = F.element_at(F.col("nodes"), 1)
    assert searches(trees.select(sections.date_context(F.col("nodes"), node).alias("c"))) == 1
    # an element's class and id are fetched once, not by each selector
    plan = trees.select(sections.candidates(F.col("nodes")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[class]") == 1 and plan.count("[id]") == 1


def test_candidates_keep_their_order_and_repeats_go(spark):
    article = '<article class="x calendar"><p id="event-1">Lecture on Friday, in the great hall behind the river</p></article>'
    lone = '<ul id="list"><li class="views-row">Lecture on Friday, in the small hall behind the river</li></ul>'
    again = "<section>Reading on Monday morning in the old library by the market</section>" * 2
    found = pages_of(spark, ("u", article + "<body class=event>" + lone), ("v", again), ("w", lone), ("x", "<p>none</p>"), ("y", None))
    ranked = sections.candidates(F.col("nodes"))
    trees = found.withColumn("nodes", page_nodes(F.col("html"), signatures=True)).withColumn("r", ranked)
    kept = trees.withColumn("k", sections.without_nested(F.col("nodes"), F.col("r"))).coalesce(1).collect()
    assert {r.url: r.r and [(c.rank, c.pre) for c in r.r] for r in kept} == {"u": [(1, 0), (4, 5), (11, 1)], "v": [(15, 0), (15, 2)], "w": [(4, 1)], "x": [], "y": None}
    assert {r.url: r.k and [(c.rank, c.pre) for c in r.k] for r in kept} == {"u": [(1, 0), (4, 5)], "v": [(15, 0)], "w": [(4, 1)], "x": [], "y": None}


def test_the_edge_of_a_word_is_looked_for_once_at_each_place(spark):
    assert DATE_PATTERN.count(r"\b") == 2
    dated = ["on 1/2/24.", "12-25-2024", "at 9:30", "9:30 PM!", "the 3RD", "in mAy", "\u017fun", "x 12:30 pmx", "may-be"]
    plain = ["x1/2/24", "123/4/24", "1/2/24567", "9:3", "9:305", "a3rd", "3rds", "dismay", "maybe", "sun_", "sun\u0301", "112:30", "", "2024"]
    rows = spark.createDataFrame([(t,) for t in dated + plain], "t string").select("t", names_a_date(F.col("t")).alias("yes")).collect()
    assert [r.t for r in rows if r.yes] == dated
