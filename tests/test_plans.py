"""Plans that read few pages out of many, the answer ledger, the store on disk, the extraction as a stream."""
import json
import os
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from almanac import schemas
from almanac.operators import fetch, jsonld, ledger, models
from almanac.operators.sieve import passing
from almanac.plans import answering
from almanac.plans.extract import extract
from almanac.plans.requests import serve
from almanac.plans.staging import write_once
from almanac.streaming import extraction
from test_extract import HINTED, PLAIN, SITE, TEXT, answer, as_of, event, pages_of, table


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def block(*objects):
    return "".join(f'<script type="application/ld+json">{o if isinstance(o, str) else json.dumps(o)}</script>' for o in objects)


def happening(name, **more):
    return {"@type": "Event", "@id": f"urn:{name}", "name": name, "startDate": "2025-02-01", "description": "d", "location": "Hall", **more}


# ---- reading few pages ----------------------------------------------------------------------------


def nodes_of(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes_of(children.apply(i))
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from nodes_of(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        yield from nodes_of(plan.plan())


def rows_moved(df, column):
    """Rows in exchanges that hold ``column``, after the query has run."""
    moved = 0
    for node in nodes_of(df._jdf.queryExecution().executedPlan()):
        if node.nodeName() == "Exchange" and column in [node.output().apply(i).name() for i in range(node.output().size())]:
            moved += node.metrics().apply("shuffleRecordsWritten").value()
    return moved


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture()
def many_pages(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS page_id", "concat('https://a.org/', id % 19000, '#x') AS url", "concat('html of ', id) AS html").write.parquet(str(tmp_path / "pages"))
    return spark.read.schema(schemas.PAGES).parquet(str(tmp_path / "pages"))


@pytest.mark.parametrize("listed", [1_000, 3])
def test_only_wanted_pages_move(spark, many_pages, no_broadcast, monkeypatch, listed):
    monkeypatch.setattr(fetch, "LISTED", listed)
    wanted = spark.createDataFrame([(f"https://a.org/{i}",) for i in (*range(0, 20_000, 200), 5, "none")], "address string")
    ids = write_once(fetch.newest_pages(many_pages, wanted))
    found = fetch.fetched(many_pages, ids)
    rows = {r.address: (r.page_id, r.html) for r in found.collect()}
    newest = [i + 19_000 if i < 1_000 else i for i in (*range(0, 19_000, 200), 5)]
    assert rows == {f"https://a.org/{i % 19_000}": (i, f"html of {i}") for i in newest}
    moved = rows_moved(found, "html")
    assert len(newest) <= moved <= (len(newest) if listed > 3 else 1_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("PushedFilters: [In(page_id" in plan) == (listed > 3)


def test_sieve_loses_nothing(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([(r.choice([None, *range(50)]), r.choice([None, "a", "b", "c"]), i) for i in range(3000)], "k int, t string, n long")
    wanted = write_once(spark.createDataFrame([(7, "a"), (None, "b"), (3, None), (40, "c")], "k int, t string"))
    found = {x.n for x in passing(rows, wanted, ["k", "t"]).collect()}
    assert found >= {x.n for x in rows.collect() if (x.k, x.t) in {(7, "a"), (None, "b"), (3, None), (40, "c")}} and len(found) < 300
    assert passing(rows, wanted.limit(0), ["k", "t"]).count() == 0 and passing(rows, wanted, ["k", "t"]).columns == rows.columns


def test_new_pages_leave_the_ledger_where_it_is(spark, no_broadcast, tmp_path):
    spark.range(30_000).selectExpr("CAST(id % 7 AS INT) AS source_id", "concat('https://l.org/', id) AS url").write.parquet(str(tmp_path / "jobs"))
    jobs = spark.read.parquet(str(tmp_path / "jobs"))
    found = spark.createDataFrame([(i % 7, f"https://l.org/{i}") for i in (5, 5, 40_000, 40_000, 12)] + [(1, "https://l.org/5"), (None, "x")], "source_id int, url string")
    fresh = ledger.new_pages(found, jobs, F.lit("2025-01-01 00:00:00"))
    assert sorted((r.source_id or -1, r.url) for r in fresh.collect()) == [(-1, "x"), (1, "https://l.org/5"), (40_000 % 7, "https://l.org/40000")]
    assert rows_moved(fresh, "url") < 100


# ---- requests -------------------------------------------------------------------------------------


def request(spark, *rows):
    return table(spark, [(SITE + u, (n, None, s, None), (r, None) if r else None) for u, n, s, r in rows], schemas.REQUESTS)


def test_each_request_has_its_own_answer(spark):
    bad = {"@type": "Event", "@id": "urn:x", "name": "x", "startDate": "2025-02-02", "location": {"@type": "Place", "name": 3}}
    pages = pages_of(
        spark, ("/a", HINTED), ("/d", PLAIN), ("/s", block(happening("s1"), happening("s2", endDate="2025-02-03"), bad)),
        ("/f", '<iframe src="/in"></iframe>'), ("/in", block(happening("framed"))), ("/other", block(happening("unasked"))),
        ("/s#old", block(happening("s0"))),
    )
    full = {"title": "whole", "start": "2025-05-01", "description": "d", "location": "Hall"}
    answers = [answer("/d", TEXT, {**full, "title": "detail"}), answer("/a", f"{TEXT}\nd\nrest", full, event("no place"))]
    asked = request(spark, ("/a", 1, [".e"], None), ("/a", 7, None, ["title", "organizer"]), ("/a", None, [], None), ("/s#x", 1, None, ["end"]),
                    ("/f", None, None, None), ("/gone", 0, [".e"], None), ("/a", 1, [".e"], None))
    served = serve(asked, pages, as_of(), table(spark, answers, schemas.RESPONSES))
    rows = [(r.url.removeprefix(SITE), r.extraction_method, [e.title for e in r.events], r.as_expected, r.set_aside, r.conforming, r.missing_required)
            for r in served.responses.collect()]
    assert sorted(rows, key=str) == sorted([
        ("/a", "llm", ["detail"], True, 0, 1, []), ("/a", "llm", ["detail"], True, 0, 1, []),
        ("/a", "llm", ["whole"], False, 1, 0, ["organizer"]), ("/a", "llm", ["whole"], None, 1, 1, []),
        ("/s#x", "jsonld", ["s0"], True, 0, 0, ["end"]), ("/f", "jsonld", ["framed"], None, 0, 1, []), ("/gone", "failed", [], True, 0, 0, []),
    ], key=str)
    assert [(r.title, r.reasons) for r in served.rejected.collect()] == [("no place", ["location is missing"])]
    titles = {r.request_id: r.page_title for r in serve(asked.withColumn("request_id", F.col("url")), pages, as_of()).responses.collect()}
    assert titles[f"{SITE}/gone"] == "Unknown" and len(titles) == 4


def test_events_that_break_the_contract_are_set_aside(spark):
    bad = {"@type": "Event", "@id": "urn:x", "name": "x", "startDate": "2025-02-02", "location": {"@type": "Place", "name": 3}}
    pages = pages_of(spark, ("/s", block(happening("s1"), bad)))
    served = serve(request(spark, ("/s", 1, None, None)), pages, as_of())
    (row,) = served.responses.collect()
    assert (row.success, row.total_found, row.set_aside, [e.title for e in row.events]) == (True, 1, 1, ["s1"])
    assert [r.reasons for r in served.rejected.collect()] == [["location.name is no text"]]


def test_discovered_hints_serve_requests_without_any(spark):
    pages = pages_of(spark, ("/a", HINTED), ("/d", PLAIN))
    answers = table(spark, [answer("/d", TEXT, {"title": "detail", "start": "2025-05-01", "location": "Hall"})], schemas.RESPONSES)
    found = table(spark, [(f"{SITE}/a", [".e"])], "url string, event_containers array<string>")
    asked = request(spark, ("/a", None, None, None), ("/a", None, [".none"], None))
    rows = serve(asked, pages, as_of(), answers, found).responses.collect()
    assert sorted([e.title for e in r.events] for r in rows) == [[], ["detail"]]


def test_requests_for_few_pages_leave_the_others_alone(spark, tmp_path, no_broadcast):
    html = block(happening("e")).replace("'", "''")
    rows = spark.range(3_000).selectExpr("id AS page_id", f"concat('{SITE}/', id) AS url", f"concat('{html}', '<iframe src=\"/', id + 1, '\"></iframe>') AS html")
    rows.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.schema(schemas.PAGES).parquet(str(tmp_path / "pages"))
    wanted = fetch.newest_pages(pages, spark.createDataFrame([(f"{SITE}/7",), (f"{SITE}/70",)], "address string"))
    found = fetch.fetched(pages, write_once(wanted))
    assert found.count() == 2
    found = fetch.fetched(pages, write_once(wanted))
    found.collect()
    assert rows_moved(found, "html") == 2
    served = serve(request(spark, ("/7", 2, None, None), ("/70", 2, None, None)), pages, as_of())
    assert [(r.total_found, [e.url for e in r.events]) for r in served.responses.orderBy("url").collect()] == [
        (2, [f"{SITE}/7", f"{SITE}/8"]), (2, [f"{SITE}/70", f"{SITE}/71"])]


# ---- second reading of JSON, links of many titles ---------------------------------------------------


@pytest.mark.parametrize("text, titles", [
    ('{"@type":"Event","name":"a","name":"b","startDate":"2025-01-01"}', ["b"]),
    ('{"@type":"Thing","@type":"Event","name":"a","offers":[NaN,{"x":Infinity}],"startDate":"2025-01-01"}', ["a"]),
    ('[{"@type":"Event","name":"a","n":1e999},{"@type":"Event","name":"c","d":{"k":1,"k":2}}]', ["a", "c"]),
    ('{"@type":"Event","name":"a",}', []), ("{'@type':'Event'}", []), ('{"@type":"Event"', []), ("[" * 3000, []),
])
def test_second_reading(spark, text, titles):
    html = block(text, happening("good"))
    pages = pages_of(spark, ("/p", html), ("/q", block(happening("other"))))
    assert [r.title for r in jsonld.page_events(pages).filter("page_id = 0").orderBy("seq").collect()] == [*titles, "good"]
    assert [(r.page_id, r.reason) for r in jsonld.rejected_events(pages).collect()] == [(0, "recovered" if titles else "strict_json")]
    found = extract(pages, as_of())
    assert sorted(r.title for r in found.events.filter("page_id = 0").collect()) == sorted([*titles, "good"])


def test_many_titles_and_links(spark, monkeypatch):
    r = random.Random(3)
    words = ["Fair", "TALK", "walk", "Night", "of", "the", " ", "Überraschung"]
    titles = [" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(40)] + ["", "missing", " "]
    links = [(r.choice(["/x", "", f"/{i}"]), " ".join(r.choice(words) for _ in range(4))) for i in range(80)]
    html = "".join(f'<a href="{h}">{t}</a>' for h, t in links) + block([{"@type": "Event", "name": t, "startDate": "2025-01-01"} for t in titles])
    pages = pages_of(spark, ("/p", html))
    urls = []
    for limit in (jsonld.MANY_TITLES, 0):
        monkeypatch.setattr(jsonld, "MANY_TITLES", limit)
        urls.append([e.url for e in jsonld.page_events(pages).orderBy("seq").collect()])
    assert urls[0] == urls[1] and len(set(urls[0])) > 5


def test_a_page_with_thousands_of_titles_and_links(spark):
    events = [{"@type": "Event", "name": f"Event number {i}", "startDate": "2025-01-01"} for i in range(5_000)]
    html = "".join(f'<a href="/{i}">see event number {i} here</a>' for i in range(7_499, -1, -1)) + block(events)
    began = time.time()
    rows = jsonld.page_events(pages_of(spark, ("/p", html))).select("seq", "url").collect()
    assert len(rows) == 5_000 and time.time() - began < 60
    # numbers are looked for as text, so the first link from the top whose number starts with the title's counts
    first = {i: next(f"{SITE}/{k}" for k in range(7_499, -1, -1) if str(k).startswith(str(i))) for i in (0, 5, 49, 4_999)}
    assert {i: next(r.url for r in rows if r.seq == i) for i in first} == first


def test_an_unreadable_date_ends_its_block_only(spark):
    def day(i, start="2025-02-01"):
        return {"@type": "Event", "@id": f"urn:{i}", "startDate": start}

    lists = [[day(1), day(2, "soon"), day(3), day(4, "later")], [day(5)], [day(6, "never"), day(7)], [{"@type": "Thing"}, day(8), day(9, "x")]]
    pages = pages_of(spark, ("/a", '<iframe src="/f"></iframe>'), ("/f", block(*lists)))
    assert [e.external_id for e in extract(pages, as_of()).events.filter("page_id = 0").orderBy("external_id").collect()] == ["urn:1", "urn:5", "urn:8"]


# ---- the answer ledger ------------------------------------------------------------------------------


class Counted:
    """A model that notes in a folder what it is asked, and dies when asked about ``dies``."""

    def __init__(self, folder, dies=None, refuses=()):
        self.folder, self.dies, self.refuses = str(folder), dies, refuses

    def __call__(self, prompts):
        for p in prompts:
            with open(f"{self.folder}/{p}", "a") as asked:
                asked.write("x")
        if self.dies in prompts:
            os._exit(1)
        return [ValueError("no") if p in self.refuses else p.upper() for p in prompts]

    def calls(self):
        return {name: os.path.getsize(f"{self.folder}/{name}") for name in os.listdir(self.folder)}


def keyed(spark, names):
    return spark.createDataFrame([(f"key {n}", n) for n in names], "prompt_key string, prompt string")


def test_settled_prompts_are_not_asked_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    store = str(tmp_path / "ledger")
    model = Counted(tmp_path / "calls", refuses=("c",))
    first = answering.ask_once(keyed(spark, "aabc"), model, "score", store, wave=2).collect()
    assert sorted((r.key, r.content, r.status) for r in first) == [("key a", "A", "ok"), ("key b", "B", "ok"), ("key c", None, "ValueError: no")]
    second = answering.ask_once(keyed(spark, "bcd"), model, "score", store).collect()
    assert sorted(r.key for r in second) == ["key b", "key c", "key d"] and model.calls() == dict.fromkeys("abcd", 1)
    answering.ask_once(keyed(spark, "bcd"), Counted(tmp_path / "calls"), "score", store, retry_failed=True)
    assert model.calls() == {"a": 1, "b": 1, "c": 2, "d": 1}
    answering.ask_once(keyed(spark, "a"), model, "page", store)
    assert model.calls()["a"] == 2
    known = models.answers(answering.settled(spark, store), "score").collect()
    assert {r.prompt_key: r.content for r in known} == {f"key {n}": n.upper() for n in "abcd"}


def test_a_run_that_dies_loses_one_wave(spark, tmp_path):
    """The worker is killed in one wave; what earlier waves settled is not asked again by the next run."""
    (tmp_path / "calls").mkdir()
    store, names = str(tmp_path / "ledger"), [f"p{i}" for i in range(40)]
    model = Counted(tmp_path / "calls", dies="p7")
    with pytest.raises(Exception):
        answering.ask_once(keyed(spark, names), model, "score", store, wave=5)
    kept = {r.key.removeprefix("key ") for r in answering.settled(spark, store).collect()}
    calls = model.calls()
    assert "p7" not in kept and set(calls) > kept and len(set(calls) - kept) <= 20
    healthy = Counted(tmp_path / "calls")
    answers = answering.ask_once(keyed(spark, names), healthy, "score", store, wave=5).collect()
    assert sorted(r.content for r in answers) == sorted(n.upper() for n in names)
    after = healthy.calls()
    assert all(after[n] == 1 for n in kept) and all(after[n] == calls.get(n, 0) + 1 for n in set(names) - kept)


# ---- the store on disk ------------------------------------------------------------------------------

STORED = "external_id STRING, first_seen STRING, title STRING, n INT"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    ledger.create_store(spark.createDataFrame([(f"e{i}", "2025-01-01", f"t{i}", i) for i in range(200)], STORED), path, 16)
    before = files(path)
    new = spark.createDataFrame([("e5", "2025-02-01", "new", 1), ("e5", "2025-02-02", "", 2), ("fresh", "2025-02-03", "f", None)], "external_id string, seen string, title string, n int")
    written = ledger.merge_into(spark, path, STORED, new, "seen", 16)
    after = files(path)
    touched = {os.path.dirname(f) for f in before ^ after}
    assert written == len(touched) <= 2 and before - after
    rows = {r.external_id: tuple(r)[1:4] for r in spark.read.schema(STORED).parquet(path).collect()}
    assert len(rows) == 201 and rows["e5"] == ("2025-01-01", "new", 2) and rows["fresh"] == ("2025-02-03", "f", None) and rows["e6"] == ("2025-01-01", "t6", 6)
    assert ledger.merge_into(spark, path, STORED, new, "seen", 16) == 0 and files(path) == after
    assert ledger.merge_into(spark, path, STORED, new.limit(0), "seen", 16) == 0


# ---- the extraction as a stream ----------------------------------------------------------------------


def stream_pages(spark):
    """Pages whose results hang on one another: frames, month pages, hinted links, frames of linked pages, newer versions."""
    return pages_of(
        spark, ("/a", '<iframe src="/f"></iframe>'), ("/f", block(happening("old"))), ("/f#2", block(happening("newer"))),
        ("/events/", block(happening("own"))), ("/events/2025-january/", block({"@type": "Event", "@id": "urn:month", "startDate": "2025-01-20"})),
        ("/l", HINTED), ("/d", '<iframe src="/deep"></iframe>'), ("/deep", PLAIN), ("/m", '<iframe src="/text"></iframe>'), ("/text", PLAIN),
        ("/alone", PLAIN),
    )


def outcome(events):
    return sorted((r.page_id, r.method, r.source_ord, r.external_id, r.title, r.url or "") for r in events.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_events_of_one_run(spark, tmp_path, seed, monkeypatch):
    pages = stream_pages(spark)
    answers = table(spark, [answer("/d", TEXT, event("detail")), answer("/m", TEXT, event("through frame")), answer("/alone", TEXT, event("alone"))], schemas.RESPONSES)
    hints = table(spark, [(f"{SITE}/l", [".e"])], "url string, selectors array<string>")
    whole = extract(pages, as_of(), answers, hints)
    expected = outcome(whole.events)
    assert {t for *_, t, _ in expected} >= {"newer", "own", "detail", "through frame", "alone"}
    order = list(range(11))
    random.Random(seed).shuffle(order)
    store = str(tmp_path / "store")
    for batch, ids in enumerate((order[:4], order[4:5], order[5:])):
        part = pages.filter(F.col("page_id").isin(ids))
        if batch == 1:  # killed after its events were written, then run again
            put = extraction._put
            monkeypatch.setattr(extraction, "_put", lambda df, s, name, n: (_ for _ in ()).throw(RuntimeError("killed")) if name == "needs" else put(df, s, name, n))
            with pytest.raises(RuntimeError):
                extraction.take_up(part, batch, store, as_of(), answers, hints)
            monkeypatch.setattr(extraction, "_put", put)
        extraction.take_up(part, batch, store, as_of(), answers, hints)
    assert outcome(extraction.current_events(spark, store)) == expected
    methods = {r.page_id: (r.extraction_method, r.total_found) for r in extraction.current_status(spark, store).collect()}
    assert methods == {r.page_id: (r.extraction_method, r.total_found) for r in whole.pages.collect()}
