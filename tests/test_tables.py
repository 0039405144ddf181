"""Sources, contract, reports, ledger, streams, staging."""
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from almanac import schemas
from almanac.operators import contract, ledger, reports
from almanac.operators.jsonld import page_events
from almanac.plans.extract import extract, responses
from almanac.plans.staging import write_once
from almanac.sources import tables
from almanac.streaming import continuous
from almanac.workloads import crawling


def write_lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_requests(spark, tmp_path):
    path = write_lines(
        tmp_path / "requests.jsonl",
        {"url": "https://example.com/events", "extraction_hints": {
            "expected_event_count": 5, "content_selectors": [".event-item", ".calendar-entry"], "date_format_hints": ["MM/dd/yyyy", "yyyy-MM-dd"]}},
        {}, "{broken",
    )
    good, rejected = tables.read_requests(spark, path)
    (row,) = good.collect()
    assert row.extraction_hints.content_selectors == [".event-item", ".calendar-entry"]
    assert row.extraction_hints.expected_event_count == 5
    assert sorted(r.reason for r in rejected.collect()) == ["unreadable", "url is missing"]


# A record in the shape of the log; the names of fields and strategies are fixed values.
def failure(domain, path="", **signs):
    names = ["has_numbered_links", "has_next_prev_text", "has_javascript_calendar", "has_load_more_buttons"]
    return {
        "timestamp": "2031-02-03T04:05:06.700800", "url": f"https://{domain}/{path}", "domain": domain, "content_hash": "0123456789ab", "content_length": 321,
        "context": {"strategies_attempted": ["iframe", "css", "javascript", "llm"], "iframe_confidence": 0.0, "css_confidence": 0.0, "js_confidence": 0.0, "playwright_available": True},
        "html_sample": {"title": " T ", "navigation_links": [{"text": "Events", "href": "/calendar", "classes": ""}], "potential_pagination_elements": [{"tag": "div", "classes": ["pager"], "text": "1"}],
                        "javascript_hints": ["itemsPerPage = 25"]},
        "potential_pagination_indicators": {**{n: n in signs for n in names}, "url_patterns": []},
    }


def test_failure_log(spark, tmp_path):
    path = write_lines(
        tmp_path / "failures.jsonl", failure("a.org", has_next_prev_text=1), failure("a.org", "2", has_next_prev_text=1, has_javascript_calendar=1), failure("b.org"),
    )
    log = tables.read_failures(spark, path)
    assert log.first().html_sample.potential_pagination_elements[0].classes == ["pager"]
    rows = {r.domain: (r.failures, r.next_prev_text, r.javascript_calendar, r.numbered_links) for r in reports.failure_rollup(log).collect()}
    assert rows == {"a.org": (2, 2, 1, 0), "b.org": (1, 0, 0, 0)}
    assert {r.strategy: r.failures for r in reports.strategy_counts(log).collect()} == dict.fromkeys(["iframe", "css", "javascript", "llm"], 3)


def test_crawl_summary_document(spark, tmp_path):
    entry = {"source": "Weir", "url": "https://a.org/", "type": "museum", "city": "Ford", "reason": "partial_success", "details": "Posted 3/4 events successfully", "events_found": 8, "events_posted": 3}
    (tmp_path / "summary.json").write_text(json.dumps({
        "timestamp": "2031-02-03T09:10:11.000120", "sources_total": 7, "total_events_found": 40, "current_future_events_posted": 5,
        "success_rate_percent": 12.5, "sources_for_improvement": [entry, {**entry, "city": "Mill", "reason": "no_events_found", "events_found": 0}], "errors": []}, indent=2))
    header, entries = tables.read_summary(spark, str(tmp_path / "summary.json"))
    assert (header.first().sources_total, header.first().success_rate_percent) == (7, 12.5)
    rolled = {(r.type, r.city): (r.entries, r.no_events_found, r.events_found) for r in reports.improvement_rollup(entries).collect()}
    assert rolled == {(None, None): (2, 1, 8), ("museum", None): (2, 1, 8), ("museum", "Ford"): (1, 0, 8), ("museum", "Mill"): (1, 1, 0)}


def test_success_rate(spark):
    # fixed values: the totals of the published report and its rate
    rows = [("s", "completed", 556, 33, 33, 1.0)]
    results = spark.createDataFrame(rows, "source string, status string, events_found int, events_posted int, events_eligible int, minutes double")
    assert reports.crawl_summary(results).first().success_rate_percent == 5.9


def test_details_name_the_eligible_events(spark):
    results = spark.createDataFrame(
        [("a", "u", "t", "c", "completed", 21, 0, 2), ("b", "u", "t", "c", "completed", 0, 0, 0), ("c", "u", "t", "c", "completed", 5, 2, 2), ("d", "u", "t", "c", "failed", 0, 0, 0)],
        "source string, url string, type string, city string, status string, events_found int, events_posted int, events_eligible int",
    )
    assert {r.source: (r.reason, r.details) for r in reports.improvement_list(results).collect()} == {
        "a": ("partial_success", "Posted 0/2 events successfully"), "b": ("no_events_found", reports.NOTHING_FOUND_DETAILS),
    }


def test_page_profile_signs(spark):
    html = '<title>T</title><nav><a href="/events">All</a><a href="?page=2">2</a><a href="/x">Next page</a></nav><button>Load <b>more</b></button><button> Show more</button><script>var pageSize = 10; $("#c").fullCalendar()</script>'
    row = reports.page_profile(spark.createDataFrame([(1, "https://u@a.org:8080/p", html)], schemas.PAGES)).first()
    assert (row.domain, row.title, row.content_length, row.links) == ("u@a.org:8080", "T", len(html), 3)
    assert row.has_numbered_links and row.has_next_prev_text and row.has_javascript_calendar and row.has_load_more_buttons
    assert [(a.text, a.href) for a in row.navigation_links] == [("All", "/events")]
    assert row.url_patterns == ["?page=2"] and row.javascript_hints == ["pageSize = 10"]


def events_of(spark, rows):
    return spark.createDataFrame(
        rows, "page_id int, external_id string, title string, description string, start_time string, place string"
    ).withColumn("location", F.struct(
        F.lit("text").alias("kind"), F.col("place").alias("text"), F.lit(None).cast(schemas.PLACE).alias("place")
    )).drop("place")


def test_contract(spark):
    checked = contract.violations(events_of(spark, [(1, "a", "t", "", "s", ""), (2, None, None, "", "s", None)]))
    assert [r.page_id for r in contract.valid(checked).collect()] == [1]
    assert contract.rejected(checked).first().reasons == ["external_id is missing", "title is missing", "location is missing"]
    assert contract.to_contract(checked).columns == ["page_id", *schemas.EVENT_FIELDS, "tags", "validation_score"]


def test_conformance_of_a_page_asked_for_twice(spark):
    events = events_of(spark, [(1, "a", "t", "d", "s", "p"), (2, "b", "", "d", "s", "p")]).withColumn("page_url", F.lit("u")).withColumn("url", F.lit("x")).withColumns(
        {"end_time": F.lit(None).cast("string"), "organizer": F.lit("")})
    requests = spark.createDataFrame([("u", None, None), ("u", None, None), ("u", None, (["organizer"], [])), ("v", None, None)], schemas.REQUESTS)
    rows = {(r.url, tuple(r.required_fields)): (r.events, r.conforming, r.complete, r.missing_required) for r in contract.field_conformance(requests, events).collect()}
    assert rows == {
        ("u", ("title", "date")): (2, 1, 2, ["title"]), ("u", ("organizer",)): (2, 0, 2, ["organizer"]), ("v", ("title", "date")): (0, 0, 0, []),
    }


def test_place_as_text(spark):
    df = spark.sql("""SELECT named_struct('kind', 'place', 'text', cast(null as string), 'place', named_struct('name', n, 'address', a)) AS l
                      FROM VALUES ('N', 'A'), ('', 'A'), (null, null) AS t(n, a)""")
    assert [r.t for r in df.select(contract.location_text(F.col("l")).alias("t")).collect()] == ["N", "A", "Unknown Location"]


def test_merge_keeps_what_new_data_leaves_empty(spark):
    day = datetime(2025, 1, 1)
    stored = spark.createDataFrame([("a", "old", "d", day), ("b", "b", "b", day)], "external_id string, title string, description string, first_seen timestamp")
    new = spark.createDataFrame(
        [("a", "newer", "", datetime(2025, 2, 2)), ("a", "new", "x", datetime(2025, 2, 1)), ("c", "c", None, datetime(2025, 2, 3))],
        "external_id string, title string, description string, seen timestamp",
    )
    rows = {r.external_id: (r.title, r.description, r.first_seen) for r in ledger.merge_events(stored, new, "seen").collect()}
    assert rows == {"a": ("newer", "x", day), "b": ("b", "b", day), "c": ("c", None, datetime(2025, 2, 3))}


def test_no_window_in_the_ledger(spark):
    jobs = spark.createDataFrame([], schemas.JOBS)
    for df in (ledger.latest_jobs(jobs), ledger.job_counts(jobs), ledger.unique_events(events_of(spark, []), ["external_id"])):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def pages_with_events(spark, count, per_page):
    html = "".join(
        '<script type="application/ld+json">' + json.dumps({"@type": "Event", "@id": f"e{n}", "name": "n", "url": "u", "startDate": "2025-01-01"}) + "</script>" for n in range(per_page)
    )
    return spark.range(count).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.org/"), F.col("id").cast("string")).alias("url"), F.lit(html).alias("html"))


def test_large_responses_are_cut_into_parts(spark):
    found = extract(pages_with_events(spark, 2, 25), F.lit("2025-01-01").cast("date"))
    parts = found.responses(part_size=10).filter("page_id = 0").orderBy("part").collect()
    assert [len(p.events) for p in parts] == [10, 10, 5]
    assert [e.external_id for p in parts for e in p.events] == [f"e{n}" for n in range(25)]
    assert {p.total_found for p in parts} == {25}
    empty = responses(found.events.limit(0), found.pages)
    assert [(r.part, r.events) for r in empty.collect()] == [(0, []), (0, [])]


def test_parts_are_bounded_over_many_sources(spark):
    """Nine links of nine events each: nine parts of at most ten, in list order."""
    found = extract(pages_with_events(spark, 1, 9), F.lit("2025-01-01").cast("date"))
    many = found.events.drop("source_ord").crossJoin(spark.range(9).select(F.col("id").cast("int").alias("source_ord")))
    parts = responses(many, found.pages, part_size=10).orderBy("part").collect()
    assert [len(p.events) for p in parts] == [10] * 8 + [1]
    assert [e.source_ord for p in parts for e in p.events] == sorted(list(range(9)) * 9)


def test_one_page_with_a_third_of_all_events(spark):
    big = pages_with_events(spark, 1, 400)
    small = pages_with_events(spark, 80, 10).withColumn("page_id", F.col("page_id") + 1).withColumn("url", F.concat("url", F.lit("/x")))
    found = extract(big.unionByName(small), F.lit("2025-01-01").cast("date"))
    assert found.events.count() == 1200
    assert found.responses(50).agg(F.max(F.size("events"))).first()[0] <= 50


def test_many_pages_embedding_one_frame(spark):
    """A third of the pages share one frame; its events come back once per page, none lost."""
    parents = spark.range(300).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://a.org/p/"), F.col("id").cast("string")).alias("url"),
        F.when(F.col("id") % 3 == 0, '<iframe src="/shared"></iframe>').otherwise(F.concat(F.lit('<iframe src="/own/'), F.col("id").cast("string"), F.lit('"></iframe>'))).alias("html"),
    )
    event = '<script type="application/ld+json">{"@type":"Event","@id":"e","startDate":"2025-01-01"}</script>'
    frames = spark.createDataFrame([(1000, "https://a.org/shared", event * 3)], schemas.PAGES)
    found = extract(parents.unionByName(frames), F.lit("2025-01-01").cast("date"))
    assert found.events.groupBy("method").count().orderBy("method").collect() == [("iframe", 300), ("jsonld", 3)]


def test_staged_tables_keep_types(spark):
    df = spark.sql("SELECT 1 AS a, parse_json('{\"x\": [1]}') AS v, array(named_struct('i', parse_json('2'))) AS items")
    kept = write_once(df)
    assert kept.dtypes == df.dtypes
    assert kept.selectExpr("a", "to_json(v)", "variant_get(items[0].i, '$', 'int')").first() == (1, '{"x":[1]}', 2)
    assert "ReadSchema: struct<a:int>" in kept.select("a")._jdf.queryExecution().executedPlan().toString()


EVENT = '<script type="application/ld+json">{"@type":"Event","@id":"%s","startDate":"2025-01-01"}</script>'


def arrivals(spark, folder, *rows):
    df = spark.createDataFrame([(n, f"u{n}", EVENT % e, at) for n, (e, at) in enumerate(rows)], continuous.ARRIVALS)
    df.coalesce(1).write.mode("append").parquet(folder)


def run_stream(spark, tmp_path, dedupe):
    events = continuous.continuous_events(continuous.arriving_pages(spark, str(tmp_path / "in")))
    events = continuous.without_repeats(events) if dedupe else events
    continuous.write_available(events, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return sorted(r.external_id for r in spark.read.schema(events.schema).parquet(str(tmp_path / "out")).collect())


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    arrivals(spark, str(tmp_path / "in"), ("a", datetime(2025, 1, 1)), ("b", datetime(2025, 1, 1)))
    assert run_stream(spark, tmp_path, dedupe=False) == ["a", "b"]
    arrivals(spark, str(tmp_path / "in"), ("a", datetime(2025, 1, 2)))
    assert run_stream(spark, tmp_path, dedupe=False) == ["a", "a", "b"]
    batch = page_events(spark.read.schema(continuous.ARRIVALS).parquet(str(tmp_path / "in")))
    assert sorted(r.external_id for r in batch.collect()) == ["a", "a", "b"]


def test_stream_suppresses_repeats_within_the_watermark(spark, tmp_path):
    arrivals(spark, str(tmp_path / "in"), ("a", datetime(2025, 1, 10)), ("a", datetime(2025, 1, 10, 1)), ("b", datetime(2025, 1, 10)))
    assert run_stream(spark, tmp_path, dedupe=True) == ["a", "b"]
    # a repeat within the delay goes, one long after comes through, one from before the watermark is dropped
    arrivals(spark, str(tmp_path / "in"), ("a", datetime(2025, 1, 10, 2)))
    assert run_stream(spark, tmp_path, dedupe=True) == ["a", "b"]
    arrivals(spark, str(tmp_path / "in"), ("c", datetime(2025, 1, 20)))
    assert run_stream(spark, tmp_path, dedupe=True) == ["a", "b", "c"]
    arrivals(spark, str(tmp_path / "in"), ("a", datetime(2025, 1, 20, 1)), ("old", datetime(2025, 1, 11)))
    assert run_stream(spark, tmp_path, dedupe=True) == ["a", "a", "b", "c"]


def test_what_a_stream_remembers_is_not_kept_on_the_heap(spark, tmp_path):
    arrivals(spark, str(tmp_path / "in"), ("a", datetime(2025, 1, 1)), ("a", datetime(2025, 1, 1)))
    assert run_stream(spark, tmp_path, dedupe=True) == ["a"]
    kinds = {p.suffix for p in (tmp_path / "state" / "state").rglob("*") if p.is_file()}
    assert ".changelog" in kinds and ".delta" not in kinds


@pytest.mark.parametrize("last, due", [(None, True), (datetime(2025, 1, 1), True), (datetime(2025, 1, 1, 12), False)])
def test_due_sources(spark, last, due):
    sources = spark.createDataFrame([(1, True, last), (2, False, last)], "source_id int, active boolean, last_scraped timestamp_ntz").withColumn(
        "scrape_frequency", F.expr("INTERVAL '24' HOUR")
    )
    assert [r.source_id for r in ledger.due_sources(sources, F.lit("2025-01-02").cast("date")).collect()] == ([1] if due else [])


def test_a_batch_of_the_stream_has_work_for_all_cores(spark, sf_dir):
    assert crawling._files_per_batch(spark) >= spark.sparkContext.defaultParallelism
    batches = []
    folder = crawling._arrivals(spark, crawling.order_pages(spark, sf_dir))
    arriving = continuous.arriving_pages(spark, folder, crawling._files_per_batch(spark))
    arriving.writeStream.foreachBatch(lambda df, n: batches.append(n)).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 1
