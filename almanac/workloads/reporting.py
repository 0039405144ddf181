"""The output contract, reports and the tables around a crawl."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac import schemas
from almanac.functions.isotime import instant
from almanac.operators import contract, ledger, reports
from almanac.operators.jsonld import location, page_events
from almanac.plans.staging import shared_folder
from almanac.sources import tables
from almanac.workloads import markup
from almanac.workloads.common import day, table, text
from almanac.workloads.structured import EXPECTED_EVENTS, order_pages

K = text("o_orderkey")
C = text("c_custkey")
D = day("o_orderdate")
AS_OF = "1998-06-15"


def _as_of():
    return F.lit(AS_OF).cast("date")


# ---- contract ------------------------------------------------------------------------------------


def location_texts(spark, sf_dir):
    events = page_events(order_pages(spark, sf_dir))
    return events.select("page_id", "block_pos", "item_pos", contract.location_text(F.col("location")).alias("place"))


def upcoming_events(spark, sf_dir):
    events = page_events(order_pages(spark, sf_dir)).withColumn("start_ts", instant(F.col("start_time")))
    return contract.upcoming(events, _as_of()).select("page_id", "external_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"))


def contract_rows(spark, sf_dir):
    return contract.to_contract(page_events(order_pages(spark, sf_dir))).select(
        "page_id", "external_id", "title", "start_time"
    )


# Events with things missing, by number.
LOOSE_EVENT = f"""named_struct('external_id', CASE WHEN o_orderkey % 8 <> 1 THEN 'e:' || {K} END, 'title', CASE WHEN o_orderkey % 8 <> 2 THEN 'T' END,
  'description', CASE WHEN o_orderkey % 8 <> 3 THEN '' END, 'start_time', CASE WHEN o_orderkey % 4 <> 0 THEN '1999-01-01T00:00:00+00:00' END)"""
LOOSE_PLACE = """CASE o_orderkey % 8 WHEN 5 THEN '{"@type":"Place","name":"N","address":{"street":"x"}}' WHEN 6 THEN '{"@type":"Place","name":null}' WHEN 7 THEN '7' ELSE '"Hall"' END"""


def _loose_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS page_id", f"{LOOSE_EVENT} AS e", f"try_parse_json({LOOSE_PLACE}) AS v")
    return rows.select("page_id", "e.*", location(F.col("v")).alias("location"))


def contract_violations(spark, sf_dir):
    checked = contract.violations(_loose_events(spark, sf_dir))
    return contract.rejected(checked).select("page_id", F.array_join("reasons", "; ").alias("reasons"))


def contract_valid(spark, sf_dir):
    return contract.valid(contract.violations(_loose_events(spark, sf_dir))).select("page_id", "external_id")


REQUEST = f"""'{{"url":"https://host' || {text('o_orderkey % 25')} || '.example.org/shows/' || {K} || '"' || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN
  ',"schema_requirements":{{"required_fields":["title","end"]}}' ELSE ',"extraction_hints":{{"expected_event_count":5,"content_selectors":[".a",".b"]}},"schema_requirements":{{"required_fields":["organizer"],"optional_fields":["title"]}}' END || '}}'"""


def _written(spark, lines: DataFrame) -> str:
    folder = f"{shared_folder(spark)}/almanac/{uuid.uuid4().hex}"
    lines.write.text(folder)
    return folder


def field_conformance(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    requests, _ = tables.read_requests(spark, _written(spark, orders.selectExpr(f"{REQUEST} AS value")))
    found = contract.field_conformance(requests, page_events(order_pages(spark, sf_dir)))
    return found.select("url", "events", "conforming", "complete", F.array_join("missing_required", ",").alias("missing"))


# ---- sources ---------------------------------------------------------------------------------------


def requests_source(spark, sf_dir):
    line = f"CASE o_orderkey % 10 WHEN 8 THEN '{{\"extraction_hints\":null}}' WHEN 9 THEN '{{broken' ELSE {REQUEST} END AS value"
    good, rejected = tables.read_requests(spark, _written(spark, table(spark, sf_dir, "orders").selectExpr(line)))
    kept = good.select("url", F.array_join("extraction_hints.content_selectors", ",").alias("selectors"), F.lit("ok").alias("outcome"))
    return kept.unionByName(rejected.select(F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("selectors"), F.col("reason").alias("outcome")))


FAILURE = f"""'{{"timestamp":"' || {D} || '","url":"https://d' || {text('o_custkey % 50')} || '.example.org/' || {K} || '","domain":"d' || {text('o_custkey % 50')} || '.example.org","content_length":' || {text('1000 + o_orderkey')}
  || ',"context":{{"strategies_attempted":["iframe","css"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"llm"' ELSE '' END || '],"css_confidence":0.0}},"potential_pagination_indicators":{{"has_numbered_links":'
  || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END || ',"has_next_prev_text":true,"has_javascript_calendar":' || CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END || ',"has_load_more_buttons":false,"url_patterns":["?p=1"]}}}}'"""


def _failures(spark, sf_dir):
    return tables.read_failures(spark, _written(spark, table(spark, sf_dir, "orders").selectExpr(f"{FAILURE} AS value")))


def failures_source(spark, sf_dir):
    return _failures(spark, sf_dir).select("url", "domain", "content_length", F.size("context.strategies_attempted").alias("strategies"))


def summary_source(spark, sf_dir):
    """One summary document per hundred customers, listing them; documents are read back file by file."""
    entry = F.struct(
        F.col("c_name").alias("source"), F.concat(F.lit("https://c.example.org/"), F.col("c_custkey").cast("string")).alias("url"),
        F.col("c_mktsegment").alias("type"), F.lit("no_events_found").alias("reason"), (F.col("c_custkey") % 5).cast("int").alias("events_found"),
    )
    documents = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("document")).agg(
        F.count(F.lit(1)).cast("int").alias("sources_total"), F.collect_list(entry).alias("sources_for_improvement")
    )
    folder = f"{shared_folder(spark)}/almanac/{uuid.uuid4().hex}"
    documents.select("document", F.to_json(F.struct("sources_total", "sources_for_improvement")).alias("value")).write.partitionBy("document").text(folder)
    header, entries = tables.read_summary(spark, folder)
    return entries.groupBy("type").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("events_found").alias("events_found"), F.count_distinct("source").alias("sources")
    ).unionByName(header.select(F.lit("all").alias("type"), "sources_total").groupBy("type").agg(
        F.sum("sources_total").alias("entries"), F.lit(0).cast("bigint").alias("events_found"), F.count(F.lit(1)).alias("sources")
    ))


def responses_source(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("'page' AS kind", f"sha2({K}, 256) AS key", f"'{{\"n\":' || {K} || '}}' AS content", "CASE WHEN o_orderkey % 9 = 0 THEN 'timeout' ELSE 'ok' END AS status")
    folder = f"{shared_folder(spark)}/almanac/{uuid.uuid4().hex}"
    rows.write.json(f"{folder}.jsonl")
    return tables.read_responses(spark, f"{folder}.jsonl").groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last_key"))


# ---- crawl reports -----------------------------------------------------------------------------------

RESULT = [
    "c_name AS source", f"'https://c.example.org/' || {C} AS url", "c_mktsegment AS type", f"'city ' || {text('c_nationkey')} AS city",
    "CASE WHEN c_custkey % 11 = 0 THEN 'failed' ELSE 'completed' END AS status", "CAST(c_custkey % 7 AS INT) AS events_found",
    "CAST(least(c_custkey % 7, c_custkey % 4) AS INT) AS events_eligible",
    "CAST(least(c_custkey % 7, c_custkey % 4, c_custkey % 3) AS INT) AS events_posted", "CAST(0.5 AS DOUBLE) AS minutes",
]


def _results(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(*RESULT)


def crawl_summary(spark, sf_dir):
    return reports.crawl_summary(_results(spark, sf_dir))


def improvement_list(spark, sf_dir):
    return reports.improvement_list(_results(spark, sf_dir))


def improvement_rollup(spark, sf_dir):
    return reports.improvement_rollup(reports.improvement_list(_results(spark, sf_dir)))


def failure_rollup(spark, sf_dir):
    return reports.failure_rollup(_failures(spark, sf_dir))


def strategy_counts(spark, sf_dir):
    return reports.strategy_counts(_failures(spark, sf_dir))


def page_profile(spark, sf_dir):
    found = reports.page_profile(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id", "domain", "content_hash", "content_length", "title", "links", F.size("navigation_links").alias("navigation_links"),
        "has_numbered_links", "has_next_prev_text", "has_javascript_calendar", "has_load_more_buttons", F.size("url_patterns").alias("url_patterns"),
        F.size("javascript_hints").alias("javascript_hints"),
    )


def failing_sources(spark, sf_dir):
    entries = reports.improvement_list(_results(spark, sf_dir))
    failures = _failures(spark, sf_dir).withColumn("url", F.regexp_replace("url", r"^https://d\d+\.", "https://c."))
    return reports.failing_sources(failures, entries).select("source", "url", "reason", "failed_at", "content_length")


# ---- sources, jobs, stored events ----------------------------------------------------------------------

NOW = "1998-06-15 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def due_sources(spark, sf_dir):
    sources = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS INT) AS source_id", "o_orderstatus <> 'F' AS active",
        "CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS last_scraped", "make_dt_interval(CAST(o_orderkey % 60 AS INT) * 30) AS scrape_frequency",
    )
    return ledger.due_sources(sources, _now()).select("source_id")


JOB = [
    "o_orderkey AS job_id", "CAST(o_custkey % 20 AS INT) AS source_id", f"'https://j.example.org/' || {text('o_custkey')} AS url",
    "CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status",
    "o_orderdate AS created_at", f"CASE WHEN o_orderkey % 4 = 3 THEN 'HTTP 500 on ' || {K} ELSE '' END AS error_message",
    "CAST(o_orderkey % 13 AS INT) AS events_found",
]


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*JOB)


def new_pages(spark, sf_dir):
    """Customers as discovered pages, four times each; those with an order are in the ledger already."""
    found = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey % 20 AS INT) AS source_id", f"'https://j.example.org/' || {text('2 * c_custkey')} AS url")
    return ledger.new_pages(found.unionByName(found), _jobs(spark, sf_dir), _now()).select("source_id", "url", "status", "created_at")


def latest_jobs(spark, sf_dir):
    return ledger.latest_jobs(_jobs(spark, sf_dir)).select("url", "job_id", "status")


def job_counts(spark, sf_dir):
    return ledger.job_counts(_jobs(spark, sf_dir))


def failed_jobs(spark, sf_dir):
    return ledger.failed_jobs(_jobs(spark, sf_dir))


# A third of all events share one title, day and place.
COPY = f"""CASE WHEN o_orderkey % 3 = 0 THEN 'Town  Fair ' ELSE 'Order of ' || {text('o_custkey')} END"""
EVENT_ROW = [
    f"'e:' || lpad({text('o_orderkey % 4000')}, 6, '0') AS external_id", f"{COPY} AS title",
    f"CASE WHEN o_orderkey % 3 = 0 THEN '1999-01-01T00:00:00+00:00' ELSE {D} || 'T00:00:00+00:00' END AS start_time",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'Hall ' ELSE 'hall' END AS place", "CAST(o_custkey % 30 AS INT) AS source_id", "o_orderkey AS n",
]


def _copies(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(*EVENT_ROW)
    nothing = F.lit(None).cast("struct<type:string,name:string,address:string,telephone:string,url:string,raw:string>")
    return rows.withColumn("location", F.struct(F.lit("text").alias("kind"), F.col("place").alias("text"), nothing.alias("place"))).drop("place")


def duplicate_clusters(spark, sf_dir):
    return ledger.duplicate_clusters(_copies(spark, sf_dir))


def clustered_events(spark, sf_dir):
    return ledger.with_cluster(_copies(spark, sf_dir)).select("n", "external_id", "cluster_id")


# Events connected in chains: four orders share an id, four others a title, and the chain breaks where a title is missing.
# A third of all have one title, and many of those one id; some have no id.
_LINK = "CAST(floor((o_orderkey + 2) / 4) AS BIGINT)"
CHAINED_ROW = [
    f"""CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'h:' || lpad({text('o_orderkey % 500')}, 8, '0')
    ELSE 'c:' || lpad({text('CAST(floor(o_orderkey / 4) AS BIGINT)')}, 8, '0') END AS external_id""",
    f"CASE WHEN o_orderkey % 3 = 0 THEN 'Town  Fair ' WHEN {_LINK} % 20 = 0 THEN '' ELSE ' Talk ' || {text(_LINK)} END AS title",
    "'1999-01-01T00:00:00+00:00' AS start_time", "'Hall' AS place", "CAST(o_custkey % 30 AS INT) AS source_id", "o_orderkey AS n",
]


def _chained(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(*CHAINED_ROW)
    nothing = F.lit(None).cast(schemas.PLACE)
    return rows.withColumn("location", F.struct(F.lit("text").alias("kind"), F.col("place").alias("text"), nothing.alias("place"))).drop("place")


def same_events(spark, sf_dir):
    return ledger.same_events(_chained(spark, sf_dir)).select("n", "external_id", "cluster_id")


def same_event_clusters(spark, sf_dir):
    return ledger.same_event_clusters(_chained(spark, sf_dir))


def unique_events(spark, sf_dir):
    return ledger.unique_events(_copies(spark, sf_dir), ["external_id", "n"]).select("external_id", "n")


def _news(spark, sf_dir):
    """Customers as stored events, orders as new data about them."""
    stored = table(spark, sf_dir, "customer").selectExpr(
        f"'c:' || {C} AS external_id", "c_name AS title", "c_mktsegment AS description", "TIMESTAMP_NTZ '1990-01-01 00:00:00' AS first_seen"
    )
    new = table(spark, sf_dir, "orders").selectExpr(
        f"'c:' || {text('o_custkey * 2')} AS external_id", f"CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Order ' || {K} END AS title",
        "CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS description",
        "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey) AS seen_at",
    )
    return stored, new


def merged_events(spark, sf_dir):
    """Newer and non-empty wins."""
    stored, new = _news(spark, sf_dir)
    return ledger.merge_events(stored, new, "seen_at")


def merged_store(spark, sf_dir):
    """The same on disk, with how many buckets a second merge of the same rows wrote."""
    stored, new = _news(spark, sf_dir)
    path, schema = f"{shared_folder(spark)}/almanac/{uuid.uuid4().hex}", "external_id STRING, title STRING, description STRING, first_seen TIMESTAMP_NTZ"
    ledger.create_store(stored, path, 16)
    ledger.merge_into(spark, path, schema, new, "seen_at", 16)
    again = ledger.merge_into(spark, path, schema, new, "seen_at", 16)
    return spark.read.schema(schema).parquet(path).drop("bucket").withColumn("written_again", F.lit(again))


QUERIES = {
    "location_texts": location_texts,
    "upcoming_events": upcoming_events,
    "contract_rows": contract_rows,
    "contract_violations": contract_violations,
    "contract_valid": contract_valid,
    "field_conformance": field_conformance,
    "requests_source": requests_source,
    "failures_source": failures_source,
    "summary_source": summary_source,
    "responses_source": responses_source,
    "crawl_summary": crawl_summary,
    "improvement_list": improvement_list,
    "improvement_rollup": improvement_rollup,
    "failure_rollup": failure_rollup,
    "strategy_counts": strategy_counts,
    "page_profile": page_profile,
    "failing_sources": failing_sources,
    "due_sources": due_sources,
    "new_pages": new_pages,
    "latest_jobs": latest_jobs,
    "job_counts": job_counts,
    "failed_jobs": failed_jobs,
    "duplicate_clusters": duplicate_clusters,
    "clustered_events": clustered_events,
    "same_events": same_events,
    "same_event_clusters": same_event_clusters,
    "unique_events": unique_events,
    "merged_events": merged_events,
    "merged_store": merged_store,
}

_REQUEST_URL = f"'https://host' || {text('o_orderkey % 25')} || '.example.org/shows/' || {K}"
_FILLED = "title <> '' AND coalesce(end_time, '') <> ''"
_SHORT = f"""SELECT *, CASE WHEN status = 'completed' AND events_found = 0 THEN 'no_events_found' WHEN status = 'completed' AND events_posted < events_eligible THEN 'partial_success' END AS reason
  FROM (SELECT {', '.join(RESULT)} FROM customer)"""
_LIST = f"""SELECT source, url, type, city, reason, CASE WHEN reason = 'no_events_found' THEN '{reports.NOTHING_FOUND_DETAILS}'
  ELSE 'Posted ' || events_posted || '/' || events_eligible || ' events successfully' END AS details, events_found, events_posted FROM ({_SHORT}) WHERE reason IS NOT NULL"""
_JOBS = f"SELECT {', '.join(JOB)} FROM orders"
_LATEST = f"SELECT * FROM ({_JOBS}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_at DESC, job_id DESC) = 1"
_KEYED = f"SELECT *, lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS kt, lower(trim(place)) AS kp FROM (SELECT {', '.join(EVENT_ROW)} FROM orders)"
# The least id that any number of shared ids and titles lead to.
_SAME = f"""WITH RECURSIVE e AS (
  SELECT *, lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS kt, CASE WHEN trim(title) <> '' THEN lower(trim(title)) END AS k FROM (SELECT {', '.join(CHAINED_ROW)} FROM orders)
), least AS (SELECT k, min(external_id) AS least FROM e WHERE k IS NOT NULL GROUP BY k
), edge AS (
  SELECT DISTINCT external_id AS a, least AS b FROM e JOIN least USING (k) WHERE external_id <> least
  UNION SELECT DISTINCT least, external_id FROM e JOIN least USING (k) WHERE external_id <> least
), found(node, root) USING KEY (node) AS (
  SELECT DISTINCT external_id, external_id FROM e WHERE external_id IS NOT NULL
  UNION SELECT edge.a, min(w.root) FROM found AS w JOIN edge ON edge.b = w.node JOIN recurring.found AS known ON known.node = edge.a
  WHERE w.root < known.root GROUP BY edge.a
)"""
_SAME_ROWS = """SELECT e.*, root AS cluster_id FROM e LEFT JOIN least USING (k) LEFT JOIN found ON node = coalesce(least, external_id)"""
_NEW = f"""SELECT 'c:' || {text('o_custkey * 2')} AS external_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Order ' || {K} END AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS description, o_orderdate + to_seconds(o_orderkey) AS seen_at FROM orders"""

_TITLES = markup.ORACLES["page_titles"]
_MERGED = f"""SELECT coalesce(s.external_id, n.external_id) AS external_id, coalesce(s.first_seen, n.seen) AS first_seen, coalesce(n.title, s.title) AS title, coalesce(n.description, s.description) AS description
      FROM (SELECT 'c:' || {C} AS external_id, c_name AS title, c_mktsegment AS description, TIMESTAMP '1990-01-01 00:00:00' AS first_seen FROM customer) AS s
      FULL JOIN (SELECT external_id, min(seen_at) AS seen, arg_max(title, seen_at) FILTER (title IS NOT NULL) AS title, arg_max(description, seen_at) FILTER (description IS NOT NULL) AS description FROM ({_NEW}) GROUP BY 1) AS n ON n.external_id = s.external_id"""

ORACLES = {
    "location_texts": f"SELECT page_id, block_pos, item_pos, coalesce(place_name, location_text) AS place FROM ({EXPECTED_EVENTS})",
    "upcoming_events": f"SELECT page_id, external_id, CAST(start_time AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS start_ts FROM ({EXPECTED_EVENTS}) WHERE CAST(start_time AS TIMESTAMPTZ) >= TIMESTAMPTZ '{AS_OF} 00:00:00+00'",
    "contract_rows": f"SELECT page_id, external_id, title, start_time FROM ({EXPECTED_EVENTS})",
    "contract_violations": """SELECT o_orderkey AS page_id, array_to_string(list_filter([CASE WHEN o_orderkey % 8 = 1 THEN 'external_id is missing' END, CASE WHEN o_orderkey % 8 = 2 THEN 'title is missing' END,
      CASE WHEN o_orderkey % 8 = 3 THEN 'description is missing' END, CASE WHEN o_orderkey % 4 = 0 THEN 'start_time is missing' END, CASE WHEN o_orderkey % 8 = 5 THEN 'location.address is no text' END], lambda x: x IS NOT NULL), '; ') AS reasons
      FROM orders WHERE o_orderkey % 8 IN (0, 1, 2, 3, 4, 5)""",
    "contract_valid": f"SELECT o_orderkey AS page_id, 'e:' || {K} AS external_id FROM orders WHERE o_orderkey % 8 IN (6, 7)",
    "field_conformance": f"""SELECT {_REQUEST_URL} AS url, coalesce(e.n, 0) AS events, coalesce(CASE o_orderkey % 3 WHEN 0 THEN full0 WHEN 1 THEN full1 ELSE full2 END, 0) AS conforming,
      coalesce(CASE o_orderkey % 3 WHEN 2 THEN full0 ELSE comp END, 0) AS complete,
      CASE o_orderkey % 3 WHEN 1 THEN CASE WHEN full1 < e.n THEN 'end' ELSE '' END WHEN 2 THEN CASE WHEN full2 < e.n THEN 'organizer' ELSE '' END ELSE '' END AS missing
      FROM orders LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (title <> '') AS full0, count(*) FILTER ({_FILLED}) AS full1, count(*) FILTER (organizer <> '') AS full2,
        count(*) FILTER (description <> '' AND coalesce(place_name, location_text) <> '' AND url <> '') AS comp FROM ({EXPECTED_EVENTS}) GROUP BY page_id) AS e ON e.page_id = o_orderkey""",
    "requests_source": f"""SELECT CASE WHEN o_orderkey % 10 < 8 THEN {_REQUEST_URL} END AS url, CASE WHEN o_orderkey % 10 < 8 AND o_orderkey % 3 = 2 THEN '.a,.b' END AS selectors,
      CASE o_orderkey % 10 WHEN 8 THEN 'url is missing' WHEN 9 THEN 'unreadable' ELSE 'ok' END AS outcome FROM orders""",
    "failures_source": f"""SELECT 'https://d' || (o_custkey % 50) || '.example.org/' || {K} AS url, 'd' || (o_custkey % 50) || '.example.org' AS domain, 1000 + o_orderkey AS content_length,
      CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS strategies FROM orders""",
    "summary_source": """SELECT c_mktsegment AS type, count(*) AS entries, CAST(sum(c_custkey % 5) AS BIGINT) AS events_found, count(DISTINCT c_name) AS sources FROM customer GROUP BY 1
      UNION ALL SELECT 'all', count(*), 0, count(DISTINCT c_custkey // 100) FROM customer""",
    "responses_source": f"SELECT 'page' AS kind, CASE WHEN o_orderkey % 9 = 0 THEN 'timeout' ELSE 'ok' END AS status, count(*) AS n, max(sha256({K})) AS last_key FROM orders GROUP BY 1, 2",
    "crawl_summary": f"""SELECT count(*) AS sources_total, count(*) FILTER (status = 'completed') AS sources_processed, count(*) FILTER (status = 'failed') AS sources_failed,
      count(reason) AS sources_needing_improvement, CAST(sum(events_found) AS BIGINT) AS total_events_found, CAST(sum(events_posted) AS BIGINT) AS current_future_events_posted,
      round(100.0 * sum(events_posted) / sum(events_found), 1) AS success_rate_percent, round(sum(minutes), 1) AS total_time_minutes FROM ({_SHORT})""",
    "improvement_list": _LIST,
    "improvement_rollup": f"""SELECT type, city, grouping(type) AS type_total, grouping(city) AS city_total, count(*) AS entries, count(*) FILTER (reason = 'no_events_found') AS no_events_found,
      count(*) FILTER (reason = 'partial_success') AS partial_success, CAST(sum(events_found) AS BIGINT) AS events_found, CAST(sum(events_posted) AS BIGINT) AS events_posted FROM ({_LIST}) GROUP BY ROLLUP (type, city)""",
    "failure_rollup": """SELECT 'd' || (o_custkey % 50) || '.example.org' AS domain, count(*) AS failures, count(*) FILTER (o_orderkey % 3 = 0) AS numbered_links, count(*) AS next_prev_text,
      count(*) FILTER (o_orderkey % 5 = 0) AS javascript_calendar, 0 AS load_more_buttons, max(1000 + o_orderkey) AS largest_page FROM orders GROUP BY 1""",
    "strategy_counts": "SELECT s AS strategy, count(*) FILTER (s <> 'llm' OR o_orderkey % 2 = 0) AS failures FROM orders, (VALUES ('iframe'), ('css'), ('llm')) AS v(s) GROUP BY s",
    "page_profile": f"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, substr(sha256(html), 1, 12) AS content_hash, length(html) AS content_length,
      (SELECT t.title FROM ({_TITLES}) AS t WHERE t.page_id = pages.page_id) AS title, len(regexp_extract_all(html, '<a href="[^"]+">')) AS links,
      len(list_filter(regexp_extract_all(html, '<a href="[^"]+">[^<]*</a>'), lambda x: regexp_matches(x, '(?i)event|calendar'))) AS navigation_links,
      len(list_filter(regexp_extract_all(html, '<a href="[^"]+">([^<]*)</a>', 1), lambda x: regexp_matches(x, '^\\s*\\d{{1,3}}\\s*$'))) > 0 AS has_numbered_links,
      len(list_filter(regexp_extract_all(html, '<a href="[^"]+">([^<]*)</a>', 1), lambda x: regexp_matches(x, '(?i)\\b(next|prev|previous)\\b'))) > 0 AS has_next_prev_text,
      regexp_matches(html, '(?i)fullcalendar|datepicker|calendar\\s*\\(') AS has_javascript_calendar, false AS has_load_more_buttons, 0 AS url_patterns, 0 AS javascript_hints FROM pages""",
    "failing_sources": f"""SELECT source, l.url, reason, {D} AS failed_at, 1000 + o_orderkey AS content_length FROM ({_LIST}) AS l JOIN orders ON l.url = 'https://c.example.org/' || {K}""",
    "due_sources": f"""SELECT CAST(o_orderkey AS INTEGER) AS source_id FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 10 = 0 OR o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER) * 30) <= TIMESTAMP '{NOW}')""",
    "new_pages": f"""SELECT DISTINCT CAST(c_custkey % 20 AS INTEGER) AS source_id, 'https://j.example.org/' || (2 * c_custkey) AS url, 'pending' AS status, TIMESTAMP '{NOW}' AS created_at FROM customer
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 2 * c_custkey AND o_custkey % 20 = c_custkey % 20)""",
    "latest_jobs": f"SELECT url, job_id, status FROM ({_LATEST})",
    "job_counts": f"""SELECT source_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed,
      count(*) FILTER (status = 'failed') AS failed, CAST(sum(events_found) AS BIGINT) AS events_found FROM ({_LATEST}) GROUP BY source_id""",
    "failed_jobs": f"SELECT job_id, source_id, url, error_message FROM ({_LATEST}) WHERE status = 'failed'",
    "duplicate_clusters": f"""SELECT min(external_id) AS cluster_id, kt AS title, start_time, kp AS place, count(*) AS copies, count(DISTINCT external_id) AS ids, count(DISTINCT source_id) AS sources FROM ({_KEYED}) GROUP BY kt, start_time, kp""",
    "clustered_events": f"SELECT n, external_id, min(external_id) OVER (PARTITION BY kt, start_time, kp) AS cluster_id FROM ({_KEYED})",
    "same_events": f"{_SAME} SELECT n, external_id, cluster_id FROM ({_SAME_ROWS})",
    "same_event_clusters": f"""{_SAME} SELECT cluster_id, min(kt) AS title, min(start_time) AS start_time, 'hall' AS place, count(*) AS copies, count(DISTINCT external_id) AS ids,
      count(DISTINCT source_id) AS sources, count(DISTINCT kt) AS variants FROM ({_SAME_ROWS}) WHERE cluster_id IS NOT NULL GROUP BY cluster_id""",
    "unique_events": f"SELECT external_id, n FROM ({_KEYED}) QUALIFY row_number() OVER (PARTITION BY kt, start_time, kp ORDER BY external_id, n) = 1",
    "merged_events": _MERGED,
    "merged_store": f"SELECT *, 0 AS written_again FROM ({_MERGED})",
}
