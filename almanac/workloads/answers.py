"""Work around a model: prompts, recorded answers, scores, the callable."""
from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import functions as F

from almanac.operators import hints, models
from almanac.operators.jsonld import page_events
from almanac.operators.sections import page_sections
from almanac.plans import answering
from almanac.plans.extract import hint_prompts as hint_prompts_through_frames
from almanac.plans.staging import shared_folder, write_once
from almanac.workloads.common import day, table, text
from almanac.workloads.crawling import FRAME_HTML, FRAME_URL, PARENT, PARENT_HTML, framed_pages
from almanac.workloads.markup import NUMBERED_SECTIONS, SECTION_LINK_URL, ORACLES as MARKUP_ORACLES, PAGE_URL, section_pages
from almanac.workloads.structured import EXPECTED_EVENTS, order_pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = text("o_orderkey")
D = day("o_orderdate")
TODAY = "2025-01-01"


def _today():
    return F.lit(TODAY).cast("date")


def _filled(template: str, **values: str) -> str:
    """The template as an SQL text expression."""
    sql = template.replace("'", "''")
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return "'" + sql + "'"


def _bare(html: str) -> str:
    """HTML without scripts and styles, as SQL."""
    return f"regexp_replace({html}, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis')"


# ---- prompts ------------------------------------------------------------------------------------


def section_prompts(spark, sf_dir):
    found = models.section_prompts(page_sections(section_pages(spark, sf_dir)), _today())
    return found.select("page_id", "section_pos", "prompt_key")


def page_prompts(spark, sf_dir):
    return models.page_prompts(table(spark, sf_dir, "pages")).select("page_id", "prompt_key")


def hint_prompts(spark, sf_dir):
    return models.hint_prompts(table(spark, sf_dir, "pages")).select("page_id", "prompt_key")


def hint_prompts_of_frames(spark, sf_dir):
    return hint_prompts_through_frames(framed_pages(spark, sf_dir)).select("page_id", "prompt_key")


def score_prompts(spark, sf_dir):
    events = page_events(order_pages(spark, sf_dir))
    return events.select("page_id", "block_pos", "item_pos", F.sha2(models.score_prompt(), 256).alias("prompt_key"))


# ---- answers ------------------------------------------------------------------------------------

ANSWER_FORM = "(event_id % 7)"
SECTION_ANSWER = f"""CASE {ANSWER_FORM} WHEN 0 THEN '{{"title":"Show","url":"https://m.example.org/","metadata_tags":["a","b"],"start_time":"2025-02-01T10:00:00-05:00"}}'
  WHEN 1 THEN concat('```json', chr(10), '{{"title":"Show","location":"Hall"}}', chr(10), '```') WHEN 2 THEN concat('```', chr(10), '{{"title":"Show","metadata_tags":[]}}', chr(10), '```')
  WHEN 3 THEN 'null' WHEN 4 THEN '{{"title":"","url":"x"}}' WHEN 5 THEN 'Sorry, {{broken' END"""


def section_answers(spark, sf_dir):
    """Every section of a page gets the answer of the page's form; the seventh form is not answered at all."""
    prompts = models.section_prompts(page_sections(section_pages(spark, sf_dir)), _today())
    prompts = write_once(prompts.drop("prompt", "section", "context"))
    recorded = prompts.withColumnRenamed("page_id", "event_id").selectExpr(
        "'section' AS kind", "prompt_key AS key", f"{SECTION_ANSWER} AS content", "'ok' AS status"
    )
    found = models.section_events(models.with_answers(prompts, recorded.filter("content IS NOT NULL"), "section"))
    return found.select(
        "page_id", "section_pos", "title", F.col("location.text").alias("location_text"), "start_time", "url",
        F.array_join("metadata_tags", ",").alias("tags"),
    )


PAGE_ANSWER = f"""CASE o_orderkey % 6 WHEN 0 THEN '{{"events":[{{"title":"A ' || {K} || '","start":"' || {D} || '","end":"' || {D} || '"}},{{"title":"B","start":"' || {D} || 'T08:00:00Z","external_id":"x:' || {K} || '"}}]}}'
  WHEN 1 THEN '{{"events":[{{"title":"A","start":"' || {D} || 'T12:00:00","timezone":"Asia/Kolkata","url":"https://u.example.org/' || {K} || '","description":"d","location":"Hall"}}]}}'
  WHEN 2 THEN '{{"events":[{{"title":"A","start":"soon"}},{{"title":"B","start":"' || {D} || '"}}]}}' WHEN 3 THEN 'no json' WHEN 4 THEN '{{"events":[]}}'
  ELSE '{{"events":[{{"title":"A","start":"' || {D} || '","timezone":"Nowhere/Town"}}]}}' END"""


def page_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS page_id", f"'https://p.example.org/' || {K} AS url", f"{PAGE_ANSWER} AS content", "'ok' AS status")
    return models.page_answer_events(rows).select(
        "page_id", "failed", F.coalesce("seq", F.lit(-1)).alias("seq"), "external_id", "title", "description", F.col("location.text").alias("location_text"), "start_time", "end_time", "url"
    )


def discovered_hints(spark, sf_dir):
    """Answers to hint questions: a list, an empty list, an unusable answer, a failed call; and who wins."""
    answer = """CASE o_orderkey % 4 WHEN 0 THEN '{"event_containers":[".a","li"],"confidence":0.9,"reasoning":"r"}' WHEN 1 THEN '{"event_containers":[]}' WHEN 2 THEN 'oops' END"""
    orders = table(spark, sf_dir, "orders")
    found = models.discovered_hints(orders.selectExpr(f"'https://p.example.org/' || {K} AS url", f"{answer} AS content", "CASE WHEN o_orderkey % 4 < 3 THEN 'ok' END AS status"))
    asked = orders.selectExpr(
        f"'https://p.example.org/' || {K} AS url",
        "named_struct('content_selectors', CASE o_orderkey % 3 WHEN 0 THEN array('.mine') WHEN 1 THEN CAST(array() AS ARRAY<STRING>) END) AS extraction_hints",
    )
    return hints.resolve_hints(asked, found).select("url", F.array_join("selectors", ",").alias("selectors"), "origin")


def event_scores(spark, sf_dir):
    """Ratings of events: good, without tags, without score, broken, none recorded."""
    events = write_once(page_events(order_pages(spark, sf_dir)))
    answer = """CASE page_id % 5 WHEN 0 THEN '{"validation_score": 0.85, "tags": ["music", "indoor"]}' WHEN 1 THEN '{"validation_score": 0.25}'
      WHEN 2 THEN '{"tags": ["free"]}' WHEN 3 THEN 'I think it is fine' END"""
    recorded = events.withColumn("key", F.sha2(models.score_prompt(), 256)).selectExpr(
        "'score' AS kind", "key", f"{answer} AS content", "CASE WHEN page_id % 5 = 4 THEN 'timeout' ELSE 'ok' END AS status"
    )
    rated = models.with_scores(events, recorded)
    return rated.select("page_id", "block_pos", "item_pos", "validation_score", F.array_join("tags", ",").alias("tags"))


def _echo(prompts: list[str]) -> list[str | Exception]:
    """Stands in for a model: refuses urgent requests, else says how long the request was."""
    return [ValueError("busy") if "URGENT" in p else f'{{"length": {len(p)}}}' for p in prompts]


def model_run(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(f"'rate ' || o_orderpriority || ' of ' || {text('o_custkey')} AS prompt")
    asked = models.run_model(rows.withColumn("prompt_key", F.sha2("prompt", 256)), _echo, "score", partitions=8)
    return asked.select("kind", "key", "content", "status")


def _first_opinion(prompts: list[str]) -> list[str | Exception]:
    return [ValueError("busy") if "MACHINERY" in p else f'{{"first": {len(p)}}}' for p in prompts]


def _second_opinion(prompts: list[str]) -> list[str | Exception]:
    return [f'{{"second": {len(p)}}}' for p in prompts]


def settled_answers(spark, sf_dir):
    """Customers' prompts are settled by a first run; a second one with another model, about orders too, asks only what is open."""
    ledger = f"{shared_folder(spark)}/almanac/{uuid.uuid4().hex}"
    customers = table(spark, sf_dir, "customer").selectExpr(f"'rate ' || c_mktsegment || ' of ' || {text('c_custkey')} AS prompt")
    orders = table(spark, sf_dir, "orders").selectExpr(f"'rate ' || o_orderpriority || ' of ' || {text('o_custkey')} AS prompt")
    keyed = [df.withColumn("prompt_key", F.sha2("prompt", 256)) for df in (customers, customers.unionByName(orders))]
    answering.ask_once(keyed[0], _first_opinion, "score", ledger, wave=1 << 20, partitions=8)
    return answering.ask_once(keyed[1], _second_opinion, "score", ledger, wave=1 << 20, partitions=8).select("key", "content", "status")


QUERIES = {
    "section_prompts": section_prompts,
    "page_prompts": page_prompts,
    "hint_prompts": hint_prompts,
    "hint_prompts_of_frames": hint_prompts_of_frames,
    "score_prompts": score_prompts,
    "section_answers": section_answers,
    "page_answers": page_answers,
    "discovered_hints": discovered_hints,
    "event_scores": event_scores,
    "model_run": model_run,
    "settled_answers": settled_answers,
}

_CONTEXT = "CASE WHEN ord = 2 THEN CASE event_id % 3 WHEN 0 THEN 'Sunday' || chr(10) WHEN 2 THEN 'June 3rd' || chr(10) || '10:30 am' || chr(10) ELSE '' END ELSE '' END"
_PLACE = "CASE WHEN location_kind = 'place' THEN '{\"@type\":\"Place\",\"address\":\"1 Main Street\",\"name\":\"' || place_name || '\"}' ELSE location_text END"
_LINK = f"CASE WHEN ord = 1 THEN {SECTION_LINK_URL} END"

ORACLES = {
    "section_prompts": f"""SELECT event_id AS page_id, section_pos, sha256({_filled(models.SECTION_PROMPT, as_of=f"'{TODAY}'", content=f"{_CONTEXT} || section", url=PAGE_URL)}) AS prompt_key FROM ({NUMBERED_SECTIONS})""",
    "page_prompts": f"""SELECT p.page_id, sha256({_filled(models.PAGE_PROMPT, url="url", content="text")}) AS prompt_key FROM pages AS p
      JOIN ({MARKUP_ORACLES["page_body_text"]}) AS t ON t.page_id = p.page_id WHERE length(text) >= 200""",
    "hint_prompts": f"""SELECT page_id, sha256({_filled(models.HINT_PROMPT, url="url", content=_bare("html"))}) AS prompt_key FROM pages""",
    "hint_prompts_of_frames": f"""SELECT 2 * c_custkey AS page_id, sha256({_filled(models.HINT_PROMPT, url=PARENT, content=_bare(f"CASE WHEN c_custkey % 7 = 6 THEN {PARENT_HTML} ELSE {FRAME_HTML} END"))}) AS prompt_key FROM customer
      UNION ALL SELECT 2 * c_custkey + 1, sha256({_filled(models.HINT_PROMPT, url=f"coalesce({FRAME_URL}, 'https://host' || {text('c_custkey % 40')} || '.example.org/unused/' || {text('c_custkey')})", content=_bare(FRAME_HTML))}) FROM customer""",
    "score_prompts": f"""SELECT page_id, block_pos, item_pos, sha256({_filled(models.SCORE_PROMPT, title="title", description="description", location=f"({_PLACE})", start_time="start_time")}) AS prompt_key FROM ({EXPECTED_EVENTS})""",
    "section_answers": f"""SELECT event_id AS page_id, section_pos, 'Show' AS title, CASE WHEN event_id % 7 = 1 THEN 'Hall' END AS location_text,
      CASE WHEN event_id % 7 = 0 THEN '2025-02-01T10:00:00-05:00' END AS start_time,
      coalesce({_LINK}, CASE WHEN event_id % 7 = 0 THEN 'https://m.example.org/' END, {PAGE_URL}) AS url, CASE WHEN event_id % 7 = 0 THEN 'a,b' ELSE '' END AS tags
      FROM ({NUMBERED_SECTIONS}) WHERE event_id % 7 IN (0, 1, 2)""",
    "page_answers": f"""SELECT page_id, failed, seq, external_id, title, description, location_text, start_time, end_time, url FROM (
      SELECT o_orderkey AS page_id, o_orderkey % 6 AS f, false AS failed, 0 AS seq, 'p.example.org:' || substr(sha1('p.example.org|A ' || {K} || '|' || {D} || 'T00:00:00+00:00'), 1, 16) AS external_id,
        'A ' || {K} AS title, '' AS description, NULL AS location_text, {D} || 'T00:00:00+00:00' AS start_time, {D} || 'T23:59:59+00:00' AS end_time, NULL AS url FROM orders WHERE o_orderkey % 6 = 0
      UNION ALL SELECT o_orderkey, 0, false, 1, 'x:' || {K}, 'B', '', NULL, {D} || 'T08:00:00+00:00', NULL, NULL FROM orders WHERE o_orderkey % 6 = 0
      UNION ALL SELECT o_orderkey, 1, false, 0, 'https://u.example.org/' || {K}, 'A', 'd', 'Hall', {D} || 'T12:00:00+05:30', NULL, 'https://u.example.org/' || {K} FROM orders WHERE o_orderkey % 6 = 1
      UNION ALL SELECT o_orderkey, 2, true, -1, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 6 IN (2, 3, 5))""",
    "discovered_hints": f"""SELECT 'https://p.example.org/' || {K} AS url,
      CASE WHEN o_orderkey % 3 = 0 THEN '.mine' WHEN o_orderkey % 4 = 0 THEN '.a,li' WHEN o_orderkey % 4 < 3 THEN '' END AS selectors,
      CASE WHEN o_orderkey % 3 = 0 THEN 'request' WHEN o_orderkey % 4 < 3 THEN 'discovered' END AS origin FROM orders""",
    "event_scores": f"""SELECT page_id, block_pos, item_pos, CASE page_id % 5 WHEN 0 THEN 0.85 WHEN 1 THEN 0.25 ELSE 0.5 END::DOUBLE AS validation_score,
      CASE page_id % 5 WHEN 0 THEN 'music,indoor' WHEN 2 THEN 'free' ELSE '' END AS tags FROM ({EXPECTED_EVENTS})""",
    "settled_answers": f"""SELECT DISTINCT sha256(p) AS key, CASE WHEN first AND p LIKE '%MACHINERY%' THEN NULL ELSE '{{"' || CASE WHEN first THEN 'first' ELSE 'second' END || '": ' || length(p) || '}}' END AS content,
      CASE WHEN first AND p LIKE '%MACHINERY%' THEN 'ValueError: busy' ELSE 'ok' END AS status
      FROM (SELECT 'rate ' || c_mktsegment || ' of ' || {text('c_custkey')} AS p, true AS first FROM customer
        UNION ALL SELECT 'rate ' || o_orderpriority || ' of ' || {text('o_custkey')}, false FROM orders)""",
    "model_run": f"""SELECT DISTINCT 'score' AS kind, sha256(p) AS key, CASE WHEN p NOT LIKE '%URGENT%' THEN '{{"length": ' || length(p) || '}}' END AS content,
      CASE WHEN p LIKE '%URGENT%' THEN 'ValueError: busy' ELSE 'ok' END AS status FROM (SELECT 'rate ' || o_orderpriority || ' of ' || {text('o_custkey')} AS p FROM orders)""",
}
