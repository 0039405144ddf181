"""Hot keys: the joins that meet them must be split, and the aggregates must reduce before they shuffle."""
import re

import pytest
from pyspark.sql import functions as F

from almanac import schemas
from almanac.operators import crawl, jsonld, ledger, models
from almanac.plans.staging import write_once
from almanac.workloads.common import table

SMALL_LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def small_limits(spark):
    """Size limits brought down to test data, so that adaptive execution sees a hot key as one."""
    before = {k: spark.conf.get(k, None) for k in SMALL_LIMITS}
    for k, v in SMALL_LIMITS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_and_read_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def hot(column, n=3):
    """A third of all rows share one key."""
    return F.when(column % n == 0, F.lit("hot")).otherwise(column.cast("string"))


def test_frames_embedded_by_a_third_of_all_pages(spark, small_limits):
    links = spark.range(30000).repartition(8).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://a.org/"), hot(F.col("id"))).alias("target_url"), F.lit("iframe").alias("method"),
        F.lit(1).alias("source_ord"), F.sha2(F.col("id").cast("string"), 512).alias("page_url"),
    )
    block = '<script type="application/ld+json">{"@type":"Event","@id":"e","startDate":"2025-01-01"}</script>'
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://a.org/"), hot(F.col("id"), 3000)).alias("url"), F.lit(block).alias("html")
    )
    found = crawl.targets(jsonld.with_items(pages), pages)
    events = crawl.followed_events(links, found, F.lit("2025-01-01").cast("date"), ["page_id", "page_url"])
    rows, plan = run_and_read_plan(events.select("page_id", "external_id"))
    assert len(rows) == 10000 + sum(1 for i in range(3000) if i % 3)
    assert "skew=true" in plan


def test_addresses_are_never_sent_whole_through_the_driver(spark):
    pages = write_once(spark.range(3000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://a.org/calendar/"), F.col("id").cast("string")).alias("url"), F.lit("<p>").alias("html")))
    links = crawl.survey(pages, F.lit("2025-01-01").cast("date")).select("page_id", F.col("url").alias("page_url"), F.inline("links"))
    found = crawl.targets(jsonld.with_items(pages), pages, crawl.addresses(links))
    rows, plan = run_and_read_plan(crawl.followed_events(links, found, F.lit("2025-01-01").cast("date"), ["page_id", "page_url"]))
    assert not rows and "Broadcast" not in plan


def test_prompts_shared_by_a_third_of_all_sections(spark, small_limits):
    prompts = spark.range(30000).repartition(8).select(F.sha2(hot(F.col("id")), 256).alias("prompt_key"), F.sha2(F.col("id").cast("string"), 512).alias("url"))
    recorded = prompts.select("prompt_key").distinct().select(
        F.lit("section").alias("kind"), F.col("prompt_key").alias("key"), F.lit("null").alias("content"), F.lit("ok").alias("status")
    )
    rows, plan = run_and_read_plan(models.with_answers(prompts, recorded, "section"))
    assert len(rows) == 30000 and all(r.content == "null" for r in rows)
    assert "skew=true" in plan


def test_copies_of_one_event_in_a_third_of_all_rows(spark, small_limits):
    events = spark.range(30000).repartition(8).select(
        F.col("id").cast("string").alias("external_id"), hot(F.col("id")).alias("title"), F.lit("2025-01-01").alias("start_time"), (F.col("id") % 7).cast("int").alias("source_id"),
        F.struct(F.lit("text").alias("kind"), F.lit("Hall").alias("text"), F.lit(None).cast(schemas.PLACE).alias("place")).alias("location"),
    )
    rows, plan = run_and_read_plan(ledger.with_cluster(events).select("external_id", "title", "cluster_id"))
    assert len(rows) == 30000
    assert {r.cluster_id for r in rows if r.title == "hot"} == {"0"}
    assert "skew=true" in plan


@pytest.mark.parametrize("make", [
    lambda e: ledger.duplicate_clusters(e), lambda e: ledger.unique_events(e, ["external_id"]),
])
def test_groups_are_reduced_before_the_shuffle(spark, make):
    events = spark.range(10).select(
        F.col("id").cast("string").alias("external_id"), F.lit("t").alias("title"), F.lit("s").alias("start_time"), F.lit(1).alias("source_id"),
        F.struct(F.lit("text").alias("kind"), F.lit("Hall").alias("text"), F.lit(None).cast(schemas.PLACE).alias("place")).alias("location"),
    )
    plan = make(events)._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan and "Window" not in plan and not re.search(r"collect_(list|set)", plan)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("url"), F.col("o_orderstatus").alias("html"))
    plan = jsonld.page_events(orders.filter("page_id > 10"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,10)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
    assert table(spark, sf_dir, "pages").count() == 50
