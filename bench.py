"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores.  Every query runs over its whole tables; the
result is written to a sink that discards it, so all rows and columns are produced.  Pages that the queries read are written out of
the supplied tables first; that time is given as ``fixtures`` and is in no query's time.
"""
from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from almanac.workloads.registry import QUERIES, build_fixtures  # noqa: E402

HEADLINE = [
    "jsonld_events", "block_quarantine", "spoilt_page_policy", "iso_normaliser", "zone_offsets", "url_resolution",
    "page_anchors", "page_body_text", "page_profile", "section_texts", "section_links", "hinted_links", "page_frames",
    "frame_events", "calendar_events", "extraction_events", "link_expansion", "section_answers", "event_scores",
    "field_conformance", "failure_rollup", "latest_jobs", "clustered_events", "merged_events", "continuous_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("almanac-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    began = time.time()
    build_fixtures(spark, sf_dir)
    fixtures = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "fixtures": fixtures, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
