"""Schemas of the tables this library reads and writes.  None is ever inferred."""
from __future__ import annotations

PAGES = "page_id BIGINT, url STRING, html STRING"

REQUESTS = """
    url STRING,
    extraction_hints STRUCT<expected_event_count: INT, date_format_hints: ARRAY<STRING>,
                            content_selectors: ARRAY<STRING>, additional_hints: STRING>,
    schema_requirements STRUCT<required_fields: ARRAY<STRING>, optional_fields: ARRAY<STRING>>
"""
# What a request asks for when it does not say.
DEFAULT_REQUIRED = ["title", "date"]
DEFAULT_OPTIONAL = ["description", "location", "url"]

# One recorded model answer: kind is section, page, hints or score; key is the content key of the prompt.
RESPONSES = "kind STRING, key STRING, content STRING, status STRING"

FAILURES = """
    timestamp STRING, url STRING, domain STRING, content_hash STRING, content_length BIGINT,
    context STRUCT<strategies_attempted: ARRAY<STRING>, iframe_confidence: DOUBLE, css_confidence: DOUBLE,
                   js_confidence: DOUBLE, playwright_available: BOOLEAN>,
    html_sample STRUCT<title: STRING,
                       navigation_links: ARRAY<STRUCT<text: STRING, href: STRING, classes: STRING>>,
                       potential_pagination_elements: ARRAY<STRUCT<tag: STRING, classes: ARRAY<STRING>, text: STRING>>,
                       javascript_hints: ARRAY<STRING>>,
    potential_pagination_indicators STRUCT<has_numbered_links: BOOLEAN, has_next_prev_text: BOOLEAN,
                       has_javascript_calendar: BOOLEAN, has_load_more_buttons: BOOLEAN, url_patterns: ARRAY<STRING>>
"""

SUMMARY = """
    timestamp STRING, sources_total INT, sources_processed INT, sources_failed INT,
    sources_needing_improvement INT, total_events_found INT, current_future_events_posted INT,
    success_rate_percent DOUBLE, total_time_minutes DOUBLE,
    sources_for_improvement ARRAY<STRUCT<source: STRING, url: STRING, type: STRING, city: STRING, reason: STRING,
                                         details: STRING, events_found: INT, events_posted: INT>>,
    errors ARRAY<STRING>
"""

PLACE = "STRUCT<type: STRING, name: STRING, address: STRING, telephone: STRING, url: STRING, raw: STRING>"
LOCATION = f"STRUCT<kind: STRING, text: STRING, place: {PLACE}>"

# The columns of an event that describe it, in output order.
EVENT_FIELDS = [
    "external_id", "title", "description", "location", "start_time", "end_time", "url",
    "organizer", "event_status", "event_attendance_mode",
]

# What a page-text answer of a model must look like.
MODEL_EVENTS = """
    source STRING,
    events ARRAY<STRUCT<external_id: STRING, title: STRING, description: STRING, start: STRING, end: STRING,
                        timezone: STRING, location: STRING, organizer: STRING, price: STRING, url: STRING>>
"""
HINT_DISCOVERY = "event_containers ARRAY<STRING>, confidence DOUBLE, reasoning STRING"

SOURCES = """
    source_id INT, base_url STRING, name STRING, active BOOLEAN, last_scraped TIMESTAMP_NTZ,
    scrape_frequency INTERVAL DAY TO SECOND, type STRING, city STRING
"""
JOBS = """
    job_id BIGINT, source_id INT, url STRING, status STRING, created_at TIMESTAMP_NTZ,
    completed_at TIMESTAMP_NTZ, error_message STRING, events_found INT
"""
JOB_STATUSES = ["pending", "running", "completed", "failed"]
