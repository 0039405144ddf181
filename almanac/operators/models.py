"""Work around a language model, as batch jobs.  No model is shipped and none is called from here.

A prompt is a row; its content key stands for it in every join.  Answers come from a recorded table
(``schemas.RESPONSES``) or from a callable that ``run_model`` applies on the workers.
"""
from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from almanac import schemas
from almanac.functions import variants as V
from almanac.functions.html import page_nodes
from almanac.functions.ids import content_key, external_id
from almanac.functions.isotime import normalise, unreadable
from almanac.functions.joins import lookup
from almanac.functions.text import bind, first_non_empty, non_empty, strip
from almanac.operators.hints import hint_html, page_text, within_budget

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Prompt texts are parameters; these defaults say in this project's words what an answer must hold.
SECTION_PROMPT = (
    "Read the section of a web page below and answer with one JSON object and nothing else: "
    "source_id, external_id, title, description, location, start_time, end_time (ISO 8601 with offset, "
    "US Eastern time), url, metadata_tags (list). Answer null when the section holds no event, or only "
    "one that was over before {as_of}.\n\nSECTION:\n{content}\n\nPAGE: {url}"
)
PAGE_PROMPT = "URL: {url}\n\nPAGE_TEXT:\n{content}"
HINT_PROMPT = "URL: {url}\n\nHTML_STRUCTURE:\n{content}"
SCORE_PROMPT = (
    "Rate the event below: answer with a JSON object of validation_score (0 to 1, how complete and "
    "plausible it is) and tags (list: audience, activity, topic, access).\n\n"
    "Title: {title}\nDescription: {description}\nLocation: {location}\nDate/Time: {start_time}"
)
# What an event gets when no usable rating exists.
NEUTRAL_SCORE = 0.5
ABSENT = "N/A"


def fill(template: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` places of a template."""
    parts, rest = [], template
    while rest:
        spots = [(rest.index("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, name = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)


# ---- prompts -----------------------------------------------------------------------------------


def section_prompts(sections: DataFrame, as_of: Column, template: str = SECTION_PROMPT) -> DataFrame:
    """M1: prompt and key per section; the date context stands before the section's own text."""
    content = F.concat_ws("\n", F.col("context"), F.col("section"))
    prompt = fill(template, as_of=F.date_format(as_of, "yyyy-MM-dd"), content=content, url=F.col("url"))
    return sections.withColumn("prompt", prompt).withColumn("prompt_key", content_key(F.col("prompt")))


def prompts_of_text(url: Column, text: Column, template: str = PAGE_PROMPT) -> Column:
    """M2: prompts of a page text, one per window of it, NULL when the text is too short to hold events."""
    return F.transform(within_budget(text), lambda t: fill(template, url=url, content=t))


def prompt_keys(url: Column, text: Column) -> Column:
    """Content keys of ``prompts_of_text``."""
    return F.transform(prompts_of_text(url, text), content_key)


def page_prompts(pages: DataFrame, template: str = PAGE_PROMPT) -> DataFrame:
    """M2: prompts of the pages that have text enough, one per window (``piece``).  ``selectors``, where present, narrow the text."""
    hinted = F.col("selectors") if "selectors" in pages.columns else None
    return (
        pages.withColumn("_nodes", page_nodes(F.col("html")))
        .select("page_id", "url", page_text(F.col("_nodes"), hinted).alias("_text"))
        .select("page_id", "url", F.posexplode(prompts_of_text(F.col("url"), F.col("_text"), template)).alias("piece", "prompt"))
        .withColumn("prompt_key", content_key(F.col("prompt")))
    )


def hint_prompts(pages: DataFrame, template: str = HINT_PROMPT) -> DataFrame:
    """M3: prompts that ask which selectors hold events, one per window of the HTML (``piece``)."""
    return prompts_of_windows(pages.select("page_id", "url", hint_html(F.col("html")).alias("windows")), template)


def prompts_of_windows(rows: DataFrame, template: str = HINT_PROMPT) -> DataFrame:
    """M3: the prompts of pages whose HTML is cut into ``windows`` already."""
    prompts = F.transform("windows", lambda h: fill(template, url=F.col("url"), content=h))
    return rows.select("page_id", "url", F.posexplode(prompts).alias("piece", "prompt")).withColumn("prompt_key", content_key(F.col("prompt")))


def score_prompt(template: str = SCORE_PROMPT) -> Column:
    """M4: prompt that asks for a rating of an event row; missing fields show as N/A."""
    place = F.coalesce(F.col("location.text"), F.col("location.place.raw"))
    return fill(
        template,
        title=F.coalesce("title", F.lit(ABSENT)), description=F.coalesce("description", F.lit(ABSENT)),
        location=F.coalesce(place, F.lit(ABSENT)), start_time=F.coalesce("start_time", F.lit(ABSENT)),
    )


# ---- answers -----------------------------------------------------------------------------------


def answers(responses: DataFrame, kind: str) -> DataFrame:
    """``prompt_key, content, status`` of one kind, one row per key: a usable answer wins over a failed one."""
    good = F.when(F.col("status") == "ok", F.col("content"))
    return (
        responses.filter(F.col("kind") == kind)
        .groupBy(F.col("key").alias("prompt_key"))
        .agg(F.max(good).alias("content"), F.max("status").alias("_any"))
        .select("prompt_key", "content", F.when(F.col("content").isNotNull(), "ok").otherwise(F.col("_any")).alias("status"))
    )


def with_answers(prompts: DataFrame, responses: DataFrame, kind: str) -> DataFrame:
    """Prompt rows with ``content`` and ``status`` of their answer, NULL where none is recorded.

    The answer side has one row per key, so a prompt that makes up a large part of the rows is only
    hot on the prompt side, which ``lookup`` keeps splittable.
    """
    return lookup(prompts, answers(responses, kind), ["prompt_key"], "left")


def run_model(prompts: DataFrame, model: Callable[[list[str]], list[str | Exception]], kind: str, partitions: int | None = None) -> DataFrame:
    """M6: apply ``model`` to the distinct prompts; rows of ``schemas.RESPONSES``, error text in ``status``.

    Equal prompts are asked once, so repeated sections cannot pile up in one task.  ``model`` takes a
    list of prompts and gives the answers in the same order, an exception in place of an answer for a
    prompt that failed.  Nothing is asked again: if it raises, all prompts of that call have failed.
    """
    unique = prompts.select("prompt_key", "prompt").groupBy("prompt_key").agg(F.first("prompt").alias("prompt"))
    if partitions:
        unique = unique.repartition(partitions)

    def ask(batches):
        for batch in batches:
            try:
                given = list(model(list(batch["prompt"])))
            except Exception as error:
                given = [error] * len(batch)
            failed = [isinstance(g, Exception) for g in given]
            content = [None if bad else g for g, bad in zip(given, failed)]
            status = [f"{type(g).__name__}: {g}" if bad else "ok" for g, bad in zip(given, failed)]
            yield pd.DataFrame({"kind": kind, "key": batch["prompt_key"], "content": content, "status": status})

    return unique.mapInPandas(ask, schemas.RESPONSES)


def unfenced(content: Column) -> Column:
    """An answer without the code fence some models put around it."""

    def open_up(c: Column) -> Column:
        tail = F.replace(F.replace(c, F.lit("```json\n"), F.lit("")), F.lit("\n```"), F.lit(""))
        bare = F.replace(F.replace(c, F.lit("```\n"), F.lit("")), F.lit("\n```"), F.lit(""))
        return F.when(c.startswith("```json"), strip(tail)).when(c.startswith("```"), strip(bare)).otherwise(c)

    return bind(strip(content), open_up)


def section_events(answered: DataFrame) -> DataFrame:
    """Events of answered sections.  ``null``, broken answers and answers without a title give none.

    Needs ``url, content, link_url``; all other columns are handed through.
    """
    keep = [c for c in answered.columns if c not in ("content", "status", "prompt", "section", "context", "text_urls", "link_url", "url")]
    read = (
        answered.withColumn("_v", F.try_parse_json(unfenced(F.col("content"))))
        .filter(V.get_truthy(F.col("_v"), "title").isNotNull() & (V.kind(F.col("_v")) == "OBJECT"))
    )
    v = F.col("_v")
    text_location = F.struct(
        F.lit("text").alias("kind"), V.get(v, "location").alias("text"), F.lit(None).cast(schemas.PLACE).alias("place")
    )
    tags = F.coalesce(
        F.try_variant_get(v, "$.metadata_tags", "array<string>"),
        F.when(V.field(v, "metadata_tags").isNull(), F.expr("cast(array() as array<string>)")),
    )
    return read.select(
        *keep,
        F.col("url").alias("page_url"),
        V.get(v, "external_id").alias("external_id"),
        V.get(v, "title").alias("title"),
        V.get(v, "description").alias("description"),
        text_location.alias("location"),
        V.get(v, "start_time").alias("start_time"),
        V.get(v, "end_time").alias("end_time"),
        first_non_empty(F.col("link_url"), V.get(v, "url"), F.col("url")).alias("url"),
        V.get(v, "organizer").alias("organizer"),
        tags.alias("metadata_tags"),
    )


def page_answer_events(answered: DataFrame) -> DataFrame:
    """Events of answered page texts, with ``failed`` rows for pages whose answer cannot be used.

    Needs ``url, content``.  One unreadable date, an unknown time zone or a broken answer fails the
    page: it then gives one row with ``failed`` TRUE and no event.  So does a call that failed, where
    there is a ``status`` other than ``ok``.
    """
    keep = [c for c in answered.columns if c not in ("content", "status", "prompt", "url")]
    parsed = answered.withColumn("_a", F.from_json("content", schemas.MODEL_EVENTS))

    def times(e: Column) -> Column:
        start = normalise(e["start"], e["timezone"])
        end = normalise(e["end"], e["timezone"], end=True)
        return F.struct(e.alias("e"), start.alias("start_time"), end.alias("end_time"))

    def is_bad(t: Column) -> Column:
        return (
            t["e"]["title"].isNull() | t["e"]["start"].isNull()
            | unreadable(t["e"]["start"], t["start_time"]) | unreadable(t["e"]["end"], t["end_time"])
        )

    timed = parsed.withColumn("_t", F.transform(F.col("_a.events"), times))
    whole = timed.withColumn("_bad", F.col("content").isNotNull() & F.coalesce(F.exists("_t", is_bad), F.col("_t").isNull() & F.try_parse_json("content").isNull(), F.lit(False)))
    if "status" in answered.columns:
        whole = whole.withColumn("_bad", F.col("_bad") | F.coalesce(F.col("status") != "ok", F.lit(False)))
    rows = whole.withColumn("_t", F.when(F.col("_bad"), F.slice("_t", 1, 0)).otherwise(F.col("_t"))).select(
        *keep, F.col("url").alias("page_url"), F.col("_bad").alias("failed"), F.posexplode_outer("_t").alias("seq", "_t")
    )
    e = F.col("_t.e")
    place = F.struct(F.lit("text").alias("kind"), e["location"].alias("text"), F.lit(None).cast(schemas.PLACE).alias("place"))
    return rows.filter(F.col("failed") | F.col("seq").isNotNull()).select(
        *keep, "page_url", "failed", "seq",
        F.when(F.col("seq").isNotNull(), F.coalesce(
            non_empty(e["external_id"]), non_empty(e["url"]), external_id(F.col("page_url"), e["title"], F.col("_t.start_time"))
        )).alias("external_id"),
        e["title"].alias("title"),
        F.when(F.col("seq").isNotNull(), F.coalesce(e["description"], F.lit(""))).alias("description"),
        F.when(F.col("seq").isNotNull(), place).alias("location"),
        F.col("_t.start_time").alias("start_time"),
        F.col("_t.end_time").alias("end_time"),
        e["url"].alias("url"),
    )


def discovered_hints(answered: DataFrame) -> DataFrame:
    """M3: ``url, event_containers`` of answered discoveries; an unusable answer counts as an empty list.

    Lists found in several windows of one page, or in several answers for it, count together, in order of text.
    """
    found = F.coalesce(F.from_json("content", schemas.HINT_DISCOVERY)["event_containers"], F.expr("cast(array() as array<string>)"))
    lists = answered.filter(F.col("status").isNotNull()).select("url", found.alias("_found"))
    return lists.groupBy("url").agg(F.collect_set("_found").alias("_lists")).select(
        "url", F.when(F.size("_lists") == 1, F.col("_lists")[0]).otherwise(F.array_sort(F.array_distinct(F.flatten("_lists")))).alias("event_containers")
    )


def with_scores(events: DataFrame, responses: DataFrame | None) -> DataFrame:
    """M5: ``validation_score`` and ``tags`` per event, 0.5 and no tags where no usable rating exists.

    Without a response table at all (no model to ask) both columns stay NULL.
    """
    if responses is None:
        return events.withColumn("validation_score", F.lit(None).cast("double")).withColumn(
            "tags", F.lit(None).cast("array<string>")
        )
    keyed = events.withColumn("prompt_key", content_key(score_prompt()))
    rated = with_answers(keyed, responses, "score").withColumn("_v", F.try_parse_json(strip(F.col("content"))))
    v, is_object = F.col("_v"), F.coalesce(V.kind(F.col("_v")) == "OBJECT", F.lit(False))
    score = F.when(V.field(v, "validation_score").isNull(), NEUTRAL_SCORE).otherwise(
        F.try_variant_get(v, "$.validation_score", "double")
    )
    none = F.expr("cast(array() as array<string>)")
    tags = F.when(V.field(v, "tags").isNull(), none).otherwise(F.try_variant_get(v, "$.tags", "array<string>"))
    return rated.select(
        *events.columns,
        F.when(is_object, score).otherwise(NEUTRAL_SCORE).alias("validation_score"),
        F.when(is_object, tags).otherwise(none).alias("tags"),
    )
