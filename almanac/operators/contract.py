"""The output contract: which columns an event has to have, and what happens to events that lack them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac import schemas
from almanac.functions import variants as V
from almanac.functions.text import first_non_empty

# What an event must have, and how a place without name and address is shown.
MANDATORY = ["external_id", "title", "description", "location", "start_time"]
NO_PLACE = "Unknown Location"
# What a field named in a request means as a column.
FIELD_COLUMNS = {"date": "start_time", "start": "start_time", "end": "end_time"}


def location_text(location: Column) -> Column:
    """A location as one line: the text, or the place's name, else its address."""
    place = location["place"]
    return F.when(
        location["kind"] == "place", F.coalesce(first_non_empty(place["name"], place["address"]), F.lit(NO_PLACE))
    ).otherwise(location["text"])


def to_contract(events: DataFrame) -> DataFrame:
    """Exactly the columns and types of the contract, keys of the page in front; all else is dropped."""
    def typed(name: str, kind: str) -> Column:
        column = F.col(name) if name in events.columns else F.lit(None)
        return column.cast(kind).alias(name)

    keys = [c for c in ("page_id", "page_url") if c in events.columns]
    return events.select(
        *keys,
        *[typed(n, schemas.LOCATION if n == "location" else "string") for n in schemas.EVENT_FIELDS],
        typed("tags", "array<string>"),
        typed("validation_score", "double"),
    )


def violations(events: DataFrame) -> DataFrame:
    """Add ``reasons``: what keeps an event from meeting the contract, empty when nothing does."""
    missing = [
        F.when(
            F.col(c).isNull() | ((F.col("location.kind") == "text") & F.col("location.text").isNull() if c == "location" else F.lit(False)),
            f"{c} is missing",
        )
        for c in MANDATORY
    ]
    raw = F.try_parse_json(F.col("location.place.raw"))
    wrong = [
        F.when(~V.kind(V.field(raw, key)).isin("STRING", "VOID"), f"location.{key} is no text")
        for key in ("name", "address", "telephone", "url")
    ]
    return events.withColumn("reasons", F.array_compact(F.array(*missing, *wrong)))


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)


def upcoming(events: DataFrame, as_of: Column) -> DataFrame:
    """Events that start on or after a day."""
    return events.filter(F.col("start_ts") >= as_of.cast("timestamp"))


def field_shapes(events: DataFrame, **keys: Column) -> DataFrame:
    """For each key (columns by their names), its events by the set of fields that are filled (``have``), with their number ``n``.

    Such sets are few, so the events of a key become a handful of rows before anything is joined.
    """
    names = [*FIELD_COLUMNS, *schemas.EVENT_FIELDS, "tags", "validation_score"]

    def filled(name: str) -> Column:
        column = FIELD_COLUMNS.get(name, name)
        if column not in events.columns:
            return F.lit(False)
        if column == "tags":
            return F.coalesce(F.size("tags"), F.lit(0)) > 0
        if column == "validation_score":
            return F.col(column).isNotNull()
        value = location_text(F.col("location")) if column == "location" else F.col(column)
        return F.coalesce(value, F.lit("")) != ""

    have = F.array_compact(F.array(*[F.when(filled(n), n) for n in names]))
    named = events.select(*[c.alias(n) for n, c in keys.items()], have.alias("have"))
    return named.groupBy(*keys, "have").agg(F.count(F.lit(1)).alias("n"))


def requirements() -> tuple[Column, Column]:
    """Fields that a request requires and those it would like, with defaults for a request that names none."""
    return (
        F.coalesce("schema_requirements.required_fields", F.array(*map(F.lit, schemas.DEFAULT_REQUIRED))).alias("required_fields"),
        F.coalesce("schema_requirements.optional_fields", F.array(*map(F.lit, schemas.DEFAULT_OPTIONAL))).alias("optional_fields"),
    )


def conformance(wanted: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of ``wanted`` (with ``keys, required_fields, optional_fields``) with what its events have of the fields."""
    joined = wanted.join(shapes, keys, "left")
    lacks = F.array_except("required_fields", "have")
    return joined.groupBy(*wanted.columns).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.coalesce(F.sum(F.when(F.size(lacks) == 0, F.col("n"))), F.lit(0)).alias("conforming"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(lacks)))).alias("missing_required"),
        F.coalesce(F.sum(F.when(F.size(F.array_except("optional_fields", "have")) == 0, F.col("n"))), F.lit(0)).alias("complete"),
    )


def field_conformance(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Per requested page, how many of its events have all required and how many each optional field.

    Events are reduced to counts per page before the join, so a page with very many events costs no more.
    """
    wanted = requests.select("url", *requirements()).distinct()
    return conformance(wanted, field_shapes(events, url=F.col("page_url")), ["url"])
