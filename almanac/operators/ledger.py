"""Sources, jobs and stored events: the tables around a crawl.

Whatever needs "the latest" or "the first" of a key is an aggregate (``max_by``/``min_by`` reduce on the
map side), not a window, so one key with very many rows is never sorted in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from almanac import schemas
from almanac.functions.joins import lookup
from almanac.functions.text import non_empty, strip
from almanac.operators.components import components
from almanac.operators.contract import location_text
from almanac.operators.sieve import passing
from almanac.plans.staging import write_once


def due_sources(sources: DataFrame, as_of: Column) -> DataFrame:
    """Active sources never read, or not read for as long as their frequency says."""
    now = as_of.cast("timestamp_ntz")
    return sources.filter(
        F.col("active") & (F.col("last_scraped").isNull() | (F.col("last_scraped") + F.col("scrape_frequency") <= now))
    )


def new_pages(discovered: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Pending job rows for (source, URL) pairs the ledger does not know yet, each once.

    The ledger grows without end and what was just discovered does not, so a sieve of the discovered pairs goes through the
    ledger first: its other rows, nearly all of it, are in no exchange.  The anti-join behind it is exact.
    """
    pair = ["source_id", "url"]
    found = write_once(discovered.select(*pair).distinct())
    known = passing(jobs.select(*pair), found, pair)
    fresh = found.join(known, pair, "left_anti")
    return fresh.select(
        "source_id", "url", F.lit("pending").alias("status"), as_of.cast("timestamp_ntz").alias("created_at"),
        F.lit("").alias("error_message"), F.lit(0).alias("events_found"),
    )


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of each URL."""
    others = [c for c in jobs.columns if c != "url"]
    newest = F.max_by(F.struct(*others), F.struct("created_at", "job_id"))
    return jobs.groupBy("url").agg(newest.alias("_j")).select("url", "_j.*")


def job_counts(jobs: DataFrame) -> DataFrame:
    """Per source, the latest jobs by status and the events they found."""
    latest = latest_jobs(jobs)
    return latest.groupBy("source_id").agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in schemas.JOB_STATUSES],
        F.sum("events_found").alias("events_found"),
    )


def failed_jobs(jobs: DataFrame) -> DataFrame:
    """Latest jobs that ended in an error, with its text."""
    return latest_jobs(jobs).filter(F.col("status") == "failed").select("job_id", "source_id", "url", "error_message")


def event_key() -> Column:
    """What two events of different sources share when they are the same: title, start and place."""
    tidy = F.lower(F.regexp_replace(strip(F.coalesce("title", F.lit(""))), r"(?U)\s+", " "))
    place = F.lower(strip(F.coalesce(location_text(F.col("location")), F.lit(""))))
    return F.struct(tidy.alias("title"), F.coalesce("start_time", F.lit("")).alias("start_time"), place.alias("place"))


def duplicate_clusters(events: DataFrame) -> DataFrame:
    """One row per group of equal events: ``cluster_id`` (least external id), ``copies``, ``sources``.

    Copies with the same external id count once in ``ids``.
    """
    keyed = events.select(event_key().alias("key"), "external_id", "source_id")
    # first per (group, id, source), then per group: two reductions, neither of which holds a group
    once = keyed.groupBy("key", "external_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("key").agg(
        F.min("external_id").alias("cluster_id"),
        F.sum("n").alias("copies"),
        F.count_distinct("external_id").alias("ids"),
        F.count_distinct("source_id").alias("sources"),
    ).select("cluster_id", "key.title", "key.start_time", "key.place", "copies", "ids", "sources")


def with_cluster(events: DataFrame) -> DataFrame:
    """Every event with the ``cluster_id`` of its group.

    Groups are reduced to their least id first; events then look it up, see ``lookup`` for hot groups.
    """
    keyed = events.withColumn("_key", F.to_json(event_key()))
    least = keyed.groupBy("_key").agg(F.min("external_id").alias("cluster_id"))
    return lookup(keyed, least, ["_key"]).drop("_key")


def unique_events(events: DataFrame, order: list[str]) -> DataFrame:
    """One event per group, the first by ``order``."""
    picked = F.min_by(F.struct(*events.columns), F.struct(*order))
    return events.groupBy(event_key().alias("_key")).agg(picked.alias("_e")).select("_e.*")


def _named_key() -> Column:
    """``event_key`` as text, for events that have a title and a start; others resemble no other event."""
    return F.when(
        (F.col("_key.title") != "") & (F.col("_key.start_time") != ""), F.concat(F.lit("k"), F.to_json("_key"))
    )


def same_events(events: DataFrame) -> DataFrame:
    """X15, exact and near rule together: every event with the ``cluster_id`` of its cluster.

    Events with one ``external_id`` are the same event, and so are events of equal title, start and place; a cluster
    is what is connected by either, over any number of steps, named by its least id.  An event without title or start is
    like others by its id alone, one without an id by title, start and place alone; one without both, or a cluster
    without any id, has no name (NULL).  The graph's nodes are ids and its edges lead from every id of a key to the key's
    least one, so a key that a third of all events share costs an edge per id, not per pair.
    """
    keyed = events.withColumn("_key", event_key()).withColumn("_key", _named_key())
    pairs = write_once(keyed.select("_key", "external_id").distinct())
    named = pairs.filter(F.col("_key").isNotNull())
    least = named.groupBy("_key").agg(F.min("external_id").alias("_least"))
    edges = lookup(named, least, ["_key"]).filter(F.col("external_id") != F.col("_least"))
    roots = write_once(components(edges.select(F.col("external_id").alias("a"), F.col("_least").alias("b"))))
    # what an event looks its cluster up by: its key or, without one, its id
    alone = pairs.filter(F.col("_key").isNull() & F.col("external_id").isNotNull()).select(_id_text().alias("_key"), F.col("external_id").alias("_least"))
    clusters = lookup(least.unionByName(alone), roots.withColumnRenamed("node", "_least"), ["_least"], "left").select(
        "_key", F.coalesce("root", "_least").alias("cluster_id"))
    return lookup(keyed.withColumn("_key", F.coalesce("_key", _id_text())), clusters, ["_key"], "left").drop("_key")


def _id_text() -> Column:
    return F.concat(F.lit("i"), F.col("external_id"))


def same_event_clusters(events: DataFrame) -> DataFrame:
    """X15, both rules: one row per cluster of ``same_events`` that has a name.

    ``copies`` events with ``ids`` different ids from ``sources`` sources and with ``variants`` different descriptions, of
    which title, start and place of the least stand for all.
    """
    keyed = same_events(events).filter(F.col("cluster_id").isNotNull()).select("cluster_id", event_key().alias("key"), "external_id", "source_id")
    once = keyed.groupBy("cluster_id", "key", "external_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("cluster_id").agg(
        F.min("key").alias("key"), F.sum("n").alias("copies"), F.count_distinct("external_id").alias("ids"),
        F.count_distinct("source_id").alias("sources"), F.count_distinct("key").alias("variants"),
    ).select("cluster_id", "key.title", "key.start_time", "key.place", "copies", "ids", "sources", "variants")


def _newest_values(new: DataFrame, columns: list[str], newest: str, types: dict[str, str]) -> DataFrame:
    """One row per ``external_id``: per column the newest non-empty value, and when the id was first seen."""
    def filled(c: str) -> Column:
        return non_empty(F.col(c)) if types[c] == "string" else F.col(c)

    return new.groupBy("external_id").agg(
        F.min(newest).alias("_seen"),
        *[F.max_by(F.col(c), F.when(filled(c).isNotNull(), F.struct(newest, c))).alias(f"_{c}") for c in columns],
    )


def _merged(stored: DataFrame, latest: DataFrame, columns: list[str]) -> DataFrame:
    return stored.join(latest, "external_id", "full_outer").select(
        "external_id",
        F.coalesce("first_seen", "_seen").alias("first_seen"),
        *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in columns],
    )


def merge_events(stored: DataFrame, new: DataFrame, newest: str) -> DataFrame:
    """Stored events brought up to date.  Per ``external_id`` and column the newest non-empty value
    wins, else the stored one stays; ``first_seen`` never moves.

    New rows are reduced to one per id before the join, so the join is one to one.  For a store on disk see ``merge_into``.
    """
    columns = [c for c in stored.columns if c not in ("external_id", "first_seen")]
    return _merged(stored, _newest_values(new, columns, newest, dict(stored.dtypes)), columns)


def bucket_of(external_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(external_id), F.lit(buckets)).cast("int")


def create_store(events: DataFrame, path: str, buckets: int = 256) -> None:
    """Write events, one row per ``external_id``, as a store of ``buckets`` folders, by a hash of the id.

    Choose buckets so that one is a few files' worth: what a merge rewrites is whole buckets.
    """
    events.withColumn("bucket", bucket_of(F.col("external_id"), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def merge_into(spark: SparkSession, path: str, schema: str, new: DataFrame, newest: str, buckets: int = 256) -> int:
    """X16 on disk: ``merge_events`` on a store of ``create_store``; the number of buckets it wrote anew.

    Only buckets that hold an id of ``new`` are read, and only those in which some row changes are replaced, each as a
    whole, by dynamic partition overwrite: files of other buckets stay as they are, and merging the same rows once more
    writes nothing.  The new content is stored in the shared folder before any bucket is replaced, so a run that is broken
    off can be repeated: replaced buckets are found up to date, the others are merged then.  ``schema`` is that of the stored events.
    """
    read = StructType.fromDDL(schema)
    columns = [f.name for f in read if f.name not in ("external_id", "first_seen")]
    types = {f.name: f.dataType.simpleString() for f in read}
    latest = write_once(_newest_values(new, columns, newest, types).withColumn("bucket", bucket_of(F.col("external_id"), buckets)))
    touched = [r["bucket"] for r in latest.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    stored = spark.read.schema(StructType([*read, StructField("bucket", IntegerType())])).parquet(path).filter(F.col("bucket").isin(touched))
    before = [F.col(c).alias(f"_was_{c}") for c in ("first_seen", *columns)]
    kept = stored.drop("bucket").select("*", *before, F.lit(True).alias("_known"))
    joined = kept.join(latest.drop("bucket"), "external_id", "full_outer")
    values = {"first_seen": F.coalesce("first_seen", "_seen"), **{c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}}
    differs = F.col("_known").isNull()
    for c, value in values.items():
        differs = differs | ~value.eqNullSafe(F.col(f"_was_{c}"))
    merged = write_once(joined.select("external_id", *[v.alias(c) for c, v in values.items()], differs.alias("_changed")).withColumn(
        "bucket", bucket_of(F.col("external_id"), buckets)))
    changed = [r["bucket"] for r in merged.filter("_changed").select("bucket").distinct().collect()]
    if changed:
        rows = merged.filter(F.col("bucket").isin(changed)).drop("_changed").repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(changed)
