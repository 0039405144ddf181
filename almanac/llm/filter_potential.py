"""How filters interact: what each removes, in every order, by the potential of the removal game.

The filters are players, and a coalition of them is worth the documents that at least one of its filters fails.
The potential of the empty coalition is 0, and that of any other is its worth plus the potentials of the coalitions one
filter smaller, divided by its size.  A filter's Shapley value, its mean removal over all orders, is the potential of
all filters less that of all others.  What a step of one order removes is the difference of two coalitions' worths,
so 32 worths for each part stand for all 120 orders, and no order is run over the documents.

Texts are read once, for five failures each; worths are sums over 32 sets of failures.
"""
from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from almanac.functions.joins import lookup
from almanac.functions.text import bind
from almanac.llm import common
from almanac.plans.staging import write_once

MIN_WORDS = 100
DIFFERENT = 80       # percent of the words, at least
CAPITALS = 10        # percent of the code points, at most
SIGNS = r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)

STEPS = T.StructType([
    T.StructField("part", T.StringType(), False), T.StructField("filter_order", T.StringType(), False), T.StructField("step", T.IntegerType(), False),
    *[T.StructField(n, T.LongType(), False) for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")],
])


def potentials(worth: np.ndarray, players: int) -> np.ndarray:
    """The potential of every coalition times the factorial of its size, so that whole numbers stay whole.

    ``worth[s]`` is that of the coalition whose players are the bits of ``s``.
    """
    found = np.zeros_like(worth)
    for s in range(1, 1 << players):
        size = s.bit_count()
        found[s] = factorial(size - 1) * worth[s] + sum(found[s ^ (1 << i)] for i in range(players) if s >> i & 1)
    return found


def order_sums(worth: np.ndarray, players: int) -> list[int]:
    """Each player's Shapley value times the number of orders: what it adds, summed over all of them."""
    found, grand = potentials(worth, players), (1 << players) - 1
    return [int(found[grand] - players * found[grand ^ (1 << i)]) for i in range(players)]


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that fail a text, which must not be null."""
    def bits(words: Column) -> Column:
        short = F.size(words) < MIN_WORDS
        repetitive = 100 * F.size(F.array_distinct(words)) < DIFFERENT * F.size(words)
        return F.when(short, 1).otherwise(0) + F.when(repetitive, 2).otherwise(0)

    capitals = F.length(text).cast("long") - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    loud = 100 * capitals > CAPITALS * F.length(text)
    words = bind(F.array_remove(F.split(text, SPACE), ""), bits)
    return words + F.when(loud, 4).otherwise(0) + F.when(text.rlike(SIGNS), 8).otherwise(0)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``part`` (its ``lang``), ``failed`` (bits, A the lowest) and whether it is ``good`` or ``toxic``.

    A copy (E) is a row whose text a smaller ``doc_id`` has, wherever it stands; a null id is neither smaller nor larger
    than any.  Texts are compared by a hash of 256 bits, so only narrow rows are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = write_once(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        own_failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("copy")))
    copied = rows.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    one = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = lookup(lookup(rows, copied, ["copy"], "left"), one, ["doc_id"], "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    return rows.select(
        "part", (F.col("own") + copy).alias("failed"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def removal_games(found: DataFrame) -> DataFrame:
    """``part, failed`` with the number of all, good and toxic documents: 32 rows a part at most, summed before they are shuffled."""
    return found.groupBy("part", "failed").agg(
        F.count("*").alias("all"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))


def steps_of(game: pd.DataFrame) -> pd.DataFrame:
    """All steps of all orders of one part, out of its counts by set of failures."""
    counts = np.zeros((3, COALITIONS), np.int64)
    counts[:, game["failed"].to_numpy()] = game[["all", "good", "toxic"]].to_numpy(np.int64).T
    sets = np.arange(COALITIONS)
    worth = counts @ ((sets[:, None] & sets) != 0).astype(np.int64)  # of each coalition: documents that fail any of it
    rows, grand, total = [], COALITIONS - 1, int(counts[0].sum())
    shapley = order_sums(worth[0], len(FILTERS))
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone, good, toxic = (int(w[after] - w[before]) for w in worth)
            rows.append((
                game["part"].iloc[0], "".join(FILTERS[k] for k in order), step, total - int(worth[0, after]), gone,
                int(worth[0, 1 << i]) - gone, int(worth[0, grand] - worth[0, grand ^ 1 << i]), good, toxic, shapley[i]))
            before = after
    return pd.DataFrame(rows, columns=STEPS.names)


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step removes.

    ``docs`` has ``doc_id, text, lang``, ``labels`` has ``doc_id, quality, toxic``; other columns are not read.  A null text is
    empty, a null language is the part named by the empty string, a row without a label is neither good nor toxic, several
    labels of one id count by the greatest, repeated rows count each; an empty table has no parts and no rows.
    """
    return removal_games(failures(docs, labels)).groupBy("part").applyInPandas(steps_of, STEPS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


# Every order run over every document, filter by filter; no game.
ORACLE = f"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), first_id AS (
    SELECT text, min(doc_id) AS least FROM d GROUP BY text
), label AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), w AS (
    SELECT d.*, least, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
           coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM d JOIN first_id USING (text) LEFT JOIN label USING (doc_id)
), verdict AS (
    SELECT r, part, good, toxic,
           CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(words)) < {DIFFERENT} * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITALS} * length(text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(text, '{SIGNS}') THEN 'D' ELSE '' END
           || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS failed
    FROM w
), letter AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), ordering AS (
    SELECT x AS o FROM letter UNION ALL SELECT o || x FROM ordering JOIN letter ON NOT contains(o, x)
), step AS (
    SELECT o, i AS step, substr(o, i, 1) AS filter, substr(o, 1, i - 1) AS earlier
    FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS i FROM ordering WHERE length(o) = 5)
), one AS (
    SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM verdict GROUP BY part, failed
), ran AS (
    SELECT part, o, step, filter, n, good, toxic, failed, contains(failed, filter) AS fails,
           failed <> '' AND regexp_matches(failed, '[' || earlier || '_]') AS gone
    FROM one CROSS JOIN step
), counted AS (
    SELECT part, o, step, filter,
           sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = filter THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
    FROM ran GROUP BY part, o, step, filter
)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""
