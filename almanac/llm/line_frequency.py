"""Quality rules over words and over lines that a host repeats across its documents, in Spark functions only.

Lines are normalised and hashed, and the different documents of a host that have a line are counted.  Lines in
too many of them are boilerplate and removed; a document is rejected if too few of its words are left without them.
Copies of a text are one document there, so a document is not boilerplate because it was copied.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.functions.joins import lookup
from almanac.functions.text import bind
from almanac.llm import common
from almanac.plans.staging import write_once

SHARE = 0.1          # of a host's documents that may have a line
LEAST = 10           # documents that may have it in any case
MOST = 1000          # documents that may have it at most, however large the host
LEFT = 0.4           # of a document's words that must be left
MIN_WORDS = 50
MAX_REPEATED = 50    # percent of the words
WINDOW = 3           # words

SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three which the text has twice or more.

    Windows are sorted by hash, the places of those with an equal neighbour are kept in order, and each
    covers three words, or as many as there are up to the next.
    """
    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)

    def twice(windows: Column) -> Column:
        neighbours = F.zip_with(windows, F.slice(windows, 2, F.size(windows)), lambda a, b: F.struct(
            a["hash"].alias("hash"), a["at"].alias("at"), b["hash"].alias("next"), b["at"].alias("next_at")))
        pairs = F.filter(neighbours, lambda x: x["hash"] == x["next"])
        places = F.array_sort(F.array_distinct(F.concat(F.transform(pairs, lambda x: x["at"]), F.transform(pairs, lambda x: x["next_at"]))))
        return bind(places, covered)

    def hashed(found: Column) -> Column:
        numbered = F.transform(found, lambda word, i: F.struct(
            F.xxhash64(word, F.get(found, i + 1), F.get(found, i + 2)).alias("hash"), i.cast("long").alias("at")))
        return bind(F.sort_array(F.slice(numbered, 1, F.greatest(F.size(found) - (WINDOW - 1), F.lit(0)))), twice)

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(bind(words, hashed))


def lines_of(text: Column) -> Column:
    """Lines with a word, as they stand."""
    return F.filter(F.split(text, "\n"), lambda line: F.regexp_replace(line, SPACE, "") != "")


def normalised(line: Column) -> Column:
    """Lower case, single spaces, every digit a 0."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), r"[0-9]", "0"))


def base_counts(text: Column) -> dict[str, Column]:
    words = words_of(text)
    lines = lines_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def with_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the host, the counts, a hash of the text and the lines of every row; texts go no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(lines_of(text), lambda line: bind(normalised(line), lambda x: F.struct(
        F.xxhash64(x).alias("line"), F.size(words_of(x)).alias("words"))))
    return docs.select(
        "doc_id", F.xxhash64("source").alias("host"), F.xxhash64(text).alias("copy"),
        *[c.alias(n) for n, c in base_counts(text).items()], lines.alias("lines"))


def boilerplate(rows: DataFrame, share: float = SHARE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``host, copy, line, words``: the lines of each text that too many different texts of its host have, and their words.

    ``rows`` are stored ones of ``with_counts``.  Texts that are equal count once.  Too many are more than ``least`` and more than
    ``share`` of the host's texts or ``most``, whichever is less, so that the rule holds in hosts of any size.
    """
    one_of_each = rows.select("host", "copy", "lines").dropDuplicates(["host", "copy"])
    entries = one_of_each.select("host", "copy", F.explode("lines").alias("x")).groupBy("host", "copy", F.col("x.line").alias("line"))
    entries = write_once(entries.agg(F.sum("x.words").alias("words")))
    sizes = rows.groupBy("host", "copy").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("documents"))
    frequent = entries.groupBy("host", "line").agg(F.count("*").alias("having")).where(F.col("having") > least)
    limit = F.least(share * F.col("documents"), F.lit(float(most)))
    frequent = frequent.join(sizes, "host").where(F.col("having") > limit).select("host", "line")
    return lookup(entries, frequent, ["host", "line"])


def judged(docs: DataFrame, share: float = SHARE, least: int = LEAST, left: float = LEFT, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: its counts, whether they fail it, its words in boilerplate lines, the verdict.

    ``docs`` has ``doc_id, text, source``.  Lines are counted over all documents, of equal texts one; see ``boilerplate``.  A null or empty text has no words and
    fails, a null source is a host like any other, a null id stays null, rows that repeat get the same verdict each; other
    columns are not read; an empty table gives an empty one.  Texts are read once; what is shuffled are hashes.
    """
    rows = write_once(with_counts(docs))
    lost = boilerplate(rows, share, least, most).groupBy("host", "copy").agg(F.sum("words").alias("boilerplate_words"))
    removed = F.coalesce("boilerplate_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    depleted = (F.col("n_words") - removed) < left * F.col("n_words")
    names = list(base_counts(F.lit("")))
    return lookup(rows.select("doc_id", "host", "copy", *names), lost, ["host", "copy"], "left").select(
        "doc_id", *names, removed.alias("boilerplate_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def without_boilerplate(docs: DataFrame, share: float = SHARE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``; all rows and columns stay, and nothing else changes.

    Lines are those between line feeds; lines without a word stay.  Null and empty texts stay as they are, rows that repeat are
    changed alike.  The lines to remove are looked up by a text's host and hash, and a hot text is split; texts without any are not changed.
    """
    host, copy, gone = common.unused(docs, "host", "copy", "gone")
    found = boilerplate(write_once(with_counts(docs)), share, least, most)
    lines = found.groupBy("host", "copy").agg(F.collect_set("line").alias(gone))  # of one text, so no more than it has
    lines = lines.select(F.col("host").alias(host), F.col("copy").alias(copy), gone)
    keyed = docs.withColumns({host: F.xxhash64("source"), copy: F.xxhash64(F.coalesce("text", F.lit("")))})
    joined = lookup(keyed, lines, [host, copy], "left")
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains(gone, F.xxhash64(normalised(x))), F.lit(False)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


# The same over the tables in SQL; lines compare as text there, and as hashes above.
ORACLE = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT r, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS lines
    FROM d
), one AS (
    SELECT r, unnest(words) AS a, unnest(range(len(words))) AS i FROM w
), tri AS (
    SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM one WINDOW o AS (PARTITION BY r ORDER BY i)
), often AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1
), repeats AS (
    SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY r
), line AS (
    SELECT r, trim(regexp_replace(regexp_replace(lower(l), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS l
    FROM (SELECT r, unnest(lines) AS l FROM w)
), entry AS (
    SELECT host, text, r, l, len(string_split(l, ' ')) AS words FROM line JOIN d USING (r)
), size AS (
    SELECT host, count(DISTINCT text) AS documents FROM d GROUP BY host
), frequent AS (
    SELECT host, l FROM (SELECT host, l, count(DISTINCT text) AS having_it FROM entry GROUP BY host, l) JOIN size USING (host)
    WHERE having_it > {LEAST} AND having_it > least({SHARE} * documents, {MOST})
), lost AS (
    SELECT r, sum(words) AS n FROM entry JOIN frequent USING (host, l) GROUP BY r
), counted AS (
    SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS boilerplate_words
    FROM d JOIN w USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, boilerplate_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
           AND n_words - boilerplate_words >= {LEFT} * n_words AS kept
FROM counted
"""
