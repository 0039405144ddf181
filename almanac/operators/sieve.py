"""Leaving rows out before a join that they cannot match, without moving them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.joins import unused

LEAST_BITS = 1 << 16
MOST_BITS = 1 << 26     # 8 MB of bits; as a table of 64-bit words, which is broadcast, at most some 32 MB
BITS_PER_KEY = 32       # a row without a match passes once in so many cases, until the sieve is full


def marked(rows: DataFrame, wanted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a boolean column: false only where no row of ``wanted`` has the same ``keys``; few others are true.

    The keys of ``wanted`` are hashed into a table of bits, of a size that fits their number but has a bound, and the table is
    broadcast; ``rows`` are neither shuffled nor sorted.  With more than some millions of keys more rows are marked, so
    an exact join has to follow in any case.  ``wanted`` is read twice: let it be a stored table.
    """
    count, bits = wanted.count(), LEAST_BITS
    while bits < min(count * BITS_PER_KEY, MOST_BITS):
        bits *= 2
    at, word, held = unused([*rows.columns, name], "at", "word", "bits")

    def place() -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast(rows.schema[k].dataType) for k in keys]), F.lit(bits))

    def bit(of: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (of % 64).cast("int"))

    def word_of(of: Column) -> Column:
        return F.floor(of / 64).cast("int")

    words = wanted.select(word_of(place()).alias(word), bit(place()).alias(held)).groupBy(word).agg(F.bit_or(held).alias(held))
    here = rows.withColumn(at, place()).withColumn(word, word_of(F.col(at))).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.col(held).bitwiseAND(bit(F.col(at))) != 0, F.lit(False))
    return here.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias(name))


def passing(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` may be among those of ``wanted``: all that are, and a few others.  See ``marked``."""
    (name,) = unused(rows.columns, "passes")
    return marked(rows, wanted, keys, name).filter(name).drop(name)
