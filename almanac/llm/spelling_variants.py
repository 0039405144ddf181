"""Spelling variants: words one edit apart, found by products of letter-count blocks.

A word's letter counts are a vector.  One inserted or deleted letter puts two vectors at a squared distance of 1, one
replaced letter at 2, so words one edit apart are at most 2 apart, and their lengths differ by one at most.  Words meet
in blocks: those of two adjacent lengths that also share a half.  One edit leaves the first or the second half of the
shorter word as it is, so no pair is lost, and a block stays small however many words there are.  In a block one matrix
product (a Gram matrix of counts) gives the squared distances of a slice of words to all others; pairs of at most 2 are
kept, and the edit itself is verified.  Blocks of many words are cut into tiles, each pair of tiles worked on by itself.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.functions.joins import lookup
from almanac.llm import common
from almanac.plans.staging import write_once

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPOILT = 199          # one word in so many loses a letter
SHORTEST = 6          # code points
LEAST = 5             # occurrences
TIMES = 5             # the form occurs so many times as often
ENTRIES = 200_000     # words counted in a task before they are handed on
STRETCH = 1 << 20     # characters of a text looked at together
TILE = 2048           # words
SLICE = 256           # rows of a product

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
PAIRS_DDL = "word string, near string, near_n long"


def stretches(text: str) -> Iterator[str]:
    """The text in parts that no run of letters crosses."""
    start = 0
    while len(text) - start > STRETCH:
        end = start + STRETCH
        while end < len(text) and RUN.match(text, end):
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def spelt(doc_id: int | None, run: str, seed: int) -> str:
    """The word of a run: A to Z in lower case and, where the checksum of id and run says so, one letter less.

    ``seed`` is the checksum of the id and a colon.
    """
    word = run.lower() if run.isascii() else run.translate(LOWER)
    code = zlib.crc32(word.encode(), seed)
    if code % SPOILT == 0:
        at = code % len(word)
        return word[:at] + word[at + 1:]
    return word


def counted(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n`` of the words of ``shortest`` code points and ``least`` occurrences or more; a null id counts as an empty text."""
    def count(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches_in:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in stretches(text):
                    for run, n in Counter(RUN.findall(part)).items():
                        if len(run) >= shortest:
                            total[spelt(doc_id, run, seed)] += n
                    if len(total) > ENTRIES:
                        yield from common.batches(list(total.items()), COUNTS)
                        total.clear()
        yield from common.batches(list(total.items()), COUNTS)

    found = docs.select(docs["doc_id"], docs["text"]).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.char_length("word") >= shortest))


def halves(length: Column) -> tuple[Column, Column]:
    """Keys of the two blocks of a word among pairs whose shorter word has ``length``: what a single edit can leave as it is."""
    word, first = F.col("word"), F.floor(length / 2).cast("int")
    second = length - first
    return (F.concat(length.cast("string"), F.lit("<"), F.substring(word, 1, first)),
            F.concat(length.cast("string"), F.lit(">"), F.substring(word, F.char_length(word) - second + 1, second)))


def blocks(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Each word with its four blocks (``key``), and the pairs of tiles (``first``, ``second``) it takes part in there.

    ``tile`` words meet at most; a block that has more is cut by a hash of the word, and its words are repeated for each tile.
    """
    own = F.char_length("word")
    entries = words.select("word", "n", F.explode(F.array(*halves(own), *halves(own - 1))).alias("key"))
    large = entries.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > tile)
    tiles = F.coalesce(F.ceil(F.col("members") / tile), F.lit(1)).cast("int")
    entries = lookup(entries, large, ["key"], "left").withColumn("tiles", tiles)
    entries = entries.withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return entries.select(
        "key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "word", "n")


def one_edit(a: str, b: str) -> bool:
    """Whether two different words, ``b`` not the shorter and longer by one at most, differ by one code point."""
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)):] == b[at + 1:]


_PLACE = np.full(0x100, -1, np.int64)
_PLACE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def letter_counts(words: list[str]) -> np.ndarray:
    """A row for each word; counts are whole, and single precision holds their products unless a word is very long."""
    letters = _PLACE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(rows * len(LETTERS) + letters, minlength=len(words) * len(LETTERS))
    kind = np.float32 if max(map(len, words)) <= 2048 else np.float64
    return flat.reshape(len(words), len(LETTERS)).astype(kind)


def near_pairs(key: str, apart: bool, words: list[str], tiles: list[int]) -> Iterator[tuple[int, int]]:
    """Places of pairs one edit apart in a block, each once, the shorter word first.

    ``apart``: the block holds two tiles, and pairs within one tile belong to another.
    """
    length = int(re.match("[0-9]+", key)[0])
    shorter = np.array([len(w) == length for w in words])
    rows = np.flatnonzero(shorter)
    if not len(rows) or len(words) < 2:
        return
    counts = letter_counts(words)
    squares, half, tile = (counts * counts).sum(1), length // 2, np.array(tiles)
    second = key[len(str(length))] == ">"
    for start in range(0, len(rows), SLICE):
        some = rows[start:start + SLICE]
        distance = squares[some, None] + squares - 2 * (counts[some] @ counts.T)
        close = distance <= 2
        if apart:
            close &= tile[some, None] != tile
        for i, j in zip(*np.nonzero(close)):
            i = int(some[i])
            a, b = words[i], words[j]
            if shorter[j] and j <= i or second and a[:half] == b[:half]:
                continue  # the pair from its other word, or of the block of their first half
            if a != b and one_edit(a, b):
                yield i, int(j)


def links(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words one edit apart."""
    by = ["key", "first", "second"]

    def work(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in common.groups(batches_in, by):
            if group.num_rows > 1:
                found, n = group.column("word").to_pylist(), group.column("n").to_pylist()
                apart = group.column("first")[0].as_py() != group.column("second")[0].as_py()
                for i, j in near_pairs(group.column("key")[0].as_py(), apart, found, group.column("own").to_pylist()):
                    out += [(found[i], found[j], n[j]), (found[j], found[i], n[i])]
                    if len(out) >= 8192:
                        yield from common.batches(out, PAIRS)
                        out = []
        yield from common.batches(out, PAIRS)

    return blocks(words, tile).repartition(*by).sortWithinPartitions(*by).mapInArrow(work, PAIRS_DDL)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` out of ``word, form``: the end of each word's way, which doubles with every stored round.

    A form occurs several times as often as its word, so ways are short and have no circles.
    """
    ways = write_once(forms.select("word", F.col("form").alias("root")))
    while True:
        of = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = write_once(lookup(ways, of, ["root"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def grouped(docs: DataFrame, times: int = TIMES, tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that is long and frequent enough.

    The form of a word is the most frequent word one edit from it (of equals the smallest in code-point order), if that occurs
    ``times`` as often or more; the root is where following forms ends.  Null and empty texts have no words, a null id
    counts as the empty text in checksums, repeated rows count each, other columns are not read, and an empty table has no
    words.  Long texts are read in stretches and counts handed on in parts.  No word and no pair is left out.
    """
    words = write_once(counted(docs))
    best = F.struct(F.col("near_n"), F.col("near"))
    near = links(words, tile).groupBy("word", "near_n").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max_by(best, "near_n").alias("best"))
    joined = words.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("best.near_n") >= times * F.col("n"), F.lit(False)))
    found = write_once(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("is_form"), F.col("best.near")).alias("form"), F.when(F.col("is_form"), F.col("best.near_n")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(common.table(spark, sf_dir, "documents"))
