"""Packing documents into training sequences, in their order, with cuts chosen by dynamic programming.

Within a partition the documents form one line of tokens.  It is cut into windows of at most ``window``
tokens; a window costs its padding, a fixed amount, and a penalty for where it ends: nothing at the end of a
document, little at the end of a sentence, more elsewhere.  With ``f(p)`` the least cost of a line up to
boundary p, ``f(p) = min over o in [p - window, p) of f(o) + o  + window - p + fixed + penalty(p)``: the
minimum of ``f(o) + o`` over a sliding range, which a monotone queue keeps.  Windows whose length is a power of two need
no padding and are further transitions.
"""
from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from almanac.llm import common

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048
WINDOW_COST = 32.0     # of any window, in tokens of padding: keeps windows from being cut small
SENTENCE_PENALTY = 2.0
WORD_PENALTY = 16.0    # of a cut at neither a document's nor a sentence's end
LONGEST_STEP = 32      # tokens without a boundary before one is put between them
BLOCK = 1 << 17        # tokens planned at once
LARGE_CACHE = 400_000  # words a worker remembers where no other stage has used its memory before

# Fixed value: the pattern that the vocabulary splits by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SENTENCE_STOPS = (".", "!", "?")  # before a space; line feeds end sentences too

SCHEMA = T.StructType([T.StructField(n, T.BinaryType() if n == "ids" else T.LongType(), n == "doc_id") for n in (
    "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])
ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in SCHEMA.names])


class Words(dict):
    """The ids of words, found out when first asked for."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.find = find

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.find(word)
        return found


class WordTokens:
    """Ids of whole texts out of remembered words.

    The vocabulary's pattern never reaches across white space, so texts are cut at spaces and line feeds, and
    only words not seen before are encoded.  Words of Latin-1 characters, which no normal form changes, are
    cut by the pattern here and only merged by the tokenizer; all others go through the whole of it.
    """

    def __init__(self, path: str, entries: int = common.CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merge = self.tokenizer.model.tokenize
        self.entries = entries  # remembered, at most
        self.words = Words(self.word)
        self.pieces = Words(self.piece)
        self.letters = re.compile(r"([a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+)([.,]?)\Z").match
        self.cut = regex.compile(PATTERN).findall
        self.other_space = re.compile(r"[\s\x00-\x20\x7f-\xa0\xad]").search
        self.as_bytes = _byte_characters()

    def piece(self, piece: str) -> bytes:
        found = [token.id for token in self.merge(piece if piece.isascii() else piece.translate(self.as_bytes))]
        return struct.pack(f"<{len(found)}I", *found)

    def word(self, word: str) -> bytes:
        """The ids of a word without spaces and line feeds."""
        lower = word.lower()
        if simple := self.letters(lower):
            letters, stop = simple.groups()
            return self.pieces[letters] + self.pieces[stop] if stop else self.pieces[letters]
        if max(word) > "\xff" or self.other_space(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.cut(lower)))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the numbers of ids at which sentences end (the text's end among them)."""
        if len(self.words) > self.entries:
            self.words = Words(self.word)
        if len(self.pieces) > self.entries:
            self.pieces = Words(self.piece)
        for stop in SENTENCE_STOPS:
            text = text.replace(stop + " ", stop + "\n")
        known = self.words.__getitem__
        parts = [b"".join(map(known, sentence.split(" "))) for sentence in text.split("\n")]
        return np.frombuffer(b"".join(parts), "<u4"), np.cumsum([len(p) >> 2 for p in parts])


def _byte_characters() -> dict[int, str]:
    """For each Latin-1 character, the characters by which byte-level vocabularies write its UTF-8 bytes.

    Printable bytes stand for themselves, the others, in order, for the characters from U+0100.
    """
    printable = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    shown = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}


@lru_cache(maxsize=1)
def _of_worker(path: str, entries: int) -> WordTokens:
    return WordTokens(path, entries)


def cuts(positions: np.ndarray, penalties: np.ndarray, window: int, at_end: bool) -> list[int]:
    """Ends of the windows over boundaries at rising ``positions`` (the first is the start of the line).

    ``at_end``: the last window ends at the last boundary; else where the cost is least within the last
    ``window`` tokens, and the smaller powers of two are left out.  No two neighbouring boundaries are further apart than ``window``.
    """
    where, penalty = positions.tolist(), penalties.tolist()
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window and (at_end or 1 << k >= window >> 3)]
    exact = _at_distances(positions, powers)
    cost, origin = [0.0], [0]
    queue: deque[tuple[float, int]] = deque([(float(where[0]), 0)])  # rising f(o) + o, rising o
    for j in range(1, len(where)):
        p = where[j]
        while where[queue[0][1]] < p - window:
            queue.popleft()
        least, best = queue[0]
        least += window - p
        if j in exact:
            for i in exact[j]:
                if cost[i] < least:
                    least, best = cost[i], i
        least += WINDOW_COST + penalty[j]
        cost.append(least)
        origin.append(best)
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    if at_end:
        j = len(where) - 1
    else:
        j = min((i for i in range(1, len(where)) if where[i] >= where[-1] - window), key=lambda i: (cost[i], -i), default=0)
    ends = []
    while j > 0:
        ends.append(where[j])
        j = origin[j]
    return ends[::-1]


def _at_distances(positions: np.ndarray, distances: list[int]) -> dict[int, list[int]]:
    """By boundary, the boundaries that lie exactly one of the ``distances`` before it, nearest first."""
    found: dict[int, list[int]] = {}
    for distance in distances:
        before = np.searchsorted(positions, positions - distance)
        for j in np.flatnonzero(positions[before] == positions - distance).tolist():
            found.setdefault(j, []).append(int(before[j]))
    return found


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int, window: int, at_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window may end, with their penalties.

    Besides the ends of documents and sentences there is one every so many tokens of a long sentence, and,
    at the end of the line, those that leave a sum of two powers of two, so that the rest need not be padded.
    """
    natural = np.unique(np.concatenate([[0], doc_ends, sentence_ends, [length]]))
    step = min(LONGEST_STEP, window)
    gaps = np.diff(natural)
    long = np.flatnonzero(gaps > step)
    between = [np.arange(natural[i] + step, natural[i + 1], step) for i in long]
    if at_end:
        powers = np.array([0] + [1 << k for k in range(window.bit_length())])
        rest = length - (powers[:, None] + powers[None, :]).ravel()
        between.append(rest[rest > 0])
    positions = np.unique(np.concatenate([natural, *between])).astype(np.int64)
    penalties = np.where(np.isin(positions, doc_ends), 0.0, np.where(np.isin(positions, sentence_ends), SENTENCE_PENALTY, WORD_PENALTY))
    return positions, penalties


class Packer:
    """Takes documents in order and gives out pieces once their windows are settled."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.docs: list[list] = []  # id, ids, starts of its ids in the line, ids already given out
        self.length = 0
        self.doc_ends: list[int] = []
        self.sentence_ends: list[np.ndarray] = []

    def add(self, doc_id, ids: np.ndarray, sentence_ends: np.ndarray) -> None:
        self.docs.append([doc_id, ids, self.length, 0])
        self.sentence_ends.append(sentence_ends + self.length)
        self.length += len(ids)
        self.doc_ends.append(self.length)

    def settle(self, at_end: bool) -> list[tuple]:
        """Pieces of all windows that are certain; the rest of the line stays."""
        if not self.length:
            return []
        sentences = np.concatenate(self.sentence_ends)
        positions, penalties = boundaries(np.array(self.doc_ends), sentences, self.length, self.window, at_end)
        ends = cuts(positions, penalties, self.window, at_end)
        pieces, kept, at = [], 0, 0
        for end in ends:
            offset = 0
            while at < end:
                doc_id, ids, start, before = self.docs[kept]
                stop = min(end, start + len(ids))
                part = ids[at - start:stop - start]
                pieces.append((doc_id, before + at - start, len(part), part.tobytes(), before + len(ids), self.sequence, offset))
                offset += len(part)
                at = stop
                if at == start + len(ids):
                    kept += 1
            self.sequence += 1
        rest = []
        for doc_id, ids, start, before in self.docs[kept:]:
            done = max(0, at - start)
            rest.append([doc_id, ids[done:], start + done - at, before + done])
        self.docs, self.length = rest, self.length - at
        self.doc_ends = [end - at for end in self.doc_ends[kept:]]
        left = sentences[sentences > at] - at
        self.sentence_ends = [left]
        return pieces


def packed(docs: DataFrame, tokens: Callable[[], Callable], window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents with their ``ids``, four bytes each, the low ones first, and their places in sequences of at most ``window`` tokens.

    One pass without a shuffle: each partition is packed on its own, in the order of its rows, a stretch of
    tokens at a time, so memory is bounded by the stretch and the longest text.  ``tokens`` makes the
    function from a text to its ids and the ends of its sentences, once per task.  Ids of sequences are
    unique: the partition's number, then a running number.  A null or empty text is the end id alone; a
    null ``doc_id`` stays null; repeated rows are packed each; an empty table has no pieces; other columns
    are not read.  A lost task is packed anew from the same rows: give it a stored table, not one whose order of rows
    depends on a shuffle.
    """
    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens()
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for batch in rows:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
                ids, ends = encode(text)
                packer.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4"), ends)
                if packer.length >= BLOCK:
                    yield from common.batches(packer.settle(False), ARROW)
        yield from common.batches(packer.settle(True), ARROW)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(pack, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(common.table(spark, sf_dir, "documents"), LARGE_CACHE).drop("ids")


def pieces(docs: DataFrame, entries: int = common.CACHE_ENTRIES) -> DataFrame:
    """``packed`` with the production vocabulary, and a check sum of each piece's ids."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    found = packed(docs, lambda: _of_worker(path, entries))
    return found.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
