"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a text ends, for each of its prefixes, in one certain token.  A table that holds this last
token for every prefix is a whole encoding: walking back from the end yields the tokens.  A token may end a
prefix if it follows the last token of the prefix before it, and two tokens follow one another if encoding
their joined bytes gives back just these two.  Exactly one token per prefix passes.  So a table grows by any
bytes without looking back further than the longest token, and after an edit it is computed again from the
edit until it agrees with the old one over such a length.
"""
from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from almanac.llm import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PAIRS = 500_000    # remembered pairs of tokens
ENTRIES = 400_000  # remembered pieces of texts
LONG = 64          # characters; longer pieces are not remembered
STRETCH = 1 << 22  # characters of texts whose pieces are learnt together

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType(), False),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("decoded", T.BinaryType(), False),
])


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks out of a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes pieces of text, each on its own, by the last token of every prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._tokens_at = ahocorasick.Automaton()  # of bytes as Latin-1 characters
        for token, rank in ranks.items():
            self._tokens_at.add_word(token.decode("latin-1"), (len(token), rank))
        self._tokens_at.make_automaton()
        self._wide = max(self.bytes_of) + 1
        self._follows: dict[int, bool] = {}  # by left * _wide + right

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by its definition: join the neighbours of lowest rank, the first of equals, until none is left."""
        rank_of, none = self.ranks.get, self._wide
        parts = [piece[i:i + 1] for i in range(len(piece))]
        ranks = [rank_of(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (lowest := min(ranks)) < none:
            at = ranks.index(lowest)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left`` (-1: at the start)."""
        known = self._follows.get(left * self._wide + right)
        if known is None:
            if len(self._follows) >= PAIRS:
                self._follows.clear()
            if left < 0:
                known = self.merged(self.bytes_of[right]) == [right]
            else:
                joined = self.bytes_of[left] + self.bytes_of[right]
                known = joined not in self.ranks and self.merged(joined) == [left, right]
            self._follows[left * self._wide + right] = known
        return known

    def extend(self, piece: bytes, last: list[int], until=None) -> list[int]:
        """Carry a table of ``piece``'s first prefixes on to its end, or until ``until(last)`` holds.

        ``last[n]`` is the last token of the first n bytes, and ``last[0]`` is -1.
        """
        known, wide, n = self._follows, self._wide, len(last)
        start = max(0, n - self.longest)
        for end, (length, token) in self._tokens_at.iter(piece[start:].decode("latin-1")):
            if start + end + 1 == n:  # the first token that passes at an end is the only one
                before = last[n - length]
                ok = known.get(before * wide + token)
                if self.follows(before, token) if ok is None else ok:
                    last.append(token)
                    n += 1
                    if until is not None and until(last):
                        break
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        tokens, end = [], len(last) - 1
        while end > 0:
            tokens.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return tokens[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk_back(self.extend(piece, [-1]))

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """The encodings of pieces in sorted order.

        Each piece starts from the table of what it shares with the one before; a table holds one token a prefix, and the
        ids are spelt once, by walking back.
        """
        before, last = b"", [-1]
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                yield [whole]
                continue
            same, most = 0, min(len(before), len(piece))
            while same < most and before[same] == piece[same]:
                same += 1
            del last[same + 1:]
            yield self.walk_back(self.extend(piece, last))
            before = piece

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableEncoding:
    """A piece of text with its table, for appending and editing without encoding it all again."""

    def __init__(self, encoder: PrefixEncoder, piece: bytes = b""):
        self.encoder, self.piece = encoder, piece
        self.last = encoder.extend(piece, [-1])

    def append(self, more: bytes) -> None:
        self.piece += more
        self.encoder.extend(self.piece, self.last)

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Put ``by`` in place of the bytes from ``start`` to ``end``; the number of prefixes computed anew."""
        old, shift = self.last, len(by) - (end - start)
        self.piece = self.piece[:start] + by + self.piece[end:]
        settled, span = start + len(by), self.encoder.longest

        def agrees(last: list[int]) -> bool:
            n = len(last)
            return n - span > settled and last[-span:] == old[n - span - shift:n - shift]

        self.last = self.encoder.extend(self.piece, old[:start + 1], agrees)
        n = len(self.last)
        self.last += old[n - shift:]
        return n - start - 1

    def tokens(self) -> list[int]:
        return self.encoder.walk_back(self.last)


# Texts of these characters only are cut by the standard library's matcher, which is faster than that of the pattern.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_OTHER = re.compile(rf"[^\n\x20-\x7e{_LETTERS}]").search

_WORKERS: dict[tuple[str, str, int], "TextEncoder"] = {}


class TextEncoder:
    """Whole texts: the pattern's matches one by one, with the ids of known ones remembered, four bytes each, the low ones first.

    Long matches are worked out anew each time, so the memory of known ones is bounded by ``entries``.
    """

    def __init__(self, path: str, pattern: str, entries: int = ENTRIES):
        self.encoder = PrefixEncoder(read_ranks(path))
        self.entries = entries
        self.known: dict[str, bytes] = {}
        self._cut = regex.compile(pattern).findall
        plain = pattern.replace(r"^\s\p{L}\p{N}", rf"^\s0-9{_LETTERS}").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")
        self._cut_plain = None if r"\p" in plain else re.compile(plain).findall

    @classmethod
    def of_worker(cls, path: str, pattern: str, entries: int = ENTRIES) -> "TextEncoder":
        """One per worker process, as reading the ranks takes longer than encoding many texts."""
        if (path, pattern, entries) not in _WORKERS:
            _WORKERS[path, pattern, entries] = cls(path, pattern, entries)
        return _WORKERS[path, pattern, entries]

    def cut(self, text: str) -> list[str]:
        """The matches of the pattern."""
        return self._cut(text) if self._cut_plain is None or _OTHER(text) else self._cut_plain(text)

    def learn(self, pieces: set[str]) -> list[str]:
        """Remember pieces; the long ones among the new are returned, to be forgotten after their texts."""
        if len(self.known) > self.entries:  # what the texts at hand use stays, and so does what is frequent
            self.known = {p: self.known[p] for p in pieces.intersection(self.known)}
        new = sorted((p.encode(), p) for p in pieces.difference(self.known))
        for (_, piece), ids in zip(new, self.encoder.encode_sorted([p for p, _ in new])):
            self.known[piece] = array("i", ids).tobytes()
        return [p for _, p in new if len(p) > LONG]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, four bytes each.

        New pieces are learnt for a stretch of texts at once: sorted, more of them start like the one before.
        """
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= STRETCH):
                size += len(texts[end])
                end += 1
            cut = [self.cut(text) for text in texts[start:end]]
            long = self.learn(set().union(*cut))
            for pieces in cut:
                yield b"".join(map(self.known.__getitem__, pieces))
            for piece in long:
                del self.known[piece]
            start = end

    def ids_and_bytes(self, text: str) -> tuple[bytes, bytes]:
        (ids,) = self.encode_all([text])
        return ids, self.decoded(ids)

    def decoded(self, ids: bytes) -> bytes:
        return self.encoder.decode(np.frombuffer(ids, np.int32).tolist())

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(str, np.frombuffer(self.ids_and_bytes(text)[0], np.int32).tolist()))

    def decode(self, ids: str) -> bytes:
        return self.encoder.decode(list(map(int, ids.split(",")))) if ids else b""


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of tokens, the ids and the bytes that they decode to, of every row.

    One pass without a shuffle; ``path`` must be readable on all executors.  A null or empty text has no
    tokens and decodes to no bytes; a null ``doc_id`` stays null; repeated rows are repeated.
    Other columns are not read.
    """
    def encode(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextEncoder.of_worker(path, pattern)
        for batch in batches_in:
            found = list(coder.encode_all(common.texts(batch)))
            ends = np.cumsum([0] + [len(ids) >> 2 for ids in found])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            decoded = pa.array(map(coder.decoded, found), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), ids, decoded], names=SCHEMA.names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(encode, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encoded(common.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    spelt = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", "n_tokens", F.sha2(spelt, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
