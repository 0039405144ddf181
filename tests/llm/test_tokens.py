"""Packing and byte-level BPE against the tokenizers' own libraries."""
import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from almanac.llm import packing, prefix_bpe

CODER = prefix_bpe.TextEncoder(P.path(prefix_bpe.VOCABULARY), P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODER.encoder.ranks, special_tokens={})
WORDS = packing.WordTokens(P.path(packing.VOCABULARY))
WHOLE = Tokenizer.from_file(P.path(packing.VOCABULARY))
WHOLE.encode_special_tokens = True
TEXTS = st.text(st.sampled_from(list("abtheüß 'sé1٣\n\t .,!=日😀\x1c\x85\xa0Σς-")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoding_is_the_librarys(text):
    ids = CODER.encode(text)
    assert ids == ",".join(map(str, THEIRS.encode_ordinary(text)))
    assert CODER.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 10), st.binary(max_size=8))
def test_edits_and_appends_are_exact(piece, start, length, by):
    encoder = CODER.encoder
    start = min(start, len(piece))
    end = min(start + length, len(piece))
    editable = prefix_bpe.EditableEncoding(encoder, piece)
    editable.replace(start, end, by)
    editable.append(b"the end")
    want = piece[:start] + by + piece[end:] + b"the end"
    assert editable.piece == want and editable.tokens() == encoder.walk_back(encoder.extend(want, [-1]))


def test_an_edit_is_local():
    editable = prefix_bpe.EditableEncoding(CODER.encoder, b"something longer than that " * 40)
    assert editable.replace(500, 503, b"xyz") < 120


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_word_tokens_are_the_librarys(text):
    assert WORDS(text)[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_special_strings_are_ordinary_text():
    text = "a <|endoftext|> b<|startoftext|>"
    assert WORDS(text)[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def brute_cost(positions, penalties, window):
    cost = [0.0]
    for j in range(1, len(positions)):
        options = []
        for i in range(j):
            length = positions[j] - positions[i]
            if length <= window:
                options.append(cost[i] + (0 if length & (length - 1) == 0 else window - length))
        cost.append(min(options) + packing.WINDOW_COST + penalties[j])
    return cost[-1]


def test_cuts_are_the_cheapest():
    r = random.Random(5)
    for _ in range(60):
        positions = np.array(sorted({0, *(r.randint(1, 200) for _ in range(40))}))
        positions = np.unique(np.concatenate([positions, np.arange(0, 200, 16)]))
        penalties = np.array([r.choice([0.0, 2.0, 16.0]) for _ in positions])
        ends = packing.cuts(positions, penalties, 32, True)
        of = dict(zip(positions.tolist(), penalties))
        total, before = 0.0, 0
        for end in ends:
            length = end - before
            assert 0 < length <= 32
            total += packing.WINDOW_COST + of[end] + (0 if length & (length - 1) == 0 else 32 - length)
            before = end
        assert before == positions[-1] and abs(total - brute_cost(positions.tolist(), penalties.tolist(), 32)) < 1e-6


def check_pieces(rows, texts):
    """Every id of every document in one piece; sequences without gaps and not too long; little padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append(row)
    for doc_id, text in texts.items():
        ids = np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for row in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert row["start"] == at and row["doc_tokens"] == len(ids)
            assert row["ids_crc32"] == zlib.crc32(ids[at:at + row["length"]].tobytes())
            at += row["length"]
        assert at == len(ids)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for row in sorted(own, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= packing.WINDOW
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding / max(total, 1)


def test_packed_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert check_pieces(packing.query(spark, sf_dir).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}) < 0.02


def test_ids_are_given_out(odd, odd_rows, spark, sf_dir):
    texts = {r[0]: r[1] or "" for r in odd_rows if r[0] not in (8, None)}
    ids = defaultdict(bytes)
    for row in sorted(packing.pieces(odd).collect(), key=lambda r: r["start"]):
        ids[row["doc_id"]] += row["ids"]
    found = {r["doc_id"]: r for r in prefix_bpe.encoded(odd, P.path(prefix_bpe.VOCABULARY), P.PATTERN).collect()}
    for doc_id, text in texts.items():
        assert np.frombuffer(ids[doc_id], "<u4").tolist() == [*WHOLE.encode(text, add_special_tokens=False).ids, 1]
        assert found[doc_id]["ids"] == THEIRS.encode_ordinary(text) and bytes(found[doc_id]["decoded"]) == text.encode()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in prefix_bpe.query(spark, sf_dir).collect():
        spelt = ",".join(map(str, THEIRS.encode_ordinary(texts[row["doc_id"]])))
        assert row["ids_sha256"] == hashlib.sha256(spelt.encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_odd_rows(odd, odd_rows, none):
    rows = packing.pieces(odd).collect()
    by_id = {r[0]: r[1] for r in odd_rows if r[0] not in (8, None)}
    check_pieces(rows, by_id)
    assert {r["doc_id"] for r in rows} == {r[0] for r in odd_rows}
    assert [r["length"] for r in rows if r["doc_id"] == 1] == [1]
    found = prefix_bpe.encoded(odd, P.path(prefix_bpe.VOCABULARY), P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == sorted((r[0] or 0, len(THEIRS.encode_ordinary(r[1] or ""))) for r in odd_rows)
    assert packing.pieces(none).count() == 0
    assert prefix_bpe.encoded(none, P.path(prefix_bpe.VOCABULARY), P.PATTERN).count() == 0


def test_long_words_take_memory_in_proportion():
    """A word without spaces: some fifty bytes for each of its characters, nothing of it kept, and the library's ids."""
    rng = random.Random(1)
    coder = prefix_bpe.TextEncoder(P.path(prefix_bpe.VOCABULARY), P.PATTERN)
    for size, letters in ((300_000, "abcdefghijklmnopqrstuvwxyz"), (20_000, "日本語文字列")):
        word = "".join(rng.choice(letters) for _ in range(size))
        tracemalloc.start()
        ids, decoded = coder.ids_and_bytes(word)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 * len(word.encode()) + 2e7 and decoded == word.encode()
        if size < 100_000:
            assert np.frombuffer(ids, np.int32).tolist() == THEIRS.encode_ordinary(word)
        assert not coder.known
    coder = prefix_bpe.TextEncoder(P.path(prefix_bpe.VOCABULARY), P.PATTERN, entries=3)
    text = "some words and  some more, of which " + "long" * 50 + " are not kept; " * 3
    assert coder.encode(text) == ",".join(map(str, THEIRS.encode_ordinary(text)))
