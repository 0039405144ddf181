"""Spelling variants against all pairs."""
from collections import Counter
import re
import zlib

import numpy as np
import pytest

from almanac.llm import spelling_variants as spelling


def near(a, b):
    """One inserted, deleted or replaced code point, by trying all of them."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_definition(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, around = {}, Counter()
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w, n in words.items():
        found = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        around[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, around[w], words.get(form[w])))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made_up(seed, documents):
    """Texts of a few words in many spellings, with capitals and letters beyond a to z."""
    rng = np.random.default_rng(seed)
    letters = "abcdeÉéßÿ×÷"
    base = ["".join(rng.choice(list(letters[:7]), int(rng.integers(6, 10)))) for _ in range(12)]
    out = []
    for i in range(documents):
        words = []
        for _ in range(60):
            w = base[min(int(rng.exponential(2)), 11)]
            for _ in range(int(rng.random() < 0.25) + int(rng.random() < 0.05)):
                k = int(rng.integers(len(w)))
                w = [w[:k] + w[k + 1:], w[:k] + str(rng.choice(list(letters))) + w[k:], w[:k] + str(rng.choice(list(letters))) + w[k + 1:]][int(rng.integers(3))]
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, " ".join(words) + (", " if i % 3 else "_3")))
    return out


@pytest.mark.parametrize("tile", [4, 2048])
def test_words_in_many_spellings(spark, tile):
    rows = made_up(1, 150)
    expected = by_definition(rows)
    assert any(r[1] != r[2] and r[1] is not None for r in expected) or any(r[1] for r in expected)
    assert sum(r[4] for r in expected) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(spelling.grouped(docs, tile=tile)) == expected


def test_chain_of_forms(spark):
    """A chain of four words, each five times as frequent as the one before."""
    words, n = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi"], 5
    rows = []
    for w in words:
        rows += [(len(rows) + k, w) for k in range(n)]
        n *= 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = by_definition(rows)
    assert {r[0]: r[2] for r in expected}["abcdef"] == words[-1]
    assert rows_of(spelling.grouped(docs)) == expected


def test_one_edit():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("ab"), int(rng.integers(1, 7)))) for _ in range(200)})
    for a in words:
        for b in words:
            if a != b and 0 <= len(b) - len(a) <= 1:
                assert spelling.one_edit(a, b) == near(a, b)


def test_stretches(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 10)
    text = "one twothreefourfive six, seveneightnineteneleven"
    assert "".join(spelling.stretches(text)) == text
    assert [r for s in spelling.stretches(text) for r in spelling.RUN.findall(s)] == spelling.RUN.findall(text)


def test_long_words(spark):
    """Counts too large for single precision, and words that only a long half tells apart."""
    long = "abc" * 4000
    rows = [(i, w) for i, w in enumerate([long] * 26 + [long[:-1] + "x"] * 5 + [long + "q"] * 5 + ["y" + long] * 5 + [long[::-1]] * 5)]
    assert rows_of(spelling.grouped(spark.createDataFrame(rows, "doc_id long, text string"))) == by_definition(rows)


def test_odd_rows(spark, odd, odd_rows, none):
    assert rows_of(spelling.grouped(odd)) == by_definition([r[:2] for r in odd_rows])
    assert spelling.grouped(none).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = by_definition(rows)
    assert rows_of(spelling.query(spark, sf_dir)) == expected and any(r[1] for r in expected)
