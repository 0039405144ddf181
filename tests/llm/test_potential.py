"""The removal game against orders run one by one."""
from collections import defaultdict
from itertools import permutations
import re

import numpy as np

from almanac.llm import filter_potential as audit

LABELS = "doc_id long, quality int, toxic int"


def by_definition(rows, labels):
    """``rows``: (doc_id, text, lang)."""
    space = re.compile(r"[^\x20\x09-\x0D]+")
    verdicts = defaultdict(list)
    for doc_id, text, lang in rows:
        text = text or ""
        words, failed = space.findall(text), set()
        if len(words) < 100:
            failed.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            failed.add("C")
        if re.search(r"[#$%&*|]", text):
            failed.add("D")
        if doc_id is not None and any(other is not None and other < doc_id and (t or "") == text for other, t, _ in rows):
            failed.add("E")
        good = any(i == doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc_id and t == 1 for i, _, t in labels if i is not None)
        verdicts[lang or ""].append((failed, good, toxic))
    out = {}
    for part, docs in verdicts.items():
        sums = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                sums[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return out


def as_dict(df):
    rows = [tuple(r) for r in df.collect()]
    found = {r[:3]: list(r[3:]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_potential_of_a_known_game():
    """The glove game: one left glove, two right ones; the left one's holder gets two thirds."""
    worth = np.array([0, 0, 0, 1, 0, 1, 0, 1])  # players 0 (left), 1 and 2 (right)
    assert audit.order_sums(worth, 3) == [4, 1, 1]


def test_potential_sums_over_orders():
    rng = np.random.default_rng(2)
    worth = rng.integers(0, 50, 32)
    worth[0] = 0
    sums = [0] * 5
    for order in permutations(range(5)):
        s = 0
        for i in order:
            sums[i] += int(worth[s | 1 << i] - worth[s])
            s |= 1 << i
    assert audit.order_sums(worth, 5) == sums


def test_steps(spark):
    rng = np.random.default_rng(4)
    texts = ["", "A B C", "low words only", "a | b", "X" * 40, " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i % 9}" for i in range(120)),
             " ".join(f"w{i}" for i in range(120)) + " #", "é " * 130, "Ä ÖÜ", "one\x0btwo three four"]
    rows = [(int(rng.integers(0, 60)), texts[int(rng.integers(len(texts)))], ["en", "de", None, ""][int(rng.integers(4))]) for _ in range(150)]
    rows += [(None, "", "en"), (None, None, "xx"), (3, None, "en"), (70, None, None), (71, "", "fr")]
    labels = [(int(rng.integers(0, 60)), *(None if rng.random() < 0.2 else int(rng.integers(2)) for _ in "qt")) for _ in range(60)] + [(None, 1, 1), (70, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert as_dict(audit.audited(docs, spark.createDataFrame(labels, LABELS))) == by_definition(rows, labels)


def test_odd_rows(spark, odd, odd_rows, none):
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, 0), (8, None, 1)]
    found = as_dict(audit.audited(odd, spark.createDataFrame(labels, LABELS)))
    assert found == by_definition([r[:3] for r in odd_rows], labels)
    assert audit.audited(none, spark.createDataFrame([], LABELS)).count() == 0
    assert as_dict(audit.audited(odd, spark.createDataFrame([], LABELS))) == by_definition([r[:3] for r in odd_rows], [])
