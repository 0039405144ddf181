"""Personal data by a semi-Markov conditional random field next to fixed patterns.

Fixed patterns find plain addresses and numbers.  In between, text near digits, ``@``, ``=`` or quotes is cut
into atoms (runs of letters and digits, single signs), and a segmentation into single atoms and entities of a
bounded number of atoms is chosen; what stands between quotes after ``=`` may be one of any number of atoms.  A
segment is scored as a whole: its digits, signs, check sum, and what stands around it.  Dynamic programming over the ends of segments gives the best segmentation, boundaries and
types together, and, while learning, the sum over all of them.  It learns from the patterns' own spans, from those with a
sign left out, and from a seed pattern for secrets, whose values it also sees spelt in letters only and with signs, and
in letters after a name of no secret, so it finds what the patterns miss by little.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from almanac.llm import common

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
SAMPLE = 4_000        # documents that zones for learning are taken from, at most
ZONES = 600           # learnt from, at most
MOST_ATOMS = 14       # of an entity
MOST_CHARS = 96       # of an entity
EPOCHS = 40
RATE = 0.3
RIDGE = 1e-3
MARGIN = 1.0          # by which an entity must beat its atoms standing alone

EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"\b(?:token|key|secret|password)\s{0,3}=\s{0,3}\"([^\"\s]{8,80})\"", re.I)
SECRET_NAME = re.compile(r"(?:token|key|secret|password)\s{0,3}=\s{0,3}\"$", re.I)
QUOTED = re.compile(r"=\s{0,3}\"([^\"\s]{8,80})\"")
ATOM = re.compile(r"[^\W_]+|[^\w\s]|_")
TRIGGER = re.compile(r"[0-9@=\"]")
HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, ``@`` and a domain with a dot, found from each ``@``, as one without would cost much."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind; matches that fail their check are dropped."""
    spans = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            spans.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def zones(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Stretches of words near a trigger, none of them within a span, in order."""
    found: list[list[int]] = []
    at, n = 0, len(text)
    blocked = [[a, b] for a, b, _ in spans]
    merged: list[list[int]] = []
    for a, b in blocked:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    gaps, free = [], 0
    for a, b in [*merged, [n, n]]:
        if a > free:
            gaps.append((free, a))
        free = b
    for low, high in gaps:
        at = low
        while m := TRIGGER.search(text, at, high):
            start = max(low, text.rfind("\n", low, m.start()) + 1, m.start() - 40)
            space = text.find(" ", start, m.start())
            if start > low and start == m.start() - 40 and space >= 0:
                start = space + 1
            if found and found[-1][1] >= start and found[-1][0] >= low:
                start = found.pop()[0]
            end = m.end()
            while nearby := TRIGGER.search(text, end, min(high, end + 24)):
                end = nearby.end()
            line = text.find("\n", end, min(high, end + 24))
            end = line if line >= 0 else min(high, end + 24)
            for quoted in QUOTED.finditer(text, start, min(high, end + 88)):  # a quoted value is not cut
                if quoted.start() < end < quoted.end():
                    end = quoted.end()
            found.append([start, end])
            at = end
    return [(a, b) for a, b in found]


FEATURES = [
    "always", "no digit", "1-6 digits", "7-9 digits", "10-13 digits", "14-15 digits", "16 digits", "17-19 digits", "more digits",
    "letters", "only letters", "@", "dot after @", "three dots", "numbers to 255", "plus", "brackets", "check sum", "hex", "=",
    "opening quote before", "closing quote after", "= before", "space", "one atom", "letter or digit before", "letter or digit after",
    "@ before or after", "other signs", "short groups", "name of a secret before",
]


def segment_features(text: str, start: int, end: int, atoms: int) -> list[float]:
    """What a whole segment looks like, and what stands around it."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    n, letters = len(digits), sum(c.isalpha() for c in span)
    dots, parts = span.count("."), span.split(".")
    before, after = text[max(0, start - 3):start], text[end:end + 1]
    at = span.find("@")
    groups = re.findall("[0-9]+", span)
    return [
        1.0, n == 0, 1 <= n <= 6, 7 <= n <= 9, 10 <= n <= 13, 14 <= n <= 15, n == 16, 17 <= n <= 19, n > 19,
        letters > 0, letters > 0 and n == 0, span.count("@") == 1, at > 0 and "." in span[at:], dots == 3 and at < 0,
        len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts), span[0] == "+", "(" in span and ")" in span,
        n >= 14 and letters == 0 and luhn(digits), bool(HEX.fullmatch(span)), "=" in span,
        before.endswith('"'), after == '"', before.rstrip(' "').endswith("="), " " in span, atoms == 1,
        before[-1:].isalnum(), after.isalnum(), before.endswith("@") or after == "@",
        sum(not (c.isalnum() or c in " ().-@+_%") for c in span) > 0, len(groups) > 1 and max(map(len, groups)) <= 4,
        before.endswith('"') and bool(SECRET_NAME.search(text, max(0, start - 16), start)),
    ]


def segments(text: str, low: int, high: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Atoms of a zone, and the segments (first and last atom) that may be entities."""
    atoms = [(m.start(), m.end()) for m in ATOM.finditer(text, low, high)]
    starts, stops = {a: i for i, (a, _) in enumerate(atoms)}, {b: j for j, (_, b) in enumerate(atoms)}
    # between quotes after "=" anything may be an entity, whatever its signs and their number
    quoted = dict.fromkeys((starts[m.start(1)], stops[m.end(1)]) for m in QUOTED.finditer(text, low, high))
    found = []
    for i, (start, stop) in enumerate(atoms):
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        told = False
        for j in range(i, min(len(atoms), i + MOST_ATOMS)):
            a, b = atoms[j]
            if b - start > MOST_CHARS or (j > i and "\n" in text[atoms[j - 1][1]:a]):
                break
            told = told or any(c.isdigit() or c == "@" for c in text[a:b])
            if told and (text[a].isalnum()):
                found.append((i, j))
                quoted.pop((i, j), None)
    return atoms, [*found, *quoted]


@dataclass
class SpanModel:
    weights: np.ndarray  # features by kinds

    def decode(self, text: str, low: int, high: int) -> list[Span]:
        """The best segmentation of a zone: its entities."""
        atoms, found = segments(text, low, high)
        if not found:
            return []
        x = np.array([segment_features(text, atoms[i][0], atoms[j][1], j - i + 1) for i, j in found], float)
        scores = x @ self.weights - MARGIN
        kinds = scores.argmax(1)
        best = [0.0] + [0.0] * len(atoms)
        back: list[tuple[int, int] | None] = [None] * (len(atoms) + 1)
        ending: dict[int, list[int]] = {}
        for s, (i, j) in enumerate(found):
            if scores[s, kinds[s]] > 0:
                ending.setdefault(j, []).append(s)
        for j in range(len(atoms)):
            best[j + 1], back[j + 1] = best[j], None
            for s in ending.get(j, ()):
                value = best[found[s][0]] + scores[s, kinds[s]]
                if value > best[j + 1]:
                    best[j + 1], back[j + 1] = value, (found[s][0], int(kinds[s]))
        spans, j = [], len(atoms)
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                spans.append((atoms[i][0], atoms[j - 1][1], kind))
                j = i
        return spans[::-1]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans in order, of a whole text."""
        if not TRIGGER.search(text):
            return [], []
        base = base_spans(text)
        added = [s for low, high in zones(text, base) for s in self.decode(text, low, high)]
        return base, sorted([*base, *added], key=lambda s: (s[0], s[2], s[1]))


def examples(text: str) -> list[tuple[str, list[Span]]]:
    """Lines around known spans, with these; again with a sign left out that the patterns need."""
    known = base_spans(text) + [(*m.span(1), 4) for m in SECRET.finditer(text)]
    out = []
    for start, end, kind in known:
        low, high = max(0, start - 48), min(len(text), end + 32)
        inside = [(a - low, b - low, k) for a, b, k in known if a >= low and b <= high]
        if all(b <= c or d <= a for a, b, _ in inside for c, d, _ in inside if (a, b) != (c, d)) and len(set(inside)) == len(inside):
            out.append((text[low:high], inside))
        if kind == 3 and text[start] == "+":
            out.append((text[low:start] + text[start + 1:high], [(start - low, end - low - 1, 3)]))
        if kind == 4:
            letters = text[start:end].translate(_LETTERS)
            signs = text[start:end - 4] + "/+=="
            name = re.search(r"\w+\s{0,3}=\s{0,3}\"$", text[low:start])
            for spelling in (letters, signs):
                out.append((name.group() + spelling + '"', [(len(name.group()), len(name.group()) + len(spelling), 4)]))
            out.append((f'name = "{letters}"', []))
    return out


_LETTERS = str.maketrans("0123456789", "ghijklmnop")


def learn(found: list[tuple[str, list[Span]]]) -> SpanModel:
    """Weights by gradient ascent on the likelihood of the known segmentations, summed over all others by the forward and backward sums.

    Nothing to learn from gives weights that find nothing.
    """
    zones_of, rows, golds = [], [], []
    for text, spans in found:
        atoms, candidates = segments(text, 0, len(text))
        place = {(atoms[i][0], atoms[j][1]): s for s, (i, j) in enumerate(candidates)}
        gold = [(place[a, b], k) for a, b, k in spans if (a, b) in place]
        if candidates:
            zones_of.append((len(rows), len(atoms), candidates))
            golds.append([(len(rows) + s, k) for s, k in gold])
            rows.extend(segment_features(text, atoms[i][0], atoms[j][1], j - i + 1) for i, j in candidates)
    weights = np.zeros((len(FEATURES), len(KINDS)))
    weights[0] = -4.0
    if not rows:
        return SpanModel(weights)
    x = np.array(rows, float)
    gold = np.zeros((len(x), len(KINDS)))
    for own in golds:
        for s, k in own:
            gold[s, k] = 1
    moment, square = np.zeros_like(weights), np.zeros_like(weights)
    for epoch in range(1, EPOCHS + 1):
        scores = x @ weights
        total = np.logaddexp.reduce(scores, axis=1).tolist()
        chance = np.zeros(len(x))
        for base, n, candidates in zones_of:
            forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            forward[0] = backward[n] = 0.0
            ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            starts: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            for s, (i, j) in enumerate(candidates):
                ends[j + 1].append((i, total[base + s]))
                starts[i].append((j + 1, total[base + s]))
            for j in range(1, n + 1):
                terms = [forward[j - 1]] + [forward[i] + v for i, v in ends[j]]
                top = max(terms)
                forward[j] = top + np.log(sum(np.exp(np.array(terms) - top)))
            for i in range(n - 1, -1, -1):
                terms = [backward[i + 1]] + [backward[j] + v for j, v in starts[i]]
                top = max(terms)
                backward[i] = top + np.log(sum(np.exp(np.array(terms) - top)))
            i, j = np.array(candidates).T
            chance[base:base + len(candidates)] = np.exp(forward[i] + backward[j + 1] + np.array(total[base:base + len(candidates)]) - forward[n])
        expected = np.exp(scores - np.array(total)[:, None]) * chance[:, None]
        gradient = x.T @ (gold - expected) / len(zones_of) - RIDGE * weights
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weights = weights + RATE * (moment / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.99**epoch)) + 1e-8)
    return SpanModel(weights)


def fit(docs: DataFrame) -> SpanModel:
    """Learn from the lines around known spans in at most ``SAMPLE`` documents; at most ``ZONES`` such lines go to the driver."""
    near = F.col("text").rlike(r"[0-9]\.[0-9]|@|\+[0-9]|= ?\"|[0-9]{4}") & F.col("doc_id").isNotNull()
    chosen = docs.where(near).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(line, [list(s) for s in spans]) for text in common.texts(batch) for line, spans in examples(text)]
            yield from common.batches(rows, pa.schema([("line", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]))

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(lines, "line string, spans array<array<long>>")
    found = found.orderBy(F.xxhash64("line"), "line").limit(ZONES).collect()
    return learn([(r["line"], [tuple(s) for s in r["spans"]]) for r in found])


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(f"n_{k}", T.LongType(), False) for k in BASE],
    T.StructField("base_sha256", T.StringType(), False),
    T.StructField("spans", T.StringType(), False),
    T.StructField("n_added", T.LongType(), False),
])


def spelt(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def found_spans(docs: DataFrame, model: SpanModel) -> DataFrame:
    """Counts, a hash of the base spans and all spans of every row's whole text, in one pass without a shuffle.

    Places are code points, ends exclusive.  Null and empty texts have no spans; null ids and repeated rows stay;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
                base, spans = shared.value.spans(text)
                counts = [sum(k == kind for _, _, k in base) for kind in range(len(BASE))]
                rows.append((doc_id, *counts, hashlib.sha256(spelt(base).encode()).hexdigest(), spelt(spans), len(spans) - len(base)))
            yield from common.batches(rows, pa.schema([(f.name, pa.string() if f.dataType == T.StringType() else pa.int64()) for f in SCHEMA]))

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(find, SCHEMA)


def redact(text: str, spans: list[Span]) -> str:
    """The text with a mark in place of every span; overlapping spans share that of the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with marks in place of personal data in ``text``, and ``n_chars``, if there is one, to fit; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, names = docs.schema, docs.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and redact(t, shared.value.spans(t)[1]) for t in batch.column("text").to_pylist()]
            changed = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in names and pa.types.is_integer(batch.schema.field("n_chars").type):
                changed["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([changed.get(n, c) for n, c in zip(names, batch.columns)], names=names)

    return docs.mapInArrow(mark, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return found_spans(docs, fit(docs))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of a pipeline: every document stays, its personal data do not.

    Null and empty texts stay as they are, rows that repeat are changed alike, an empty table stays empty, and no working
    columns are added; ``n_chars`` follows the text.
    """
    return redacted(docs, fit(docs))
