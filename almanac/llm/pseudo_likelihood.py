"""Documents scored by masked pseudo-likelihood: every word predicted from the words on both of its sides.

A small network reads a window of two words before and two after, a table of vectors for each place, and
predicts the class of the hidden word and the word within the class, so a prediction is normalised exactly at
the cost of two small softmaxes.  Words beyond the vocabulary share tokens by hash; such a word has the probability of its
token times its share of the token's occurrences, out of the counts of all words.  Words are counted over all documents.  All documents are dealt
out, as tokens, to copies of the network, as many as its words ask for and however the table is split; each is trained within a task,
the copies are averaged, weighted by their words, and the next round starts from the average.  A document's score is the sum of its words' conditional log-probabilities.
"""
from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.llm import common
from almanac.plans.staging import write_once

CLASSES = 64
WORDS = 64              # of a class
RARE = 64               # tokens that stand for all words beyond the vocabulary, by hash
PLACES = (-2, -1, 1, 2)
WIDTH = 24
SHARE = 1               # one in so many documents is trained on: every one
COPY = 2_000_000        # words a copy is trained on, about
ROUNDS = 2
MINIBATCH = 1024
RATE = 0.1
STRETCH = 1 << 16       # words scored at once
BLOCK = 1 << 10         # of them whose numbers fit a core's cache
PIECE = 1 << 14         # numbers of a row of parameters
FLUSH = 600_000         # different words counted by a task before they are given out
FANS = 64               # partial sums of copies, before the last one
REMEMBERED = 200_000    # words that a worker remembers beyond the vocabulary
LETTERS = 1 << 23       # of these words
LONG = 64               # characters; longer words are not remembered
FREQUENT = 200_000      # words beyond the vocabulary, at most, whose shares are sent to all tasks; others are joined

TOKENS = CLASSES * WORDS
TOGETHER = 15           # minibatches whose lookups are worked out at once; 16 bits number their tokens
RANKED = np.array([0, CLASSES - 1, *range(1, CLASSES - 1)])    # classes by how many words of a text they have, about
RANKS = np.argsort(RANKED)
RUNS = np.array([0, 1, 2, 5, 11, 22, 37])       # ranks at which classes of about as many words begin
SPANS = np.array([1, *(n << k for k in range(40) for n in (2, 3))])     # numbers of rows that a token's places are filled up to


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all documents, added up in each task before they are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        counts: Counter = Counter()
        for batch in batches:
            for text in common.texts(batch):
                counts.update(words_of(text))
                if len(counts) > FLUSH:
                    yield from common.batches(list(counts.items()), schema)
                    counts.clear()
        yield from common.batches(list(counts.items()), schema)

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Known(dict):
    """Tokens of words; that of a rare one is found out when first asked for, and remembered unless it is long."""

    def __missing__(self, word: str) -> int:
        token = TOKENS - RARE + xxhash.xxh3_64_intdigest(word) % RARE
        if len(word) <= LONG:
            self[word] = token
        return token


@dataclass
class Network:
    ids: dict[str, int]        # words of the vocabulary; rare ones have the last tokens
    parts: dict[str, np.ndarray]

    @classmethod
    def start(cls, counts: list[tuple[str, int]], others: int) -> "Network":
        """A network that predicts by frequency alone: ``counts`` falling, and the occurrences of all other words."""
        kept = counts[:TOKENS - RARE]
        frequency = np.ones(TOKENS)
        frequency[:len(kept)] += [n for _, n in kept]
        frequency[TOKENS - RARE:] += others / RARE
        table = np.log(frequency).reshape(CLASSES, WORDS)
        top = table.max(1, keepdims=True)
        total = (top + np.log(np.exp(table - top).sum(1, keepdims=True)))
        rng = np.random.default_rng(7)

        def small(*shape):
            return (rng.standard_normal(shape) * 0.1).astype(np.float32)

        return cls({w: i for i, (w, _) in enumerate(kept)}, {
            "places": small(len(PLACES), TOKENS + 1, WIDTH), "bias": np.zeros(WIDTH, np.float32),
            "classes": small(WIDTH, CLASSES), "class_bias": total[:, 0].astype(np.float32) - np.float32(total.max()),
            "words": small(CLASSES, WIDTH, WORDS), "word_bias": (table - total).astype(np.float32)})

    def tokens(self, text: str) -> list[int]:
        return self.tokens_of(words_of(text))

    def tokens_of(self, words: list[str]) -> list[int]:
        known = self.__dict__.get("_known")
        if known is None or len(known) > len(self.ids) + REMEMBERED:
            known = self.__dict__["_known"] = _Known(self.ids)
        return list(map(known.__getitem__, words))

    def windows(self, documents: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens in a row, and the tokens at each place around each; beyond a document's ends stands a mark."""
        reach = max(PLACES)
        gap = [TOKENS] * reach
        line = np.array([t for d in documents for t in (*gap, *d)] + gap)
        at = np.flatnonzero(line != TOKENS)
        return line[at], np.stack([line[at + p] for p in PLACES])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        p = self.parts
        total = p["places"][0][around[0]] + p["bias"]
        for k in range(1, len(PLACES)):
            total += p["places"][k][around[k]]
        return np.tanh(total, out=total)

    def scores(self, h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``predict`` for many tokens: only the sums of exponentials are worked out, not every probability."""
        p = self.parts
        group, member = np.divmod(tokens, WORDS)
        out = _chosen(h, p["classes"], p["class_bias"], group)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            own = order[bounds[c]:bounds[c + 1]]
            if len(own):
                out[own] += _chosen(h[own], p["words"][c], p["word_bias"][c], member[own])
        return out

    def predict(self, h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Log-probability of each token after the hidden values, out of whole softmaxes."""
        p = self.parts
        group, member = np.divmod(tokens, WORDS)
        out = _log_softmax(h @ p["classes"] + p["class_bias"])[np.arange(len(tokens)), group].astype(np.float64)
        for c in np.unique(group):
            own = np.flatnonzero(group == c)
            out[own] += _log_softmax(h[own] @ p["words"][c] + p["word_bias"][c])[np.arange(len(own)), member[own]]
        return out

    def log_probabilities(self, documents: list[list[int]]) -> np.ndarray:
        """Sums by document."""
        lengths = np.array([len(d) for d in documents], np.int64)
        return self.sums(np.fromiter(chain.from_iterable(documents), np.int64, lengths.sum()), lengths)

    def sums(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums by document of the log-probabilities of all documents' tokens in a row."""
        at, line = _lined(tokens, lengths[lengths > 0], np.int64)
        places, reach = _by_token(self.parts["places"]), max(PLACES)
        out = np.zeros(len(tokens))
        for start in range(0, len(tokens), STRETCH):
            part = slice(start, start + STRETCH)
            here = at[part]
            h = np.empty((len(here), WIDTH), np.float32)
            for some in range(0, len(here), BLOCK):
                own = here[some:some + BLOCK]
                low = own[0] - reach
                near = places.take(line[low:own[-1] + reach + 1], axis=0)
                np.tanh(_summed(near, self.parts["bias"]).take(own - (low + reach), axis=0), out=h[some:some + BLOCK])
            out[part] = self.scores(h, tokens[part])
        return by_document(out, lengths)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parts[n].ravel() for n in sorted(self.parts)])

    def filled(self, values: np.ndarray) -> "Network":
        """A network of the same shape with these parameters."""
        parts, at = {}, 0
        for name in sorted(self.parts):
            size = self.parts[name].size
            parts[name] = values[at:at + size].reshape(self.parts[name].shape).astype(np.float32)
            at += size
        return Network(self.ids, parts)


def by_document(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


@dataclass
class Step:
    """What a step of training looks up, worked out for several minibatches at once."""
    line: np.ndarray        # tokens and marks of the minibatch and as far as its windows reach
    here: np.ndarray        # its words' positions, those of a class together, counted from the first that can be a word's
    ranks: np.ndarray       # their classes, by rank
    members: np.ndarray     # and which word of the class
    runs: list[tuple[int, int, int]]    # classes from, to, and rows that each gets
    slots: np.ndarray       # of each word its row among those
    words: np.ndarray       # of each row its word, or one past the last
    seen: np.ndarray        # different tokens of the line, those with as many places together
    spans: list[tuple[int, int]]        # how many tokens, and how many rows each gets
    places: np.ndarray      # of each of these rows its place in the line, or one past the last


def steps(line: np.ndarray, at: np.ndarray, tokens: np.ndarray) -> Iterator[Step]:
    """At most ``TOGETHER`` minibatches: ``tokens`` that stand ``at`` places of the ``line``."""
    reach, number = max(PLACES), -(-len(at) // MINIBATCH)
    firsts = np.arange(0, len(at), MINIBATCH)
    sizes = np.diff(firsts, append=len(at))
    batch = np.repeat(np.arange(number), sizes)
    low, high = at[firsts] - reach, at[firsts + sizes - 1] + reach + 1

    key = (batch * CLASSES + RANKS[tokens // WORDS]).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    key, tokens, here = key[order], tokens[order], at[order] - (low + reach)[batch]
    counts = np.bincount(key, minlength=number * CLASSES).reshape(number, CLASSES)
    bounds = np.append(RUNS, CLASSES)
    most, total = np.maximum.reduceat(counts, RUNS, axis=1), np.add.reduceat(counts, RUNS, axis=1)
    apart = np.diff(bounds) * most > 2 * total + MINIBATCH // 2     # few rows would be words, so each class has its own number
    width = np.where(np.repeat(apart, np.diff(bounds), axis=1), counts, np.repeat(most, np.diff(bounds), axis=1))
    rows = width.sum(1)
    slots = (np.cumsum(width, axis=1) - width).ravel()[key] + np.arange(len(key)) - (np.cumsum(counts) - counts.ravel())[key]
    words = np.repeat(sizes, rows)
    words[slots + (np.cumsum(rows) - rows)[batch]] = np.arange(len(key)) - firsts[batch]

    lengths = high - low
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(number), lengths)
    place = np.arange(ends[-1]) - (ends - lengths)[of]
    lines = line[place + low[of]]
    named = (lines + (TOKENS + 1) * of).astype(np.uint16)
    sort = np.argsort(named, kind="stable")
    named = named[sort]
    starts = np.flatnonzero(np.diff(named, prepend=-1))
    times = np.diff(starts, append=len(named))
    owner, token = np.divmod(named[starts], TOKENS + 1)
    kind = owner.astype(np.int64) * len(SPANS) + np.searchsorted(SPANS, times)
    by = np.argsort(kind, kind="stable")
    kinds = np.bincount(kind, minlength=number * len(SPANS))
    room = kinds.reshape(number, -1) * SPANS
    first = np.empty(len(by), np.int64)
    first[by] = (np.cumsum(room) - room.ravel())[kind[by]] + np.arange(len(by)) - (np.cumsum(kinds) - kinds)[kind[by]]
    places = np.repeat(lengths, room.sum(1))
    places[np.repeat(first, times) + (np.arange(len(named)) - np.repeat(starts, times)) * np.repeat(kinds[kind], times)] = place[sort]
    seen, kinds = token[by], kinds.reshape(number, -1)

    def cut(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.cumsum(sizes)[:-1])

    for i, (x, h, k, m, s, w, t, p) in enumerate(zip(
            cut(lines, lengths), cut(here, sizes), cut(key - batch * CLASSES, sizes), cut(tokens % WORDS, sizes), cut(slots, sizes),
            cut(words, rows), cut(seen, kinds.sum(1)), cut(places, room.sum(1)))):
        runs = []
        for j, (c, to) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            runs += [(b, b + 1, int(counts[i, b])) for b in range(c, to)] if apart[i, j] else [(c, to, int(most[i, j]))]
        yield Step(x, h, k, m, runs, s, w, t, [(n, each) for n, each in zip(kinds[i].tolist(), SPANS.tolist()) if n], p)


class Learner:
    """A network in training: its parameters and the sums of their squared gradients, laid out so that a step is a few products.

    A token's vectors for all places lie in a row, biases stand below the weights, and classes are ranked so that those of
    about as many words are neighbours: these get the same number of rows, the last ones empty, and one product of stacks.
    """

    def __init__(self, network: Network):
        p = network.parts
        self.ids = network.ids
        self.places = _by_token(p["places"])
        self.bias = p["bias"].copy()
        self.classes = np.concatenate([p["classes"], p["class_bias"][None]])[:, RANKED]
        self.words = np.concatenate([p["words"], p["word_bias"][:, None]], axis=1)[RANKED]
        self.place_squares, self.gradient = np.zeros_like(self.places), np.zeros_like(self.words)
        squares = np.zeros_like(self.words)
        stacks = [slice(c, c + 8) for c in range(0, CLASSES, 8)]  # these fit a core's cache
        self.stepped = [(self.words[c].reshape(-1), squares[c].reshape(-1), self.gradient[c].reshape(-1)) for c in stacks]
        self.class_squares, self.bias_squares = np.zeros_like(self.classes), np.zeros_like(self.bias)
        self.kept: dict[str, np.ndarray] = {}

    def network(self) -> Network:
        words, classes = self.words[RANKS], self.classes[:, RANKS]
        places = self.places.reshape(TOKENS + 1, len(PLACES), WIDTH).transpose(1, 0, 2)
        return Network(self.ids, {
            "places": places, "bias": self.bias, "classes": classes[:-1], "class_bias": classes[-1], "words": words[:, :-1], "word_bias": words[:, -1]})

    def learn(self, tokens: np.ndarray, lengths: np.ndarray) -> None:
        """One pass of adaptive gradient steps over the documents, their tokens in a row; beyond a document's ends stands a mark."""
        lengths = lengths[lengths > 0]
        at, line = _lined(tokens, lengths, np.uint16)
        for start in range(0, len(tokens), TOGETHER * MINIBATCH):
            part = slice(start, start + TOGETHER * MINIBATCH)
            for step in steps(line, at[part], tokens[part]):
                self.step(step)

    def room(self, name: str, rows: int, width: int) -> np.ndarray:
        """Rows to write into, the same ones each time."""
        kept = self.kept.get(name)
        if kept is None or len(kept) < rows:
            kept = self.kept[name] = np.empty((rows + rows // 8, width), np.float32)
        return kept[:rows]

    def step(self, step: Step) -> None:
        size, reach = len(step.here), max(PLACES)
        share = np.float32(1 / size)
        near = np.take(self.places, step.line, axis=0, out=self.room("near", len(step.line), self.places.shape[1]), mode="clip")
        total = _summed(near, self.bias)
        middle = len(total)
        h = np.take(total, step.here, axis=0, out=self.room("h", size, WIDTH), mode="clip")
        np.tanh(h, out=h)
        wide = self.room("wide", size + 1, WIDTH + 1)
        wide[:size, :WIDTH] = h
        wide[:size, WIDTH] = 1
        wide[size] = 0

        x = self.room("x", size, CLASSES)
        _errors(x, lambda: np.matmul(wide[:size], self.classes, out=x), step.ranks + np.arange(size) * CLASSES, share)
        back = x @ self.classes.T
        classes = wide[:size].T @ x

        rows = np.take(wide, step.words, axis=0, out=self.room("rows", len(step.words), WIDTH + 1), mode="clip")
        y, down = self.room("y", len(rows), WORDS), self.room("down", len(rows), WIDTH + 1)
        stacks, at = [], 0
        for c, to, each in step.runs:
            part = slice(at, at + (to - c) * each)
            stacks.append((slice(c, to), *(a[part].reshape(to - c, each, -1) if each else None for a in (rows, y, down))))
            at = part.stop

        def forward() -> None:
            for c, own, logits, _ in stacks:
                if own is not None:
                    np.matmul(own, self.words[c], out=logits)

        _errors(y, forward, step.members + step.slots * WORDS, share)
        for c, own, error, under in stacks:
            if own is None:
                self.gradient[c] = 0
            else:
                np.matmul(own.transpose(0, 2, 1), error, out=self.gradient[c])
                np.matmul(error, self.words[c].transpose(0, 2, 1), out=under)
        back += np.take(down, step.slots, axis=0, out=self.room("taken", size, WIDTH + 1), mode="clip")

        _step(self.classes, self.class_squares, classes)
        for stack in self.stepped:
            _step(*stack)
        after = self.room("after", size, WIDTH)
        np.multiply(h, h, out=after)
        np.subtract(1, after, out=after)
        after *= back[:, :WIDTH]
        _step(self.bias, self.bias_squares, after.sum(0))

        all_after = self.room("all", middle, WIDTH)
        if middle > size:
            all_after[:] = 0
        all_after[step.here] = after
        spread = self.room("spread", len(near) + 1, self.places.shape[1])
        for k, place in enumerate(PLACES):
            columns = spread[:, k * WIDTH:(k + 1) * WIDTH]
            columns[:reach + place] = 0
            columns[reach + place:reach + place + middle] = all_after
            columns[reach + place + middle:] = 0
        ranked = np.take(spread, step.places, axis=0, out=self.room("ranked", len(step.places), spread.shape[1]), mode="clip")
        gradient, at, row = self.room("gradient", len(step.seen), spread.shape[1]), 0, 0
        for n, each in step.spans:
            np.add.reduce(ranked[row:row + n * each].reshape(each, -1), axis=0, out=gradient[at:at + n].reshape(-1))
            at, row = at + n, row + n * each
        values, squares = self.places.take(step.seen, axis=0), self.place_squares.take(step.seen, axis=0)
        _step(values, squares, gradient)
        self.places[step.seen], self.place_squares[step.seen] = values, squares


def _by_token(places: np.ndarray) -> np.ndarray:
    """A copy with a token's vectors for all places in a row."""
    return places.transpose(1, 0, 2).reshape(TOKENS + 1, -1)


def _summed(near: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Of a line of tokens' vectors, what each place gets from those around it; the places at the ends, whose window is cut, are left out."""
    reach = max(PLACES)
    middle = len(near) - 2 * reach
    total = near[reach + PLACES[0]:reach + PLACES[0] + middle, :WIDTH] + bias
    for k, place in enumerate(PLACES[1:], 1):
        total += near[reach + place:reach + place + middle, k * WIDTH:(k + 1) * WIDTH]
    return total


def _lined(tokens: np.ndarray, lengths: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Places of all documents' tokens in a line with marks before, between and behind the documents; the line."""
    reach = max(PLACES)
    at = np.arange(len(tokens)) + np.repeat((np.arange(len(lengths)) + 1) * reach, lengths)
    line = np.full(len(tokens) + (len(lengths) + 1) * reach, TOKENS, kind)
    line[at] = tokens
    return at, line


def _errors(x: np.ndarray, fill: Callable[[], object], chosen: np.ndarray, share: np.float32) -> None:
    """What ``fill`` writes into ``x``, by row: the gradient, times ``share``, of the logarithm of the softmax at the place chosen."""
    fill()
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        np.exp(x, out=x)
        sums = x @ np.ones(x.shape[1], np.float32)
    if not (sums.min() > 1e-25 and sums.max() < 1e25):  # each row's own greatest is taken off only where that matters
        fill()
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        sums = x.sum(1)
    x *= (-share / sums)[:, None]
    x.reshape(-1)[chosen] += share


class Codes(dict):
    """Numbers of words: their tokens or, for rare ones, places beyond ``TOKENS`` in lists of what is known of them.

    The lists grow as words are met; ``full`` says when to start again, so that a worker's memory has a bound.
    """

    def __init__(self, network: Network, share_of: dict[int, float]):
        super().__init__(network.ids)
        self.share_of, self.letters = share_of, 0
        self.names, self.buckets, self.shares = array("q"), array("q"), array("d")

    def __missing__(self, word: str) -> int:
        name, bucket = _named(word)
        self[word] = code = TOKENS + len(self.names)
        self.names.append(name)
        self.buckets.append(bucket)
        self.shares.append(self.share_of.get(name, np.nan))
        self.letters += len(word)
        return code

    def full(self) -> bool:
        return len(self.names) > REMEMBERED or self.letters > LETTERS

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all texts in a row, and the number of each text's words."""
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        return np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, lengths.sum()), lengths


def scored_texts(network: Network, codes: Codes, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Number of words and sum of each text, and of the rare words whose share was not sent: text, hash, token among the rare ones, how often."""
    found, lengths = codes.of(texts)
    rare = np.flatnonzero(found >= TOKENS)
    place = found[rare] - TOKENS
    tokens = found.copy()
    tokens[rare] = TOKENS - RARE + np.array(codes.buckets, np.int64)[place]
    sent = np.zeros(len(found))
    sent[rare] = np.array(codes.shares)[place]
    missing = np.flatnonzero(np.isnan(sent))
    sent[missing] = 0.0
    text = np.repeat(np.arange(len(texts)), lengths)[missing]
    width = len(codes.names) + 1
    pairs, times = np.unique(text * width + found[missing] - TOKENS, return_counts=True)
    text, place = np.divmod(pairs, width)
    rest = (text, np.array(codes.names, np.int64)[place], np.array(codes.buckets, np.int64)[place], times)
    return lengths, network.sums(tokens, lengths) + by_document(sent, lengths), rest


def _chosen(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of each row the logarithm of the softmax at one place.

    Hidden values lie within -1 and 1, so the weights bound the exponents of all rows; only where that bound is wide
    each row's own greatest one is taken off.
    """
    reach = float(np.abs(weights).sum(0).max())
    shift, ones = bias - (bias.max() + reach), np.ones(weights.shape[1], np.float32)
    out = np.empty(len(h))
    room = np.empty((min(len(h), BLOCK), weights.shape[1]), np.float32)
    for start in range(0, len(h), BLOCK):
        part = slice(start, start + BLOCK)
        x = np.matmul(h[part], weights, out=room[:len(h) - start])
        x += shift
        if reach > 35:
            x -= x.max(1, keepdims=True)
        chosen = x[np.arange(len(x)), which[part]].astype(np.float64)
        np.exp(x, out=x)
        out[part] = chosen - np.log(x @ ones)
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    x -= np.log(np.exp(x).sum(1, keepdims=True))
    return x


def _step(values: np.ndarray, squares: np.ndarray, gradient: np.ndarray) -> None:
    change = gradient * gradient
    squares += change
    np.sqrt(squares, out=change)
    change += np.float32(1e-6)
    np.divide(gradient, change, out=change)
    change *= np.float32(RATE)
    values += change


def _added(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of weighted parameters added up by ``by``, each task reading its rows one batch after the other."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for key, weight, values in zip(zip(*(batch.column(c).to_pylist() for c in ("fan", "piece"))), batch.column("weight").to_pylist(), batch.column("numbers").to_pylist()):
                key = key if "fan" in by else (0, key[1])
                numbers = np.frombuffer(values, np.float64)
                kept = sums.setdefault(key, [0.0, np.zeros(len(numbers))])
                kept[0] += weight
                kept[1] += numbers
        yield from common.batches([(*key, w, v.tobytes()) for key, (w, v) in sums.items()], PARTS)

    return rows.repartition(*by).mapInArrow(add, PARTS_DDL)


PARTS = pa.schema([("fan", pa.int32()), ("piece", pa.int32()), ("weight", pa.float64()), ("numbers", pa.binary())])
PARTS_DDL = "fan int, piece int, weight double, numbers binary"


def dealt(docs: DataFrame, network: Network, share: int = SHARE, copies: int = 1) -> DataFrame:
    """``copy, tokens, lengths``: the documents of the share dealt out evenly to ``copies``, as tokens, stored once for all rounds.

    A row holds the documents of an Arrow batch; a copy's rows follow each other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("copy", pa.int32()), ("tokens", pa.binary()), ("lengths", pa.binary())])
        for batch in batches:
            documents = [shared.value.tokens(t) for t in common.texts(batch)]
            lengths = np.array([len(d) for d in documents], np.int32)
            tokens = np.fromiter(chain.from_iterable(documents), np.uint16, int(lengths.sum(dtype=np.int64)))
            yield from common.batches([(TaskContext.get().partitionId(), tokens.tobytes(), lengths.tobytes())], schema)

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("text").repartition(copies)
    return write_once(sample.mapInArrow(encode, "copy int, tokens binary, lengths binary"))


def trained(dealt: DataFrame, network: Network) -> Network:
    """The average, weighted by words, of copies of the network trained on what was ``dealt`` to each; nothing to train on leaves it as it is.

    A task adds up its copies, so what it gives out does not grow with them.
    """
    shared = dealt.sparkSession.sparkContext.broadcast(network)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c, np.frombuffer(t, np.uint16), np.frombuffer(n, np.int32)) for b in batches for c, t, n in zip(*(b.column(i).to_pylist() for i in range(3))))
        weight, values = 0, np.zeros(0)
        for _, own in groupby(rows, key=lambda row: row[0]):
            learner, words = Learner(shared.value), 0
            for _, tokens, lengths in own:
                learner.learn(tokens, lengths)
                words += len(tokens)
            if words:
                added = learner.network().flat().astype(np.float64) * words
                weight, values = weight + words, values + added if weight else added
        if weight:
            fan = TaskContext.get().partitionId() % FANS
            yield from common.batches([
                (fan, i, float(weight), values[at:at + PIECE].tobytes()) for i, at in enumerate(range(0, len(values), PIECE))], PARTS)

    parts = write_once(dealt.select("copy", "tokens", "lengths").mapInArrow(train, PARTS_DDL))
    rows = _added(_added(parts, ["fan", "piece"]), ["piece"]).orderBy("piece").collect()
    if not rows:
        return network
    return network.filled(np.concatenate([np.frombuffer(r["numbers"], np.float64) / r["weight"] for r in rows]))


def shares(counts: DataFrame, network: Network) -> DataFrame:
    """``name, bucket, n, share``: of each word beyond the vocabulary its hash, its token, how often it occurs and the logarithm of its share of the token.

    Each token keeps one more occurrence for all words that were not counted, so the shares add up to one with these.
    """
    known = counts.sparkSession.sparkContext.broadcast(network.ids)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            rows = [(*_named(w), n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) if w not in known.value]
            yield from common.batches(rows, schema)

    words = counts.select("word", "n").mapInArrow(rare, "name long, bucket int, n long")
    totals = {r["bucket"]: r["n"] for r in words.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most RARE
    total = F.element_at(F.array(*[F.lit(totals.get(b, 0) + 1).cast("double") for b in range(RARE)]), F.col("bucket") + 1)
    return words.select("name", "bucket", "n", F.log(F.col("n") / total).alias("share"), (-F.log(total)).alias("least"))


def frequent(found: DataFrame, most: int = FREQUENT) -> dict[int, float]:
    """The shares, by hash, of the words that occur most often: as many whole frequencies as ``most`` words hold."""
    bound, words = 1, 0
    for r in found.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect():
        words += r["count"]
        if words > most:
            bound = r["n"] + 1
            break
    rows = found.where(F.col("n") >= bound).select("name", "share").toPandas()
    return dict(zip(rows["name"].tolist(), rows["share"].tolist()))


def _named(word: str) -> tuple[int, int]:
    """The hash of a word beyond the vocabulary, as Spark holds it, and its token among the rare ones."""
    hashed = xxhash.xxh3_64_intdigest(word)
    return hashed - (1 << 64) if hashed >> 63 else hashed, hashed % RARE


def fit(docs: DataFrame, share: int = SHARE, rounds: int = ROUNDS, counts: DataFrame | None = None) -> Network:
    """Count the words of all documents, if ``counts`` does not have them, then train on all of them, or on one in ``share``."""
    counts = write_once(word_counts(docs)) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(TOKENS - RARE).collect()]
    network = Network.start(top, total - sum(n for _, n in top))
    if rounds:
        documents = dealt(docs, network, share, 1 + total // (share * COPY))
        for _ in range(rounds):
            network = trained(documents, network)
    return network


def scored(docs: DataFrame, network: Network, counts: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob`` of every row's whole text.

    The network scores in one pass.  Of words beyond its vocabulary the more frequent ones' shares of ``counts`` (those of
    ``docs``, if not given) are known to every task; the others of a row, hashes and how often, are joined with theirs, whatever the number of words.  A word that was not counted scores as one seen
    once.  A null or empty text has no tokens, a sum of 0 and no mean; null ids and repeated rows stay; other columns are not read.
    """
    counts = write_once(word_counts(docs)) if counts is None else counts
    found = write_once(shares(counts, network))
    shared = docs.sparkSession.sparkContext.broadcast((network, frequent(found)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, share_of = shared.value
        codes = Codes(network, share_of)
        for batch in batches:
            counts, sums, rest, before = [], [], [], 0
            for some in common.slices(common.texts(batch), 128):
                if codes.full():
                    codes = Codes(network, share_of)
                lengths, totals, (text, *found) = scored_texts(network, codes, some)
                counts.append(lengths)
                sums.append(totals)
                rest.append((text + before, *found))
                before += len(some)
            text, names, buckets, times = (np.concatenate(x) for x in zip(*rest)) if rest else [np.zeros(0, np.int64)] * 4
            ends = pa.array(np.searchsorted(text, np.arange(before + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((names, pa.int64()), (buckets, pa.int32()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), pa.array(np.concatenate([np.zeros(0), *sums])), *lists],
                names=["doc_id", "n_tokens", "log_prob", "names", "buckets", "times"])

    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    rows = ids.mapInArrow(score, "doc_id long, n_tokens long, log_prob double, names array<long>, buckets array<int>, times array<int>")
    rows = write_once(rows.withColumn("row", F.monotonically_increasing_id()))
    least = {r["bucket"]: r["least"] for r in found.groupBy("bucket").agg(F.first("least").alias("least")).collect()}
    unseen = F.element_at(F.array(*[F.lit(float(least.get(b, 0.0))) for b in range(RARE)]), F.col("x.buckets") + 1)
    rare = rows.select("row", F.explode(F.arrays_zip("names", "buckets", "times")).alias("x")).select(
        "row", F.col("x.names").alias("name"), F.col("x.times").alias("times"), unseen.alias("unseen"))
    rare = rare.join(found.select("name", "share"), "name", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.coalesce("share", "unseen")).alias("rare"))
    total = F.col("log_prob") + F.coalesce("rare", F.lit(0.0))
    return rows.select("row", "doc_id", "n_tokens", "log_prob").join(rare, "row", "left").select(
        "doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = write_once(word_counts(docs))
    return scored(docs, fit(docs, counts=counts), counts)
