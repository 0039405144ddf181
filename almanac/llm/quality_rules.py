"""Quality by a sparse ensemble of rules over statistics of the text.

Small boosted trees are grown on the statistics of labelled documents; every path from a root to a node is a
rule, a conjunction of comparisons.  A logistic model with a lasso penalty weighs the rules and drops most of
them.  What is left is written as one Spark column expression, so scoring is a projection over the table.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.functions.text import bind
from almanac.llm import common

SAMPLE = 20_000     # labelled documents learnt from, at most
TREES = 30
DEPTH = 3
THRESHOLDS = 32     # candidate cuts of a statistic
SHRINK = 0.3        # of each tree
PENALTY = 2e-3      # of the lasso
THRESHOLD = 0.3


def _kept(text: Column, dropped: str) -> Column:
    """Characters left after those of a class are taken away."""
    return F.length(F.regexp_replace(text, dropped, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Counts over the whole text; ``text`` must not be null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    return {
        "chars": F.length(text),
        "letters": _kept(text, r"[^\p{L}]+"),
        "capitals": _kept(text, r"[^\p{Lu}]+"),
        "digits": _kept(text, r"[^0-9]+"),
        "symbols": _kept(text, r"[^#*$%&|<>=]+"),
        "marks": _kept(text, r"[^.,;:!?]+"),
        "exclaimed": _kept(text, r"[^!]+"),
        "words": F.size(words),
        "different_words": F.size(F.array_distinct(words)),
        "lines": F.size(lines),
        "different_lines": F.size(F.array_distinct(lines)),
    }


def features(counts: Column | None = None) -> dict[str, Column]:
    """Shares out of a struct of the counts, each safe for empty texts."""
    counts = F.col("counts") if counts is None else counts

    def share(a: str, b: str) -> Column:
        return (counts[a] / F.greatest(counts[b], F.lit(1))).cast("double")

    return {
        "words": counts["words"].cast("double"),
        "word_length": share("letters", "words"),
        "letters": share("letters", "chars"),
        "capitals": share("capitals", "letters"),
        "digits": share("digits", "chars"),
        "symbols": share("symbols", "words"),
        "marks": share("marks", "words"),
        "exclaimed": share("exclaimed", "words"),
        "line_length": share("words", "lines"),
        "different_words": share("different_words", "words"),
        "different_lines": share("different_lines", "lines"),
    }


def _struct(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def measured(text: Column, fn=lambda found: found) -> Column:
    """``fn`` of the struct of the features of a text; null is the empty text.

    Counts and features are handed on as values.  As columns of projections, the optimizer would write each of them out
    again wherever a filter on the result names it.
    """
    counts = _struct(statistics(F.coalesce(text, F.lit(""))))
    return bind(counts, lambda c: bind(_struct(features(c)), fn))


Rule = tuple[tuple[int, bool, float], ...]  # feature, whether above, threshold


@dataclass
class RuleModel:
    names: list[str]
    base: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self, value_of=lambda name: F.col(f"_f_{name}")) -> Column:
        """The score as an expression over the features, by default columns named ``_f_*``."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for i, above, threshold in rule:
                value = value_of(self.names[i])
                holds = holds & (value > threshold if above else value <= threshold)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, text: Column) -> Column:
        """The score of a text, its features worked out once."""
        return measured(text, lambda found: self.column(lambda name: found[name]))


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, threshold in rule:
        out &= (x[:, i] > threshold) == above
    return out


def grow(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, residual: np.ndarray, curvature: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """A tree by Newton gains over binned features: the paths to its nodes, and its values."""
    rules, value = [], np.zeros(len(x))

    def descend(rows: np.ndarray, path: Rule, depth: int) -> None:
        g, h = residual[rows].sum(), curvature[rows].sum()
        if path:
            rules.append(path)
        best = (1e-3, None)
        if depth < DEPTH:
            for i, c in enumerate(cuts):
                if len(c):
                    low_g = np.cumsum(np.bincount(bins[rows, i], residual[rows], len(c) + 1))[:-1]
                    low_h = np.cumsum(np.bincount(bins[rows, i], curvature[rows], len(c) + 1))[:-1]
                    gain = low_g**2 / (low_h + 1) + (g - low_g) ** 2 / (h - low_h + 1) - g**2 / (h + 1)
                    gain[(low_h < 0.5) | (h - low_h < 0.5)] = 0
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], (i, at))
        if best[1] is None:
            value[rows] = g / (h + 1)
            return
        i, at = best[1]
        above = bins[rows, i] > at
        descend(rows[~above], (*path, (i, False, float(cuts[i][at]))), depth + 1)
        descend(rows[above], (*path, (i, True, float(cuts[i][at]))), depth + 1)

    descend(np.arange(len(x)), (), 0)
    return rules, value


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights under an absolute penalty by accelerated proximal steps; the base is not penalised."""
    n, m = a.shape
    a = np.column_stack([np.ones(n), a])
    step = 4 / (np.linalg.norm(a, 2) ** 2 / n)
    w, ahead, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -30, 30)))
        new = ahead - step * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def learn_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Documents of one label only give its share as a constant score, none at all 0.5."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = RuleModel(names, float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, THRESHOLDS + 2)[1:-1]).round(6)) for i in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)])
    margin, found = np.full(len(y), model.base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rules, value = grow(x, cuts, bins, y - p, p * (1 - p) + 1e-6)
        found.update(dict.fromkeys(rules))
        margin = margin + SHRINK * value
    columns: dict[bytes, Rule] = {}
    for rule in found:  # rules that hold for the same documents count once, the shortest
        holds = applies(rule, x)
        if 0 < holds.sum() < len(y):
            key = holds.tobytes()
            if key not in columns or len(rule) < len(columns[key]):
                columns[key] = rule
    rules = list(columns.values())
    if rules:
        base, weights = lasso(np.column_stack([applies(r, x) for r in rules]).astype(float), y, PENALTY)
        model.base = base
        model.rules = [(r, float(w)) for r, w in zip(rules, weights) if w]
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> RuleModel:
    """Learn from the statistics of at most ``sample`` labelled documents."""
    names = list(features())
    sample_rows = common.labelled(docs, labels, "quality", learn, sample).select("wanted", measured(F.col("text")).alias("found"))
    rows = sample_rows.select("wanted", *[f"found.{n}" for n in names]).toPandas()
    return learn_rules(rows.drop(columns="wanted").to_numpy(float), rows["wanted"].to_numpy(float), names)


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """All columns of ``docs`` and ``_score``, which replaces one of that name: a projection without Python and without a shuffle.

    Null and empty texts are scored by counts of 0; ids and repeated rows do not matter, other columns are kept.
    """
    return docs.drop("_score").select("*", model.score(F.col("text")).alias("_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.remainder(F.col("doc_id"), 5) == 0
    model = fit(docs, common.table(spark, sf_dir, "labels"), ~held_out)
    return scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of a pipeline: documents that the classifier does not reject, learnt from those that came this far.

    Null and empty texts are judged by counts of 0, rows that repeat get the same verdict each, null ids are not learnt
    from but judged, an empty table stays empty, and no working columns are added, so any names may occur.
    """
    held_out = common.remainder(F.col("doc_id"), 5) == 0
    model = fit(docs, common.table(spark, sf_dir, "labels"), ~held_out)
    return docs.where(model.score(docs["text"]) >= THRESHOLD)
