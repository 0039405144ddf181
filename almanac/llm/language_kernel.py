"""Language by a string kernel: shared n-grams of one to four characters, present or not.

The kernel of two texts is the number of n-grams both have, over the geometric mean of how many each has.
Nyström's method stands a few landmark texts in for all others, and a ridge regression per language on the kernel values
with them is a classifier.  The kernel is a product of presence vectors, so landmarks and weights multiply out to
one matrix from n-grams to languages, and a batch of texts is scored by one product with it.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from almanac.functions.joins import lookup
from almanac.llm import common

SIZES = (1, 2, 3, 4)   # of the n-grams
BUCKETS = 1 << 16      # n-grams are told apart by a hash to so many
LANDMARKS = 160
SAMPLE = 2_000         # documents learnt from, at most
PER_LANGUAGE = 500     # of one language, at most
RIDGE = 1e-3
UNKNOWN = "und"
LEAST_SCORE = 0.3      # below it a pipeline rejects a document
STRETCH = 1 << 20      # characters hashed at once
ROWS = 64              # texts scored at once

LETTER = regex.compile(r"\p{L}").search
_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def presence(text: str, out: np.ndarray) -> None:
    """Mark the buckets of all n-grams of the whole text, in lower case."""
    text = text.lower()
    for start in range(0, len(text), STRETCH):
        part = text[start:start + STRETCH + max(SIZES) - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32) + np.uint32(1)
        mixed = np.zeros(len(codes), np.uint32)
        for size in range(1, max(SIZES) + 1):
            mixed = mixed[:len(codes) - size + 1]
            if not len(mixed):
                break
            mixed = (mixed ^ codes[size - 1:]) * _ODD[size - 1]
            mixed ^= mixed >> np.uint32(15)
            if size in SIZES:
                out[(mixed * _ODD[0]) >> np.uint32(16)] = 1


@dataclass
class KernelModel:
    languages: list[str]
    weights: np.ndarray   # buckets by languages
    bias: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 where it has no letter or nothing was learnt."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        present = np.zeros((ROWS, BUCKETS), np.uint8)
        for start in range(0, len(texts), ROWS):
            part = texts[start:start + ROWS]
            present[:] = 0
            for row, text in zip(present, part):
                presence(text, row)
            dense = present[:len(part)].astype(np.float32)
            count = dense.sum(1, keepdims=True)
            value = dense @ self.weights / np.sqrt(np.maximum(count, 1)) + self.bias
            best = value.argmax(1)
            for i, text in enumerate(part):
                if LETTER(text):
                    names[start + i] = self.languages[best[i]]
                    scores[start + i] = min(1.0, max(0.0, (float(value[i, best[i]]) + 1) / 2))
        return names, scores


def train(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS) -> KernelModel:
    """One regression per language, towards 1 for its documents and -1 for others, over landmark kernels.

    ``rows`` are presence vectors.  Landmarks are taken from the languages in turn.
    """
    names = sorted(set(languages))
    if not names:
        return KernelModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    of = {name: [i for i, x in enumerate(languages) if x == name] for name in names}
    turns = sorted((k, name, i) for name, own in of.items() for k, i in enumerate(own))
    chosen = [i for _, _, i in turns[:landmarks]]
    norms = np.sqrt(np.maximum(rows.sum(1, dtype=np.float64), 1))
    marks = (rows[chosen] / norms[chosen, None]).astype(np.float32)
    cross = np.concatenate([part.astype(np.float32) @ marks.T for part in np.array_split(rows, max(1, len(rows) // 256))]) / norms[:, None]
    values, vectors = np.linalg.eigh(cross[chosen].astype(np.float64))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    z = cross @ whiten
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1 / np.array([len(of[x]) for x in languages])  # languages count alike
    weight *= len(languages) / weight.sum()
    mean_z, mean_y = np.average(z, 0, weight), np.average(y, 0, weight)
    zc = z - mean_z
    solved = np.linalg.solve((zc * weight[:, None]).T @ zc + RIDGE * len(z) * np.eye(zc.shape[1]), (zc * weight[:, None]).T @ (y - mean_y))
    weights = marks.T @ (whiten @ solved).astype(np.float32)
    return KernelModel(names, np.ascontiguousarray(weights, np.float32), (mean_y - mean_z @ solved).astype(np.float32))


def fit(docs: DataFrame, learn: Column) -> KernelModel:
    """Learn from at most ``SAMPLE`` documents that ``learn`` and have a language, chosen by a hash of their ids.

    Only ids and languages are ranked; the chosen texts become presence bits in the tasks that read them, and
    these bits (8 KB a document) go to the driver.
    """
    code = F.xxhash64("doc_id")
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & learn).select("doc_id", "lang")
    # Of a large language only ids with a small hash are ranked: some four times as many as are wanted.
    share = F.least(F.lit(4.0 * PER_LANGUAGE) / F.col("rows"), F.lit(1.0))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).select("lang", (share * F.lit(2.0**64) - F.lit(2.0**63)).alias("below"))
    few = lookup(known, sizes, ["lang"]).where(code.cast("double") <= F.col("below")).select("doc_id", "lang").distinct()
    turn = Window.partitionBy("lang").orderBy(code, "doc_id")
    chosen = few.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= PER_LANGUAGE)
    chosen = chosen.orderBy("turn", "lang").limit(SAMPLE).select("doc_id").distinct()

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in common.texts(batch):
                row = np.zeros(BUCKETS, np.uint8)
                presence(text, row)
                packed.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(packed, pa.binary())], names=["doc_id", "lang", "bits"])

    sample = docs.where(F.col("lang").isNotNull() & learn).select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")
    found = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(bits, "doc_id long, lang string, bits binary")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("lang", "bits")).alias("least")).select("least.*").toPandas()  # one of each id
    rows = rows.assign(raw=rows["bits"].map(bytes)).sort_values(["lang", "raw"])
    vectors = np.unpackbits(np.frombuffer(b"".join(rows["raw"]), np.uint8).reshape(len(rows), -1), axis=1) if len(rows) else np.zeros((0, BUCKETS), np.uint8)
    return train(vectors, rows["lang"].tolist())


def predicted(docs: DataFrame, model: KernelModel, lang: str = "_lang", score: str = "_lang_score") -> DataFrame:
    """All columns of ``docs``, and two new ones for language and score, in one pass without a shuffle.

    Of equal scores the first language in order of names counts.  Null and empty texts and texts without a letter are ``und`` with a score of 0; null ids and repeated rows stay as they
    are, and columns of any other name are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(common.texts(batch))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang, score])

    return docs.mapInArrow(predict, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.remainder(F.col("doc_id"), 3) == 1
    model = fit(docs, ~held_out)
    return predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of a pipeline: documents in a language that was learnt, with a score that is not very low.

    Null and empty texts and texts without a letter go; rows that repeat are judged each and alike; null ids and languages are
    not learnt from but judged; an empty table stays empty; working columns have names that ``docs`` does not.
    """
    model = fit(docs, common.remainder(F.col("doc_id"), 3) != 1)
    lang, score = common.unused(docs, "lang", "lang_score")
    return predicted(docs, model, lang, score).where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)
