"""The pipeline's stages: columns stay, decisions take effect, clean documents stay."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from almanac.llm import pii_spans, quality_rules

DATA = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert set(rows) <= set(before)
        if name in ("language", "quality"):
            assert len((set(before) - set(rows)) & good) <= 0.01 * len(good)
        if name == "near_duplicates":
            assert len({r["text"] for r in rows.values()}) == len(rows)
        if name == "personal_data":
            assert set(rows) == set(before) and not any(pii_spans.base_spans(r["text"]) for r in rows.values())
        before = rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(before)


def test_odd_rows(spark, odd, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_clashing_names(spark, odd, stage):
    """Columns named like the ones that stages work with: none is lost, changed or in the way."""
    own = ["_score", "_f_words", "_q_words", "_lang", "_lang_score", "_dropped", "_copy", "_text", "counts", "found", "at", "part", "row", "shape"]
    docs = odd.drop("words", "class_id").withColumns({c: F.concat(F.lit(c), odd["doc_id"].cast("string")) for c in own})
    function = dict(corpus_pipeline.STAGES)[stage]
    rows = function(spark, docs, DATA).collect()
    assert rows
    if stage != "packing":
        assert set(rows[0].asDict()) == set(docs.columns)
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in own)
    assert function(spark, docs.limit(0), DATA).count() == 0


def test_quality_counts_each_character_class_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = quality_rules.keep_good(spark, docs, DATA)._jdf.queryExecution().optimizedPlan().toString()
    once = {c: plan.count(f"[^{c}]+") for c in (r"\p{L}", r"\p{Lu}", "0-9", "!")}
    assert set(once.values()) == {1}, once
