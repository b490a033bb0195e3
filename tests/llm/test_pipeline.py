"""The pipeline's stages, each held against what its operator says of its own input."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reportmill.llm import decontaminate, mixing, ngram_join, pipeline as corpus_pipeline, quality

from .test_operators import HARD, docs, made_texts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_as_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_quality_stage(spark, table):
    kept = STAGE["quality"](spark, table, SF)
    assert kept.columns == table.columns
    want = quality.score(table, quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))).where("predicted = 1")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())


def test_near_duplicate_stage(spark, table):
    kept = STAGE["near_duplicates"](spark, table, SF)
    assert kept.columns == table.columns
    want = ngram_join.similar_components(table).where("doc_id = component_id")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())


def test_near_duplicate_stage_keeps_one_of_equal_rows(spark):
    rows = [*made_texts(20, 3), *HARD]
    kept = STAGE["near_duplicates"](spark, docs(spark, rows), SF).collect()
    assert Counter(r.doc_id for r in kept)[5] <= 1
    texts = [r.text for r in kept if r.text and r.text.strip()]
    assert len(texts) == len(set(texts))
    assert {1, 2, 3} <= {r.doc_id for r in kept}


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "mixing"])
def test_no_column_name_clashes(spark, name):
    rows = docs(spark, [*made_texts(20, 3), *HARD]).withColumns({c: F.lit(c) for c in ("_id", "_h", "row", "listed_id", "listed_h", "a.b", "component_id", "_0", "_text", "score")})
    out = STAGE[name](spark, rows, SF)
    assert out.columns == rows.columns
    assert all(r["a.b"] == "a.b" and r["_h"] == "_h" for r in out.collect())


def test_decontamination_stage(spark, table):
    kept = STAGE["decontamination"](spark, table, SF)
    judged = decontaminate.contamination(table, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in judged.where("not contaminated").collect())


def test_mixing_stage(spark, table):
    mixed = STAGE["mixing"](spark, table, SF)
    assert mixed.columns == table.columns
    want = {r.doc_id: r.copies for r in mixing.mix(table).where("copies > 0").collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(want)


def test_sharding_stage(spark, table):
    listed = STAGE["sharding"](spark, table.union(table.limit(3)), SF).groupBy("doc_id").agg(F.count("*").alias("n"))
    assert listed.agg(F.sum("n")).first()[0] == table.count() + 3


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_hard_rows(spark, name):
    for rows in (HARD, []):
        out = STAGE[name](spark, docs(spark, rows), SF)
        assert out.count() >= 0
        if name != "sharding":
            assert set(out.columns) == set(docs(spark, rows).columns)
