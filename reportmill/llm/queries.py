"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, divergence, hard_negatives, html_text, line_dedup, lm_score, mixing, ngram_join, pipeline as corpus, quality, quality_rules, sharding, topk, warc
from .workspace import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_passages(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(_table(spark, sf_dir, "documents"), leave_one_out=True)
    return scored.select("doc_id", "n_words", F.round("score", 6).alias("score"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), new_path(spark, "shards")).listing("doc_id")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_html_extraction, op3_line_dedup, op4_lm_scoring, op5_quality_classifier, op6_warc,
        op7_exact_top_k, op8_sharding, op9_benchmark_decontamination, op10_ngram_jaccard_join, op11_quality_rules, op12_hard_negatives, op13_source_divergence, pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": mixing.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_lm_scoring": lm_score.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_exact_top_k": topk.ORACLE,
    "op9_benchmark_decontamination": decontaminate.ORACLE,
    "op10_ngram_jaccard_join": ngram_join.ORACLE,
    "op11_quality_rules": quality_rules.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
