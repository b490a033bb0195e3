"""The corpus pipeline: five stages, each one operator, each written as Parquet and read again.

Every stage but the last returns the columns of its input.  SQL can't express
the trained classifier, so ORACLE_SQL is None and tests hold the stages against
brute-force versions.  Rows travel as one struct beside an operator's own
columns, so no name of a document's columns clashes with these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, mixing, ngram_join, quality, sharding
from .sizes import small
from .workspace import materialize, new_path, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _row_key() -> Column:
    """Equal for equal rows of one id and text."""
    return F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, row) of each document."""
    return docs.select(_row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _rows(keyed: DataFrame, columns: list[str]) -> DataFrame:
    return keyed.select(*[F.col("row").getField(c).alias(c) for c in columns])


def _listed(keys: DataFrame, name: str) -> DataFrame:
    """A written table of keys as (listed_id, listed_h)."""
    return small(materialize(keys.select(F.col("key.doc_id").alias("listed_id"), F.col("key.h").alias("listed_h")), name))


def _is_listed() -> Column:
    return F.col("key.doc_id").eqNullSafe(F.col("listed_id")) & (F.col("key.h") == F.col("listed_h"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is judged as a text without words, rows of one text
    alike, very long texts whole; without labels every document stays; an empty
    table stays empty.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return _rows(quality.score(rows, model, keep=("row",)).where("predicted = 1"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of smallest id, once.

    Documents without words, null texts included, are no duplicates of others;
    a null id stays only if its group has no other; of rows of one id and text,
    with or without words, one stays, that of smallest hash over all columns.
    """
    keyed = _keyed(docs)
    groups = materialize(ngram_join.similar_components(docs.select(_row_key().alias("key"), "text"), id_col="key"), "groups")
    gone = _listed(groups.where("key <> component_id").select("key").distinct(), "gone")
    kept = keyed.join(gone, _is_listed(), "left_anti")
    again = _listed(groups.where("key = component_id").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    once = keyed.join(again, _is_listed()).groupBy("key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return _rows(kept.join(again, _is_listed(), "left_anti").unionByName(once.select("key", "row")), docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go.

    Null and empty texts are clean, rows of one text are judged alike, very long
    texts whole; an empty benchmark takes nothing away.
    """
    judged = decontaminate.contamination(docs.select(_row_key().alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    gone = _listed(judged.where("contaminated").select("key").distinct(), "contaminated")
    return _rows(_keyed(docs).join(gone, _is_listed(), "left_anti"), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is a source of its own; rows of one id and source are taken
    alike; a source without words gives none; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in target-sized shards; a row for each with its shard.

    Every row is written as it is, repeated ones and nulls too; an empty table
    gives an empty listing.
    """
    return sharding.shard(docs, new_path(spark, "shards")).listing("doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; a stage's own tables go with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
