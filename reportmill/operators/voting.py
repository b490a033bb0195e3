"""Votes of several models as long tables (key, model, pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def long_votes(df: DataFrame, key: str, models: list[str], *keep: str) -> DataFrame:
    """One row for each row and model: (key, keep..., model, pred)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in models])
    return df.select(key, *keep, F.explode(pairs).alias("v")).select(key, *keep, "v.model", "v.pred")


def plurality(votes: DataFrame, priority: list[str] | None, *keys: str) -> DataFrame:
    """(keys, pred, votes, margin): the label with most votes.

    Ties go to the label of the model listed first in ``priority``, or to the
    first label in the alphabet if that is None.
    """
    place = F.lit(0) if priority is None else F.array_position(F.array(*[F.lit(m) for m in priority]), F.col("model"))
    tally = votes.groupBy(*keys, "pred").agg(F.count("*").alias("votes"), F.min(place).alias("place"))
    by = Window.partitionBy(*keys).orderBy(F.col("votes").desc(), "place", "pred")
    ranked = tally.withColumns({"_r": F.row_number().over(by), "_next": F.lead("votes").over(by)})
    return ranked.where("_r = 1").select(*keys, "pred", "votes", (F.col("votes") - F.coalesce("_next", F.lit(0))).alias("margin"))


def weighted(votes: DataFrame, weight: Column, fallback: str, *keys: str) -> DataFrame:
    """(keys, pred, weight): the label with the highest weight, ties to the row's ``fallback`` column, then by alphabet."""
    tally = votes.groupBy(*keys, fallback, "pred").agg(F.sum(weight).alias("weight"))
    by = Window.partitionBy(*keys).orderBy(F.col("weight").desc(), (F.col("pred") == F.col(fallback)).desc(), "pred")
    return tally.withColumn("_r", F.row_number().over(by)).where("_r = 1").select(*keys, "pred", "weight")


def bucket(votes: Column, high: int, medium: int) -> Column:
    """A confidence word for a number of votes."""
    return F.when(votes >= high, "high").when(votes >= medium, "medium").otherwise("low")


def gated(base: Column, agree: Column, override: Column, confidence: Column, least: int = 2) -> Column:
    """The override where at least ``least`` models agree on it and its confidence isn't low."""
    return F.when((agree >= least) & (confidence != "low"), override).otherwise(base)


def all_agree(*models: Column) -> Column:
    """Whether all models give one label."""
    out = F.lit(True)
    for a, b in zip(models, models[1:], strict=False):
        out = out & (a == b)
    return out


def ablations(votes: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Every vote once for each named set that its model belongs to, in ``ablation``."""
    names = F.filter(F.array(*[F.when(F.col("model").isin(m), F.lit(n)) for n, m in sets.items()]), lambda x: x.isNotNull())
    return votes.withColumn("ablation", F.explode(names))


def gate(flag: Column, votes: DataFrame, families: dict[bool, list[str]], priority: list[str], *keys: str) -> DataFrame:
    """Plurality among the labels of the family that the row's gate opens; ``flag`` is a boolean over the votes."""
    allowed = F.when(flag, F.col("pred").isin(families[True])).otherwise(F.col("pred").isin(families[False]))
    return plurality(votes.where(allowed), priority, *keys)
