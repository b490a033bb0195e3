"""Deduplication, unions of pools, overlays and back-fills with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..sources.tables import observed


def keep_one(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    In an order of plain columns this is a minimum, of which each task sends
    one row a key; only for other orders rows are sorted by key.
    """
    if all(isinstance(o, str) for o in order):
        return _picked(df, key, F.min_by(F.struct(*df.columns), F.struct(*order)))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def _picked(df: DataFrame, key: list[str], row: Column) -> DataFrame:
    return df.groupBy(*key).agg(row.alias("_row")).select(*[F.col("_row")[c].alias(c) for c in df.columns])


def keep_last(df: DataFrame, key: list[str], *position: str) -> DataFrame:
    """The last row of each key by position, null positions first; each task sends one row a key."""
    return _picked(df, key, F.max_by(F.struct(*df.columns), F.struct(*position)))


def _descending(df: DataFrame, score: str) -> Column:
    """What sorts rows by a numeric score from the greatest down: not a number first, null last."""
    if df.schema[score].dataType.typeName() in ("double", "float"):
        return F.struct(F.col(score).isNull().alias("a"), (~F.isnan(score)).alias("b"), (-F.col(score)).alias("c"))
    return F.struct(F.col(score).isNull().alias("a"), F.lit(True).alias("b"), (-F.col(score).cast("decimal(38,10)") if df.schema[score].dataType.typeName() in ("long", "integer", "short", "byte") else -F.col(score)).alias("c"))


def keep_best(df: DataFrame, key: list[str], score: str, *position: str) -> DataFrame:
    """The row of highest numeric score of each key, ties to the earliest position; each task sends one row a key."""
    return _picked(df, key, F.min_by(F.struct(*df.columns), F.struct(_descending(df, score).alias("score"), *position)))


def pool_union(pools: list[DataFrame], key: str, score: str, exclude: DataFrame, *position: str) -> DataFrame:
    """The best row of each key over the pools, earlier pools winning ties, without the excluded keys; adds ``pool``."""
    tagged = [p.withColumn("pool", F.lit(i)) for i, p in enumerate(pools)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p)
    return keep_best(union.join(exclude.select(key), key, "left_anti"), [key], score, "pool", *position)


def _judged(base: DataFrame, more: DataFrame, key: str, complete: Column, *position: str) -> DataFrame:
    """``more`` with ``outcome``: incomplete, duplicate or appended."""
    known = base.select(key).distinct().withColumn("_known", F.lit(True))
    judged = more.join(known, key, "left").withColumn("_r", F.row_number().over(Window.partitionBy(key, complete).orderBy(*position)))
    outcome = F.when(~complete, "incomplete").when(F.col("_known") | (F.col("_r") > 1), "duplicate").otherwise("appended")
    return judged.withColumn("outcome", outcome)


def append_merge(base: DataFrame, more: DataFrame, key: str, complete: Column, *position: str) -> tuple[DataFrame, DataFrame]:
    """(merged rows, counts by outcome): complete rows of new keys are appended, the first of each key."""
    judged = _judged(base, more, key, complete, *position)
    merged = base.unionByName(judged.where("outcome = 'appended'").select(*base.columns))
    return merged, judged.groupBy("outcome").agg(F.count("*").alias("n"))


def observed_merge(base: DataFrame, more: DataFrame, key: str, complete: Column, *position: str) -> tuple[DataFrame, Observation]:
    """(merged rows, counts): as ``append_merge``, with the outcomes counted in the pass that merges."""
    judged, seen = observed(_judged(base, more, key, complete, *position), **{x: F.col("outcome") == x for x in ("incomplete", "duplicate", "appended")})
    return base.unionByName(judged.where("outcome = 'appended'").select(*base.columns)), seen


def overlay(base: DataFrame, patches: list[DataFrame], key: str, value: str, position: str | None = None) -> DataFrame:
    """``base`` with values of (key, value) patches, later patches winning; adds ``previous``, ``changed`` and ``patch``.

    Within a patch the row of the greatest ``position`` wins, or without one
    that of the smallest value.
    """
    place = F.col(position) if position else F.lit(None).cast("int")
    tagged = [p.select(key, F.col(value).alias("_value"), F.lit(i).alias("patch"), place.alias("_place")) for i, p in enumerate(patches, 1)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p)
    best = F.max_by(F.struct("_value", "patch"), F.struct("patch", "_place")) if position else F.min_by(F.struct("_value", "patch"), F.struct(-F.col("patch"), "_value"))
    last = union.groupBy(key).agg(best.alias("_last")).select(key, "_last._value", "_last.patch")
    joined = base.join(last, key, "left")
    new = F.coalesce("_value", value)
    return joined.withColumns({"previous": F.col(value), "changed": ~F.col(value).eqNullSafe(new), value: new}).drop("_value")


def coalescing_join(base: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str, own: str) -> DataFrame:
    """``base`` with the first non-null value of several keyed sources, else its own; adds ``origin``."""
    out = base
    for i, (_, s) in enumerate(sources):
        out = out.join(keep_one(s, [key], [value]).select(key, F.col(value).alias(f"_v{i}")), key, "left")
    names = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(sources)], F.lit("own"))
    return out.withColumns({value: F.coalesce(*[F.col(f"_v{i}") for i in range(len(sources))], F.col(own)), "origin": names}).drop(*[f"_v{i}" for i in range(len(sources))])


def back_fill(tiers: list[tuple[str, DataFrame]], key: str, score: str, target: int) -> DataFrame:
    """The first ``target`` rows over ranked tiers, each key from its first tier; adds ``provenance`` and ``tier``."""
    tagged = [t.withColumns({"provenance": F.lit(n), "tier": F.lit(i)}) for i, (n, t) in enumerate(tiers)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    return keep_one(union, [key], ["tier", F.col(score).desc()]).orderBy("tier", F.col(score).desc(), key).limit(target)


def checked_inner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises KeyError if a key of ``left`` is missing on the right."""
    missing = left.join(right, key, "left_anti").select(key).limit(5).collect()
    if missing:
        raise KeyError(f"{key} without a match: {[r[0] for r in missing]}")
    return left.join(right, key)


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """Left join with the first right row of each key."""
    return left.join(keep_one(right, [key], order), key, "left")
