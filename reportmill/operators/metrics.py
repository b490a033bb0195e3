"""Agreement and classification metrics over long tables.

Predictions are rows (keys..., gold, pred); every function takes the grouping
keys, so all models, folds or thresholds are scored in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key with their share of all rows, most common first."""
    grouped = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return grouped.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``values`` by row, 0 where there are none, and the row's total."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    return wide.join(df.groupBy(row).agg(F.count("*").alias("total")), row)


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred", *keys: str) -> DataFrame:
    """(keys, gold, pred, n)."""
    return df.groupBy(*keys, gold, pred).agg(F.count("*").alias("n"))


def _marks(df: DataFrame, *keys: str, gold: str, pred: str) -> DataFrame:
    """``per_label`` with a row for rows without a label, and ``judged``, the rows that have both sides."""
    hit = F.col(gold) == F.col(pred)
    side = lambda label, g, p, h, j: F.struct(F.col(label).alias("label"), F.lit(g).cast("long").alias("g"), F.lit(p).cast("long").alias("p"), h.cast("long").alias("h"), j.cast("long").alias("j"))
    sides = F.array(side(gold, 1, 0, F.coalesce(hit, F.lit(False)), hit.isNotNull()), side(pred, 0, 1, F.lit(0), F.lit(0)))
    rows = df.select(*keys, F.inline(sides))
    out = rows.groupBy(*keys, "label").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"), F.sum("j").alias("judged"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def per_label(df: DataFrame, *keys: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(keys, label, support, predicted, hits, precision, recall, f1) for all labels that are gold or predicted; 0/0 is 0.

    Each row is turned into at most two label rows before one aggregation, so
    the pass is linear and combines map-side.
    """
    return _marks(df, *keys, gold=gold, pred=pred).where(F.col("label").isNotNull()).drop("judged")


def summary(df: DataFrame, *keys: str, gold: str = "gold", pred: str = "pred", labels: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """(keys, answered, accuracy, macro_f1).

    macro_f1 is the mean over the labels that occur, or over ``labels``, where
    an absent one counts as 0, of F1 scores rounded to ``digits`` if given.
    All three come from one table of marks by label, so ``df`` is read once.
    """
    marks = _marks(df, *keys, gold=gold, pred=pred)
    f1 = F.col("f1") if digits is None else F.round("f1", digits)
    if labels is None:
        macro = F.avg(F.when(F.col("label").isNotNull(), f1))
    else:
        macro = F.sum(F.when(F.col("label").isin(labels), f1)) / len(labels)
    hits, judged = F.sum("hits"), F.sum("judged")
    return marks.groupBy(*keys).agg(F.coalesce(F.sum("support"), F.lit(0)).alias("answered"), F.when(judged > 0, hits / judged).alias("accuracy"), F.coalesce(macro, F.lit(0.0)).alias("macro_f1"))


def kappa(df: DataFrame, a: str, b: str, *keys: str, degenerate: float = 1.0, labels: list[str] | None = None) -> DataFrame:
    """(keys, n, observed, expected, kappa); ``degenerate`` where the expected agreement is 1.

    ``labels`` holds the expected agreement to a fixed vocabulary.
    """
    pairs = df.groupBy(*keys, a, b).agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys)
    total = pairs.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)) / F.sum("c")).alias("observed"))
    sides = F.array(F.struct(F.col(a).alias("label"), F.col("c").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col(b).alias("label"), F.lit(0).cast("long").alias("x"), F.col("c").alias("y")))
    margins = pairs.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, "s.label").agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y"))
    margins = margins.withColumn("n", F.sum("x").over(by))
    if labels is not None:
        margins = margins.where(F.col("label").isin(labels))
    expected = margins.groupBy(*keys).agg(F.sum(F.col("x") / F.col("n") * (F.col("y") / F.col("n"))).alias("expected"))
    out = total.join(expected, list(keys)) if keys else total.crossJoin(expected)  # one row each
    return out.withColumn("kappa", F.when(F.col("expected") >= 1, F.lit(degenerate)).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two label arrays: 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def subsets(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Every row once for each named condition it meets, with the name in ``subset``."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]), lambda x: x.isNotNull())
    return df.withColumn("subset", F.explode(names))


def answered_only(df: DataFrame, *keys: str, answer: Column, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Scores of the rows that meet ``answer``, with their coverage of all rows."""
    total = df.groupBy(*keys).agg(F.count("*").alias("total"))
    scored = summary(df.where(answer), *keys, gold=gold, pred=pred)
    joined = scored.join(total, list(keys)) if keys else scored.crossJoin(total)  # one row each
    return joined.withColumn("coverage", F.col("answered") / F.col("total")).drop("total")


def selective_curve(df: DataFrame, votes: str, thresholds: range, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(threshold, answered, coverage, accuracy, macro_f1) for answers with at least so many votes."""
    steps = F.filter(F.sequence(F.lit(thresholds.start), F.lit(thresholds.stop - 1)), lambda t: t <= F.col(votes))
    every = F.lit(None).cast("int")  # a threshold that all rows meet, for the total
    swept = df.withColumn("threshold", F.explode(F.concat(F.array(every), F.coalesce(steps, F.array().cast("array<int>")))))
    scored = summary(swept, "threshold", gold=gold, pred=pred)
    total = F.max(F.when(F.col("threshold").isNull(), F.col("answered"))).over(Window.partitionBy())  # one row for each threshold
    return scored.withColumn("coverage", F.col("answered") / total).where("threshold is not null")


def best_by(df: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """(group, name, score) of each group's best row, ties to the first name."""
    return df.groupBy(group).agg(F.min_by(F.struct(name, score), F.struct(F.col(score).isNull(), -F.col(score), name)).alias("_row")).select(group, f"_row.{name}", f"_row.{score}")


def by_slice(df: DataFrame, slice_col: str, values: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Scores of each slice; a slice without rows has zeros."""
    spark = df.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{slice_col} string")
    return every.join(summary(df, slice_col, gold=gold, pred=pred), slice_col, "left").na.fill(0)
