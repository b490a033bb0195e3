"""Splits, folds, quotas and greedy selections with explicit ties.

Ranks that every row needs come from a range partitioning (``ranked``), so a
label with most of the rows uses all tasks; windows remain only where few rows
of a group stay, which Spark cuts down before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import hash_bucket
from ..scratch import same_key, small, written


def rank_in(group: list[str | Column], order: list[str | Column]) -> Column:
    """1-based rank within a group, for the first few rows of each."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))


def ranked(df: DataFrame, group: list[str], order: list[str | Column], tasks: int | None = None) -> DataFrame:
    """Adds ``_rank``, the 1-based rank within the group, and ``_size``, the group's rows.

    Rows are range-partitioned by group and order into ``tasks`` parts (the
    session's shuffle partitions) and numbered within them; a row's rank is its
    number after the first of its group in its part, and the rows of its group
    in earlier parts.  So no task holds a group, only a range.  A null is a
    group like any other; rows of equal order are told apart by their hash.
    """
    parts = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*group, *order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    sorted_rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = written(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    counts = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row for each part, and one more for each further group in it
    of_group = Window.partitionBy(*group)
    before = F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = small(written(counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_size": F.sum("_n").over(of_group)}).drop("_n"), "starts")).alias("starts")
    joined = rows.join(starts, [rows["_part"] == starts["_part"], *same_key(rows, starts, group)])
    return joined.select(*[rows[c] for c in df.columns], (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("_rank"), "_size")


def kfold(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """Adds ``fold``: the rank within the label, modulo k."""
    return ranked(df, [label], [key]).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")


def kfold_of(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """``kfold`` for rows with texts: keys and labels alone are ranked, and joined back by ``key``, which tells rows apart."""
    return df.join(kfold(df.select(key, label), label, key, k).select(key, "fold"), key)


def split_10(df: DataFrame, label: str, key: str) -> DataFrame:
    """Adds ``split``: of ten rows of a label one test, one validation, eight train."""
    at = (F.col("_rank") - 1) % 10
    return ranked(df, [label], [key]).withColumn("split", F.when(at == 0, "test").when(at == 1, "validation").otherwise("train")).drop("_rank", "_size")


def holdout(df: DataFrame, label: str, key: str, share: float = 0.2) -> DataFrame:
    """Adds ``held``: every stride-th row of a label, round(n * share) rows and at least one."""
    n, at = F.col("_size"), F.col("_rank") - 1
    wanted = F.greatest(F.lit(1), F.bround(n * F.lit(share), 0)).cast("long")
    stride = F.greatest(F.lit(1), F.bround(n / wanted, 0)).cast("long")
    return ranked(df, [label], [key]).withColumn("held", (at % stride == 0) & (F.floor(at / stride) < wanted)).drop("_rank", "_size")


def hash_split(df: DataFrame, key: Column, buckets: int = 10, train_below: int = 8) -> DataFrame:
    """Adds ``bucket`` and ``split`` by the key's SHA-256; no shuffle."""
    return df.withColumn("bucket", hash_bucket(key, buckets)).withColumn("split", F.when(F.col("bucket") < train_below, "train").otherwise("test"))


def chronological(df: DataFrame, ts: str, key: str, share: float = 0.8) -> DataFrame:
    """Adds ``split``: the first floor(n * share) rows by time (null first) and key train, the rest test.

    The cut is found from counts by day and then within one day, so no task
    sorts the whole table.
    """
    day = F.coalesce(F.to_date(ts), F.lit("0001-01-01").cast("date"))
    dated = df.withColumn("_day", day)
    by_day = dated.groupBy("_day").agg(F.count("*").alias("n"))
    order = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    by_day = by_day.select("_day", F.sum("n").over(order).alias("upto"), "n", F.floor(F.sum("n").over(Window.partitionBy()) * F.lit(share)).alias("cut"))
    joined = dated.join(by_day, "_day")
    within = F.row_number().over(Window.partitionBy("_day").orderBy(F.col(ts).asc_nulls_first(), key))
    edge = joined.where("upto - n < cut and cut < upto").withColumn("_r", F.col("upto") - F.col("n") + within).withColumn("split", F.when(F.col("_r") <= F.col("cut"), "train").otherwise("test")).drop("_r")
    rest = joined.where("not (upto - n < cut and cut < upto)").withColumn("split", F.when(F.col("upto") <= F.col("cut"), "train").otherwise("test"))
    return edge.unionByName(rest).drop("_day", "upto", "n", "cut")


def first_per(df: DataFrame, group: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_r", rank_in(group, order)).where(F.col("_r") <= n).drop("_r")


def temporal_spread(df: DataFrame, group: list[str], order: list[str | Column], limit: int) -> DataFrame:
    """At most ``limit`` rows of each group, evenly spread over its order, first and last included."""
    n, at = F.col("_size"), F.col("_rank") - 1
    if limit == 1:
        picked = at == 0
    else:
        picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (n - 1) / F.lit(limit - 1), 0).cast("long"))
        picked = (n <= limit) | F.array_contains(picks, at)
    return ranked(df, group, order).where(picked).drop("_rank", "_size")


def hashed_cap(df: DataFrame, label: str, key: Column, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each label in a seeded hash order."""
    return first_per(df, [label], [F.sha1(F.concat(F.lit(f"{seed}|"), key).cast("binary"))], cap)


def capped_queue(df: DataFrame, label: str, score: str, ties: list[str], cap: int, size: int) -> DataFrame:
    """``size`` rows by score, those beyond ``cap`` of a label only after all others; adds ``place``."""
    order = [F.col(score).desc(), *ties]
    classed = df.withColumn("_class", (rank_in([label], order) > cap).cast("int"))
    top = classed.orderBy("_class", *order).limit(size)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_class", *order))).drop("_class")


def double_capped(df: DataFrame, first: str, second: str, order: list[str | Column], caps: tuple[int, int], size: int) -> DataFrame:
    """The first ``size`` rows that a walk in order takes, passing over rows of a full ``first`` or ``second`` value.

    The walk is settled in rounds.  Of a value's open rows, as many as it has
    places left cannot be crowded out; a row is taken once that holds for both
    its values, and given up once either is full.  The first open row is always
    settled, so rounds end, and every round settles rows of all values at once;
    no task sees more rows of a value than its cap.  A null is a value like any
    other.  ``order`` should tell all rows apart.
    """
    pair = [first, second]
    # No more than the smaller cap of a pair of values can be taken.
    narrow = df.withColumn("_r", rank_in(pair, order)).where(F.col("_r") <= min(caps)).drop("_r")
    rows = written(narrow.withColumn("_row", F.monotonically_increasing_id()), "rows")
    open_rows, taken = rows, None
    while open_rows.limit(1).count():
        near, full = [], []
        for value, cap in zip(pair, caps, strict=True):
            left = F.lit(cap)
            ahead = open_rows.withColumn("_r", rank_in([value], order)).where(F.col("_r") <= cap)
            if taken is not None:
                used = written(taken.groupBy(value).agg(F.count("*").alias("_used")), "used")
                full.append((value, small(used.where(F.col("_used") >= cap))))
                used = small(used)
                ahead = ahead.join(used, same_key(ahead, used, [value]), "left").drop(used[value])
                left = left - F.coalesce("_used", F.lit(0))
            near.append(ahead.where(F.col("_r") <= left).select("_row"))
        now = written(near[0].join(near[1], "_row"), "now")
        chosen = written(rows.join(now, "_row", "left_semi"), "taken")
        taken = chosen if taken is None else taken.unionByName(chosen)
        left_rows = open_rows.join(now, "_row", "left_anti")
        for value, gone in full:
            left_rows = left_rows.join(gone, same_key(left_rows, gone, [value]), "left_anti")
        open_rows = written(left_rows, "open")
    return (rows if taken is None else taken).drop("_row").orderBy(*order).limit(size)


def stacked_limits(df: DataFrame, label: str, order: list[str | Column], per_label: int, size: int) -> DataFrame:
    """The first rows of each label, then the first ``size`` of those by label."""
    return first_per(df, [label], order, per_label).orderBy(label, *order).limit(size)


def few_shot(df: DataFrame, label: str, order: list[str | Column], n: int, key: str) -> DataFrame:
    """(label, pool): the first n keys of each label in order."""
    top = df.withColumn("_r", rank_in([label], order)).where(F.col("_r") <= n)
    return top.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", key))), lambda s: s[key]).alias("pool"))


def oversample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Rows repeated until every label has as many as the largest: whole repeats, then the first by key; adds ``copy``."""
    rows = ranked(df, [label], [key])
    most = rows.agg(F.max("_size").alias("_most"))
    times = F.floor(F.col("_most") / F.col("_size")) + (F.col("_rank") <= F.col("_most") % F.col("_size")).cast("long")
    return rows.crossJoin(F.broadcast(most)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("_size", "_most", "_rank")  # one row


def batches(df: DataFrame, group: list[str], order: list[str | Column], size: int) -> DataFrame:
    """Adds ``batch``: the number of the mini-batch within the group."""
    return ranked(df, group, order).withColumn("batch", F.floor((F.col("_rank") - 1) / size)).drop("_rank", "_size")
