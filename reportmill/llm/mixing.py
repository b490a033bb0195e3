"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket.  In each source the running sum
shows the bucket in which its budget ends; only the documents of that boundary
bucket are summed again, by finer buckets, until a single hash is left.  A
document is in the mix if its hash lies below its source's threshold, so
nothing is sorted, and a larger budget always takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sizes import small
from .workspace import materialize

#: The hash has HASH_BITS bits, of which each round of histograms settles ROUND_BITS.
HASH_BITS = 60
ROUND_BITS = 15


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(key: Column) -> Column:
    """The first 60 bits of the md5 digest of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): weights dealt out by code point, and no target above cap times its source.

    What a capped source can't take is shared again by weight, which ends at one
    rate per unit of weight; sources are capped in order of cap to weight, so
    that rate is read off running sums.  One row for each source only.
    """
    every, before = Window.partitionBy(), Window.orderBy("limit_rate", "place").rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = totals.withColumn("place", place).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1))
    rows = rows.withColumns({"limit": F.lit(float(cap)) * F.col("source_size"), "limit_rate": F.lit(float(cap)) * F.col("source_size") / F.col("weight")})
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("rate", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    settled = F.min(F.when(F.col("rate") <= F.col("limit_rate"), F.struct("limit_rate", "place", "rate"))).over(every)
    rows = rows.withColumn("final", settled["rate"])
    return rows.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("limit_rate") < F.col("final")), F.col("limit")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def _with(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Inner join on source, null matching null."""
    right = small(by_source.withColumnRenamed("source", "_source"))
    return rows.join(right, rows["source"].eqNullSafe(right["_source"])).drop("_source")


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """One row per source: (source, source_size, target, whole, below) from rows (source, size, h).

    Every document of the source is taken ``whole`` times, and once more if its
    hash is under ``below``.

    Defined cases: a null source is a source, last in order; a source of size 0
    has target 0 and is not taken; null and repeated ids share their hash and go
    together; an empty table gives an empty plan.
    """
    plan = _targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan, "plan")
    state = plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    inside, last = sized.select("source", "size", "h"), None
    for settled in range(ROUND_BITS, HASH_BITS + 1, ROUND_BITS):
        shift = HASH_BITS - settled
        histogram = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        histogram = _with(histogram.withColumn("upto", F.sum("size").over(running)), state)
        # A budget ends in the first bucket that exceeds it; a single hash is left out if that brings the sum nearer.
        over = F.col("upto") > F.col("rest") if shift else 2 * F.col("upto") - F.col("size") > 2 * F.col("rest")
        found = histogram.where(over).groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))).alias("b"))
        found = materialize(found.select("source", F.col("b.bucket").alias("bucket"), "b.rest"), "boundary")
        if shift:
            inside = materialize(_with(inside, found).where(F.shiftright("h", shift) == F.col("bucket")).select("source", "size", "h"), "inside")
            state, last = found.select("source", "rest"), found.select("source", F.shiftleft(F.col("bucket") + 1, shift).alias("end"))
    ends = last.join(found.withColumnRenamed("source", "_source"), last["source"].eqNullSafe(F.col("_source")), "left").select("source", F.coalesce("bucket", "end").alias("below"))
    ends = ends.withColumnRenamed("source", "_source")
    plan = plan.join(ends, plan["source"].eqNullSafe(F.col("_source")), "left")
    return materialize(plan.select("source", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")), "plan")


def size_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Written rows (id, source, size, h), all that the plan needs of a document."""
    return materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), unit_hash(F.col(id_col)).alias("h")), "sized")


def copies(rows: DataFrame, plan: DataFrame, source_col: str = "source", hash_value: Column | None = None) -> DataFrame:
    """Adds the plan's columns and ``copies``: how often the mix takes each row."""
    plan = small(plan.withColumnRenamed("source", "_source"))
    h = hash_value if hash_value is not None else F.col("h")
    joined = rows.join(plan, rows[source_col].cast("string").eqNullSafe(plan["_source"])).drop("_source")
    return joined.withColumn("copies", F.col("whole") + (h < F.col("below")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """One row per document: (id_col, source, size, source_size, target, copies, taken).

    ``weights`` go to the sources by code point, repeating, null last; the
    targets share ``share`` of all sizes and stop at ``cap`` times their source.
    taken is size * copies; reruns agree, since the hash depends on the id only.

    Defined cases: a null or empty text has size 0; null is a source of its
    own; rows with one id in one source are taken or left together (a null id
    counts as the empty string); a source of size 0 has target 0; an empty table
    gives an empty result; other columns are ignored.
    """
    sized = size_table(docs, id_col, text_col, source_col)
    mixed = copies(sized, mix_plan(sized, weights, share, cap))
    return mixed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns only.

    Defined cases: as in ``mix_plan``; columns of any name are kept as they are;
    a row without words goes with its hash; an empty table stays empty.
    """
    plan = mix_plan(size_table(docs, id_col, text_col, source_col), **options)
    names = docs.columns
    hidden = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source_col).alias("source"), unit_hash(F.col(id_col)).alias("h"))
    taken = copies(hidden, plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in names])


ORACLE = r"""
WITH s AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM t),
v AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM w),
r AS (SELECT *, cap / weight AS cap_rate FROM v),
q AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS rate FROM r
WINDOW b AS (ORDER BY cap_rate, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rate AS final FROM q WHERE rate <= cap_rate ORDER BY cap_rate, place LIMIT 1),
p AS (SELECT q.*, CASE WHEN final IS NULL OR cap_rate < final THEN cap ELSE final * weight END AS target FROM q LEFT JOIN f ON true),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM p),
g AS (SELECT source, h, sum(size) AS part FROM s GROUP BY source, h),
c AS (SELECT *, sum(part) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM g)
SELECT s.doc_id, s.size, k.source_size, k.target, (s.size * (k.whole + CASE WHEN 2 * c.upto - c.part <= 2 * (k.target - k.whole * k.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN k ON s.source IS NOT DISTINCT FROM k.source JOIN c ON c.source IS NOT DISTINCT FROM s.source AND c.h = s.h
"""
