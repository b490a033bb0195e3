"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length into buckets of bounded size.  The longest buckets
give every query a first threshold.  A bucket whose greatest length cannot
reach any threshold of a block of queries is never loaded for it.  In the
others each query has a local cosine threshold, its threshold over the two
lengths: where that is high, candidates are pruned by the query's largest
coordinate, else by length alone; what is left is verified by its product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .sizes import small
from .workspace import bound_batches, materialize

BUCKET = 8192
QUERY_BLOCK = 1024
#: Query blocks that one task meets with a bucket.
GROUP = 32
#: Buckets that give the first thresholds.
SEED_BUCKETS = 2
#: Local cosine from which pruning by coordinate is worth its cost.
COORDINATE_FROM = 0.7


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int, is_query: Column) -> DataFrame:
    """(vec_id, is_query, v, norm) of the rows that take part: no null, no component null or not finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = lambda x: F.when(F.abs(x * F.lit(float(scale))) < F.lit(2.0**63), F.floor(x * F.lit(float(scale))).cast("long")).otherwise(F.raise_error(F.lit("a scaled component is beyond a long")))
    whole = F.transform(v, fits)
    rows = vectors.where(v.isNotNull() & fine & F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), whole.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _blocks(width: int, rows: int):
    """Sorted rows to blocks: ids, row numbers and a matrix of ``width`` columns, shorter vectors ending in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(part: list[tuple]) -> pa.RecordBatch:
            matrix = np.zeros((len(part), width), np.int64)
            for i, (_, _, v, _) in enumerate(part):
                matrix[i, : len(v)] = v
            norms = np.array([x[3] for x in part])
            return pa.RecordBatch.from_arrays(
                [pa.array([float(norms.max())]), pa.array([np.array([x[0] for x in part], np.int64).tobytes()]), pa.array([np.array([x[1] for x in part], np.int64).tobytes()]), pa.array([matrix.astype("<i4" if np.abs(matrix).max(initial=0) < 1 << 31 and matrix.min(initial=0) > -(1 << 31) else "<i8").tobytes()]), pa.array([norms.tobytes()])],
                names=["top", "ids", "row_nos", "matrix", "norms"],
            )

        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            while len(held) >= rows:
                yield block(held[:rows])
                held = held[rows:]
        if held:
            yield block(held)

    return run


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where no sum can leave its integers, in longs, else in unbounded integers."""
    most = max(abs(int(x)) for x in (q.min(initial=0), q.max(initial=0))) * max(abs(int(x)) for x in (p.min(initial=0), p.max(initial=0))) * q.shape[1]
    if most < 1 << 52:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return q @ p.T
    return q.astype(object) @ p.astype(object).T


def _search(k: int, width: int):
    """Rows sorted by bucket and group, the bucket before its query blocks, to each query's best k of the bucket that can reach its threshold."""

    def best(q: np.ndarray, q_no: np.ndarray, q_norm: np.ndarray, floor: np.ndarray, p: np.ndarray, ids: np.ndarray, nos: np.ndarray, norms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        slack = 1e-9 * (1.0 + np.abs(floor))
        top = norms.max(initial=0.0)
        live = np.flatnonzero(q_norm * top >= floor - slack)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(q_norm * top > 0, (floor - slack) / (q_norm * top), -1.0)
            unit = np.where(norms[:, None] > 0, p / norms[:, None], 0.0)
        by_length = [i for i in live if not local[i] > COORDINATE_FROM]
        for at in range(0, len(by_length), 256):
            part = by_length[at : at + 256]
            for i, scores in zip(part, _products(q[part], p), strict=True):
                yield i, np.arange(len(p)), scores
        for i in (i for i in live if local[i] > COORDINATE_FROM):
            f = int(np.abs(q[i]).argmax())
            a = q[i, f] / q_norm[i]
            bound = a * unit[:, f] + np.sqrt(max(0.0, 1 - a * a)) * np.sqrt(np.maximum(0.0, 1 - unit[:, f] ** 2))
            near = np.flatnonzero(bound * norms * q_norm[i] >= floor[i] - slack[i] - 1e-9 * q_norm[i] * norms)
            if len(near):
                yield i, near, _products(q[i : i + 1], p[near])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        risen: dict[int, np.ndarray] = {}
        held: tuple | None = None
        whole = lambda raw, n: np.frombuffer(raw, "<i4" if len(raw) == 4 * n * width else "<i8").reshape(n, width).astype(np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    ids, nos = (np.frombuffer(r[c], np.int64) for c in ("ids", "row_nos"))
                    held, p, norms = (r["bucket"], r["grp"]), whole(r["matrix"], len(ids)), np.frombuffer(r["norms"])
                    continue
                if held != (r["bucket"], r["grp"]):
                    raise RuntimeError("query blocks came without their bucket")
                q_id, q_no = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "q_row_nos"))
                q, q_norm = whole(r["q_matrix"], len(q_id)), np.frombuffer(r["q_norms"])
                floor = np.frombuffer(r["q_floor"]).copy() if r["q_floor"] else np.full(len(q), -np.inf)
                if len(risen) > 64:
                    risen.clear()
                floor = np.maximum(floor, risen.get(r["q_block"], floor))
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i, at, scores in best(q, q_no, q_norm, floor, p, ids, nos, norms):
                    keep = (nos[at] != q_no[i]) & (scores >= floor[i])
                    at, scores = at[keep], scores[keep]
                    if len(at) > k:
                        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                        at, scores = at[scores >= edge], scores[scores >= edge]
                        order = np.lexsort((ids[at], -scores))[:k]
                        at, scores = at[order], scores[order]
                    if scores.dtype == object:
                        if any(not -(1 << 63) <= x < 1 << 63 for x in scores):
                            raise OverflowError("an inner product is beyond a long")
                        scores = scores.astype(np.int64)
                    if len(at) == k:
                        floor[i] = max(floor[i], float(scores.min()))
                    for column, values in zip(out, (np.full(len(at), q_id[i]), np.full(len(at), q_no[i]), ids[at], scores), strict=True):
                        column.append(values)
                risen[r["q_block"]] = floor
                columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "q_no", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows by integer inner product.

    Components x become floor(scale * x); ties go to the smaller id.  The query
    rows meet all rows in blocks.

    Defined cases: vectors that are null, or hold a null or non-finite
    component, and rows with a null id take no part; shorter vectors count as
    ending in zeros; an empty vector has product 0 with all; a scaled component
    or a product beyond a long is an error; repeated query rows each get their own ranks;
    a table with one row or none gives an empty result; other columns are ignored.
    """
    bound_batches(vectors.sparkSession, rows=2048)
    rows = materialize(scaled(vectors, id_col, vector_col, scale, is_query).withColumn("row_no", F.monotonically_increasing_id()), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.count_if("is_query").alias("q")).first()
    width = max(1, counts.width)
    wanted = ["vec_id", "row_no", "v", "norm"]
    schema = "top double, ids binary, row_nos binary, matrix binary, norms binary"
    by_length = rows.select(*wanted).repartitionByRange(max(1, -(-counts.n // BUCKET)), F.col("norm").desc(), "row_no").sortWithinPartitions(F.col("norm").desc(), "row_no")
    buckets = materialize(by_length.mapInArrow(_blocks(width, BUCKET), schema).withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    asked = rows.where("is_query").select(*wanted).repartitionByRange(max(1, -(-counts.q // QUERY_BLOCK)), F.col("norm").desc(), "row_no").sortWithinPartitions(F.col("norm").desc(), "row_no")
    queries = asked.mapInArrow(_blocks(width, QUERY_BLOCK), schema).withColumn("q_raw", F.monotonically_increasing_id())
    queries = materialize(queries.select("q_raw", *[F.col(c).alias(f"q_{c}") for c in ("top", "ids", "row_nos", "matrix", "norms")]), "queries")
    # Numbers from 0 for the blocks, one row for each QUERY_BLOCK queries.
    numbered = materialize(queries.select("q_raw", (F.row_number().over(Window.orderBy("q_raw")) - 1).cast("long").alias("q_block")), "query_blocks")
    n_blocks, n_buckets = numbered.count(), max(1, -(-counts.n // BUCKET))
    queries = queries.join(small(numbered), "q_raw").drop("q_raw")
    found_schema = "query_id long, q_no long, vec_id long, score long"
    if not n_blocks:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def meet(some: DataFrame, floors: DataFrame | None) -> DataFrame:
        pairs = some.select("bucket", "top").withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        if floors is None:
            pairs = pairs.withColumn("q_floor", F.lit(None).cast("binary"))
        else:  # the least length with which a bucket can reach any query of the block
            pairs = pairs.join(floors, "q_block").where(F.col("top") >= F.col("reach"))
        pairs = pairs.select("bucket", "q_block", "q_floor", F.floor(F.col("q_block") / GROUP).cast("long").alias("grp"))
        # A bucket is sent once for each group of query blocks that reach it, the blocks follow it one by one.
        sent = pairs.join(queries.drop("q_top"), "q_block").withColumn("kind", F.lit(1))
        still = some.drop("top").join(pairs.select("bucket", "grp").distinct(), "bucket").withColumn("kind", F.lit(0))
        rows = sent.unionByName(still, allowMissingColumns=True).repartition(max(1, min(n_buckets * -(-n_blocks // GROUP), 20_000)), "bucket", "grp")
        return rows.sortWithinPartitions("bucket", "grp", "kind", "q_block").mapInArrow(_search(k, width), found_schema)

    order = Window.partitionBy("q_no").orderBy(F.col("score").desc(), "vec_id")
    seeds = buckets.orderBy(F.col("top").desc(), "bucket").limit(SEED_BUCKETS).select("bucket")
    first = materialize(meet(buckets.join(F.broadcast(seeds), "bucket", "left_semi"), None), "first")
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("q_no", F.col("score").alias("floor"))
    floors = materialize(_floors(queries, floors), "floors")
    rest = materialize(meet(buckets.join(F.broadcast(seeds), "bucket", "left_anti"), floors), "rest")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _floors(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(q_block, q_floor, reach) from the thresholds (q_no, floor) found so far."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, nos in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(nos, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(len(own))), pa.array(own)], names=["q_block", "place", "q_no"])

    placed = queries.select("q_block", "q_row_nos").mapInArrow(numbers, "q_block long, place long, q_no long").join(found, "q_no", "left")
    listed = placed.groupBy("q_block").agg(F.collect_list(F.struct("place", "floor")).alias("floors")).join(queries.select("q_block", "q_norms"), "q_block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, floors, norms in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                floor = np.full(len(floors), -np.inf)
                for f in floors:
                    if f["floor"] is not None:
                        floor[f["place"]] = f["floor"]
                norm = np.frombuffer(norms)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(floor <= 0, 0.0, np.where(norm > 0, floor / norm, np.inf))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([floor.tobytes()], pa.binary()), pa.array([float(reach.min()) * (1 - 1e-9)])], names=["q_block", "q_floor", "reach"])

    return listed.mapInArrow(pack, "q_block long, q_floor binary, reach double")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.no, q.vec_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.e, p.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v p ON q.no <> p.no WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
