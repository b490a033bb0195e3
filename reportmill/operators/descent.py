"""Linear models of many rows by full-batch gradient steps, a Spark job for each step.

A step reads the rows' packed vectors once, meets each with the weights of its
held-out fold, and adds the gradient up by (fold, class, feature) within the task,
so a task sends no more than folds times classes times features, however many
rows there are.  The weights, of that same size, go from the driver to the tasks.
The number of steps is fixed and all rows count alike, so SQL can say the same.
The seeded descent of ``models`` goes through the rows one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..scratch import written
from .features import PACKED, flat

STEPS, RATE, DECAY, L2 = 10, 4.0, 0.02, 5e-4


def training_rows(vectors: DataFrame, folds: DataFrame, key: str, label: str, by: str = "fold") -> DataFrame:
    """(held, key, label, by, x): every row by the vector of each held-out fold, x being features.PACKED.

    ``vectors`` is as of ``features.fold_vectors``.  A row without a known term
    has an empty vector.  ``folds`` that has ``held`` and ``x`` is returned as it
    is: rows of ``features.fold_rows``, whose long view ``vectors`` then is.
    """
    if "x" in folds.columns:
        return folds.select("held", key, label, by, "x")
    packed = vectors.groupBy("held", key).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "weight"))).alias("x"))
    held = folds.select(F.col(by).alias("held")).distinct()
    rows = folds.select(key, label, by).crossJoin(F.broadcast(held))  # a row for each fold
    return rows.join(packed, ["held", key], "left").select("held", key, label, by, F.struct(F.col("x.idx").alias("i"), F.col("x.weight").alias("w")).cast(PACKED).alias("x"))


def _softmax(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each class's probability less its indicator."""
    e = np.exp(m - m.max(axis=1, keepdims=True))
    out = e / e.sum(axis=1, keepdims=True)
    out[np.arange(len(y)), y] -= 1
    return out


def _hinge(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One against the rest: minus its sign for each class whose margin is violated."""
    sign = np.full(m.shape, -1.0)
    sign[np.arange(len(y)), y] = 1.0
    return np.where(sign * m < 1, -sign, 0.0)


LOSSES = {"softmax": _softmax, "hinge": _hinge}


def _margins(b: pa.RecordBatch, held: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(margins by row and class, each row's fold, each feature's row, its place among all folds' features, its weight)."""
    place = {h: i for i, h in enumerate(held)}
    fold = np.array([place[h] for h in b.column("held").to_pylist()], np.int64)
    row, idx, value = flat(b.column("x"))
    at = fold[row] * w.shape[1] + idx + 1
    of_class = [np.bincount(row, value * w[:, :, c].ravel()[at], b.num_rows) + w[fold, 0, c] for c in range(w.shape[2])]
    return np.stack(of_class, axis=1), fold, row, at, value


def _fit(rows: DataFrame, label: str, classes: list[str], width: int, loss: str, by: str, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, l2: float = L2) -> tuple[list, np.ndarray]:
    """(folds, weights by fold, feature and class); feature 0 is the bias."""
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    used = rows.where((F.col(by) != F.col("held")) & F.col(label).isin(classes)).select("held", "x", y.cast("int").alias("y"))
    held = sorted(r[0] for r in rows.select("held").distinct().collect())  # one row for each fold
    known = dict(used.groupBy("held").count().collect())
    n = np.array([float(known.get(h, 1)) for h in held])
    w = np.zeros((len(held), width + 1, len(classes)))
    for t in range(steps):

        def pull(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            g = np.zeros((w.shape[0] * w.shape[1], w.shape[2]))
            for b in batches:
                if not b.num_rows:
                    continue
                m, fold, row, at, value = _margins(b, held, w)
                a = LOSSES[loss](m, b.column("y").to_numpy())
                for c in range(w.shape[2]):
                    g[:, c] += np.bincount(at, value * a[row, c], len(g)) + np.bincount(fold * w.shape[1], a[:, c], len(g))
            at, c = np.nonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(c, pa.int32()), pa.array(g[at, c])], names=["at", "c", "g"])

        sums = used.mapInArrow(pull, "at long, c int, g double").groupBy("at", "c").agg(F.sum("g").alias("g")).toPandas()  # folds times classes times features
        g = np.zeros((len(held) * (width + 1), len(classes)))
        g[sums["at"], sums["c"]] = sums["g"]
        shrink = l2 * w
        shrink[:, 0] = 0.0
        w = w - rate / (1 + decay * t) * (g.reshape(w.shape) / n[:, None, None] + shrink)
    return held, w


def fit(rows: DataFrame, label: str, classes: list[str], width: int, loss: str, by: str = "fold", **how) -> DataFrame:
    """(held, c, idx, w): weights of each held-out fold, learned from the rows of the other folds; idx 0 is the bias, which is not shrunk.

    ``rows`` is read once a step, so it should be a written table.
    Weights start at 0; step t moves them by rate / (1 + decay t) against the
    mean gradient.  Labels outside ``classes`` and null ones are left out.  A
    fold without training rows keeps zeros.
    """
    held, w = _fit(rows, label, classes, width, loss, by, **how)
    flat_rows = [(h, c, k, float(w[i, k, c])) for i, h in enumerate(held) for c in range(len(classes)) for k in range(width + 1)]
    return rows.sparkSession.createDataFrame(flat_rows, f"held {rows.schema['held'].dataType.simpleString()}, c int, idx int, w double")


def _all_folds(model: tuple[list, np.ndarray], held: list) -> tuple[list, np.ndarray]:
    """``model`` with zero weights for the folds that it has none of."""
    w = np.zeros((len(held), *model[1].shape[1:]))
    for h, own in zip(*model, strict=True):
        w[held.index(h)] = own
    return held, w


def predict(rows: DataFrame, model: tuple[list, np.ndarray], classes: list[str]) -> DataFrame:
    """``rows`` with ``pred``, the class of the greatest margin, ties to the first listed."""
    held, w = model
    names = np.array(classes, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = names[_margins(b, held, w)[0].argmax(axis=1)] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string())], names=[*b.schema.names, "pred"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("pred", StringType())]))


def cross_validated(vectors: DataFrame, folds: DataFrame, key: str, label: str, loss: str, width: int, by: str = "fold", stored: bool = False, **how) -> DataFrame:
    """(key, by, gold, pred): each row predicted by the model of the other folds; rows that are a written table (``stored``) are not written again."""
    rows = training_rows(vectors, folds, key, label, by)
    rows = rows if stored else written(rows, "rows")
    classes = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())  # the labels of a benchmark
    if not classes:
        return rows.select(key, by, F.col(label).alias("gold"), F.lit(None).cast("string").alias("pred")).limit(0)
    model = _fit(rows, label, classes, width, loss, by, **how)
    test = rows.where(F.col(by) == F.col("held"))
    return predict(test, model, classes).select(key, by, F.col(label).alias("gold"), "pred")


def two_stage(vectors: DataFrame, folds: DataFrame, key: str, label: str, loss: str, width: int, groups: dict[str, str], by: str = "fold", **how) -> DataFrame:
    """(key, by, gold, pred): a model of label groups, then the model of the predicted group's labels; labels without a group are their own."""
    rows = written(training_rows(vectors, folds, key, label, by), "rows")
    named = F.coalesce(*[F.when(F.col(label) == y, F.lit(g)) for y, g in groups.items()], F.col(label))
    rows = rows.withColumn("_group", named)
    labels = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())  # the labels of a benchmark
    if not labels:
        return rows.select(key, by, F.col(label).alias("gold"), F.lit(None).cast("string").alias("pred")).limit(0)
    families = sorted({groups.get(y, y) for y in labels})
    first = _fit(rows, "_group", families, width, loss, by, **how)
    test = predict(rows.where(F.col(by) == F.col("held")), first, families)
    inner = []
    for g in families:
        own = [y for y in labels if groups.get(y, y) == g]
        sent = test.where(F.col("pred") == g).drop("pred")
        model = _fit(rows.where(F.col("_group") == g), label, own, width, loss, by, **how) if len(own) > 1 else None
        if model is not None:
            model = _all_folds(model, first[0])
        inner.append(sent.withColumn("pred", F.lit(own[0])) if model is None else predict(sent, model, own))
    out = inner[0]
    for part in inner[1:]:
        out = out.unionByName(part)
    return out.select(key, by, F.col(label).alias("gold"), "pred")
