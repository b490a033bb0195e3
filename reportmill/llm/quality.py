"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios.

Indicators are n-grams of words and of word shapes (letters, digits and case
collapsed to classes, marks kept, a word that repeats its predecessor marked),
and the share that each shape has of the text, in eighths.  The model is fitted
by dual coordinate descent on a bounded sample of labelled rows; every text is
scored whole, in one pass over the table without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .hashing import U64, gram_hashes, mix64, string_buffer, word_hashes
from .sizes import BROADCAST_ROWS
from .workspace import bound_batches, materialize

#: Hashed indicator space; labelled rows and bytes of text used at most; passes over them.
BITS = 20
SAMPLE = 8_000
SAMPLE_BYTES = 64 << 20
EPOCHS = 12
THRESHOLD = 0.3

CLASS = np.arange(256, dtype=np.uint8)
CLASS[65:91] = ord("A")
CLASS[97:123] = ord("a")
CLASS[48:58] = ord("0")
CLASS[128:] = ord("a")


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words after runs of one class are collapsed, and each text's first word."""
    mapped = CLASS[data]
    keep = np.ones(len(mapped), dtype=bool)
    keep[1:] = mapped[1:] != mapped[:-1]
    keep[offsets[:-1][offsets[:-1] < len(keep)]] = True
    at = np.zeros(len(mapped) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return word_hashes(mapped[keep], at[offsets], lower=False)


def indicators(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct indicator ids of every text; a null or empty text has one, for no words."""
    data, offsets = string_buffer(column)
    words, first = word_hashes(data, offsets)
    shapes, _ = _shapes(data, offsets)
    with np.errstate(over="ignore"):
        shapes = shapes.copy()
        shapes[1:][words[1:] == words[:-1]] += U64(1)
        runs = [(words, 1, 1), (gram_hashes(words, 2), 2, 2), (mix64(shapes), 1, 3), (gram_hashes(shapes, 2), 2, 4), (gram_hashes(shapes, 3), 3, 5)]
        runs = [(((mix64(h + U64(kind)) if kind < 3 else h) >> U64(64 - BITS)).astype(np.int64), k) for h, k, kind in runs]
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if a == b:
                out.append(np.zeros(1, np.int64))
                continue
            parts = [h[a : max(a, b - k + 1)] for h, k in runs]
            own, count = np.unique(shapes[a:b], return_counts=True)
            share = np.ceil(8 * count / (b - a)).astype(U64)
            parts.append((mix64(own * U64(31) + share) >> U64(64 - BITS)).astype(np.int64))
            out.append(np.unique(np.concatenate(parts)))
    return out


@dataclass(frozen=True)
class Model:
    """Indicator weights, and the line that turns a margin into a log-odds."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum(dtype=np.float64) / np.sqrt(len(ids)) + self.bias)

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 0.1, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Log-count ratios, then dual coordinate descent on the L2-regularised hinge loss.

    One row in five is left out of the descent and fits the score's line.
    Equal rows count each; rows of one text and both labels pull both ways.
    With a single class, or no row, every score is that class's share (0.5 for none).
    """
    labels = np.asarray(labels, dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) < 10 or share in (0.0, 1.0):
        odds = np.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1))
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(odds))
    order = np.random.default_rng(seed).permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    counts = np.ones((2, 1 << BITS))
    for i in used:
        counts[labels[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    del counts
    norm = {i: float((ratio[rows[i]] ** 2).mean()) + 1.0 for i in used}
    weights, bias, alpha = np.zeros(1 << BITS), 0.0, dict.fromkeys(used, 0.0)
    sign = 2 * labels - 1
    top = {c: cost * len(used) / (2 * max(1, int((labels[used] == c).sum()))) for c in (0, 1)}
    draw = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(used):
            ids, y = rows[i], sign[i]
            x = ratio[ids] / np.sqrt(len(ids))
            slope = y * (weights[ids] @ x + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), top[int(labels[i])])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[ids] += step * x
                bias += step
                moved += abs(step)
                alpha[i] = new
        if moved < 1e-4 * len(used):
            break
    model = Model((weights * ratio).astype(np.float32), bias, 1.0, 0.0)
    z = np.array([model.margin(rows[i]) for i in held])
    return Model(model.weights, bias, *_line(z, labels[held]))


def _line(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins and labels, by Newton steps with a weak prior."""
    hits = int(y.sum())
    target = np.where(y == 1, (hits + 1) / (hits + 2), 1 / (len(y) - hits + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - target) * z).sum() + 1e-3 * a, (p - target).sum()
        haa, hab, hbb = (w * z * z).sum() + 1e-3, (w * z).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-1.0, min(1.0, da)), b - max(-1.0, min(1.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def _in_slices(column: pa.Array, rows: int = 256) -> Iterator[np.ndarray]:
    for at in range(0, len(column), rows):
        yield from indicators(column.slice(at, rows))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [x.astype("<i4").tobytes() for x in _in_slices(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["place", "label", "ids"])


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, cost: float = 0.1, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` labelled ids outside fold 0, those of smallest hash, and at most ``sample_bytes`` of their texts.

    Texts are taken in the order of a hash; one that does not fit into what is
    left of the bytes is left out by itself, those after it are still taken.

    Defined cases: labels other than 0 and 1, ids whose labels disagree and null
    ids are left out; of several documents of an id the smallest text counts; a
    null text is like an empty one; empty tables give a model that scores 0.5.
    """
    if sample > BROADCAST_ROWS:
        raise ValueError(f"a sample of at most {BROADCAST_ROWS} labelled rows")
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"), F.max(label_col).alias("_high")).where("_label = _high")
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_id", "_label")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(known), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    texts = materialize(texts.select(F.xxhash64("_id", "_text").alias("_place"), "_label", "_text"), "sample")
    left, fits = sample_bytes, []
    sizes = texts.select("_place", F.coalesce(F.octet_length("_text"), F.lit(0))).collect()  # ``sample`` rows at most
    for place, n in sorted(sizes):
        if n <= left:
            left -= n
            fits.append((place,))
    if len(fits) < len(sizes):
        texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "_place long")), "_place", "left_semi")
    got = texts.mapInArrow(_learn, "place long, label int, ids binary").toArrow().combine_chunks()
    if not got.num_rows:
        return fit([], np.zeros(0, np.int64), cost=cost)
    packed = got.column("ids").chunk(0)
    cuts = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 4
    ids = np.frombuffer(packed.buffers()[2], "<i4")
    order = np.argsort(got.column("place").to_numpy(), kind="stable")  # the rows' own order, whichever task sent them
    return fit([ids[cuts[k] : cuts[k + 1]] for k in order], got.column("label").to_numpy()[order], cost=cost)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: (id_col, *keep, held_out, score, predicted).

    Defined cases: a null or empty text gets the score of a text without words;
    repeated rows get equal scores; a null id is held out; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = pa.array([own.score(x) for x in _in_slices(batch.column(batch.num_columns - 1))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    taken = docs.select(F.col(id_col).alias("_0"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep, 1)], F.col(text_col).cast("string").alias("_text"))
    out = taken.mapInArrow(run, T.StructType([*taken.schema.fields[:-1], T.StructField("score", T.DoubleType())]))
    out = out.select(F.col("_0").alias(id_col), *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep, 1)], "score")
    return out.select(id_col, *keep, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
