"""Stupid-backoff scores against the whole corpus, computed relationally.

Texts are dealt into groups.  Each group explodes its texts into n-grams and
counts the different ones; these partial counts go, packed, to the count table
of their order and hash range, where they are summed.  The table's counts are
joined to the n-grams that a group asked for and go back to it, where the
scores are summed per document.  A hot n-gram counts once per group, never once
per text.  Groups and tables grow with the square root of the corpus, so the
messages between them are in proportion to it (``sizes.group_bytes``).

Under the counts of the whole corpus every n-gram of a text has been seen, in
the text itself, so nothing is ever given up.  ``leave_one_out`` takes a text's
own counts off: a copy elsewhere raises its score and the text itself doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .hashing import U64, gram_hashes, string_buffer, word_hashes
from .sizes import group_bytes
from .workspace import bound_batches

ORDER = 3
BACKOFF = 0.4


#: Bytes of text that a task packs by group at a time.
PACK_BYTES = 16 << 20


def _pack_texts():
    """Rows (doc_group, id, text) to one row for each group of a pack: (doc_group, ids, sizes, total, data), texts compressed."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pa.compute.sort_indices(rows.column(0)))
        group = rows.column(0).to_numpy()
        data, offsets = string_buffer(rows.column(2))
        cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
        ids = pa.concat_arrays(rows.column(1).chunks)
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids)
        sizes = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.diff(offsets), pa.int64()))
        spans = [(int(offsets[a]), int(offsets[b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        blobs = [pa.compress(data[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array(group[cuts[:-1]], pa.int32()), lists, sizes, pa.array([b - a for a, b in spans], pa.int64()), pa.array(blobs, pa.binary())], names=["doc_group", "ids", "sizes", "total", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _texts(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """(ids, texts) of a group's packs."""
    ids = pa.concat_arrays([x.flatten() for x in table.column("ids").chunks])
    sizes = np.concatenate([np.asarray(x.flatten()) for x in table.column("sizes").chunks])
    data = b"".join(pa.decompress(d.as_buffer(), decompressed_size=n.as_py(), codec="zstd", asbytes=True) for d, n in zip(table.column("data"), table.column("total"), strict=True))
    offsets = pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64).tobytes())
    return ids, pa.Array.from_buffers(pa.large_string(), len(sizes), [None, offsets, pa.py_buffer(data)])


def _exploded(column: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First word of each text, and by n the hash of the n-gram that ends at each word (0: it would begin before its text)."""
    data, offsets = string_buffer(column)
    words, first = word_hashes(data, offsets)
    grams = []
    start = np.repeat(first[:-1], np.diff(first))
    for n in range(1, order + 1):
        own = np.zeros(len(words), U64)
        if len(words) >= n:
            own[n - 1 :] = gram_hashes(words, n) | U64(1)
            own[np.arange(len(words)) - n + 1 < start] = 0
        grams.append(own)
    return first, grams


def _parts(values: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of each part's values in a sorted array of hashes."""
    part = ((values >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
    return np.searchsorted(part, np.arange(parts + 1))


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _restore(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _pack(values: np.ndarray, part: int, parts: int) -> bytes:
    """Sorted 64-bit hashes of one part as gaps, byte plane by byte plane; planes without a bit are left out."""
    base = ((part << 32) + parts - 1) // parts
    gaps = np.diff(values - (U64(base) << U64(32)), prepend=U64(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T
    used = max([0, *np.flatnonzero(planes.any(axis=1))]) + 1
    return _squeeze(bytes([used]) + planes[:used].tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    """The hashes again, less their part's base."""
    raw = _restore(raw)
    used = raw[0]
    out = np.zeros(((len(raw) - 1) // used, 8), np.uint8)
    out[:, :used] = np.frombuffer(raw, np.uint8, offset=1).reshape(used, -1).T
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=U64)


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams[grams != 0], return_counts=True)


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes, with those over 254 in full after them."""
    big = counts > 254
    return _squeeze(np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<i8").tobytes())


def _full(raw: bytes, n: int) -> np.ndarray:
    raw = _restore(raw)
    out = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], "<i8")
    return out


def _ask(order: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column(0)[0].as_py()
        _, grams = _exploded(_texts(table)[1], order)
        rows = []
        for n, own in enumerate(grams, 1):
            values, counts = _distinct(own)
            bounds = _parts(values, parts)
            for p in range(parts):
                a, b = bounds[p], bounds[p + 1]
                if b > a:
                    rows.append((p, group, n, _pack(values[a:b], p, parts), _small(counts[a:b])))
        return _table(rows)

    return run


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "doc_group", "n", "grams", "counts"])


def _sum(table: pa.Table) -> pa.Table:
    """The count table of one order and part, joined to the n-grams of each group that asked, in its order."""
    rows = table.to_pylist()
    grams = [_unpack(r["grams"]) for r in rows]
    sizes = np.cumsum([len(g) for g in grams])[:-1]
    _, back = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(back, np.concatenate([_full(r["counts"], len(g)) for r, g in zip(rows, grams, strict=True)])).astype(np.int64)
    return _table([(r["part"], r["doc_group"], r["n"], None, _small(x)) for r, x in zip(rows, np.split(totals[back], sizes), strict=True)])


def _counted(values: np.ndarray, totals: np.ndarray, grams: np.ndarray, doc: np.ndarray, leave_one_out: bool) -> np.ndarray:
    """For each n-gram occurrence its corpus count, without those of its own text if these are left out."""
    out = np.zeros(len(grams), np.int64)
    at = np.flatnonzero(grams != 0)
    if len(at):
        index = np.searchsorted(values, grams[at])
        out[at] = totals[index]
        if leave_one_out:
            _, back, own = np.unique(doc[at] * len(values) + index, return_inverse=True, return_counts=True)
            out[at] -= own[back]
    return out


def _answer(order: int, parts: int, backoff: float, words_in_all: int, id_kind: pa.DataType, leave_one_out: bool):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table([pa.nulls(0, id_kind), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["id", "n_words", "log_score"])
        ids, column = _texts(texts)
        first, grams = _exploded(column, order)
        sizes = np.diff(first)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        known: dict[int, dict[int, bytes]] = {}
        for r in replies.select(["part", "n", "counts"]).to_pylist() if replies.num_rows else ():
            known.setdefault(r["n"], {})[r["part"]] = r["counts"]
        left = []
        for n, own in enumerate(grams, 1):
            values, _ = _distinct(own)
            bounds = _parts(values, parts)
            pieces = [_full(known[n][p], bounds[p + 1] - bounds[p]) for p in range(parts) if bounds[p + 1] > bounds[p]]
            left.append(_counted(values, np.concatenate(pieces) if pieces else np.zeros(0, np.int64), own, doc, leave_one_out))
        total = np.maximum(words_in_all - (np.repeat(sizes, sizes) if leave_one_out else 0), 1)
        # Backward: the longest n-gram that was seen decides.
        scores = np.log(np.maximum(left[0], 0.5) / total)
        for n in range(2, order + 1):
            context = np.zeros(len(doc), np.int64)
            context[1:] = left[n - 2][:-1]
            seen = left[n - 1] > 0
            can = grams[n - 1] != 0
            scores = np.where(seen, np.log(np.maximum(left[n - 1], 1) / np.maximum(context, 1)), np.where(can, np.log(backoff) + scores, scores))
        sums = np.bincount(doc, scores, minlength=len(sizes)).astype(np.float64)
        return pa.table([ids, pa.array(sizes.astype(np.int64)), pa.array(sums)], names=["id", "n_words", "log_score"])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, first = word_hashes(*string_buffer(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([int(first[-1])], pa.int64())], names=["n"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, leave_one_out: bool = False) -> DataFrame:
    """One row per document: (id_col, n_words, log_score, score).

    log_score sums ln S(w | up to order - 1 words before) over the words
    ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased); score is its mean.  S is the count
    of the longest n-gram ending at w that was seen, over that of its context,
    times ``backoff`` for each order given up.  Counts are those of all texts,
    or of all other texts with ``leave_one_out``; a word never seen counts as
    half an occurrence.

    Defined cases: words and texts of any length are taken whole; a text without words has n_words 0, log_score 0.0 and a null
    score; a repeated row is another text, so its copies count for it; null ids
    are scored like others; an empty table gives an empty result; other columns
    are ignored.
    """
    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    totals = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    words = docs.select(text.alias("text")).mapInArrow(_count_words, "n long").agg(F.sum("n")).first()[0] or 0
    parts = max(4, -(-totals // group_bytes(totals)))
    kind = docs.schema[id_col].dataType.simpleString()
    group = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(parts)).cast("int")
    texts = docs.select(group.alias("doc_group"), F.col(id_col).alias("id"), text.alias("text"))
    texts = texts.mapInArrow(_pack_texts(), f"doc_group int, ids array<{kind}>, sizes array<long>, total long, data binary")
    row = "part int, doc_group int, n int, grams binary, counts binary"
    asked = texts.groupBy("doc_group").applyInArrow(_ask(order, parts), row)
    replies = asked.groupBy("part", "n").applyInArrow(_sum, row)
    answer = _answer(order, parts, backoff, words, to_arrow_type(docs.schema[id_col].dataType), leave_one_out)
    out = texts.groupBy("doc_group").cogroup(replies.groupBy("doc_group")).applyInArrow(answer, f"id {kind}, n_words long, log_score double")
    return out.select(F.col("id").alias(id_col), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("score"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
g AS (SELECT rid, p, w, lag(w, 1) OVER o AS v, lag(w, 2) OVER o AS u FROM t WINDOW o AS (PARTITION BY rid ORDER BY p)),
o1 AS (SELECT rid, w, count(*) AS c FROM g GROUP BY ALL), a1 AS (SELECT w, sum(c) AS c FROM o1 GROUP BY ALL),
o2 AS (SELECT rid, v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY ALL), a2 AS (SELECT v, w, sum(c) AS c FROM o2 GROUP BY ALL),
o3 AS (SELECT rid, u, v, w, count(*) AS c FROM g WHERE u IS NOT NULL GROUP BY ALL), a3 AS (SELECT u, v, w, sum(c) AS c FROM o3 GROUP BY ALL),
m AS (SELECT rid, count(*) AS n FROM g GROUP BY rid), z AS (SELECT count(*) AS n FROM g),
c AS (SELECT g.rid, g.p, g.v, g.u, a1.c - o1.c AS cw, av.c - ov.c AS cv, a2.c - o2.c AS cvw, b2.c - q2.c AS cuv, a3.c - o3.c AS cuvw, greatest(z.n - m.n, 1) AS rest
FROM g JOIN m USING (rid), z JOIN a1 ON a1.w = g.w JOIN o1 ON o1.rid = g.rid AND o1.w = g.w
LEFT JOIN a1 av ON av.w = g.v LEFT JOIN o1 ov ON ov.rid = g.rid AND ov.w = g.v
LEFT JOIN a2 ON a2.v = g.v AND a2.w = g.w LEFT JOIN o2 ON o2.rid = g.rid AND o2.v = g.v AND o2.w = g.w
LEFT JOIN a2 b2 ON b2.v = g.u AND b2.w = g.v LEFT JOIN o2 q2 ON q2.rid = g.rid AND q2.v = g.u AND q2.w = g.v
LEFT JOIN a3 ON a3.u = g.u AND a3.v = g.v AND a3.w = g.w LEFT JOIN o3 ON o3.rid = g.rid AND o3.u = g.u AND o3.v = g.v AND o3.w = g.w),
s1 AS (SELECT *, ln(greatest(cw, 0.5) / rest) AS s FROM c),
s2 AS (SELECT * REPLACE (CASE WHEN cvw > 0 THEN ln(cvw / greatest(cv, 1)) WHEN v IS NOT NULL THEN ln(0.4) + s ELSE s END AS s) FROM s1),
s3 AS (SELECT rid, sum(CASE WHEN cuvw > 0 THEN ln(cuvw / greatest(cuv, 1)) WHEN u IS NOT NULL THEN ln(0.4) + s ELSE s END) AS log_score, count(*) AS n FROM s2 GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(log_score / n, 6) AS score FROM d LEFT JOIN s3 USING (rid)
"""
