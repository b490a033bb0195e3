"""Line dedup by content-defined chunks of lines.

A rolling hash over the last lines' hashes decides where a chunk ends, so the
boundaries move along with the lines when something is put in before them.
Chunks of several lines that occur more than once are compared byte by byte
with their first occurrence, and go wherever they are the same again.

Chunks lose what repeats only in part of a chunk.  ``dedup_passages`` compares
the shortest runs that begin or end at each line instead; together these cover
every line of every repeated passage, wherever it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .workspace import bound_batches, materialize

#: Lines that the rolling hash covers; one in MODULUS lines ends a chunk, of LEAST_LINES lines at least.
WINDOW = 2
MODULUS = 2
LEAST_LINES = 2
#: A line of more words is a passage by itself.
LONG_WORDS = 50
#: Rows that a Python worker holds before it passes them on.
ROWS = 20_000
_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunk_spans(lines: list[str], window: int = WINDOW, modulus: int = MODULUS, least: int = LEAST_LINES) -> list[tuple[int, int]]:
    """[start, end) of each chunk of a text's lines."""
    spans, start = [], 0
    hashes = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in lines]
    out_factor = pow(_FACTOR, window, 1 << 64)
    rolling = 0
    for i, h in enumerate(hashes):
        rolling = (rolling * _FACTOR + h) & _MASK
        if i >= window:
            rolling = (rolling - hashes[i - window] * out_factor) & _MASK
        if i + 1 - start >= least and (rolling >> 32) % modulus == 0:
            spans.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        spans.append((start, len(lines)))
    return spans


def _chunks(with_text: bool, least_bytes: int):
    """A row for each chunk of several lines: (k1, k2, id, row key, chunk number, its text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                text = batch.column(3)[i].as_py()
                if not text or "\n" not in text:
                    continue
                lines = text.split("\n")
                for n, (a, b) in enumerate(chunk_spans(lines)):
                    if b - a < LEAST_LINES:
                        continue
                    piece = "\n".join(lines[a:b])
                    raw = piece.encode()
                    if len(raw.strip()) <= least_bytes:
                        continue
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
                    rows.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), i, n, piece if with_text else None))
            at = pa.array([r[2] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *(batch.column(c).take(at) for c in range(3)), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.string())],
                names=["k1", "k2", "id", "r1", "r2", "chunk", "piece"],
            )

    return run


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines_in, lines_gone, words_gone = [], [], [], []
        for text, gone in zip(batch.column(1), batch.column(2), strict=True):
            text, gone = text.as_py(), set(gone.as_py() or ())
            lines = text.split("\n") if text else []
            kept, dropped = [], []
            for n, (a, b) in enumerate(chunk_spans(lines)) if gone else ():
                (dropped if n in gone else kept).extend(lines[a:b])
            texts.append("\n".join(kept) if gone else text)
            lines_in.append(len(lines))
            lines_gone.append(len(dropped))
            words_gone.append(sum(len(x.split()) for x in dropped))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines_in, pa.int64()), pa.array(lines_gone, pa.int64()), pa.array(words_gone, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_lines", "n_removed", "words_removed", "text"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = 0) -> DataFrame:
    """One row per document: (id_col, n_lines, n_removed, words_removed, text), text without repeated chunks.

    The first occurrence, by id and place in the text (null ids first), stays.
    Chunks of at most ``least_bytes`` bytes between their first and last mark,
    so those of blank lines only, are left.

    Defined cases: a null text stays null with 0 lines; a text of one line is
    left as it is; chunks repeated within one text go as well; of repeated
    documents one keeps its chunks, and of rows equal in id and text none is
    told from the other, so these keep them alike; an empty table gives an empty
    result; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("r1"), F.xxhash64(F.lit("row"), F.col(id_col), text).alias("r2"), text.alias("text"))
    schema = f"k1 long, k2 long, id {kind}, r1 long, r2 long, chunk int, piece string"
    place = F.struct("id", "r1", "r2", "chunk")
    repeats = rows.mapInArrow(_chunks(False, least_bytes), schema).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("k1", "k2", "first")
    repeats = materialize(repeats, "repeats")
    found = rows.mapInArrow(_chunks(True, least_bytes), schema).join(repeats, ["k1", "k2"]).select("k1", "k2", "r1", "r2", "chunk", "piece", (place == F.col("first")).alias("is_first"))
    found = materialize(found, "occurrences")
    firsts = found.where("is_first").select("k1", "k2", F.col("piece").alias("model")).dropDuplicates(["k1", "k2"])
    again = found.where("not is_first").join(firsts, ["k1", "k2"]).where(F.encode("piece", "UTF-8") == F.encode("model", "UTF-8"))
    gone = again.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("chunk")).alias("gone"))
    cleaned = rows.join(gone, ["r1", "r2"], "left").select("id", "text", "gone").mapInArrow(_clean, f"id {kind}, n_lines long, n_removed long, words_removed long, text string")
    return cleaned.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def passage_spans(lines: list[bytes], least_bytes: int = 0) -> list[tuple[int, int]]:
    """[start, end) of the shortest runs of LEAST_LINES lines and over ``least_bytes`` bytes that begin or end at a line, and of each long line.

    White space at a line's ends counts as no byte, so blank lines are no run.
    A line of any longer run of lines lies in one of these that lies in the run.
    """
    n = len(lines)
    sizes = [len(x.strip()) for x in lines]
    spans = {(i, i + 1) for i, x in enumerate(lines) if len(x) > 2 * LONG_WORDS and len(x.decode().split()) > LONG_WORDS}
    end = total = 0
    for i in range(n):
        while end < n and (end - i < LEAST_LINES or total <= least_bytes):
            total += sizes[end]
            end += 1
        if end - i < LEAST_LINES or total <= least_bytes:
            break
        spans.add((i, end))
        total -= sizes[i]
    start, total = n, 0
    for j in range(n, 0, -1):
        while start > 0 and (j - start < LEAST_LINES or total <= least_bytes):
            start -= 1
            total += sizes[start]
        if j - start < LEAST_LINES or total <= least_bytes:
            break
        spans.add((start, j))
        total -= sizes[j - 1]
    return sorted(spans)


def _passages(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, id, row key, span) of each span of (id, row key, text)."""
    for batch in batches:
        keys, at, spans = [], [], []

        def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            pair = memoryview(b"".join(keys)).cast("q")
            took = pa.array(at, pa.int32())
            columns = [pa.array(pair[0::2].tolist(), pa.int64()), pa.array(pair[1::2].tolist(), pa.int64()), *(batch.column(c).take(took) for c in range(3)), pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "id", "r1", "r2", "a", "b"])

        for i, text in enumerate(batch.column(3)):
            lines = (text.as_py() or b"").split(b"\n")
            for a, b in passage_spans(lines, least_bytes):
                keys.append(hashlib.blake2b(b"\n".join(lines[a:b]), digest_size=16).digest())
                at.append(i)
                spans.append((a, b))
                if len(at) >= ROWS:
                    yield out()
                    keys.clear(), at.clear(), spans.clear()
        yield out()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, row key, span, is_first, text) of the wanted spans of (row key, text, wanted)."""
    names = ["k1", "k2", "r1", "r2", "a", "b", "is_first", "piece"]
    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_(), pa.binary()]
    for batch in batches:
        rows, held = [], 0
        for r1, r2, text, wanted in zip(*(batch.column(c) for c in range(4)), strict=True):
            lines = text.as_py().split(b"\n")
            for w in wanted.as_py():
                piece = b"\n".join(lines[w["a"] : w["b"]])
                rows.append((w["k1"], w["k2"], r1.as_py(), r2.as_py(), w["a"], w["b"], w["is_first"], piece))
                held += len(piece)
                if len(rows) >= ROWS or held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_lines, n_removed, words_removed, text) of (id, text, gone)."""
    for batch in batches:
        texts, lines_in, lines_gone, words_gone = [], [], [], []
        for text, gone in zip(batch.column(1), batch.column(2), strict=True):
            text, gone = text.as_py(), gone.as_py() or ()
            lines = text.split("\n") if text else []
            drop = {i for g in gone for i in range(g["a"], g["b"])}
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
            lines_in.append(len(lines))
            lines_gone.append(len(drop))
            words_gone.append(sum(len(lines[i].split()) for i in drop))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines_in, pa.int64()), pa.array(lines_gone, pa.int64()), pa.array(words_gone, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_lines", "n_removed", "words_removed", "text"])


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = 0) -> DataFrame:
    """One row per document, as by ``dedup_lines``, text without any repeated passage.

    A passage is a run of LEAST_LINES lines at least with over ``least_bytes``
    bytes besides white space at line ends, or a line of more than LONG_WORDS
    words.  A line goes if it lies in a passage
    that occurs, the same byte for byte, at an earlier place by id and place in
    the text (null ids first); so an equal line is always left at an earlier one.

    Defined cases: a null text stays null with 0 lines; a text of which all
    lines go is empty; the rest as in ``dedup_lines``.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("r1"), F.xxhash64(F.lit("row"), F.col(id_col), text).alias("r2"), text.alias("text"))
    raw = F.encode("text", "UTF-8").alias("text")
    place = F.struct("id", "r1", "r2", "a", "b")
    spans = rows.select("id", "r1", "r2", raw).mapInArrow(lambda batches: _passages(batches, least_bytes), f"k1 long, k2 long, id {kind}, r1 long, r2 long, a int, b int")
    repeats = spans.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("k1", "k2", "first")
    repeats = materialize(repeats, "repeats")
    found = spans.join(repeats, ["k1", "k2"]).select("k1", "k2", "r1", "r2", "a", "b", (place.eqNullSafe(F.col("first"))).alias("is_first"))
    wanted = found.groupBy("r1", "r2").agg(F.collect_set(F.struct("k1", "k2", "a", "b", "is_first")).alias("wanted"))
    texts = rows.join(wanted, ["r1", "r2"]).select("r1", "r2", raw, "wanted")
    pieces = materialize(texts.mapInArrow(_pieces, "k1 long, k2 long, r1 long, r2 long, a int, b int, is_first boolean, piece binary"), "occurrences")
    firsts = pieces.where("is_first").select("k1", "k2", F.col("piece").alias("model")).dropDuplicates(["k1", "k2"])
    again = pieces.where("not is_first").join(firsts, ["k1", "k2"]).where("piece = model")
    gone = again.groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    cleaned = rows.join(gone, ["r1", "r2"], "left").select("id", "text", "gone").mapInArrow(_without, f"id {kind}, n_lines long, n_removed long, words_removed long, text string")
    return cleaned.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT rid, unnest(range(0, len(l))) AS i, unnest(l) AS x, len(l) AS n FROM d WHERE text <> ''),
ln AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM u),
nb AS (SELECT *, min(CASE WHEN w > 0 THEN i END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead,
max(CASE WHEN w > 0 THEN i END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM ln),
sp AS (SELECT rid, i AS a, greatest(i + 2, ahead + 1) AS b FROM nb WHERE greatest(i + 2, ahead + 1) <= n AND ahead IS NOT NULL
UNION SELECT rid, least(i - 1, back), i + 1 FROM nb WHERE back IS NOT NULL AND i >= 1 UNION SELECT rid, i, i + 1 FROM nb WHERE strlen(x) > 100 AND w > 50),
pc AS (SELECT sp.rid, a, b, array_to_string(l[a + 1:b], chr(10)) AS piece FROM sp JOIN d USING (rid)),
rk AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY rid, a, b) AS r FROM pc),
gone AS (SELECT DISTINCT rid, unnest(range(a, b)) AS i FROM rk WHERE r > 1),
out AS (SELECT ln.rid, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed, coalesce(sum(w) FILTER (WHERE g.i IS NOT NULL), 0) AS words_removed, coalesce(string_agg(x, chr(10) ORDER BY ln.i) FILTER (WHERE g.i IS NULL), '') AS text
FROM ln LEFT JOIN gone g ON g.rid = ln.rid AND g.i = ln.i GROUP BY ln.rid)
SELECT doc_id, CASE WHEN d.text <> '' THEN len(l) ELSE 0 END::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(words_removed, 0)::BIGINT AS words_removed, CASE WHEN d.text <> '' THEN out.text ELSE d.text END AS text FROM d LEFT JOIN out USING (rid)
"""
