"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become words once, in one pass over the documents.  For a window of L
words the k-grams (k is 4, 2 or 1) are hashed and the smallest hash of every
L - k + 1 consecutive ones is kept, on both sides: two texts that share L
consecutive words share the k-grams of that span, so they keep a common
fingerprint.  A bit table of the benchmark's fingerprints, of bounded size,
tells in that pass which k-grams can be one of them; only those are checked for
being the smallest of a window and leave the pass, with the words around them.
They are joined with the benchmark's fingerprints, and every hit is extended to
the windows that hold it, which are compared word by word with the benchmark's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sizes import small
from .workspace import materialize

WINDOW = 13
#: Longs of the bit table of the benchmark's fingerprints, at least and at most (16 MB); some 32 bits for a fingerprint up to 4 million of them.
TABLE_LONGS = (1 << 6, 1 << 21)


def worded(df: DataFrame, text: str) -> DataFrame:
    """Adds ``words``, the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; a null text has none.

    The text's bytes are taken for Latin-1 first: lower-casing is fast there,
    and as UTF-8 lead bytes are told apart by what follows them, words of
    different texts stay different.  The words are keys, not for display.
    """
    low = F.lower(F.decode(F.col(text).cast("binary"), "ISO-8859-1"))
    split = df.withColumn("_raw", F.coalesce(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.array(F.lit(""))))
    raw = F.col("_raw")
    lead, end = (F.get(raw, F.lit(0)) == "").cast("int"), (F.get(raw, F.size(raw) - 1) == "").cast("int")
    words = F.when(lead + end == 0, raw).otherwise(F.slice(raw, lead + 1, F.greatest(F.size(raw) - lead - end, F.lit(0))))
    return split.withColumn("words", words).drop("_raw")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_length(length: int) -> int:
    """k for spans of ``length`` words: 1, 2 or 4, at most (length + 1) // 2."""
    return 4 if length >= 7 else 2 if length >= 3 else 1


def _grams(words: Column, k: int) -> Column:
    """Hash of the k words (1, 2 or 4) that begin at each place."""

    def pairs(x: Column, apart: int) -> Column:
        return _let(x, lambda own: F.transform(own, lambda h, i: F.xxhash64(h, F.get(own, i + apart))))

    every = F.transform(words, lambda w: F.xxhash64(w))
    for apart in (1, 2)[: k // 2]:
        every = pairs(every, apart)
    return F.when(F.size(words) >= k, F.slice(every, F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(grams: Column, length: int) -> Column:
    """Distinct smallest hashes of every window's grams, for spans of ``length`` words."""
    wide = length - gram_length(length) + 1
    starts = F.when(F.size(grams) >= wide, F.sequence(F.lit(1), F.size(grams) - (wide - 1)))
    return F.array_distinct(F.coalesce(F.transform(starts, lambda i: F.array_min(F.slice(grams, i, wide))), F.array().cast("array<bigint>")))


def _places(x: Column, longs: int) -> list[tuple[Column, Column]]:
    """Two places (long, bit) of a hash in a bit table."""
    return [(F.shiftrightunsigned(x, by).bitwiseAND(F.lit(longs - 1).cast("long")).cast("int"), F.shiftrightunsigned(x, by + 20).bitwiseAND(F.lit(63).cast("long")).cast("int")) for by in (0, 30)]


def _bit_table(marks: DataFrame, longs: int) -> Column:
    """The bits of all ``fingerprint`` rows as one array of longs, a scalar subquery."""
    bits = marks.select(F.explode(F.array(*[F.struct(at.alias("at"), bit.alias("bit")) for at, bit in _places(F.col("fingerprint"), longs)])).alias("p"))
    bits = bits.groupBy("p.at").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.bit"))).alias("mask"))
    every = marks.sparkSession.range(longs).select(F.col("id").cast("int").alias("at")).join(bits, "at", "left").select("at", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mask"))), lambda s: s["mask"]).alias("bits")).scalar()


def _known(grams: Column, table: Column, longs: int) -> Column:
    """Places, from 0, of the grams that a bit table of ``longs`` may hold; each is looked up once."""

    def holds(bits: Column, x: Column) -> Column:
        one, two = (F.getbit(F.get(bits, at), bit) == 1 for at, bit in _places(x, longs))
        return one & two

    every = F.sequence(F.lit(0), F.size(grams) - 1)
    return F.when(F.size(grams) > 0, _let(table, lambda bits: F.filter(every, lambda i: holds(bits, F.get(grams, i))))).otherwise(F.array().cast("array<int>"))


def _met(words: Column, grams: Column, places: Column, k: int, lengths: list[int]) -> Column:
    """Fingerprints of the text at ``places`` of its grams: array of (length, fingerprint, start, around).

    ``around`` holds the words, from ``start`` on, of all windows that hold the
    fingerprint's words.  Time is in proportion to the text's words.
    """
    n = F.size(words)

    def spans(at: Column, length: int) -> Column:
        wide = length - k + 1
        lowest = lambda p: F.exists(F.sequence(F.greatest(F.lit(0), p - (wide - 1)), F.least(p, F.size(grams) - wide)), lambda j: F.array_min(F.slice(grams, j + 1, F.lit(wide))) == F.get(grams, p))

        def one(p: Column) -> Column:
            start = F.greatest(F.lit(0), p - (length - k))
            around = F.slice(words, start + 1, F.least(p, n - length) - start + length)
            return F.struct(F.lit(length).alias("length"), F.get(grams, p).alias("fingerprint"), start.alias("start"), around.alias("around"))

        return F.when(n >= length, F.transform(F.filter(at, lowest), one))

    every = lambda at: F.flatten(F.filter(F.array(*[spans(at, length) for length in lengths]), lambda x: x.isNotNull()))
    return F.when(F.size(places) > 0, _let(places, every))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per document: (id_col, n_words, n_hit, n_items, items_sha256, contaminated).

    A window is ``window`` consecutive words of an item, or all of a shorter
    item.  n_hit counts document words inside an occurrence of any window,
    n_items the items with such a window; items_sha256 is the hex digest of
    their ids, sorted as strings and joined by commas.  contaminated means
    n_hit > 0 and 20 * n_hit >= n_words.

    Defined cases: null and empty texts have no words and are clean; very long
    texts are taken whole; an item without words or with a null id matches
    nothing; items with equal texts count each; repeated document rows give
    repeated, equal rows; an empty benchmark leaves every document clean; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit("row"), "id", "text").alias("k2"), "text")
    rows = worded(rows, "text").drop("text")
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    items = worded(items, "text").drop("text").where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    items = materialize(items.distinct(), "items")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most ``window`` values
    own = lambda n: items.where(F.col("length") == n)
    marks = {n: own(n).select(F.lit(n).alias("length"), F.explode(fingerprints(_grams(F.col("words"), gram_length(n)), n)).alias("fingerprint")) for n in lengths}
    found = []
    if lengths:
        marked = marks[lengths[0]]
        for n in lengths[1:]:
            marked = marked.union(marks[n])
        marked = materialize(marked.distinct(), "marks")
        n_marks = marked.count()
        longs = min(max(TABLE_LONGS[0], 1 << (n_marks // 2).bit_length()), TABLE_LONGS[1])
        for k in sorted({gram_length(n) for n in lengths}):
            of_k = [n for n in lengths if gram_length(n) == k]
            known = marked.where(F.col("length").isin(of_k)).select("fingerprint").distinct()
            rows = rows.withColumns({f"grams_{k}": _grams(F.col("words"), k), f"table_{k}": _bit_table(known, longs)})
            rows = rows.withColumn(f"places_{k}", _known(F.col(f"grams_{k}"), F.col(f"table_{k}"), longs))
            found.append(_met(F.col("words"), F.col(f"grams_{k}"), F.col(f"places_{k}"), k, of_k))
    pieces = F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull())) if found else F.lit(None).cast("array<struct<length:int,fingerprint:bigint,start:int,around:array<string>>>")
    counted = materialize(rows.select("id", "k1", "k2", F.size("words").cast("long").alias("n_words"), pieces.alias("pieces")), "counted")
    if not lengths:
        judged = counted.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items"))
    else:
        met = counted.where(F.size("pieces") > 0).select("k1", "k2", F.inline("pieces")).join(small(marked), ["length", "fingerprint"], "left_semi")
        joined = lambda words, start, n: F.array_join(F.slice(words, start + 1, n), " ")
        every = F.transform(F.sequence(F.lit(0), F.size("around") - F.col("length")), lambda i: F.struct((F.col("start") + i).alias("pos"), joined(F.col("around"), i, F.col("length")).alias("window")))
        extended = met.select("k1", "k2", "length", F.inline(every))
        known = items.select("item", "length", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("length")), lambda i: joined(F.col("words"), i, F.col("length")))).alias("window"))
        known = small(materialize(known.distinct(), "windows"))
        spans = extended.join(known, ["length", "window"]).select("k1", "k2", "pos", (F.col("pos") + F.col("length")).alias("stop"), "item")
        spans = materialize(spans.distinct(), "spans")
        before = Window.partitionBy("k1", "k2").orderBy("pos", "stop").rowsBetween(Window.unboundedPreceding, -1)
        cover = spans.groupBy("k1", "k2", "pos").agg(F.max("stop").alias("stop"))
        cover = cover.select("k1", "k2", "stop", F.greatest("pos", F.coalesce(F.max("stop").over(before), F.lit(0))).alias("begin"))
        cover = cover.groupBy("k1", "k2").agg(F.sum(F.greatest(F.col("stop") - F.col("begin"), F.lit(0))).cast("long").alias("n_hit"))
        named = spans.select("k1", "k2", "item").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
        judged = counted.select("id", "k1", "k2", "n_words").join(cover.join(named, ["k1", "k2"]), ["k1", "k2"], "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return judged.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM bl),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM bp),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM dp),
h AS (SELECT DISTINCT rid, p, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
c AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS x FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""
