"""Divergence of sources within a language, from dense blocks of group-by-term counts.

One pass over the texts gives counts of terms by (lang, source), summed in the
tasks before they are shuffled.  The terms that a language keeps are dealt to
blocks by hash; a tile is the matrix of all groups of a language (or of two
chunks of them, where there are many) by the terms of one block.  In a tile all
pairs of groups are compared by broadcasting; the partial sums of the pairs are
added up, and each group's best terms of the tiles are merged.  No tile has more
than CHUNK groups a side nor, but by chance, much more than BLOCK terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .sizes import small
from .workspace import bound_batches, materialize

#: Terms of a block, groups of a chunk.
BLOCK, CHUNK = 512, 128
#: Documents of a language that must hold a term; terms reported for each group.
LEAST_DOCS, TOP = 10, 10
#: Shares are whole parts of this many, and one more.
PARTS = 1_000_000_000
#: (term, group) entries that a task holds before it passes them on; bytes of a text split at once.
HELD, PIECE = 500_000, 1 << 20

#: ASCII letters to lower case, other ASCII to blanks; bytes beyond stay.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, split in pieces of about PIECE bytes that end at a blank."""
    low = text.translate(TERM_BYTES)
    at = 0
    while at < len(low):
        to = low.find(b" ", at + PIECE) if at + PIECE < len(low) else len(low)
        to = to if to >= 0 else len(low)
        yield low[at:to].split()
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), summed over as much as a task may hold."""
    words, docs = defaultdict(Counter), defaultdict(Counter)

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in words.items():
            terms, n, held = list(own), len(own), docs[lang, source]
            columns = [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([held[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[pa.repeat(x.decode(), n).cast(pa.string()) for x in (lang, source)], *columns], names=["lang", "source", "term", "n", "docs"])
        words.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
            seen: set[bytes] = set()
            for part in _pieces(text):
                words[lang, source].update(part)
                seen.update(part)
            docs[lang, source].update(seen)
        if sum(map(len, words.values())) > HELD:
            yield from passed()
    yield from passed()


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(PARTS * (count + 2) / (total + 2 * terms)) in longs, exact while the divisor is below 2 ** 53: a division by thousands."""
    whole = np.asarray(total, np.int64) + 2 * terms
    rest, out = counts.astype(np.int64) + 2, np.zeros(counts.shape, np.int64)
    for step in (1, 1000, 1000, 1000):
        rest = rest * step
        out = out * step + rest // whole
        rest = rest % whole
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q))."""
    return (p - q) * (p - q) // (p + q)


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """One tile's partial sums of pairs and, where its two chunks are one, the best terms of its groups."""
    lang, _, ci, cj = (k.as_py() for k in key)
    held = table.column("term").is_null()
    groups, terms = table.filter(held).sort_by("source"), table.filter(pc.invert(held))
    names = groups.column("source").combine_chunks()
    sources, sizes, chunks = names.to_pylist(), groups.column("n_group").to_numpy(), groups.column("chunk").to_numpy()
    spelt = np.array([t.encode() for t in terms.column("term").to_pylist()], dtype=object)
    order = np.argsort(spelt, kind="stable")
    terms, spelt = terms.take(pa.array(order)), spelt[order]
    counts = np.zeros((len(sources), len(spelt)), np.int64)
    cells = terms.column("cells").combine_chunks()
    flat = cells.flatten()
    where = pc.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False)
    counts[where.astype(np.int64), np.repeat(np.arange(len(spelt)), np.diff(cells.offsets.to_numpy()))] = flat.field("n").to_numpy()
    kept = int(table.column("kept")[0].as_py())
    p = shares(counts, sizes[:, None], kept) if len(spelt) else counts
    parts: list[tuple] = []
    for i in range(len(sources)):
        mates = np.arange(i + 1, len(sources)) if ci == cj else np.flatnonzero(chunks == cj) if chunks[i] == ci else []
        if len(mates):
            sums = distance(p[i][None, :], p[mates]).sum(axis=1, dtype=np.int64)
            parts += [("pair", sources[i], sources[j], int(s)) for j, s in zip(mates, sums, strict=True)]
    if ci == cj and len(spelt):
        q = shares(terms.column("total").to_numpy(), int(table.column("n_lang")[0].as_py()), kept)
        for i, own in enumerate(p):
            live = np.flatnonzero((counts[i] > 0) & (own > q))
            value = distance(own[live], q[live])
            for j in np.argsort(-value, kind="stable")[:TOP]:
                parts.append(("term", sources[i], spelt[live[j]].decode(), int(value[j])))
    part, source, item, value = zip(*parts, strict=True) if parts else ((), (), (), ())
    return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "part": pa.array(part, pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank): for every (lang, source) its distance to each other source and its TOP most distinctive terms.

    Terms are runs of ASCII letters, lower-cased, and other non-ASCII
    characters; a language keeps those that at least ``least_docs`` of its
    documents hold.  Distances are sums of whole numbers, exact.

    Defined cases: a null text, lang or source is the empty one; a group without
    terms has the distances of its smoothed shares, 0 where the language keeps
    none; a language of one source has no pairs; ties go by the item's UTF-8
    bytes; repeated rows count each; texts of any length are counted whole; an
    empty table gives an empty result; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells")).where(F.col("docs") >= least_docs)
    terms = materialize(terms.drop("docs"), "terms")
    sizes = terms.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = materialize(texts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").na.fill(0, ["n_group"]), "groups")
    known = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("n_lang"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(known, "lang", "left").na.fill(0, ["kept", "n_lang"])
    langs = small(materialize(langs.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / block)), "chunks": F.ceil(F.col("groups") / chunk)}), "langs"))
    number = lambda name: F.pmod(F.xxhash64(name), F.col("chunks"))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    of_term = terms.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).withColumn("ci", F.explode(each("chunks"))).withColumn("cj", F.explode(F.sequence(F.col("ci"), F.col("chunks") - 1)))
    here = F.filter("cells", lambda c: number(c["source"]).isin(F.col("ci"), F.col("cj")))
    nothing = {"source": "string", "n_group": "long", "chunk": "long"}
    of_term = of_term.select("lang", "block", "ci", "cj", *[F.lit(None).cast(k).alias(n) for n, k in nothing.items()], "term", "total", here.alias("cells"), "kept", "n_lang")
    of_group = groups.join(langs, "lang").withColumn("chunk", number("source")).withColumn("block", F.explode(each("blocks"))).withColumn("other", F.explode(each("chunks")))
    of_group = of_group.select(
        "lang", "block", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "source", "n_group", "chunk", F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("long").alias("total"), F.lit(None).cast(terms.schema["cells"].dataType).alias("cells"), "kept", "n_lang",
    )
    tiles = of_term.union(of_group).groupBy("lang", "block", "ci", "cj").applyInArrow(_tile, "lang string, part string, source string, item string, value long")
    tiles = materialize(tiles, "tiles")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "value", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    best = tiles.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return both.withColumn("rank", rank).union(best.withColumn("rank", rank).where(F.col("rank") <= TOP))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(total)::HUGEINT AS total FROM gn GROUP BY lang),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * v.v) AS p FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(p.n) + 2)) // (any_value(ln.total) + 2 * any_value(v.v)) AS q FROM p JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pa AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
te AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pa UNION ALL SELECT * FROM te))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
