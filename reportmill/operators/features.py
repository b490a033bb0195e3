"""TF-IDF, Naive Bayes and BM25 over long term tables.

Term tables are (doc, term, tf); statistics are sums by term, so one pass
serves all folds: a held-out fold's share is subtracted from the totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import once
from ..llm.workspace import bound_batches
from ..scratch import small, written


def counted(tokens: Column) -> Column:
    """Array of (term, tf, pos): the terms of one text in order, their counts and first positions.

    Tokens are sorted with their places within the row and runs of equal ones
    are counted, so no text's tokens are shuffled.
    """

    def runs(own: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(own, i)["term"] != F.get(own, i - 1)["term"])
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), first)
        one = lambda at: lambda i, k: F.struct(F.get(own, i)["term"].alias("term"), (F.coalesce(F.get(at, k + 1), F.size(own)) - i).cast("long").alias("tf"), F.get(own, i)["pos"].alias("pos"))
        return once(starts, lambda at: F.transform(at, one(at)))

    placed = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    return once(placed, lambda own: F.when(F.size(own) > 0, runs(own)))


#: Array of (term, tf, pos), as of ``counted``.
COUNTED = ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType()), StructField("pos", IntegerType())]))


def counted_rows(df: DataFrame, tokens: Column, pairs: bool, *keep: str) -> DataFrame:
    """(keep..., terms): ``counted`` of the tokens, and of their bigrams after them if ``pairs``, a batch of texts at a time; a text without tokens has no terms."""
    bound_batches(df.sparkSession)
    said = df.select(*keep, tokens.alias("terms"))
    schema = StructType([*[said.schema[c] for c in keep], StructField("terms", COUNTED)])
    kind = to_arrow_type(COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, n = b.column("terms"), b.num_rows
            row = pc.list_parent_indices(own).to_numpy(zero_copy_only=False).astype(np.int64)
            words, size = pc.list_flatten(own), np.bincount(row, minlength=n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            if pairs:
                at = np.flatnonzero(row[1:] == row[:-1])
                joined = pc.binary_join_element_wise(words.take(pa.array(at)), words.take(pa.array(at + 1)), "__")
                words = pa.concat_arrays([words.cast(pa.large_string()), joined.cast(pa.large_string())])
                row, pos = np.concatenate([row, row[at]]), np.concatenate([pos, size[row[at]] + pos[at]])
            coded = words.dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()  # by the bytes
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            found = row * max(1, len(order)) + place[coded.indices.to_numpy(zero_copy_only=False)]
            at = np.argsort(found, kind="stable")  # in each row the places of a term stay in order
            starts = np.flatnonzero(np.concatenate([[True], np.diff(found[at]) != 0])[: len(at)])
            tf = np.diff(np.append(starts, len(at)))
            first = at[starts]
            terms = coded.dictionary.take(pa.array(order[place[coded.indices.to_numpy(zero_copy_only=False)[first]]])).cast(pa.string())
            listed = pa.StructArray.from_arrays([terms, pa.array(tf, pa.int64()), pa.array(pos[first], pa.int32())], fields=list(kind.value_type))
            ends = np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32)
            empty = pa.array(np.append(size == 0, False))
            lists_of = pa.ListArray.from_arrays(pc.if_else(empty, pa.scalar(None, pa.int32()), pa.array(ends)), listed)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists_of.cast(kind)], names=schema.names)

    return said.mapInArrow(count, schema)


def term_table(df: DataFrame, key: str, tokens: Column, *keep: str) -> DataFrame:
    """(key, keep..., term, tf, pos): term counts and the first position of each row's text, without a shuffle; ``key`` tells rows apart."""
    return df.select(key, *keep, F.inline(counted(tokens))).select(key, *keep, "term", "tf", "pos")


def exploded(rows: DataFrame) -> DataFrame:
    """A term table of rows with ``terms``, as of ``counted``."""
    return rows.select(*[c for c in rows.columns if c != "terms"], F.inline("terms")).select(*[c for c in rows.columns if c != "terms"], "term", "tf", "pos")


def vocabulary(terms: DataFrame, key: str, n_docs: int, size: int, min_df: int = 1, min_length: int = 2) -> DataFrame:
    """(term, tf, df, idf) of the ``size`` most frequent terms, ties to the first appearance by key and position.

    idf is ln((1 + N) / (1 + df)) + 1.
    """
    stats = terms.where(F.length("term") >= min_length).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"), F.min(F.struct(key, "pos")).alias("seen"))
    top = stats.where(F.col("df") >= min_df).orderBy(F.col("tf").desc(), "seen").limit(size)
    return top.select("term", "tf", "df", (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(terms: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): term shares among known terms times idf, scaled to length 1."""
    known = terms.select(key, "term", "tf").join(vocab.select("term", "idf"), "term")
    by = Window.partitionBy(key)
    raw = known.withColumn("weight", F.col("tf") / F.sum("tf").over(by) * F.col("idf"))
    return raw.select(key, "term", (F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(by))).alias("weight"))


def fold_vocabulary(terms: DataFrame, key: str, fold: str, size: int, min_length: int = 2) -> DataFrame:
    """(held, term, idx, idf): the vocabulary of the rows outside each fold, numbered from 0 in alphabetical order.

    ``terms`` has (key, fold, term, tf, pos) and is read twice.  Sums by term and
    fold are all that is shared out to the folds.  The first pass has the sums
    alone, whose histogram gives the least one that a fold keeps; documents and
    first appearances are for the terms that reach it.
    """
    folds = terms.select(key, fold).distinct().groupBy(fold).agg(F.count("*").alias("docs"))
    known = [(r[0], r[1]) for r in folds.collect()]  # one row for each fold
    if not known:
        return terms.select(F.col(fold).alias("held"), "term", F.lit(0).alias("idx"), F.lit(0.0).alias("idf")).limit(0)
    outside = F.map_from_entries(F.array(*[F.struct(F.lit(f).cast(terms.schema[fold].dataType), F.lit(sum(n for g, n in known if g != f))) for f, _ in known]))
    of = lambda f: F.col(fold) == f
    long_enough = terms.where(F.length("term") >= min_length)
    sums = written(long_enough.groupBy("term").agg(*[F.coalesce(F.sum(F.when(of(f), F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, (f, _) in enumerate(known)]), "sums", "zstd")
    side = [sum((F.col(f"tf{i}") for i in range(len(known)) if i != h), F.lit(0).cast("long")) for h in range(len(known))]
    spread = sums.select(F.posexplode(F.array(*side)).alias("held", "tf")).where("tf > 0").groupBy("held", "tf").agg(F.count("*").alias("n"))
    by = Window.partitionBy("held").orderBy(F.col("tf").desc())  # a row for each fold and sum
    least = dict(spread.withColumn("before", F.sum("n").over(by) - F.col("n")).where(F.col("before") < size).groupBy("held").agg(F.min("tf")).collect())
    reach = [F.col("_s")[h] >= t for h, t in least.items()]
    wanted = written(sums.withColumn("_s", F.array(*side)).where(reduce(or_, reach, F.lit(False))).select("term"), "wanted", "zstd")
    long_enough = long_enough.join(small(wanted), "term")
    own = [x for i, (f, _) in enumerate(known) for x in (F.sum(F.when(of(f), F.col("tf"))).alias(f"tf{i}"), F.count(F.when(of(f), 1)).alias(f"df{i}"), F.min(F.when(of(f), F.struct(key, "pos"))).alias(f"seen{i}"))]
    part = long_enough.groupBy("term").agg(*own)  # one row of a term for all folds: the folds share one shuffle
    total = lambda c, h: sum((F.coalesce(F.col(f"{c}{i}"), F.lit(0)) for i in range(len(known)) if i != h), F.lit(0).cast("long"))
    seen = lambda h: F.array_min(F.array_compact(F.array(*[F.col(f"seen{i}") for i in range(len(known)) if i != h]))) if len(known) > 1 else F.col("seen0")
    sides = [F.struct(F.lit(f).cast(terms.schema[fold].dataType).alias("held"), total("tf", i).alias("tf"), total("df", i).alias("df"), seen(i).alias("seen")) for i, (f, _) in enumerate(known)]
    stats = part.select("term", F.inline(F.array(*sides))).where("df > 0")
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"  # up to it, each task sends its own first rows of a fold, not all terms
    terms.sparkSession.conf.set(limit, str(max(size, int(terms.sparkSession.conf.get(limit)))))
    top = stats.withColumn("_r", F.row_number().over(Window.partitionBy("held").orderBy(F.col("tf").desc(), "seen"))).where(F.col("_r") <= size)
    idf = F.log((1.0 + F.element_at(outside, F.col("held"))) / (1 + F.col("df"))) + 1
    return top.select("held", "term", (F.row_number().over(Window.partitionBy("held").orderBy("term")) - 1).alias("idx"), idf.alias("idf"))


def fold_vectors(terms: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(held, key, idx, weight): TF-IDF of every row by the vocabulary of each fold's training side, scaled to length 1."""
    known = terms.select(key, "term", "tf").join(vocab, "term")
    by = Window.partitionBy("held", key)
    raw = known.withColumn("weight", F.col("tf") / F.sum("tf").over(by) * F.col("idf"))
    return raw.select("held", key, "idx", (F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(by))).alias("weight"))


#: Vectors of rows as two arrays, indices and weights.
PACKED = StructType([StructField("i", ArrayType(IntegerType())), StructField("w", ArrayType(DoubleType()))])


def lists(flat: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """``flat`` as n lists; ``row`` is the row of each value, ascending."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, weight) of a column of PACKED vectors; a null one is empty."""
    i, w = x.field("i"), x.field("w")
    return pc.list_parent_indices(i).to_numpy(zero_copy_only=False), pc.list_flatten(i).to_numpy(zero_copy_only=False), pc.list_flatten(w).to_numpy(zero_copy_only=False)


def _by_fold(vocab: DataFrame) -> tuple[list, list[str], np.ndarray, np.ndarray]:
    """(folds, all their terms, each term's index and idf by fold); an index of -1 is no term of the fold."""
    words = vocab.select("held", "term", "idx", "idf").collect()  # folds times the terms that a model keeps
    held, terms = sorted({r.held for r in words}), sorted({r.term for r in words})
    place = {t: i for i, t in enumerate(terms)}
    index, idf = np.full((len(held), len(terms)), -1, np.int32), np.zeros((len(held), len(terms)))
    for r in words:
        index[held.index(r.held), place[r.term]], idf[held.index(r.held), place[r.term]] = r.idx, r.idf
    return held, terms, index, idf


def fold_rows(rows: DataFrame, vocab: DataFrame, key: str, *keep: str) -> DataFrame:
    """(held, key, keep..., x): ``fold_vectors`` packed, a row for each fold of ``vocab`` and row of ``rows``, without a shuffle.

    ``rows`` has (key, keep..., terms), terms as of ``counted``.  The vocabulary,
    of bounded size for each fold, is sent to the tasks; a row without a known
    term has an empty vector.
    """
    held, terms, index, idf = _by_fold(vocab)
    schema = StructType([StructField("held", vocab.schema["held"].dataType), *[rows.schema[c] for c in (key, *keep)]]).add("x", PACKED)
    held_kind = to_arrow_type(schema["held"].dataType)
    kind = pa.struct([("i", pa.list_(pa.int32())), ("w", pa.list_(pa.float64()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for b in batches:
            own, n = b.column("terms"), b.num_rows
            row, words = pc.list_parent_indices(own).to_numpy(zero_copy_only=False), pc.list_flatten(own)
            no = pc.fill_null(pc.index_in(words.field("term"), known), -1).to_numpy(zero_copy_only=False)
            tf = words.field("tf").to_numpy(zero_copy_only=False)
            for h, value in enumerate(held):
                at = np.flatnonzero(no >= 0)
                at = at[index[h][no[at]] >= 0]
                r, t = row[at], no[at]
                w = tf[at] / np.bincount(r, tf[at], n)[r] * idf[h][t]
                w = w / np.sqrt(np.bincount(r, w * w, n))[r]
                x = pa.StructArray.from_arrays([lists(index[h][t], r, n), lists(w, r, n)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([pa.array([value] * n, held_kind), *[b.column(c) for c in (key, *keep)], x], names=["held", key, *keep, "x"])

    return rows.select(key, *keep, "terms").mapInArrow(pack, schema)


def fold_counts(rows: DataFrame, vocab: DataFrame, key: str, *keep: str) -> tuple[DataFrame, dict]:
    """((held, key, keep..., x), {fold: idf by index}): ``fold_rows`` with x the indices and counts of known terms in few bytes, which ``counts_of`` reads.

    Weights are the counts' shares times idf, scaled to length 1; where rows
    are moved their counts are a tenth of their weights.
    """
    held, terms, index, idf = _by_fold(vocab)
    schema = StructType([StructField("held", vocab.schema["held"].dataType), *[rows.schema[c] for c in (key, *keep)]]).add("x", BinaryType())
    held_kind = to_arrow_type(schema["held"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for b in batches:
            own, n = b.column("terms"), b.num_rows
            row, words = pc.list_parent_indices(own).to_numpy(zero_copy_only=False), pc.list_flatten(own)
            no = pc.fill_null(pc.index_in(words.field("term"), known), -1).to_numpy(zero_copy_only=False)
            tf = words.field("tf").to_numpy(zero_copy_only=False)
            for h, value in enumerate(held):
                at = np.flatnonzero(no >= 0)
                at = at[index[h][no[at]] >= 0]
                idx, own_tf, ends = index[h][no[at]].astype("<i4"), tf[at].astype("<i4"), np.searchsorted(row[at], np.arange(n + 1))
                x = [pa.compress(idx[i:j].tobytes() + own_tf[i:j].tobytes(), codec="zstd", asbytes=True) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                x = [int(j - i).to_bytes(4, "little") + own for own, i, j in zip(x, ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([value] * n, held_kind), *[b.column(c) for c in (key, *keep)], pa.array(x, pa.binary())], names=["held", key, *keep, "x"])

    own_idf = {h: np.array([w for _, w in sorted((i, w) for i, w in zip(index[n], idf[n], strict=True) if i >= 0)]) for n, h in enumerate(held)}
    return rows.select(key, *keep, "terms").mapInArrow(pack, schema), own_idf


def counts_of(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(indices, counts) of a row of ``fold_counts``."""
    n = int.from_bytes(x[:4], "little")
    data = pa.decompress(x[4:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(data, "<i4", n), np.frombuffer(data, "<i4", n, 4 * n)


def long_vectors(rows: DataFrame, key: str) -> DataFrame:
    """(held, key, idx, weight) of packed rows."""
    return rows.select("held", key, F.inline(F.arrays_zip(F.col("x.i").alias("idx"), F.col("x.w").alias("weight"))))


def naive_bayes(terms: DataFrame, key: str, label: str, fold: str, classes: list[str], prior: bool = True) -> DataFrame:
    """(key, label, score) for every text and class: multinomial Naive Bayes with add-one smoothing.

    ``terms`` has columns key, label, fold, term, tf, and is best a written
    table; each text is scored by the other folds' texts.  Terms unseen in
    training still count in the denominator.  A term's counts outside each fold
    that has it are one map, and looked up once by each text that holds the
    term; the totals are a row for each fold.
    """
    counts = terms.groupBy("term", fold).agg(*[F.coalesce(F.sum(F.when(F.col(label) == c, F.col("tf"))), F.lit(0).cast("long")).alias(f"_c{i}") for i, c in enumerate(classes)])
    by_term = counts.groupBy("term").agg(
        F.collect_list(F.when(F.col(fold).isNotNull(), F.struct(F.col(fold).alias("f"), F.array(*[f"_c{i}" for i in range(len(classes))]).alias("c")))).alias("own"),  # an entry for each fold
        F.array(*[F.coalesce(F.sum(F.when(F.col(fold).isNotNull(), F.col(f"_c{i}"))), F.lit(0).cast("long")) for i in range(len(classes))]).alias("all"),
        F.count(fold).alias("k"),
        F.min(fold).alias("only"),
    )
    outside_of = F.map_from_entries(F.transform("own", lambda e: F.struct(e["f"].alias("f"), F.zip_with(F.col("all"), e["c"], lambda a, c: a - c).alias("c"))))
    of_term = written(by_term.withColumn("own", outside_of), "of_term")
    texts = terms.groupBy(key, fold, label).agg(F.sum("tf").alias("t")).groupBy(fold, label).agg(F.sum("t").alias("t"), F.count("*").alias("d"))
    vocabulary = of_term.groupBy(F.when(F.col("k") == 1, F.col("only")).alias("f")).agg(F.count("*").alias("n"))
    # A row for each fold: the classes' sums outside it, and the terms that occur outside it.
    totals = texts.agg(F.collect_list(F.struct(fold, label, "t", "d")).alias("all")).crossJoin(vocabulary.agg(F.collect_list(F.struct("f", "n")).alias("words")))  # one row each
    held = texts.select(F.col(fold).alias("held")).distinct().crossJoin(totals)
    add = lambda rows, field: F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + r[field])
    outside = F.filter("all", lambda r: r[fold] != F.col("held"))
    words = F.filter("words", lambda w: ~w["f"].eqNullSafe(F.col("held")))
    of_class = lambda c: F.filter(outside, lambda r: r[label] == c)
    per_class = F.array(*[F.struct(F.lit(c).alias("class"), add(of_class(c), "t").alias("t"), add(of_class(c), "d").alias("d")) for c in classes])
    folds = F.broadcast(written(held.select("held", per_class.alias("classes"), add(words, "n").alias("v"), add(outside, "d").alias("docs")), "folds").withColumnRenamed("held", fold))  # a row for each fold
    # The counts of a term outside the text's fold, class by class.
    met = terms.select(key, fold, "term", "tf").join(of_term.select("term", "own", "all"), "term").select(key, fold, "tf", F.coalesce(F.try_element_at("own", F.col(fold)), F.col("all")).alias("_c"))
    rows = met.select(key, fold, "tf", *[F.col("_c")[i].alias(f"_c{i}") for i in range(len(classes))])
    rows = rows.join(folds, fold)
    part = lambda i: F.sum(F.col("tf") * F.log((F.col(f"_c{i}") + 1) / (F.col("classes")[i]["t"] + F.col("v"))))
    scored = rows.groupBy(key, fold).agg(*[part(i).alias(f"_s{i}") for i in range(len(classes))])
    scored = scored.join(folds, fold)
    starts = lambda i: F.log(F.col("classes")[i]["d"] / F.col("docs")) if prior else F.lit(0.0)
    found = F.array(*[F.struct(F.lit(c).alias("label"), F.when(F.col("classes")[i]["d"] > 0, F.col(f"_s{i}") + starts(i)).alias("score")) for i, c in enumerate(classes)])
    return scored.select(key, F.inline(found)).where(F.col("score").isNotNull()).select(key, "label", "score")


def best_label(scores: DataFrame, key: str, order: list[str], digits: int | None = None) -> DataFrame:
    """(key, pred) of the highest score, rounded to ``digits`` if given, ties to the class listed first."""
    scores = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("label"))
    return scores.groupBy(key).agg(F.min_by("label", F.struct(-F.col("score"), place)).alias("pred"))


def bm25(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, k1: float = 1.5, b: float = 0.75, fold: str | None = None) -> DataFrame:
    """(query_key, doc_key, score) of all pairs that share a term.

    ``docs`` is a term table, ``queries`` has distinct (query_key, term) rows.
    With ``fold`` in both, a query meets only documents of other folds, and
    document counts, frequencies and lengths are those of the other folds.
    """
    lengths = docs.groupBy(doc_key, *([fold] if fold else [])).agg(F.sum("tf").alias("len"))
    if fold:
        stats = lengths.groupBy(fold).agg(F.count("*").alias("n"), F.sum("len").alias("l"))
        stats = stats.select(F.col(fold).alias("q_fold"), (F.sum("n").over(Window.partitionBy()) - F.col("n")).alias("n"), ((F.sum("l").over(Window.partitionBy()) - F.col("l")) / (F.sum("n").over(Window.partitionBy()) - F.col("n"))).alias("avg"))
        by_fold = docs.groupBy("term", fold).agg(F.count("*").alias("own"))
        by_fold = by_fold.withColumn("all", F.sum("own").over(Window.partitionBy("term")))
        totals = docs.groupBy("term").agg(F.count("*").alias("all"))
        asked = queries.withColumnRenamed(fold, "q_fold").join(totals, "term").join(by_fold.select("term", F.col(fold).alias("q_fold"), "own"), ["term", "q_fold"], "left").na.fill(0, ["own"])
        asked = asked.withColumn("df", F.col("all") - F.col("own")).join(F.broadcast(stats), "q_fold").drop("all", "own")  # one row for each fold
        paired = asked.join(docs.select(doc_key, F.col(fold).alias("d_fold"), "term", "tf"), "term").where("q_fold <> d_fold").join(lengths.select(doc_key, "len"), doc_key)
    else:
        stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
        freq = docs.groupBy("term").agg(F.count("*").alias("df"))
        paired = queries.join(freq, "term").join(docs.select(doc_key, "term", "tf"), "term").join(lengths, doc_key).crossJoin(stats)  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return paired.groupBy(query_key, doc_key).agg(F.sum(score).alias("score"))


def top_per_query(scores: DataFrame, query_key: str, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each query with their rank."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(*order))).where(F.col("rank") <= n)


def label_capped(scores: DataFrame, query_key: str, label: str, order: list[Column | str], cap: int, total: int) -> DataFrame:
    """The best rows of each query, at most ``cap`` of a label and ``total`` in all."""
    within = scores.where("score > 0").withColumn("_c", F.row_number().over(Window.partitionBy(query_key, label).orderBy(*order)))
    return top_per_query(within.where(F.col("_c") <= cap).drop("_c"), query_key, order, total)


def knn_label(top: DataFrame, query_key: str, label: str, fallback: str) -> DataFrame:
    """(query_key, pred): the label with the highest sum of positive scores, ties to the best single rank; else the fallback."""
    votes = top.groupBy(query_key, label).agg(F.sum(F.when(F.col("score") > 0, F.col("score")).otherwise(0.0)).alias("s"), F.min("rank").alias("r"))
    best = votes.withColumn("_r", F.row_number().over(Window.partitionBy(query_key).orderBy(F.round("s", 9).desc(), "r"))).where("_r = 1")
    return best.select(query_key, F.when(F.col("s") > 0, F.col(label)).otherwise(fallback).alias("pred"))
