"""Exact BM25 retrieval with upper bounds, over a written inverted index.

The index holds the postings by term and block of documents, and for each term
and block the greatest share of a score that any of its documents takes from
the term.  A query's rare terms give first candidates, whose scores bound its
k-th score from below.  Terms that together cannot reach that score are not
searched: candidates come from the other terms' postings only, in blocks whose
bounds reach the k-th, and are completed by look-ups of their own words.  A term
and block is a key of at most BLOCK postings, so a stop word is no hot group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import BROADCAST_ROWS, small, written
from .features import counted

#: Documents of a block; postings read for a query's first candidates; what rounding may take from a bound.
BLOCK, SEED, SLACK = 1024, 64, 1e-4
#: Postings of all queries' terms together that are read outright: one join and one sum are less than the passes that bounds take.
FEW = 1_000_000_000


@dataclass
class Index:
    """``postings``: (doc, fold, label, len, block, term, tf), ``terms``: (term, df, own), ``folds``: (q_fold, n, avg); the largest avg."""

    postings: DataFrame
    terms: DataFrame
    folds: DataFrame
    avg: float
    k1: float
    b: float

    def tops(self) -> DataFrame:
        """(term, block, top): a share grows with the mean length, so the largest mean bounds it in all folds."""
        top = F.max(_share(F.col("tf"), F.col("len"), F.lit(self.avg), self.k1, self.b))
        return written(self.postings.groupBy("term", "block").agg(top.alias("top")), "tops")


def _share(tf: Column, length: Column, avg: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


def build_index(docs: DataFrame, doc_key: str, tokens: Column, fold: str | None = None, label: str | None = None, k1: float = 1.5, b: float = 0.75, block: int = BLOCK) -> Index:
    """Tokenise every document once and write its words and the lists by term and block.

    With ``fold`` a query will meet the documents of the other folds only, by
    their statistics; ``label`` is kept for selections by label.  A null key or
    text is left out.
    """
    # The empty term stands for the document itself; a text's terms are counted within its row.
    made = lambda t: F.struct(F.size(t).alias("len"), counted(F.concat(F.array(F.lit("")), t)).alias("terms"))
    said = docs.select(F.col(doc_key).alias("doc"), (F.col(fold) if fold else F.lit(0)).alias("fold"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), F.inline(F.transform(F.array(tokens), made)))
    terms = said.where("doc is not null and len > 0").select("doc", "fold", "label", "len", F.inline("terms")).drop("pos")
    postings = written(terms.withColumn("hash", F.xxhash64("doc")), "postings")
    by_fold = postings.where("term = ''").groupBy("fold").agg(F.count("*").alias("n"), F.sum("len").alias("total"))
    if fold:
        every = Window.partitionBy()  # one row for each fold
        folds = by_fold.select(F.col("fold").alias("q_fold"), (F.sum("n").over(every) - F.col("n")).alias("n"), ((F.sum("total").over(every) - F.col("total")) / F.nullif(F.sum("n").over(every) - F.col("n"), F.lit(0))).alias("avg"))
    else:
        folds = by_fold.select(F.col("fold").alias("q_fold"), "n", (F.col("total") / F.col("n")).alias("avg"))
    folds = written(folds, "folds")
    bounds = folds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("avg"), F.lit(1.0)).alias("avg")).first()
    n_blocks = max(1, -(-bounds.n // block))
    postings = postings.where("term <> ''").withColumn("block", F.pmod("hash", F.lit(n_blocks))).drop("hash")
    by_term = postings.groupBy("term", "fold").agg(F.count("*").alias("own")).groupBy("term")
    terms = by_term.agg(F.sum("own").alias("df"), F.map_from_entries(F.collect_list(F.struct("fold", "own"))).alias("own"))  # an entry for each fold
    return Index(postings, terms, folds, float(bounds.avg), k1, b)


def _completed(index: Index, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """``pairs`` (query, doc, label, part) with ``score``: part, and what the terms of ``asked`` (query, avg, term, idf) add."""
    said = small(written(asked.select("term").distinct(), "said"))
    words = index.postings.select("doc", "term", "tf", "len").join(said, "term", "left_semi")  # few queries' terms are sent to the postings, not these to them
    share = F.col("idf") * _share(F.col("tf").cast("double"), F.col("len"), F.col("avg"), index.k1, index.b)
    added = pairs.select("query", "doc", "label").join(asked, "query").join(words, ["doc", "term"]).select("query", "doc", "label", share.alias("part"))
    return pairs.select("query", "doc", "label", "part").union(added).groupBy("query", "doc", "label").agg(F.sum("part").alias("score"))


def _kth(scored: DataFrame, k: int, labelled: bool) -> DataFrame:
    """(query, kth): a score that the query's k-th row (k-th of every label) reaches at least; none where fewer are known."""
    group = ["query", "label"] if labelled else ["query"]
    ranked = scored.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("score").desc()))).where(F.col("_r") == k)
    return ranked.select(*group, F.col("score").alias("kth"))


def search(index: Index, queries: DataFrame, query_key: str, tokens: Column, k: int, fold: str | None = None, by_label: bool = False, seed: int = SEED, few: int = FEW) -> DataFrame:
    """(query, doc, label, score): all documents whose score may be among the query's first k, of each label if ``by_label``, with their exact scores.

    Where the queries' terms have at most ``few`` postings together these are
    read outright and every document with a term of the query is a row.
    Rows beyond the k-th are ties up to SLACK and others that the bounds let
    through; rank and cut them by any order of score and ties.  A query without
    known terms has no row.
    """
    said = queries.select(F.col(query_key).alias("query"), (F.col(fold) if fold else F.lit(0)).alias("q_fold"), F.explode(F.array_distinct(tokens)).alias("term")).where(F.col("query").isNotNull()).distinct()
    known = said.join(index.terms, "term").join(small(index.folds), "q_fold").where("n > 0")
    df = F.col("df") - F.coalesce(F.col("own")[F.col("q_fold")], F.lit(0)) if fold else F.col("df")
    known = known.withColumn("df", df).where("df > 0").withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    known = written(known.select("query", "q_fold", "avg", "term", "df", "idf"), "known")
    asked = known.select("query", "q_fold", "avg", "term", "idf")
    others = F.col("fold") != F.col("q_fold") if fold else F.lit(True)
    score = F.sum(F.col("idf") * _share(F.col("tf").cast("double"), F.col("len"), F.col("avg"), index.k1, index.b))
    if (known.agg(F.sum("df")).first()[0] or 0) <= few:
        return index.postings.join(small(asked), "term").where(others).groupBy("query", "doc", "label").agg(score.alias("score"))
    index_tops = index.tops()
    known = known.join(index_tops.groupBy("term").agg(F.max("top").alias("most")), "term").withColumn("bound", F.col("idf") * F.col("most"))
    rare = Window.partitionBy("query").orderBy("df", "term")
    first = known.withColumn("_before", F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = first.where((F.col("_before") == 0) | (F.col("_before") + F.col("df") <= seed)).select("query", "q_fold", "term")
    seeds = index.postings.join(small(written(first, "first")), "term").where(others).select("query", "doc", "label").distinct().withColumn("part", F.lit(0.0))
    kth = written(_kth(_completed(index, seeds, asked.drop("q_fold")), k, by_label), "kth")
    if by_label:  # a term is needed if any label's documents may need it; a label not met yet needs all
        n_labels = index.postings.select("label").distinct().count()
        floor = kth.groupBy("query").agg(F.when(F.count("*") >= n_labels, F.min("kth")).alias("floor"))
    else:
        floor = kth.select("query", F.col("kth").alias("floor"))
    # The terms of least bound that together stay below the k-th score are completed, not searched.
    upto = F.sum("bound").over(Window.partitionBy("query").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    reach = known.withColumn("upto", upto).join(floor, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    plan = written(reach.select("query", "q_fold", "avg", "floor", "term", "idf", (F.col("upto") >= F.col("floor")).alias("needed")), "plan")
    tops = plan.join(index_tops, "term").groupBy("query", "block").agg(
        F.sum(F.col("idf") * F.col("top")).alias("reach"), F.sum(F.when(~F.col("needed"), F.col("idf") * F.col("top")).otherwise(0.0)).alias("rest"), F.first("floor").alias("floor"), F.bool_or("needed").alias("any"),
    )
    blocks = tops.where("any and reach >= floor").select("query", "block", "rest", "floor")
    needed = small(written(plan.where("needed").select("query", "q_fold", "avg", "term", "idf"), "needed"))
    reads = index.postings.join(needed, "term").where(others).join(small(written(blocks, "blocks"), 10 * BROADCAST_ROWS), ["query", "block"])
    part = reads.groupBy("query", "doc", "label").agg(score.alias("part"), F.first("rest").alias("rest"), F.first("floor").alias("floor"))
    alive = part.where("part + rest >= floor")
    if by_label:
        alive = alive.join(kth, ["query", "label"], "left").where(F.col("kth").isNull() | (F.col("part") + F.col("rest") >= F.col("kth") - SLACK))
    return _completed(index, written(alive.select("query", "doc", "label", "part"), "alive"), plan.where("not needed").select("query", "avg", "term", "idf"))
