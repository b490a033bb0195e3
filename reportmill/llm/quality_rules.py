"""Quality rules whose cutoffs are controlled by risk, with DataFrame functions only.

Every text gets a few counts and, from them, a severity for each rule, a whole
number.  One part of the documents labelled good tunes a path of cutoffs for
each stratum: at level l a rule rejects what exceeds all but a given share of
the good documents.  The other part, the holdout, tests the union of all rules
level by level: a level stands if the exact binomial chance of so few rejected
good documents, were the true share above ``risk``, is at most ``error`` over
the number of strata.  Levels are tested from the mildest on and end at the
first that fails, which needs no further correction, and strata share ``error``
(Bonferroni).  So with probability 1 - ``error`` no stratum's rules reject more
than ``risk`` of its good documents, as far as rows are drawn alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sizes import small
from .workspace import materialize

#: Words of a window that counts as repeated when it is found twice.
SPAN = 8
#: Greatest severity; larger ones count as this.
MOST = 10_000
#: Share of good documents, in thousandths, that a rule may exceed at each level.
LEVELS = (0, 1, 2, 3, 4, 5, 6, 8, 10)
RISK, ERROR = 0.02, 0.05
#: First hex digits of the id's MD5 that put a labelled document on the tuning side (5 of 16).
TUNING = "01234"

SPACES, LINE_WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
BLANKS, SYMBOLS = "\t\n\x0b\f\r ", "#*$%&|<>"
RULES = ("symbols", "long_words", "short_words", "dup_lines", "repeats")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """Number of words in windows of ``span`` words that are found twice or more in the array.

    Windows are told apart by 64 bits.  Only an array with a repeated window is
    sorted, so time is n log n at most.
    """
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashed, lambda h: F.transform(F.sequence(F.lit(1), n - (span - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(span)))))

    def covered(own: Column) -> Column:
        placed = F.array_sort(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, h: F.get(s, i)["h"] == h
        twice = _let(placed, lambda s: F.filter(s, lambda x, i: F.coalesce(same(s, i - 1, x["h"]), F.lit(False)) | F.coalesce(same(s, i + 1, x["h"]), F.lit(False))))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        step = lambda a, i: F.struct((a["n"] + i + span - F.greatest(i, a["to"])).alias("n"), (i + span).alias("to"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    counted = _let(windows, lambda own: F.when(F.size(F.array_distinct(own)) < F.size(own), covered(own)).otherwise(0))
    return F.when(n > span, counted).otherwise(0).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """(id_col, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) in one pass without a shuffle.

    Words are runs of anything but white space; word_chars are their code
    points; a line counts if it holds a word.  A null text has no words, a null
    stratum is the empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), text.alias("_text"))
    solid = F.translate("_text", BLANKS, "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(LINE_WORD))
    rows = rows.select(
        "_id", "_stratum", F.array_remove(F.split("_text", SPACES), "").alias("_words"), F.char_length(solid).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda own: F.struct(F.size(own).cast("long").alias("n"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("dup"))).alias("_lines"),
    )
    counted = rows.select(
        F.col("_id").alias(id_col), F.col("_stratum").alias("stratum"), F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("_lines.n").alias("n_lines"), F.col("_lines.dup").alias("n_dup_lines"), repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def severities() -> dict[str, Column]:
    """Each rule's severity of a measured row, from 0 to MOST."""
    share = lambda a, b, of: F.least(F.lit(MOST), F.floor(of * F.col(a) / F.greatest(F.lit(1), F.col(b)))).cast("int")
    length = share("word_chars", "n_words", 100)
    return {"symbols": share("n_symbols", "word_chars", 1000), "long_words": length, "short_words": F.lit(MOST) - length, "dup_lines": share("n_dup_lines", "n_lines", 1000), "repeats": share("n_repeat_words", "n_words", 1000)}


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """Chance of at most ``x`` hits among ``n`` draws of chance ``p``; 1 where x >= n p, where it is a half at least.

    The chance of x itself is taken from the deviance and the remainders of
    Stirling's series; those of fewer hits follow by their ratios, until ten
    standard deviations on nothing is left to add.
    """
    exact = F.array(*[F.lit(0.0), *[F.lit(math.lgamma(m + 1) - (m + 0.5) * math.log(m) + m - 0.5 * math.log(2 * math.pi)) for m in range(1, 16)]])
    x, n = x.cast("double"), n.cast("double")
    rest = lambda m: F.when(m < 16, F.get(exact, m.cast("int"))).otherwise(1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * F.pow(m, F.lit(5.0))) - 1 / (1680 * F.pow(m, F.lit(7.0))))
    deviance = x * F.log(x / (n * p)) + (n - x) * F.log((n - x) / (n * (1 - p)))
    at_x = F.when(x == 0, F.exp(n * math.log1p(-p))).otherwise(F.sqrt(n / (2 * math.pi * x * (n - x))) * F.exp(rest(n) - rest(x) - rest(n - x) - deviance))
    steps = F.least(x, F.ceil(10 * F.sqrt(n * (p * (1 - p)))) + 50).cast("int")
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * (x - j + 1) * (1 - p) / ((n - x + j) * p)
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    below = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), zero, step, lambda a: a["sum"])).otherwise(1.0)
    return F.when(x >= n * p, 1.0).otherwise(at_x * below)


def cutoffs(good: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(stratum, cuts): for each stratum a map of rule to its cutoffs, one for each level, from the severities of the tuning rows.

    ``good`` has (stratum, rule columns).  A cutoff is the least severity that
    at most the level's thousandths of the rows exceed.  Only counts by
    severity, at most MOST of a stratum and rule, are sorted.
    """
    long = good.select("stratum", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "v"))
    counts = long.groupBy("stratum", "rule", "v").agg(F.count("*").alias("n"))
    by = Window.partitionBy("stratum", "rule")
    upto = F.sum("n").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    above = counts.select("stratum", "rule", "v", F.sum("n").over(by).alias("all"), upto.alias("upto"))
    cuts = above.groupBy("stratum", "rule").agg(F.array(*[F.min(F.when(1000 * (F.col("all") - F.col("upto")) <= e * F.col("all"), F.col("v"))) for e in levels]).alias("cuts"))
    return cuts.groupBy("stratum").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "cuts")))).alias("cuts"))


def first_level(levels: int) -> Column:
    """Number of the first level at which any rule rejects the row, ``levels`` if none does or there are no cutoffs."""
    passed = lambda r: F.size(F.filter(F.get(F.array(F.col("cuts")[r]), F.lit(0)), lambda c: F.col(r) <= c))
    return F.when(F.col("cuts").isNull(), levels).otherwise(F.least(*[passed(r) for r in RULES]))


def chosen_levels(held: DataFrame, levels: int, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, chosen): the last level of each stratum before the first that fails its test, -1 if the first fails.

    ``held`` has (stratum, level), a row for each good document of the holdout.
    """
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("level") <= i).alias(f"x{i}") for i in range(levels)])
    counts = counts.withColumn("strata", F.count("*").over(Window.partitionBy()))  # one row for each stratum
    fails = F.array(*[binomial_tail(F.col(f"x{i}"), F.col("n"), risk) > F.lit(error) / F.col("strata") for i in range(levels)])
    first = F.array_position(fails, True)
    return counts.select("stratum", F.when(first == 0, levels - 1).otherwise(first - 2).cast("int").alias("chosen"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", label_col: str = "quality",
    levels: tuple[int, ...] = LEVELS, risk: float = RISK, error: float = ERROR,
) -> DataFrame:
    """One row per document: (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, level).

    ``level`` is the first level of the stratum's path that rejects the
    document (the number of levels if none does); it is kept if it passes the
    base rules and its level is beyond the stratum's chosen one.

    Defined cases: null and empty texts have no words and fail the base rules;
    texts of any length are taken whole; a null stratum is the empty one; a
    stratum without tuning rows or without enough held-out ones rejects nothing
    beyond the base rules; an id is good if all its labels are 1; null ids and
    null labels teach nothing; repeated document rows give repeated, equal rows
    and count each; of equal severities all or none are rejected; empty tables
    give an empty result or the base rules alone; other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_of"), F.col(stratum).alias("_in"))
    rows = materialize(measures(named, "_doc", "_of", "_in"), "measures")
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_good")).agg(F.min(label_col).alias("_low"), F.max(label_col).alias("_high")).where("_low = 1 and _high = 1")
    known = rows.where(~F.col("base_failed")).join(good, F.col("_doc") == F.col("_good")).select("stratum", F.substring(F.md5(F.col("_good").cast("string").cast("binary")), 1, 1).isin(*TUNING).alias("tunes"), *[v.alias(r) for r, v in severities().items()])
    known = materialize(known, "good")
    paths = materialize(cutoffs(known.where("tunes"), levels), "paths")
    held = known.where("not tunes").join(small(paths), "stratum", "left").select("stratum", first_level(len(levels)).alias("level"))
    limits = materialize(paths.join(chosen_levels(held, len(levels), risk, error), "stratum", "left"), "limits")
    out = rows.withColumns(severities()).join(small(limits), "stratum", "left").withColumn("level", first_level(len(levels)))
    kept = ~F.col("base_failed") & (F.col("level") > F.coalesce("chosen", F.lit(-1)))
    return out.select(F.col("_doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "stratum", "level")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, p, array_to_string(w[p:p + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
rep AS (SELECT rid, count(DISTINCT x) AS n_rep FROM (SELECT rid, unnest(range(p, p + 8)) AS x FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, s) AS k FROM win) WHERE k > 1) GROUP BY rid),
m AS (SELECT rid, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (SELECT rid, stratum, base_failed, doc_id, least(10000, 1000 * n_symbols // greatest(1, word_chars)) AS symbols, least(10000, 100 * word_chars // greatest(1, n_words)) AS long_words,
10000 - least(10000, 100 * word_chars // greatest(1, n_words)) AS short_words, least(10000, 1000 * n_dup_lines // greatest(1, n_lines)) AS dup_lines, least(10000, 1000 * n_repeat_words // greatest(1, n_words)) AS repeats FROM j),
u AS (SELECT * FROM (SELECT rid, stratum, base_failed, doc_id, unnest([{'rule': 'symbols', 'v': symbols}, {'rule': 'long_words', 'v': long_words}, {'rule': 'short_words', 'v': short_words}, {'rule': 'dup_lines', 'v': dup_lines}, {'rule': 'repeats', 'v': repeats}], recursive := true) FROM v)),
g AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
k AS (SELECT u.*, substr(md5(doc_id::VARCHAR), 1, 1) IN ('0', '1', '2', '3', '4') AS tunes FROM u JOIN g USING (doc_id) WHERE NOT base_failed),
h AS (SELECT stratum, rule, v, count(*) AS n FROM k WHERE tunes GROUP BY ALL),
a AS (SELECT stratum, rule, v, sum(n) OVER (PARTITION BY stratum, rule) AS total, sum(n) OVER (PARTITION BY stratum, rule ORDER BY v DESC) - n AS above FROM h),
e AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 8), (8, 10)) AS e (lv, share)),
c AS (SELECT stratum, rule, lv, min(v) AS cut FROM a, e WHERE 1000 * above <= share * total GROUP BY ALL),
f AS (SELECT rid, coalesce(min(lv), 9) AS level FROM u LEFT JOIN c ON u.stratum = c.stratum AND u.rule = c.rule AND u.v > c.cut GROUP BY rid),
hold AS (SELECT DISTINCT k.rid, k.stratum, f.level FROM k JOIN f USING (rid) WHERE NOT tunes),
hn AS (SELECT stratum, count(*) AS n FROM hold GROUP BY stratum),
hx AS (SELECT hn.stratum, n, lv, (SELECT count(*) FROM hold WHERE hold.stratum = hn.stratum AND hold.level <= lv) AS x, count(*) OVER (PARTITION BY lv) AS strata FROM hn, e),
pv AS (SELECT stratum, lv, list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))) > 0.05 / strata AS fails FROM hx),
ch AS (SELECT stratum, coalesce(min(CASE WHEN fails THEN lv END), 9) - 1 AS chosen FROM pv GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND level > coalesce(chosen, -1) AS kept, stratum, level::INTEGER AS level
FROM j JOIN f USING (rid) LEFT JOIN ch USING (stratum)
"""
