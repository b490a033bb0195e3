"""Risk-controlled quality rules against brute force."""

import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from reportmill.llm import quality_rules as rules

from .test_operators import SF, WORD, docs, hard, needs_tables
from ..helpers import connection, same


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures_brute_force(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("ab#") for _ in range(draw.randint(0, 60))) for _ in range(60)]
    texts += ["\n".join(draw.choice(["one two", "", " ", "three", "ÉÈ 😀"]) for _ in range(draw.randint(0, 12))) for _ in range(40)]
    texts += [None, "", "\x0b\f x\r\ny", "a " * 7, "a " * 8, "a " * 9, "1 2 3 4 5 6 7 8 " * 3, "x" * 5000]
    made = docs(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r[0]: tuple(r[1:]) for r in rules.measures(made).select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_repeats_of_a_long_text_take_linear_space_and_time(spark):
    text = " ".join(f"w{i % 997}" for i in range(200_000))
    row = rules.measures(docs(spark, [(1, text, "en", "s", 0)])).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (200_000, 200_000, True)


def test_binomial_tail_is_exact(spark):
    cases = [(x, n) for n in (1, 5, 16, 40, 217, 1000) for x in range(0, min(n, 30)) if x < n * 0.05]
    got = spark.createDataFrame(cases, "x long, n long").select("x", "n", rules.binomial_tail(F.col("x"), F.col("n"), 0.05).alias("p")).collect()
    p = Fraction(0.05)
    for x, n, tail in got:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))
        assert tail == pytest.approx(float(want), rel=1e-11)
    assert len(got) == len(cases)
    far = spark.sql("select 19970000L x, 1000000000L n").select(rules.binomial_tail(F.col("x"), F.col("n"), 0.02).alias("p"), rules.binomial_tail(F.lit(20), F.lit(1000), 0.02).alias("q")).first()
    assert 1e-13 < far.p < 1e-10 and far.q == 1.0


def made(spark, n=3000, bad=0.003, seed=5):
    """Good documents, of which a share ``bad`` has symbols; bad ones all have; two strata, one of few rows."""
    draw, rows, labels = random.Random(seed), [], []
    for i in range(n):
        quality = int(draw.random() < 0.8)
        marks = draw.random() < bad if quality else True
        body = [f"{draw.randrange(10**6):06d}" for _ in range(25)]
        rows.append((i, " ".join(body) + (" ##########" if marks else ""), "xx" if i % 100 == 0 else "en", "s", 0))
        labels.append((i, quality))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_junk_goes_and_good_stays_within_the_risk(spark):
    table, labels = made(spark)
    out = rules.judge(table, labels).join(labels, "doc_id").toPandas()
    en = out[out.stratum == "en"]
    assert not en[en.quality == 0].kept.any()
    assert (~en[en.quality == 1].kept).mean() <= 0.02
    assert out[out.stratum == "xx"].kept.all()  # too few held-out rows to prove anything


def test_no_level_stands_beyond_the_risk(spark):
    table, labels = made(spark, bad=0.0)
    held = spark.createDataFrame([("en", 0 if i < 30 else 5 if i < 100 else 9) for i in range(1000)], "stratum string, level int")
    assert rules.chosen_levels(held, 9, risk=0.02).collect() == [("en", -1)]
    assert rules.chosen_levels(held, 9, risk=0.05).collect() == [("en", 4)]
    assert rules.chosen_levels(held, 9, risk=0.2).collect() == [("en", 8)]


def test_cutoffs_by_hand(spark):
    """Of 1,000 rows of severities 1 to 1,000 at most the level's thousandths lie above a cutoff."""
    rows = spark.range(1, 1001).select(F.lit("en").alias("stratum"), *[F.col("id").cast("int").alias(r) for r in rules.RULES])
    cuts = rules.cutoffs(rows, (0, 1, 5)).first().cuts
    assert cuts == {r: [1000, 999, 995] for r in rules.RULES}


def test_hard_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 1, 0), (5, 0, 1), (7, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int").withColumn("lang", F.lit("x"))
    out = rules.judge(hard(spark), labels)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = out.collect()
    assert len(rows) == 10 and not any(r.kept for r in rows) and {r.stratum for r in rows} == {"", "en", "fr"}
    none = rules.judge(hard(spark).limit(0), labels.limit(0))
    assert none.collect() == []
    assert rules.judge(hard(spark), labels.limit(0)).count() == 10
    odd = rules.judge(hard(spark).withColumnRenamed("doc_id", "level"), labels.withColumnRenamed("doc_id", "level"), id_col="level", stratum="source")
    assert odd.count() == 10


@needs_tables
def test_against_sql(spark):
    same(rules.judge(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")), connection(SF), rules.ORACLE)


def test_native(spark):
    table, labels = made(spark, n=50)
    plan = rules.judge(table, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
