"""Agreement, scores, samples, retrieval and votes on literal rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.functions import text as tx
from reportmill.operators import curation, descent, features, metrics, models, retrieval, sampling, voting


def pairs(spark, a, b):
    return spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string")


def test_kappa(spark):
    r = metrics.kappa(pairs(spark, "xxyy", "xyyy"), "a", "b").first()
    assert (r.observed, r.expected, r.kappa) == (0.75, 0.5, 0.5)
    same = pairs(spark, "xx", "xx")
    assert metrics.kappa(same, "a", "b").first().kappa == 1.0
    assert metrics.kappa(same, "a", "b", degenerate=0.0).first().kappa == 0.0


def test_published_confusion_gives_published_kappa(spark):
    # A 2x2 table by its counts: observed and expected follow from the margins.
    rows = [("p", "p")] * 40 + [("p", "q")] * 10 + [("q", "p")] * 5 + [("q", "q")] * 45
    r = metrics.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert r.observed == pytest.approx(0.85)
    assert r.kappa == pytest.approx((0.85 - 0.5) / 0.5)


def test_jaccard(spark):
    df = spark.createDataFrame([("a|b", "b|c"), ("", ""), ("a", "")], "x string, y string")
    assert df.select(F.avg(metrics.jaccard(tx.label_list(F.col("x")), tx.label_list(F.col("y"))))).first()[0] == pytest.approx(0.444444, abs=1e-6)


def test_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "needs_review")], "gold string, pred string")
    r = metrics.summary(df).first()
    assert (r.answered, r.accuracy) == (4, 0.5)
    assert r.macro_f1 == pytest.approx(1 / 3)
    assert metrics.summary(df, labels=["a", "b", "c"]).first().macro_f1 == pytest.approx(0.444444, abs=1e-6)


def test_temporal_spread(spark):
    for n, limit, want in [(8, 5, [0, 2, 4, 5, 7]), (6, 5, [0, 1, 2, 4, 5]), (12, 5, [0, 3, 6, 8, 11]), (5, 5, [0, 1, 2, 3, 4]), (7, 1, [0])]:
        df = spark.createDataFrame([("g", i) for i in range(n)], "g string, i int")
        assert sorted(r.i for r in sampling.temporal_spread(df, ["g"], ["i"], limit).collect()) == want


def test_holdout_and_folds(spark):
    for n, want in [(10, [0, 5]), (7, [0]), (3, [0]), (1, [0]), (13, [0, 4, 8])]:
        df = spark.createDataFrame([("g", i) for i in range(n)], "g string, i int")
        assert sorted(r.i for r in sampling.holdout(df, "g", "i").where("held").collect()) == want
    df = spark.createDataFrame([("g", i) for i in range(7)], "g string, i int")
    assert sorted(r["count"] for r in sampling.kfold(df, "g", "i").groupBy("fold").count().collect()) == [1, 1, 1, 2, 2]
    many = spark.createDataFrame([(f"l{g}", i) for g in range(7) for i in range(30)], "g string, i int")
    assert sampling.stacked_limits(many, "g", ["i"], 17, 120).count() == 119


def test_chronological_matches_a_full_sort(spark):
    df = spark.sql("select id, case when id % 17 = 0 then null else timestamp'2024-01-01' + make_interval(0,0,0,0,cast(id * 7919 % 97 as int)) end as ts from range(503)")
    got = {r.id for r in sampling.chronological(df, "ts", "id").where("split = 'train'").collect()}
    rows = sorted(df.collect(), key=lambda r: (r.ts is not None, r.ts, r.id) if r.ts else (False, 0, r.id))
    assert got == {r.id for r in rows[: int(503 * 0.8)]}


def test_ranks_of_a_hot_group_use_all_tasks(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 100 = 1 then 'few' when id % 100 = 2 then null else 'hot' end as g", "id * 7919 % 1009 as s")
    out = sampling.ranked(df, ["g"], [F.col("s").desc(), "id"], tasks=8)
    rows = out.collect()
    want = {}
    for r in sorted(df.collect(), key=lambda r: (-r.s, r.id)):
        want.setdefault(r.g, []).append(r.id)
    assert {r.id: (r._rank, r._size) for r in rows} == {i: (n, len(ids)) for ids in want.values() for n, i in enumerate(ids, 1)}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sampling.ranked(df.limit(0), ["g"], ["id"]).collect() == []


def test_double_cap_of_hot_values(spark):
    """A few values hold most rows and each cap fills while the other value's rows are still open."""
    draw = random.Random(8)
    rows = [(i, draw.choice(["a", "a", "a", "b", None]), draw.choice(["x", "x", "y", "z"])) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for caps, size in (((3, 200), 100), ((40, 5), 100), ((7, 9), 12), ((1, 1), 100)):
        left, want = {}, []
        for i, a, b in rows:
            if len(want) < size and left.get(("a", a), 0) < caps[0] and left.get(("b", b), 0) < caps[1]:
                want.append(i)
                left["a", a] = left.get(("a", a), 0) + 1
                left["b", b] = left.get(("b", b), 0) + 1
        assert [r.i for r in sampling.double_capped(df, "a", "b", ["i"], caps, size).collect()] == want
    assert sampling.double_capped(df.limit(0), "a", "b", ["i"], (3, 3), 5).collect() == []


def test_double_cap_is_greedy(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice("abcd"), draw.choice("xyz"), draw.randint(0, 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a string, b string, s int")
    got = {r.i for r in sampling.double_capped(df, "a", "b", [F.col("s").desc(), "i"], (9, 11), 30).collect()}
    left, want = {}, []
    for i, a, b, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(want) < 30 and left.get(("a", a), 0) < 9 and left.get(("b", b), 0) < 11:
            want.append(i)
            left["a", a] = left.get(("a", a), 0) + 1
            left["b", b] = left.get(("b", b), 0) + 1
    assert got == set(want)


def test_capped_queue_is_greedy(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice("aab"), draw.randint(0, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, l string, s int")
    got = [r.i for r in sampling.capped_queue(df, "l", "s", ["i"], 5, 15).orderBy("place").collect()]
    taken, later, seen = [], [], {}
    for i, label, s in sorted(rows, key=lambda r: (-r[2], r[0])):
        seen[label] = seen.get(label, 0) + 1
        (taken if seen[label] <= 5 else later).append(i)
    assert got == (taken + later)[:15]


CORPUS = [(1, "nan nan overflow", "p"), (2, "nan loss", "p"), (3, "slow kernel slow", "q"), (4, "dtype cast", "r")]


def corpus(spark):
    return spark.createDataFrame(CORPUS, "id int, text string, label string")


def test_bm25(spark):
    terms = features.term_table(corpus(spark), "id", tx.tokens_a(F.col("text")))
    asked = spark.createDataFrame([(1, "nan slow"), (2, "dtype nan nan"), (3, "zzz")], "q int, text string").select("q", F.explode(F.array_distinct(tx.tokens_a(F.col("text")))).alias("term"))
    got = {(r.q, r.id): r.score for r in features.bm25(terms, asked, "id", "q").collect()}
    want = {(1, 1): 0.930399, (1, 2): 0.761700, (1, 3): 1.616071, (2, 1): 0.930399, (2, 2): 0.761700, (2, 4): 1.323047}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    scored = features.bm25(terms, asked, "id", "q").join(corpus(spark).select("id", "label"), "id")
    top = features.top_per_query(scored, "q", [F.col("score").desc(), F.col("label").desc(), "id"], 5)
    assert {r.q: r.pred for r in features.knn_label(top, "q", "label", "p").collect()} == {1: "p", 2: "p"}


def test_naive_bayes(spark):
    rows = [(i, t, y, 1) for i, t, y in CORPUS] + [(11, "nan slow", "p", 0), (12, "cast", "p", 0), (13, "zzz", "p", 0)]
    docs = spark.createDataFrame(rows, "id int, text string, label string, fold int")
    terms = features.term_table(docs, "id", tx.tokens_a(F.col("text")), "label", "fold")
    got = {(r.id, r.label): r.score for r in features.naive_bayes(terms, "id", "label", "fold", ["p", "q", "r"]).where("id > 10").collect()}
    want = {(11, "p"): -4.276666, (11, "q"): -4.892852, (11, "r"): -5.780744, (12, "p"): -3.178054, (12, "q"): -3.688879, (12, "r"): -2.890372, (13, "p"): -3.178054, (13, "q"): -3.688879, (13, "r"): -3.583519}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_tfidf(spark):
    terms = features.term_table(corpus(spark), "id", tx.tokens_a(F.col("text")))
    vocab = features.vocabulary(terms, "id", 4, 4)
    got = {r.term: r.idf for r in vocab.collect()}
    assert got == {"nan": pytest.approx(1.510826, abs=1e-6), "slow": pytest.approx(1.916291, abs=1e-6), "overflow": pytest.approx(1.916291, abs=1e-6), "loss": pytest.approx(1.916291, abs=1e-6)}
    first = {r.term: r.weight for r in features.tfidf(terms, vocab, "id").where("id = 1").collect()}
    assert first == {"nan": pytest.approx(0.844493, abs=1e-6), "overflow": pytest.approx(0.535566, abs=1e-6)}


def test_votes(spark):
    rows = spark.createDataFrame([(1, "a", "b", "b", "a", "c")], "id int, svm string, log string, weak string, bigram string, nb string")
    names = ["svm", "log", "weak", "bigram", "nb"]
    r = voting.plurality(voting.long_votes(rows, "id", names), names, "id").first()
    assert (r.pred, r.votes, r.margin) == ("a", 2, 0)
    votes = spark.createDataFrame([(1, "a", "b"), (1, "b", "b"), (2, "a", "c"), (2, "b", "c")], "id int, pred string, fb string")
    assert {r.id: r.pred for r in voting.weighted(votes, F.lit(2), "fb", "id").collect()} == {1: "b", 2: "a"}


@pytest.mark.parametrize("name", ["softmax", "hinge"])
def test_linear_models_separate(spark, name):
    draw = random.Random(1)
    rows = []
    for i in range(60):
        y = "abc"[i % 3]
        rows.append((i, y, i // 3 % 2, {"abc".index(y): 1.0, 3 + draw.randrange(4): 0.3}))
    vectors = spark.createDataFrame([(h, i, k, v) for h in (0, 1) for i, _, _, x in rows for k, v in x.items()], "held int, id int, idx int, weight double")
    folds = spark.createDataFrame([(i, y, f) for i, y, f, _ in rows], "id int, label string, fold int")
    got = models.cross_validated(vectors, folds, "id", "label", name, 7).collect()
    assert len(got) == 60
    assert all(r.gold == r.pred for r in got)
    local = models.TRAINERS[name]([(x, y) for _, y, f, x in rows if f == 1], 7)
    assert all(local(x) == y for _, y, f, x in rows if f == 0)


def test_oversample_and_batches(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(3)], "l string, i int")
    assert {r.l: r["count"] for r in sampling.oversample(df, "l", "i").groupBy("l").count().collect()} == {"a": 7, "b": 7}
    assert [r["count"] for r in sampling.batches(df.where("l = 'a'"), ["l"], ["i"], 3).groupBy("batch").count().orderBy("batch").collect()] == [3, 3, 1]


def test_curation(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    p1, p2 = spark.createDataFrame([(1, "x"), (2, "b")], "id int, v string"), spark.createDataFrame([(1, "y")], "id int, v string")
    got = {r.id: (r.v, r.previous, r.changed, r.patch) for r in curation.overlay(base, [p1, p2], "id", "v").collect()}
    assert got == {1: ("y", "a", True, 2), 2: ("b", "b", False, 1), 3: ("c", "c", False, None)}
    with pytest.raises(KeyError):
        curation.checked_inner(base, p1, "id")
    more = spark.createDataFrame([(3, "z"), (4, "d"), (4, "e"), (5, "")], "id int, v string")
    merged, counts = curation.append_merge(base, more, "id", F.col("v") != "", "v")
    assert sorted(r.id for r in merged.collect()) == [1, 2, 3, 4]
    assert {r.outcome: r.n for r in counts.collect()} == {"duplicate": 2, "appended": 1, "incomplete": 1}


def test_selective_curve(spark):
    df = spark.createDataFrame([("a", "a", 5), ("a", "b", 2), ("b", "b", 3)], "gold string, pred string, votes int")
    got = {r.threshold: (r.answered, r.coverage, r.accuracy) for r in metrics.selective_curve(df, "votes", range(2, 6)).collect()}
    assert got[2] == (3, 1.0, pytest.approx(2 / 3))
    assert got[4] == (1, pytest.approx(1 / 3), 1.0)
    assert math.isclose(got[5][1], 1 / 3)


def test_bounded_retrieval_is_exact(spark):
    """By bounds and outright: the same first k, with folds and by label, for rare and common terms, ties and null keys."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(draw.expovariate(0.12)))] for _ in range(n))
    rows = [(i, text(draw.randint(0, 40)), draw.choice("abc"), i % 3) for i in range(300)]
    rows += [(1000 + i, rows[5][1], "a", i % 3) for i in range(4)] + [(None, "w1 w2", "a", 0), (2000, None, "b", 1)]
    docs = spark.createDataFrame(rows, "id long, text string, label string, fold int")
    asked = spark.createDataFrame([(q, text(n)) for q, n in enumerate([1, 2, 3, 5, 8, 30])] + [(9, "unknown"), (10, None)], "q long, text string")
    tokens = tx.tokens_a(F.col("text"))

    def first(index, queries, key, k, fold=None, by_label=False, **how):
        found = retrieval.search(index, queries, key, tokens, k, fold=fold, by_label=by_label, **how).withColumn("score", F.round("score", 6))
        group = ["query", "label"] if by_label else ["query"]
        return sorted(tuple(r) for r in sampling.first_per(found, group, [F.col("score").desc(), "doc"], k).collect()), found.count()

    for block in (16, 1024):
        index = retrieval.build_index(docs, "id", tokens, label="label", block=block)
        for by_label, k in ((False, 1), (False, 3), (True, 2)):
            outright, every = first(index, asked, "q", k, by_label=by_label)
            bounded, met = first(index, asked, "q", k, by_label=by_label, few=0, seed=8)
            assert bounded == outright and met <= every
    index = retrieval.build_index(docs, "id", tokens, fold="fold", label="label", block=16)
    terms = features.term_table(docs.where("id is not null and text is not null"), "id", tokens, "fold")
    naive = features.bm25(terms, terms.select(F.col("id").alias("q"), "fold", "term"), "id", "q", fold="fold").withColumn("score", F.round("score", 6))
    want = sorted(tuple(r) for r in features.top_per_query(naive, "q", [F.col("score").desc(), "id"], 3).select("q", "id", "score").collect())
    for few in (0, retrieval.FEW):
        got, _ = first(index, docs, "id", 3, fold="fold", few=few)
        assert sorted((q, d, s) for q, d, _, s in got) == want


def test_bounds_leave_documents_out(spark):
    """Queries with a document of their own meet few others, though all documents share the common words."""
    docs = spark.range(2000).selectExpr("id", "concat('the of and own', id, ' own', id, ' rare', id % 700) as text")
    asked = spark.range(0, 2000, 100).selectExpr("id as q", "concat('the and of own', id, ' rare', id % 700) as text")
    tokens = tx.tokens_a(F.col("text"))
    found = retrieval.search(retrieval.build_index(docs, "id", tokens), asked, "q", tokens, 1, few=0)
    assert found.count() < 20 * 5 and found.where("query = doc").count() == 20


def separable(spark, labels, n=90, seed=4):
    """Rows whose label's own feature is the strongest; three folds; vectors as of each held-out fold."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        y = draw.randrange(len(labels))
        x = {y: 0.9, len(labels): 0.3, draw.randrange(len(labels)): 0.2}
        rows.append((i, labels[y], i % 3, {y: 0.9} | {k: v for k, v in x.items() if k != y}))
    folds = spark.createDataFrame([(i, y, f) for i, y, f, _ in rows], "id int, label string, fold int")
    vectors = spark.createDataFrame([(h, i, k, v) for i, _, _, x in rows for k, v in x.items() for h in range(3)], "held int, id int, idx int, weight double")
    return rows, folds, vectors


@pytest.mark.parametrize("loss", ["softmax", "hinge"])
def test_full_batch_descent(spark, loss):
    """The same weights as the steps written out, and every row of a separable set right."""
    rows, folds, vectors = separable(spark, ["a", "b", "c"])
    out = descent.cross_validated(vectors, folds, "id", "label", loss, 4).collect()
    assert len(out) == 90 and all(r.gold == r.pred for r in out)
    classes, width = ["a", "b", "c"], 4
    sent = descent.training_rows(vectors, folds, "id", "label")
    got = {(r.held, r.c, r.idx): r.w for r in descent.fit(sent, "label", classes, width, loss, steps=3, rate=1.5).collect()}
    for held in range(3):
        data = [([1.0, *[x.get(k, 0.0) for k in range(width)]], classes.index(y)) for _, y, f, x in rows if f != held]
        w = [[0.0] * (width + 1) for _ in classes]
        for t in range(3):
            g = [[0.0] * (width + 1) for _ in classes]
            for x, y in data:
                m = [sum(a * b for a, b in zip(x, wc, strict=True)) for wc in w]
                e = [math.exp(v) for v in m]
                for c in range(3):
                    sign = 1 if c == y else -1
                    pull = e[c] / sum(e) - (c == y) if loss == "softmax" else -sign if sign * m[c] < 1 else 0
                    g[c] = [a + pull * b for a, b in zip(g[c], x, strict=True)]
            rate = 1.5 / (1 + descent.DECAY * t)
            w = [[v - rate * (d / len(data) + (descent.L2 * v if k else 0)) for k, (v, d) in enumerate(zip(wc, gc, strict=True))] for wc, gc in zip(w, g, strict=True)]
        for c in range(3):
            for k in range(width + 1):
                assert got[held, c, k] == pytest.approx(w[c][k], abs=1e-12)


def test_full_batch_two_stages(spark):
    rows, folds, vectors = separable(spark, ["a", "b", "c", "d"], n=150)
    out = descent.two_stage(vectors, folds, "id", "label", "hinge", 5, {"a": "g", "b": "g"}).collect()
    assert len(out) == 150 and all(r.gold == r.pred for r in out)
    empty = descent.cross_validated(vectors.limit(0), folds.limit(0), "id", "label", "softmax", 5)
    assert empty.collect() == []
    unknown = descent.cross_validated(vectors.limit(0), folds, "id", "label", "softmax", 5, steps=2)
    assert unknown.count() == 150


def test_packed_rows_are_the_long_vectors(spark):
    """``fold_rows`` against ``fold_vectors``, with a row of no known term and one of no term."""
    texts = [(i, i % 3, f"aa bb {'cc ' * (i % 4)} dd{i % 2} x{i}") for i in range(20)] + [(20, 0, "zz"), (21, 1, "")]
    docs = spark.createDataFrame(texts, "id long, fold int, text string")
    rows = docs.select("id", "fold", features.counted(tx.tokens_a(F.col("text"))).alias("terms"))
    vocab = features.fold_vocabulary(features.exploded(rows), "id", "fold", 6)
    packed = features.fold_rows(rows, vocab, "id", "fold")
    assert packed.count() == 22 * 3
    got = {(r.held, r.id, r.idx): r.weight for r in features.long_vectors(packed, "id").collect()}
    want = {(r.held, r.id, r.idx): r.weight for r in features.fold_vectors(features.exploded(rows), vocab, "id").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_seeded_models_take_rows_from_a_file(spark):
    """Rows streamed to a file give the model of the same rows in memory, whatever their number; labels may be null."""
    draw = random.Random(3)
    xs = [{k: draw.random() for k in sorted(draw.sample(range(8), 3))} for _ in range(90)]
    rows = [(i, "ab"[int(sum(v for k, v in x.items() if k < 4) > 1)], i % 3) for i, x in enumerate(xs)]
    vectors = spark.createDataFrame([(h, i, k, v) for h in range(3) for i, x in enumerate(xs) for k, v in x.items()], "held int, id long, idx int, weight double")
    folds = spark.createDataFrame([*rows, (90, None, 1)], "id long, label string, fold int")
    got = {r.id: r.pred for r in models.cross_validated(vectors, folds, "id", "label", "hinge", 8).collect()}
    assert len(got) == 91 and not hasattr(models, "MOST_ROWS")
    for h in range(3):
        local = models.train_hinge([(xs[i], y) for i, y, f in rows if f != h], 8)
        assert all(got[i] == local(xs[i]) for i, _, f in rows if f == h)
    assert set(got.values()) == {"a", "b"}


def test_scores_that_differ_by_rounding_tie(spark):
    scores = spark.createDataFrame([(1, "a", -7.0000000001), (1, "b", -7.0), (2, "a", -7.1), (2, "b", -7.0)], "id int, label string, score double")
    assert {r.id: r.pred for r in features.best_label(scores, "id", ["a", "b"], digits=6).collect()} == {1: "a", 2: "b"}


def test_counted_rows_equal_the_expression(spark):
    """Batches of texts are counted as one text by itself is, with and without bigrams, empty and null ones too."""
    texts = ["b a b a a", "", "a", "é z é a_b a__b", "B b", None, "zz zz " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    tokens = tx.tokens_a(F.col("t"))
    for pairs in (False, True):
        want = {r.id: r.terms for r in df.select("id", features.counted(tx.terms(tokens, pairs)).alias("terms")).collect()}
        assert {r.id: r.terms for r in features.counted_rows(df, tokens, pairs, "id").collect()} == want


def test_fold_vocabulary_takes_ties_by_place_and_sends_few_terms(spark):
    """The terms kept equal a count by hand; only those that reach a fold's least sum are shared out with their places."""
    draw = random.Random(8)
    rows = [(d, d % 3, w, draw.randrange(1, 4), p) for d in range(40) for p, w in enumerate(draw.sample([f"w{k}" for k in range(300)], 12))]
    table = spark.createDataFrame(rows, "id long, fold int, term string, tf long, pos int")
    got = {}
    for r in features.fold_vocabulary(table, "id", "fold", 20).collect():
        got.setdefault(r.held, {})[r.term] = r.idx
    for held in range(3):
        tf, first = Counter(), {}
        for d, fold, w, n, p in rows:
            if fold != held:
                tf[w] += n
                first[w] = min(first.get(w, (d, p)), (d, p))
        best = sorted(sorted(tf, key=lambda w: (-tf[w], first[w]))[:20])
        assert got[held] == {w: i for i, w in enumerate(best)}


def test_descent_reads_a_stored_row_once_while_there_is_room(monkeypatch):
    """Rows that fit are read from their file once, not once an epoch; without room the models are the same."""
    draw, reads = random.Random(4), []

    class Row:
        def __init__(self):
            self.x = np.sort(np.array(draw.sample(range(30), 6), np.int32)), np.array([draw.random() for _ in range(6)])

        def read(self):
            reads.append(1)
            return self.x

    rows = [(Row(), "ab"[i % 2]) for i in range(20)]
    for train in (models.train_softmax, models.train_hinge):
        found = []
        for room, want in ((1 << 20, 20), (0, 240), (5 * 472, 5 + 15 * 12)):
            monkeypatch.setattr(models, "KEPT_BYTES", room)
            reads.clear()
            predict = train(rows, 30)
            assert len(reads) == want
            found.append([predict(x) for x, _ in rows])
        assert found[0] == found[1] == found[2]
