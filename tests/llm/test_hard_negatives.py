"""Hard-negative mining and its ball trees against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm import hard_negatives as hn, queries

from .test_operators import SF, needs_tables
from ..helpers import connection, same


def brute(rows, anchor, positives=5, negatives=10, window=(30, 90)):
    """rows: (id, label, whole vector)."""
    once = {}
    for i, label, v in rows:
        if i not in once or (label, v) < once[i]:
            once[i] = (label, v)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in once.items():
        if not anchor(a):
            continue
        scored = sorted(((dot(v, w), i, other) for i, (other, w) in once.items() if i != a), key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and window[0] * ps <= 100 * s[0] <= window[1] * ps]
            out += [(a, p, r, i, ps, s) for r, (s, i, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit(c) for c in ("part", "kind", "windows", "v", "score", "no", "anchor_id")})


def made(n, seed, width=6, copies=0.0, size=1.0):
    draw = random.Random(seed)
    hot = [draw.gauss(0, size) for _ in range(width)]
    return [(i, draw.randrange(3), list(hot) if draw.random() < copies else [draw.gauss(0.3, size) for _ in range(width)]) for i in range(n)]


def whole(rows):
    return [(i, label, tuple(int(np.floor(256 * x)) for x in v)) for i, label, v in rows]


@pytest.mark.parametrize(("n", "part", "copies"), [(300, 4096, 0.0), (300, 9, 0.0), (400, 50, 0.35)])
def test_brute_force(spark, n, part, copies):
    """Many small parts take two rounds; a third of the rows may be one vector."""
    rows = made(n, n + part, copies=copies)
    got = sorted(tuple(r) for r in hn.mine(table(spark, rows), F.col("vec_id") % 20 == 0, part=part).collect())
    assert got == brute(whole(rows), lambda a: a % 20 == 0)
    assert got


def test_tree_holds_every_row_in_its_ball():
    draw = np.random.default_rng(1)
    x = np.rint(draw.normal(size=(1500, 5)) * 100).astype(np.int64)
    x[:500] = x[0]
    tree = hn.Tree.build(np.arange(1500), np.arange(1500) % 4, x)
    again = hn.Tree.unpacked(tree.packed(), 5)
    for f in tree.__dataclass_fields__:
        assert np.array_equal(getattr(tree, f), getattr(again, f))
    leaves = np.flatnonzero(tree.left < 0)
    assert sorted(np.concatenate([tree.ids[tree.start[i] : tree.end[i]] for i in leaves])) == list(range(1500))
    for i in range(len(tree.start)):
        own = tree.x[tree.start[i] : tree.end[i]]
        assert (np.sqrt(((own - tree.center[i]) ** 2).sum(axis=1)) <= tree.radius[i] + 1e-6).all()
        assert (tree.ids[tree.start[i] : tree.end[i]] % 4 == tree.label[i]).all()


def test_bounds_leave_nodes_out():
    """Anchors near one of many far clusters open few leaves, from above and from below."""
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(64, 3)) * 10_000
    x = np.rint(np.repeat(centers, 64, axis=0) + draw.normal(size=(4096, 3)) * 10).astype(np.int64)
    tree = hn.Tree.build(np.arange(4096), np.zeros(4096, np.int64), x)
    q = x[:1]
    asked = hn.Asked(np.array([-1]), np.array([0]), q, np.array([0]), np.array([hn.LEAST + 1]), np.array([hn.MOST]), 5)
    asked.search(tree, True)
    scores = x @ q[0]
    assert asked.scores[0].tolist() == sorted(scores.tolist(), reverse=True)[:5] and asked.visited <= 8
    high = int(np.percentile(scores, 5))
    below = hn.Asked(np.array([-1]), np.array([1]), q, np.array([0]), np.array([hn.LEAST + 1]), np.array([high]), 5)
    below.search(tree, False)
    assert below.scores[0].tolist() == sorted((s for s in scores.tolist() if s <= high), reverse=True)[:5] and below.visited <= 16


def test_hard_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 1.0]), (10, 1, [1.0, 0.9]), (20, 2, [0.5, 0.5]), (20, 2, [0.5, 0.5]), (20, 1, [9.0, 9.0]), (30, 2, [0.5, 0.5]), (40, 2, []), (50, 3, [0.5]),
        (60, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (70, 1, None), (80, 1, [None, 1.0]), (90, 2, [nan, 1.0]), (100, 2, [inf, 1.0]), (-10, 2, [0.4, 0.7]), (110, 1, [-5.0, -5.0]), (120, 4, [0.0, 0.0]),
    ]
    fine = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    got = sorted(tuple(r) for r in hn.mine(table(spark, rows), F.col("vec_id") % 10 == 0).collect())
    assert got == brute(whole(fine), lambda a: True) and got
    out = hn.mine(table(spark, rows).limit(0), F.lit(True))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.collect() == []
    assert hn.mine(table(spark, rows), F.lit(False)).collect() == []
    assert hn.mine(table(spark, [r for r in rows if r[1] == 1]), F.lit(True)).collect() == []


def test_large_components_are_exact(spark):
    small = [(i, i % 2, [(1e9 + 3 * i) / 256, (2e3 - i) / 256]) for i in range(-20, 20)]
    got = sorted(tuple(r) for r in hn.mine(table(spark, small), F.col("vec_id") == 3, window=(0, 100)).collect())
    assert got == brute(whole(small), lambda a: a == 3, window=(0, 100)) and got


@needs_tables
def test_against_sql(spark):
    same(queries.op12_hard_negatives(spark, SF), connection(SF), hn.ORACLE)
