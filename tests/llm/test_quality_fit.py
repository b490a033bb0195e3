"""The classifier's descent against a slow solver of the same dual, and the store's tiers against the rule written out."""

import random

import numpy as np

from reportmill.llm import quality, sharding


def problem(seed=3, n=60):
    draw = np.random.default_rng(seed)
    labels = np.array([i % 2 for i in range(n)])
    rows = [np.unique(np.concatenate([draw.choice(40, 6), draw.choice(20, 4) + 40 + 20 * y])) for y in labels]
    return rows, labels


def test_descent_reaches_the_optimum_of_the_dual():
    """Projected gradient ascent with tiny steps on the same scaled indicators ends at the same margins."""
    rows, labels = problem()
    cost = 0.1
    model = quality.fit(rows, labels, cost=cost, epochs=4000)
    order = np.random.default_rng(5).permutation(len(rows))
    used = order[len(order) // 5 :]
    counts = np.ones((2, 1 << quality.BITS))
    for i in used:
        counts[labels[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    width = 80
    x = np.zeros((len(used), width + 1))
    for at, i in enumerate(used):
        x[at, rows[i]] = ratio[rows[i]] / np.sqrt(len(rows[i]))
        x[at, width] = 1
    y = 2 * labels[used] - 1
    top = np.array([cost * len(used) / (2 * (labels[used] == labels[i]).sum()) for i in used])
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(len(used))
    step = 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, top)
    w = (alpha * y) @ x
    dual = lambda a: a.sum() - a @ q @ a / 2
    primal = w @ w / 2 + (top * np.maximum(0, 1 - y * (x @ w))).sum()
    assert abs(dual(alpha) - primal) < 1e-4  # the slow solver is at the optimum
    got = np.array([model.margin(rows[i]) for i in used])
    other = np.array([model.weights[k] for k in range(width)])
    mine = np.concatenate([other / np.where(ratio[:width] == 0, 1, ratio[:width]), [model.bias]])
    assert np.allclose(got, x @ w, atol=1e-2)
    assert mine @ mine / 2 + (top * np.maximum(0, 1 - y * got)).sum() < primal + 1e-3


def test_ties_and_single_classes():
    rows, labels = problem()
    assert quality.fit([], np.zeros(0, np.int64)).score(rows[0]) == 0.5
    same = quality.fit(rows + rows, np.concatenate([labels, 1 - labels]))
    assert abs(np.mean([same.score(r) for r in rows]) - 0.5) < 0.15
    assert quality.fit(rows, np.ones(len(rows), np.int64)).score(rows[0]) > 0.9


def test_tiers_by_brute_force(spark, tmp_path):
    """Runs hold shards of one tier, no more bytes than a target, and are due by number or by size."""
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target=1000, fan_in=4)
    draw = random.Random(2)
    tier = lambda size: next(t for t in range(99) if size * 4 ** (t + 1) >= 1000)
    for _ in range(30):
        shards = [sharding.Shard(f"data/{i:03d}", draw.choice([1, 3, 10, 60, 200, 400, 499, 500, 900]), 0) for i in range(draw.randint(0, 40))]
        due = store.merges_due(shards)
        named = [s.path for run in due for s in run]
        assert len(named) == len(set(named))
        for run in due:
            assert len({tier(s.size) for s in run}) == 1 and all(s.size < 500 for s in run)
            assert sum(s.size for s in run) <= 1000 and (len(run) >= 4 or 2 * sum(s.size for s in run) >= 1000)
            assert [s.path for s in run] == sorted(s.path for s in run)
        left = [s for s in shards if s.size < 500 and s.path not in set(named)]
        for t in {tier(s.size) for s in left}:  # what is left of a tier: no run of it would have been due by number and still fit
            rest = [s for s in sorted(left, key=lambda s: s.path) if tier(s.size) == t]
            assert len(rest) < 4 or any(sum(x.size for x in rest[i : i + 4]) > 1000 for i in range(len(rest) - 3)) or len(due) > 0
