"""Bootstrap and validation metrics against plain loops."""

import random

import numpy as np

from quillon.operators import metrics as m


def plain_draws(n, size, times, seed):
    np.random.seed(seed)
    return [np.random.choice(n, size, replace=True) for _ in range(times)]


def plain_majority(pairs):
    seen = {}
    for vote, value in pairs:
        seen.setdefault(vote, []).append(value)
    return max(seen.values(), key=len)[0]


def rollouts(spark, rng, prompts=25):
    rows = [(rng.choice("xy"), u, k, round(rng.random(), 2), rng.choice("abc")) for u in range(prompts) for k in range(rng.choice([1, 2, 3, 5, 8, 9]))]
    source = {}
    rows = [(source.setdefault(u, s), u, k, v, w) for s, u, k, v, w in rows]
    return rows, spark.createDataFrame(rows, "status string, uid long, sample int, score double, vote string").repartition(3)


def test_bootstrap(spark):
    rows, df = rollouts(spark, random.Random(1))
    got = {r.uid: r[1:] for r in m.bootstrap(df, ["uid"], "score", "sample", 4, times=50).collect()}
    for u in {r[1] for r in rows}:
        x = [r[3] for r in rows if r[1] == u]
        draws = [[x[i] for i in d] for d in plain_draws(len(x), 4, 50, 42)]
        best, worst = [max(d) for d in draws], [min(d) for d in draws]
        assert np.allclose(got[u], (np.mean(best), np.std(best), np.mean(worst), np.std(worst)))
    assert m.bootstrap(df.limit(0), ["uid"], "score", "sample", 4).collect() == []


def test_ladder():
    assert [m.ladder(n) for n in (0, 1, 2, 3, 4, 5, 8, 9)] == [[], [], [2], [2, 3], [2, 4], [2, 4, 5], [2, 4, 8], [2, 4, 8, 9]]


def test_validation_metrics(spark):
    rows, df = rollouts(spark, random.Random(2))
    got = {(r.status, r.metric): r.value for r in m.validation_metrics(df, "status", "uid", "sample", "score", "vote", times=40).collect()}
    want = {}
    for u in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == u]
        source, n = own[0][0], len(own)
        x = [r[3] for r in own]
        add = lambda name, v, source=source: want.setdefault((source, name), []).append(v)
        add(f"mean@{n}", np.mean(x))
        add(f"std@{n}", np.std(x))
        k = 2
        sizes = []
        while k < n:
            sizes.append(k)
            k *= 2
        for size in [*sizes, n] if n > 1 else []:
            draws = plain_draws(n, size, 40, 42)
            for name, f in (("best", max), ("worst", min)):
                y = [f(x[i] for i in d) for d in draws]
                add(f"{name}@{size}/mean", np.mean(y))
                add(f"{name}@{size}/std", np.std(y))
            y = [plain_majority([(own[i][4], x[i]) for i in d]) for d in draws]
            add(f"maj@{size}/mean", np.mean(y))
            add(f"maj@{size}/std", np.std(y))
    assert set(got) == set(want)
    assert all(abs(got[k] - np.mean(v)) < 1e-12 for k, v in want.items())
    assert not any("maj" in r.metric for r in m.validation_metrics(df, "status", "uid", "sample", "score", times=5).collect())
