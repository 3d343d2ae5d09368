import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import ranking as r


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(3)


def clusters(rng, n, dim=8, k=6):
    centers = rng.normal(size=(k, dim)) * 5
    return (centers[rng.integers(0, k, n)] + rng.normal(size=(n, dim)) * 0.1).astype(np.float32)


def brute(q, c, k, first, skip_self, base=0):
    scores = q.astype(np.float64) @ c.astype(np.float64).T
    out = []
    for i, row in enumerate(scores):
        order = [j for j in sorted(range(len(row)), key=lambda j: (-row[j], j)) if not (skip_self and j + 0 == i + base)]
        out += [(i + base, rank + 1, j) for rank, j in enumerate(order[first - 1 : first - 1 + k])]
    return sorted(out)


@pytest.mark.parametrize(("rows", "kind"), [(8, "clusters"), (40, "noise"), (30, "equal"), (4096, "noise")])
def test_blocks_give_what_all_pairs_give(spark, rows, kind):
    rng = np.random.default_rng(rows)
    x = clusters(rng, 120) if kind == "clusters" else rng.normal(size=(120, 8)).astype(np.float32) if kind == "noise" else np.ones((120, 8), np.float32)
    df = frame(spark, x)
    for first in (1, 2):
        got = sorted((g.id, g.rank, g.item_id) for g in r.inner_topk(df, df, 4, "id", "v", True, first, rows).collect())
        assert got == brute(x, x, 4, first, True)
    got = sorted((g.id, g.rank, g.item_id) for g in r.inner_topk(frame(spark, x[:30], 500), df, 3, "id", "v", False, 1, rows).collect())
    assert got == brute(x[:30], x, 3, 1, False, 500)


def test_bounds_hold_and_leave_blocks_out(spark):
    x = clusters(np.random.default_rng(1), 300)
    left = r.blocks(frame(spark, x), "id", "v", 25)[0]
    held = {b.block: (np.array(b.flat).reshape(len(b.ids), -1), b.ids) for b in left.collect()}
    assert sorted(i for _, ids in held.values() for i in ids) == list(range(300))
    pairs = r.bounds(left, left).collect()
    assert len(pairs) == len(held) ** 2 > 36
    for p in pairs:
        assert (held[p.q][0] @ held[p.c][0].T).max() <= p.bound + 1e-9
    own = {k: (m @ m.T).min() for k, (m, _) in held.items()}  # any row of the own block has at least that
    assert sum(p.bound < own[p.q] for p in pairs) > len(pairs) // 2


def test_rows_without_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [])], "id long, v array<float>")
    assert sorted((g.id, g.item_id) for g in r.inner_topk(df, df, 5, "id", "v", True).collect()) == [(1, 3), (3, 1)]
    assert r.inner_topk(df.limit(0), df.limit(0), 5, "id", "v", True).collect() == []


def test_blocks_are_read_and_not_shuffled_to_meet(spark):
    """Tasks with blocks of queries read the blocks of the corpus where they are stored."""
    x = np.random.default_rng(2).normal(size=(120, 8)).astype(np.float32)
    df = frame(spark, x)
    found = r.inner_topk(df, df, 4, "id", "v", True, 1, 8)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((g.id, g.rank, g.item_id) for g in found.collect()) == brute(x, x, 4, 1, True)


def test_what_meetings_give_grows_with_the_vectors_alone(spark, monkeypatch):
    """A query has its best rows once, however many blocks the corpus has; it had them
    once for each 64 of these."""
    x = np.random.default_rng(3).normal(size=(150, 8)).astype(np.float32)
    df = frame(spark, x)
    met, real = [], type(df).mapInArrow

    def seen(self, f, schema, *more, **named):
        met.append(real(self, f, schema, *more, **named))
        return met[-1]

    monkeypatch.setattr(type(df), "mapInArrow", seen)
    found = r.inner_topk(df, df, 4, "id", "v", True, 1, 1)
    assert met[-1].columns == ["q", "id", "item_id", "similarity"]
    assert max(g["count"] for g in met[-1].groupBy("id").count().collect()) == 4
    assert sorted((g.id, g.rank, g.item_id) for g in found.collect()) == brute(x, x, 4, 1, True)


def test_blocks_of_queries_that_share_a_task(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(120, 8)).astype(np.float32)
    df = frame(spark, x)
    monkeypatch.setattr(r, "TASKS", 1)
    assert sorted((g.id, g.rank, g.item_id) for g in r.inner_topk(df, df, 4, "id", "v", True, 2, 8).collect()) == brute(x, x, 4, 2, True)


def test_norms_are_those_of_whole_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None), (5, [1.0, None])], "id long, v array<float>")
    assert [tuple(g) for g in df.select("id", r.unit(F.col("v"))).orderBy("id").collect()] == [(1, [0.6, 0.8]), (2, [None, None]), (3, []), (4, None), (5, [None, None])]
