"""Pruned lookups against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quillon.operators import catalogue as c
from quillon.operators import inverted_index
from quillon.operators.retrieval import bm25


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fuzzy_lookup(spark, seed):
    rng = random.Random(seed)
    vocab = ["a", "ab", "abc", "abcd", "bc", "xabcy", "", "s", "ss", "zebra", "zeb", "bra", "é", "éa", "long word", "word"]
    keys = sorted({",".join(rng.choice(vocab) for _ in range(rng.choice([5, 5, 5, 3]))) for _ in range(120)})
    asked = sorted({",".join(rng.choice([*vocab, "none", "q"]) for _ in range(rng.choice([5, 5, 2]))) for _ in range(40)})
    index = c.word_index(spark.createDataFrame([(k,) for k in keys], "tid string"), __import__("pyspark").sql.functions.col("tid"))
    got = {r.query: (r.tid, r.score) for r in c.fuzzy_lookup(spark.createDataFrame([(q,) for q in asked], "query string"), index).collect()}
    want = {}
    for q in asked:
        best = []
        for k in keys:
            s = sum((1.0 if x == w else 0.8) / (pos + 1) for pos, x in enumerate(q.split(",")) for w in k.split(",") if x in w or w in x)
            if s:
                best.append((-round(s, 9), k))
        if best:
            s, k = min(best)
            want[q] = (k, -s)
    assert got == want


def test_containing(spark):
    words = ["", "a", "ab", "abc", "abcd", "bcd", "zabcdz", "x", "日本語", "本語", "日"]
    frame = lambda name: spark.createDataFrame([(w,) for w in words] * 2, f"{name} string")
    got = sorted(map(tuple, c.containing(frame("q"), frame("word")).collect()))
    assert got == sorted((q, w, 1.0 if q == w else 0.8) for q in words for w in words if q in w or w in q)


@pytest.mark.parametrize("k", [1, 3])
def test_bm25(spark, k, monkeypatch):
    monkeypatch.setattr(inverted_index, "AT_ONCE", 4)
    monkeypatch.setattr(inverted_index, "BLOCK", 3)
    rng = random.Random(k)
    vocab = [f"w{int(30 * rng.random() ** 2)}" for _ in range(60)] + ["the"] * 30
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(40)))) for i in range(90)] + [(90, None), (None, "the w1"), (91, ""), (92, "the the the\t\nthe")]
    asked = [(100 + i, " ".join(rng.choice([*vocab, "unknown"]) for _ in range(6))) for i in range(9)] + [(200, None), (201, ""), (202, "unknown")]
    got = bm25(spark.createDataFrame(asked, "item long, text string"), spark.createDataFrame(docs, "doc long, text string").repartition(4), "item", "doc", "text", k).collect()
    split = {i: t.split() for i, t in docs if i is not None and t is not None}
    n = sum(1 for t in split.values() if t)
    mean = sum(map(len, split.values())) / n
    df = Counter(w for t in split.values() for w in set(t))
    want = set()
    for q, text in asked:
        scores = []
        for i, t in split.items():
            tf = Counter(t)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 1.9 / (tf[w] + 0.9 * (0.6 + 0.4 * len(t) / mean)) for w in set((text or "").split()) if tf[w])
            if s:
                scores.append((-round(s, 6), i))
        want |= {(q, i, -s) for s, i in sorted(scores)[:k]}
    assert {(r.item, r.doc, r.score) for r in got} == want


def test_stored_index(spark, tmp_path):
    """Small shards and blocks, asked twice; ids are text; a common word in all."""
    rng = random.Random(8)
    vocab = [f"w{int(200 * rng.random() ** 3)}" for _ in range(400)]
    docs = [(f"d{i:03}", " ".join(["All", *(rng.choice(vocab) for _ in range(rng.randrange(60)))])) for i in range(400)]
    path = str(tmp_path / "index")
    inverted_index.build(spark.createDataFrame(docs, "doc string, text string").repartition(3), "doc", "text", path, shard_docs=50)
    n, mean = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t.lower().split()))
    for seed, k1, b, k in ((1, 0.9, 0.4, 5), (2, 1.5, 0.75, 2)):
        own = random.Random(seed)
        asked = [(i, " ".join(["all", *(own.choice(vocab) for _ in range(own.randrange(1, 9)))])) for i in range(40)]
        got = inverted_index.search(spark, path, spark.createDataFrame(asked, "q int, text string"), "q", "doc", "text", k, k1, b).collect()
        want = set()
        for q, text in asked:
            scores = []
            for i, t in docs:
                tf, size = Counter(t.lower().split()), len(t.split())
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * size / mean)) for w in set(text.split()) if tf[w])
                scores.append((-round(s, 6), i))
            want |= {(q, i, -s) for s, i in sorted(scores)[:k]}
        assert {(r.q, r.doc, r.score) for r in got} == want


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "index")
    inverted_index.build(spark.createDataFrame([(1, None), (None, "x"), (2, " ")], "doc long, text string"), "doc", "text", path)
    assert inverted_index.search(spark, path, spark.createDataFrame([(1, "x")], "q int, text string"), "q", "doc", "text", 3).collect() == []


def test_pruning_is_exact():
    """Best documents by blocks of bounds against plain sums."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        acc, terms = np.zeros(300), []
        for _ in range(rng.integers(1, 9)):
            docs = np.sort(rng.choice(300, rng.integers(1, 200), replace=False))
            scores = rng.random(len(docs)) ** 4 * rng.integers(1, 9)
            cut = np.arange(0, len(docs), 7)
            bounds = np.maximum.reduceat(scores, cut)
            terms.append((docs, scores, docs[np.append(cut[1:], len(docs)) - 1], bounds, float(bounds.max())))
        k = int(rng.integers(1, 12))
        docs, scores = inverted_index._best(terms, k, acc)
        assert not acc.any()
        plain = np.zeros(300)
        for d, s, *_ in terms:
            plain[d] += s
        want = np.lexsort((np.arange(300), -plain))[:k]
        want = want[plain[want] > 0]
        top = docs[np.lexsort((docs, -scores))[:k]]
        assert top.tolist() == want.tolist()
        assert np.allclose(plain[docs], scores)
