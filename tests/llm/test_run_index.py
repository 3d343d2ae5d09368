import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import queries, run_index
from quillon.session import table


def brute(rows, length):
    c, out = Counter(), []
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, d in data:
        c.update(d[k : k + length] for k in range(len(d) - length + 1))
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - length + 1):
            if c[d[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_index_finds_what_is_there_twice():
    rng = random.Random(5)
    for _ in range(200):
        length = rng.choice([3, 5, 8, 20])
        base = bytes(rng.choice(b"ab\x00") for _ in range(60))
        strings = []
        for _ in range(rng.randrange(1, 8)):
            at = rng.randrange(50)
            s = bytearray(base[at : at + rng.randrange(1, 60)])
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = 98
            strings.append(bytes(s))
        at: dict = {}
        for i, s in enumerate(strings):
            for j in range(len(s) - length + 1):
                at.setdefault(s[j : j + length], []).append((i, j))
        want = {x for v in at.values() if len(v) > 1 for x in v}
        assert set(zip(*(x.tolist() for x in run_index.repeated_windows(strings, length)), strict=True)) == want


@pytest.mark.parametrize("at_once", [50, 100, 1 << 20])
def test_stretches_have_every_window_once(monkeypatch, at_once):
    monkeypatch.setattr(run_index, "AT_ONCE", at_once)
    rng = random.Random(6)
    for k in range(20):
        texts = [bytes(rng.choice(b"abcd" if k % 2 else b"a") for _ in range(rng.choice([40, 41, 100, 400]))) for _ in range(5)]
        first, last, _ = run_index.seeds(b"".join(texts), np.cumsum([len(t) for t in texts]), 40)
        ends = np.cumsum([0, *(len(t) for t in texts)])
        want = [x for a, b in zip(ends[:-1], ends[1:], strict=True) for x in range(a, b - 39)]
        assert sorted(x for a, b in zip(first.tolist(), last.tolist(), strict=True) for x in range(a, b + 1)) == want


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_run_index(spark, d).collect()), key=repr)
    assert got == brute(rows, 200)


def odd_rows():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    shared, common = word(90), word(64)
    rows = [(1, None), (2, ""), (3, "short"), (None, shared + word(50)), (None, shared + word(50)), (7, "x" * 3000), (8, " " * 500 + "y"), (8, word(70))]
    rows += [(10, word(200))] * 3 + [(11 + i, word(30) + common + word(30)) for i in range(40)] + [(60, common + word(40) + common)]
    return rows


@pytest.mark.parametrize("most", [3, 4096])
def test_odd_rows(spark, most):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id int, text string").select("*", F.lit(1).alias("th"), F.lit("x").alias("spans")).repartition(3)
    got = run_index.marked(df, length=60, most=most).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(rows, 60)
    for r in got:
        spans = np.frombuffer(r.spans, "<u4").reshape(-1, 2)
        assert int((spans[:, 1].astype(int) - spans[:, 0] + 1).sum()) == r.n_removed and len(spans) == r.n_spans


def test_empty_table(spark):
    assert run_index.marked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_too_short_windows(spark):
    with pytest.raises(ValueError):
        run_index.marked(spark.createDataFrame([], "doc_id long, text string"), length=8)
