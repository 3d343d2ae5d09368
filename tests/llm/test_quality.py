import zlib

import numpy as np

from quillon.llm import quality

D = "/root/testdata/sf0.01"


def test_pairs_are_learnt():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.train(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    assert (0, 1) in [(i, j) for i, j, *_ in m.pairs[:1]]


def test_tables_are_additive():
    rng = np.random.default_rng(2)
    x = rng.random((500, 2))
    y = (x[:, 0] + 0.2 * rng.random(500) > 0.6).astype(float)
    m = quality.train(x, y)
    by_hand = [m.base + sum(t[np.searchsorted(c, r[f], "right")] for f, (c, t) in enumerate(zip(m.cuts, m.tables, strict=True))) + sum(t[np.searchsorted(a, r[i], "right"), np.searchsorted(b, r[j], "right")] for i, j, a, b, t in m.pairs) for r in x]
    assert np.allclose(m.raw(x), by_hand)


def test_one_class_and_no_rows():
    x = np.random.default_rng(3).random((10, 4))
    assert (quality.train(x, np.ones(10)).score(x) > 0.9).all()
    assert np.allclose(quality.train(x[:0], np.zeros(0)).score(x), 0.5)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rows = quality.judged(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    good = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    other = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, other)
    assert a.base == b.base and all((s == t).all() for s, t in zip(a.tables, b.tables, strict=True))


def test_rows(spark):
    docs = spark.createDataFrame([(1, "some words here", 0.5), (1, "some words here", 0.5), (2, None, 0.1), (3, "", None), (None, "x " * 40000, 0.0), (4, "\n\n\t", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (3, 1), (4, 0), (4, 1)], "doc_id long, quality int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert quality.judged(docs.limit(0), labels).collect() == []
    assert len(quality.judged(docs, labels.limit(0)).collect()) == 6


def plain_tree(g, h, depth, smooth, least):
    """The best tree over ordered bins, by trying every cut."""
    if depth:
        found = []
        for cut in range(1, len(g)):
            left, right = (sum(g[:cut]), sum(h[:cut])), (sum(g[cut:]), sum(h[cut:]))
            if left[1] >= least and right[1] >= least:
                gain = sum(a * a / (b + smooth) for a, b in (left, right)) - sum(g) ** 2 / (sum(h) + smooth)
                found.append((gain, -cut))
        if found and max(found)[0] > 1e-9:
            cut = -max(found)[1]
            return plain_tree(g[:cut], h[:cut], depth - 1, smooth, least) + plain_tree(g[cut:], h[cut:], depth - 1, smooth, least)
    return [sum(g) / (sum(h) + smooth)] * len(g)


def plain_cells(cells, smooth, shape):
    """Values by cell of the best cut of both axes, by trying every one."""
    best = None
    for i in range(1, shape[0]):
        for j in range(1, shape[1]):
            sums = {}
            for (a, b), (g, h) in cells.items():
                s = sums.setdefault((a >= i, b >= j), [0.0, 0.0])
                s[0] += g
                s[1] += h
            gain = sum(g * g / (h + smooth) for g, h in sums.values())
            if best is None or gain > best[0] + 1e-12:
                best = gain, i, j, sums
    gain, i, j, sums = best
    value = {k: g / (h + smooth) for k, (g, h) in sums.items()}
    total = [sum(v[k] for v in cells.values()) for k in (0, 1)]
    return gain - total[0] ** 2 / (total[1] + smooth), lambda a, b: value.get((a >= i, b >= j), 0.0)


def test_boosting_by_plain_sums():
    """The whole training once more, row by row, without tables."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(70, 4)), 1)
    x[:, 3] = 1.0  # one value: a feature that cannot be cut
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) | (rng.random(70) < 0.1)).astype(float)
    options = {"bins": 8, "pair_bins": 4, "rounds": 5, "pair_rounds": 4, "n_pairs": 2}
    model = quality.train(x, y, **options)
    rows, rate, smooth = range(len(y)), 0.1, 1.0
    bin_of = {(f, n): [sum(v >= c for c in quality.edges(x[:, f], n)) for v in x[:, f]] for f in range(4) for n in (8, 4)}
    mean = (y.sum() + 1) / (len(y) + 2)
    raw = [float(np.log(mean / (1 - mean)))] * len(y)

    def slopes():
        p = [1 / (1 + np.exp(-r)) for r in raw]
        return [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]

    for _ in range(5):
        for f in range(3):
            g, h = slopes()
            n = len(quality.edges(x[:, f], 8)) + 1
            at = bin_of[f, 8]
            tree = plain_tree([sum(g[r] for r in rows if at[r] == k) for k in range(n)], [sum(h[r] for r in rows if at[r] == k) for k in range(n)], 2, smooth, 1.0)
            raw = [raw[r] + rate * tree[at[r]] for r in rows]

    def cells(i, j):
        g, h = slopes()
        out = {}
        for r in rows:
            c = out.setdefault((bin_of[i, 4][r], bin_of[j, 4][r]), [0.0, 0.0])
            c[0] += g[r]
            c[1] += h[r]
        return plain_cells(out, smooth, (len(quality.edges(x[:, i], 4)) + 1, len(quality.edges(x[:, j], 4)) + 1))

    pairs = sorted(((-cells(i, j)[0], i, j) for i in range(3) for j in range(i + 1, 3)))[:2]
    assert [p[:2] for p in model.pairs] == [(i, j) for _, i, j in pairs]
    for _ in range(4):
        for _, i, j in pairs:
            value = cells(i, j)[1]
            raw = [raw[r] + rate * value(bin_of[i, 4][r], bin_of[j, 4][r]) for r in rows]
    assert np.allclose(model.raw(x), raw, atol=1e-9)


def test_score_at_the_cut_and_repeated_ids(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(4, "another")] * 5 + [(None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.judged(docs, none).collect()} == {(0.5, 1)}
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert quality.judged(docs, labels).count() == 36
