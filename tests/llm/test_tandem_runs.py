import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from quillon.llm import queries, tandem_runs
from quillon.session import table


def brute(w, least_exponent=4, least_words=6):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least_words, least_exponent * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng):
    for _ in range(rng.randrange(1, 6)):
        letters, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(0, 60)
        w = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
        if n and rng.random() < 0.6:
            at = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - at) // 3 + 1))
            w = [w[x] if x < at else w[at + (x - at) % p] for x in range(n)]
        yield w


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        docs = list(texts(rng))
        for least in ((4, 6), (2, 2)):
            assert tandem_runs.runs_of(docs, *least) == [brute(d, *least) for d in docs]


def test_fibonacci_words():
    a, b = b"a", b"ab"
    while len(b) < 300:
        a, b = b, b + a
    word = [bytes([x]) for x in b]
    assert tandem_runs.runs_of([word], 2, 2) == [brute(word, 2, 2)]


def test_long_repetitions():
    rng = random.Random(4)
    w = [str(rng.randrange(3000)).encode() for _ in range(20_000)]
    w = w[:3000] + (w[3000:3500] * 40)[:17_000]
    assert tandem_runs.runs_of([w, [b"a"] * 50_000, []]) == [[(3000, 17_000, 500)], [(0, 50_000, 1)], []]


def test_texts_without_repetition_are_told_apart():
    assert tandem_runs.runs_of([[b"a"] * 6, [b"a"] * 5, list(map(bytes, range(9)))]) == [[(0, 6, 1)], [], []]


def expected(i, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    keep = [w[k] for k in range(n) if not any(s + q <= k < s + size for s, size, q in runs)]
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest())


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents").select("doc_id", "text").filter("length(text) < 6000")
    got = tandem_runs.digests(docs, changed=queries.planted_run).collect()
    assert sorted(map(tuple, got)) == sorted(expected(r.doc_id, r.text) for r in docs.collect())


def test_query_has_every_document(spark):
    d = "/root/testdata/sf0.001"
    assert queries.op12_tandem_runs(spark, d).count() == table(spark, d, "documents").count()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a " * 8), (4, "a b " * 8 + "c"), (4, "a b " * 8 + "c"), (5, "é é " * 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("runs", F.lit(1))
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in tandem_runs.found(df).collect()), key=repr)
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 8, 1)], "a"), (4, [(0, 16, 2)], "a b c"), (4, [(0, 16, 2)], "a b c"), (5, [(0, 7, 1)], "é é")], key=repr)
    assert {r.n_runs for r in tandem_runs.digests(df, changed=queries.planted_run).collect() if r.doc_id is None} == {1}
    assert tandem_runs.found(df.limit(0)).count() == 0
