import random

import numpy as np
import pytest

from quillon.llm import signature_tree as s
from quillon.llm.components import components

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = words_of(t)
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    posting = {}
    for i, x in enumerate(sets):
        for g in x:
            posting.setdefault(g, []).append(i)
    for pair in {(i, j) for at in posting.values() for i in at for j in at if i < j}:
        a, b = sets[pair[0]], sets[pair[1]]
        if 100 * len(a & b) >= percent * len(a | b):
            up[root(pair[1])] = root(pair[0])
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, len(x), least[root(i)]) for i, ((d, _), x) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(rng, n, copies, shared):
    """Texts, their copies with a few words changed, and shared passages."""
    vocab = [f"v{i}" for i in range(3000)]
    passages = [[rng.choice(vocab) for _ in range(30)] for _ in range(shared)]
    texts = []
    while len(texts) < n:
        own = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 20, 60, 200]))]
        if shared and rng.random() < 0.6:
            own += rng.choice(passages)
        for _ in range(rng.choice([1, 1, 2, copies])):
            w = list(own)
            for _ in range(int(len(w) * rng.choice([0, 0.005, 0.02, 0.03, 0.05]))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w[: len(w) - rng.choice([0, 0, 1, 2])]))
    return texts


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 5, 80), (2, 5, 60), (3, 2, 80)])
def test_components(spark, seed, words, percent):
    rng = random.Random(seed)
    texts = corpus(rng, 500, 12, 2)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "One TWO"), (2004, "one\x0btwo"), (None, texts[0]), (2005, "one two"), (0, texts[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    got = sorted(map(tuple, s.joined(df, words, percent).collect()), key=repr)
    assert got == brute(rows, words, percent)


def test_blocks_and_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT_COUNT", 3)
    rng = random.Random(9)
    rows = list(enumerate(corpus(rng, 300, 60, 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, s.joined(df, group=8).collect()), key=repr) == brute(rows, 5, 80)


def test_groups_keep_every_pair_of_like_sizes():
    rng = np.random.default_rng(5)
    for n in (2, 9, 40, 130):
        sizes = np.sort(rng.integers(1, 60, n))
        keys = np.arange(n)
        got = {frozenset((a, b)) for k, _ in s.groups_of(keys, sizes, 80) for a in k.tolist() for b in k.tolist() if a < b}
        want = {frozenset((a, b)) for a in range(n) for b in range(a + 1, n) if 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b])}
        assert want <= got


def test_null_ids_are_bridges(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(base[k : k + 90]) for k in range(0, 40, 4)]  # each links with the next ones only
    rows = [(7, chain[0]), *((None, t) for t in chain[1:-1]), (3, chain[-1]), (None, "nothing like it at all here"), (None, None)]
    want = brute(rows, 5, 80)
    assert (7, 86, 3) in want
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, th string")
    for group in (1024, 4):
        assert sorted(map(tuple, s.joined(df, group=group).collect()), key=repr) == want


@pytest.mark.parametrize("group", [6, 40])
def test_large_groups_of_near_copies(spark, monkeypatch, group):
    """One large group of near copies, with outsiders that share its tokens."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(60)]

    def changed(words, k):
        words = list(words)
        for _ in range(k):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(i, changed(base, rng.choice([1, 1, 2]))) for i in range(160)]
    rows += [(1000 + i, changed(base, rng.choice([3, 4, 6]))) for i in range(40)]
    rows += [(2000 + i, changed(base[:30] + [f"own{i}x{j}" for j in range(25)], 0)) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, s.joined(df, group=group).collect()), key=repr) == brute(rows, 5, 80)


def test_blocks_of_open_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, 100, k, int(n), int(lab)) for g, labels in ((1, 1), (2, 3), (3, 100)) for k, (n, lab) in enumerate(zip(rng.integers(20, 30, 100), rng.integers(0, labels, 100), strict=True))]
    members = spark.createDataFrame(rows, "gid long, size long, key long, n long, label long")
    got = s.open_blocks(members, 80, 10).collect()
    by_task = {}
    for r in got:
        by_task.setdefault((r.gid, r.task), set()).add(r.key)
    assert max(map(len, by_task.values())) <= 50 and sum(map(len, by_task.values())) / len(by_task) <= 25
    assert not any(g == 1 for g, _ in by_task)  # one component: nothing left to do
    meet = {(g, frozenset(p)) for (g, _), keys in by_task.items() for a in keys for b in keys if a < b for p in [(a, b)]}
    of = {(r[0], r[2]): r for r in rows}
    for g in (2, 3):
        for a in range(100):
            for b in range(a):
                x, y = of[g, a], of[g, b]
                if x[4] != y[4] and 100 * min(x[3], y[3]) >= 80 * max(x[3], y[3]):
                    assert (g, frozenset((a, b))) in meet


def test_long_sets_have_bounded_bitmaps(monkeypatch):
    monkeypatch.setattr(s, "MOST_BITS", 128)
    test_trees_lose_no_candidate()


def test_trees_lose_no_candidate():
    rng = random.Random(6)
    for _ in range(20):
        texts = corpus(rng, 40, 8, 1)
        sets = [s.tokens(t.encode(), 5) for t in texts]
        sets = [t for t in sets if len(t) > 3]
        sizes = np.array([len(t) for t in sets])
        got = {frozenset(p) for p in s.candidates(sizes, [s.bitmap(t) for t in sets], np.arange(len(sets)), 80, True)}
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 80 * (sizes[i] + sizes[j] - common):
                    assert frozenset((i, j)) in got


def test_long_texts_hash_as_short_ones(monkeypatch):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["a", "Bc", "d" * 40, "e" * 300, "\t"]) for _ in range(rng.randrange(200))).encode() for _ in range(30)]
    texts += [b"", b" \n", b"x" * 900, b"y z " * 100 + b"w" * 700 + b" v"]
    whole = [t.tolist() for t in s.token_sets(texts, 5)]
    monkeypatch.setattr(s, "CHUNK_BYTES", 64)
    assert [t.tolist() for t in s.token_sets(texts, 5)] == whole
    split = [words_of(t.decode()) for t in texts]
    assert [len(t) for t in whole] == [len({tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)}) if w else 0 for w in split]


def test_stars(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5000, 5000 + i) for i in range(1, 60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    links = spark.createDataFrame(edges, "a long, b long")
    for local in (10**6, 60):
        got = {r.node: r.root for r in components(links, local).collect()}
        assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    pairs = links.selectExpr("named_struct('k', a, 'n', 1) AS a", "named_struct('k', b, 'n', 1) AS b")
    assert {r.node.k: r.root.k for r in components(pairs).collect()} == got


def test_one_id_with_several_texts(spark):
    own = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"x{i}" for i in range(100))
    rows = [(1, other), (1, own), (2, own + " end"), (3, other + " end"), (4, "alone it is")]
    got = s.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 96, 1), (1, 96, 1), (2, 97, 1), (3, 97, 1), (4, 1, 4)]


def test_empty_table(spark):
    assert s.joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(31)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near = list(words)
    for i in range(0, len(near), 100):
        near[i] = "changed"
    far = list(words)
    for i in range(0, len(far), 15):
        far[i] = f"c{i}"
    rows = [(5, " ".join(words)), (2, " ".join(near)), (9, " ".join(far)), (4, "y" * 3_000_000), (3, "Y" * 3_000_000), (None, " ".join(near) + " end")]
    got = {(r.doc_id, r.component_id) for r in s.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 2), (2, 2), (9, 9), (4, 3), (3, 3), (None, 2)}


def test_classes_of_many_copies_deal_out_once(spark, monkeypatch):
    """One row stands for each hot class; near copies of it are linked all the same."""
    monkeypatch.setattr(s, "HOT_COPIES", 1)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text) for i in range(30)] + [(None, text)] * 5 + [(100 + i, f"{text} x{i}") for i in range(6)] + [(200, "other words " * 9)]
    got = sorted((r.doc_id, r.component_id) for r in s.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect() if r.doc_id is not None)
    assert got == sorted((i, 200 if i == 200 else 0) for i, _ in rows if i is not None)
