import random
from collections import Counter

import numpy as np

from quillon.llm import decontamination as d


def index_of(items, stride):
    words = [[*q, *a] for q, a in (d.parts(t) for _, t in items)]
    freq = Counter(w for x in words for w in set(x))
    return d.build(items, len(items), float(np.mean([len(x) for x in words])), freq, stride)


def brute(index, texts, threshold, question_share, answer_share):
    """Every passage against every item, all impacts added up."""
    out, s = {}, index.stride
    name = {i: w for w, i in index.vocab.items()}
    impact = {(name[t], i): x for t in name for i, x in zip(index.items[t], index.impacts[t], strict=True)}
    for t, text in enumerate(texts):
        words = d.words_of(text)
        for p in range(max(1, -(-(len(words) - s) // s)) if words else 0):
            passage = words[p * s : (p + 2) * s]
            for i in range(len(index.ids)):
                score = sum(impact.get((w, i), 0.0) for w in set(passage))
                q, a = d.overlap(index.question[i], passage), d.overlap(index.answer[i], passage)
                if score >= threshold - 1e-9 and q >= question_share and a >= answer_share:
                    rank = (-(q + a), -round(score, 9), p)
                    if (t, i) not in out or rank < out[t, i]:
                        out[t, i] = rank
    return {(t, i, p) for (t, i), (_, _, p) in out.items()}


def made(rng, n_items=60, n_texts=60):
    vocab = [f"w{int(200 * rng.random() ** 2)}" for _ in range(400)]

    def some(k):
        return [rng.choice(vocab) for _ in range(k)]

    items = [(10 * i, " ".join(some(rng.randrange(4, 16))) + ". " + " ".join(some(rng.randrange(1, 6))) + ".") for i in range(n_items)]
    texts = []
    for _ in range(n_texts):
        words = some(rng.choice([0, 5, 60, 400]))
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            own = [w if rng.random() < 0.9 else rng.choice(vocab) for w in own]
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        texts.append(" ".join(words).encode())
    return items, texts


def test_finds_what_brute_force_finds():
    rng = random.Random(11)
    for shares in ((0.0, 0.0), (0.6, 0.6)):
        for threshold in (0.4, 0.7):
            items, texts = made(rng)
            index = index_of(items, 22)
            got = {(t, i, p) for t, i, _, _, _, p in d.matches(index, texts, threshold, *shares)}
            want = brute(index, texts, threshold, *shares)
            assert {x[:2] for x in got} == {x[:2] for x in want}
            assert len(got - want) <= len(want) * 0.02  # equal ranks but for rounding
            assert want


def test_wand_is_exact():
    rng = random.Random(12)
    items, _ = made(rng, 200, 0)
    index = index_of(items, 22)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.vocab)), 25))
        scores = Counter()
        for t in terms:
            for i, x in zip(index.items[t], index.impacts[t], strict=True):
                scores[i] += x
        assert sorted(i for i, _ in d.wand(index, terms, 0.3)) == sorted(i for i, x in scores.items() if x >= 0.3 - 1e-9)


def test_several_indexes_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    one = sorted(map(tuple, d.contaminated(docs, items).collect()))
    many = sorted(map(tuple, d.contaminated(docs, items, index_items=7).collect()))
    assert [(r[0], r[1]) for r in one] == [(r[0], r[1]) for r in many] and one
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    exact = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if " ".join(r.text.split()) in t}
    assert exact <= {(r[0], r[1]) for r in one}


def test_rows(spark):
    items = spark.createDataFrame([(1, "What is the colour of the clear sky at noon? It is blue."), (2, None), (None, "some text"), (3, ""), (4, "!!"), (5, "What is the colour of the clear sky at noon? It is blue.")], "item_id long, text string")
    leak = "Filler before. WHAT is the colour of the clear sky, at noon? it is blue. " + "filler after " * 3000
    docs = spark.createDataFrame([(1, leak, 1), (1, leak, 1), (2, None, 1), (3, "", 2), (None, leak, 3), (4, "What is the colour of the clear sky at noon?", 4)], "doc_id long, text string, item_id int")
    got = sorted(((r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 5), (1, 1), (1, 5), (None, 1), (None, 5)], key=repr)
    left = d.clean(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    assert d.contaminated(docs.limit(0), items).collect() == [] and d.contaminated(docs, items.limit(0)).collect() == []


def test_verdicts_hang_on_no_other_item(spark):
    rng = random.Random(13)
    item = [f"word{i}" for i in range(21)]
    far = []
    for w in item:  # the item's words, scattered over about a thousand
        far += [w, *(f"filler{rng.randrange(10**6)}" for _ in range(50))]
    near = [f"pad{i}" for i in range(500)] + item + [f"pad{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(far)), (2, " ".join(near))], "doc_id long, text string")
    huge = " ".join(f"long{rng.randrange(10**6)}" for _ in range(5000))
    short = (1, " ".join(item[:14]) + ". " + " ".join(item[14:]) + ".")
    for items in ([short], [short, (2, huge)]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        assert sorted((r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()) == [(2, 1)]
        assert [r.doc_id for r in d.clean(docs, bench).collect()] == [1]


def test_long_items_are_found_whole(spark):
    rng = random.Random(14)
    items = [(k, " ".join(f"v{rng.randrange(400)}" for _ in range(n - 9)) + ". " + " ".join(f"a{rng.randrange(400)}" for _ in range(9)) + ".") for k, n in enumerate((20, 63, 64, 65, 127, 128, 300, 2000))]
    pad = lambda n: " ".join(f"p{rng.randrange(10**6)}" for _ in range(n))
    docs = [(k, f"{pad(rng.randrange(700))} {t} {pad(rng.randrange(700))}") for k, t in items]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(frame, bench, index_items=3)
    assert {(r.doc_id, r.item_id) for r in got.collect()} >= {(k, k) for k, _ in items}
    assert d.clean(frame, bench, index_items=1).collect() == []


def test_all_indexes_in_one_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for index_items, n in ((20_000, 1), (items.count() // 3, 1)):
        plan = d.contaminated(docs, items, index_items=index_items)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == n and "Join" not in plan
    assert "Join" not in d.clean(docs, items)._jdf.queryExecution().optimizedPlan().toString()


def test_memory_is_bounded_with_many_items_and_foreign_passages():
    """Passages with one known word each: no array of all passages and blocks."""
    import tracemalloc

    items = [(i, f"w{i} common q{i % 97} x{i % 89}. answer a{i}") for i in range(20_000)]
    index = index_of(items, 64)
    foreign = [b" ".join([b"common", *(b"z%d" % ((k * 131 + j) % 9973) for j in range(60))]) for k in range(20_000)]
    known = b"w77 common q77 x77. answer a77"
    tracemalloc.start()
    start = tracemalloc.get_traced_memory()[0]
    found = []
    for at in range(0, len(foreign), 8000):
        found += [(at + t, i) for t, i, *_ in d.matches(index, [*foreign[at : at + 8000], known], 0.6, 0.6, 0.6)]
    peak = tracemalloc.get_traced_memory()[1] - start
    tracemalloc.stop()
    assert {i for _, i in found} == {77} and len(found) == 3
    assert peak < 150 << 20, peak
