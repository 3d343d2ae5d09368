import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillon.llm import cross_align, queries
from quillon.session import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    value = cross_align.byte_values()
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {i: bytes(value[c] for c in t) for t, i in a.get_vocab().items() if i < 50256}


def brute(rows, tools):
    """Whole texts by the libraries."""
    a, b, a_bytes = tools
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    count, found = collections.Counter(), []
    for i, t in rows:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        parts = [a_bytes[x] for x in ids_a], [b_bytes(x) for x in ids_b]
        if not t or any(b"".join(p) != (" " + t).encode() for p in parts):
            found.append((i, 0, 0, [], ""))
            continue
        ends = []
        for p in parts:
            at, own = 0, {}
            for k, x in enumerate(p):
                at += len(x)
                own[at] = k
            ends.append(own)
        groups, links, x, y = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            m, n = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, ids_a[x:m])) + "|" + ",".join(map(str, ids_b[y:n])))
            links.append((ids_a[m - 1], ids_b[n - 1]))
            x, y = m, n
        count.update(links)
        found.append((i, len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((i, n_a, n_b, len(x), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), h) for i, n_a, n_b, x, h in found), key=repr)


def test_query_against_the_libraries(spark, tools):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_cross_align(spark, d).collect()), key=repr) == brute(rows, tools)


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 24])
def test_odd_rows(spark, tools, block_bytes):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "a \n b\n\n"), (6, "x▁y x"), (7, "<s> <|endoftext|> </s>"), (8, "\x00\t x \x0b y"), (None, "of the of"), (9, "of the"), (9, "of the"), (10, "naïve 你好　世界 🙂   x"), (11, "the " * 3000), (12, "q" * 5000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").select("*", F.lit(1).alias("block"), F.lit(2).alias("key")).repartition(2)
    got = cross_align.aligned(df, A, B, block_bytes=block_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, tools)


def test_segments_are_independent(tools):
    """Odd strings: tokens of the segments are those of the whole."""
    own = cross_align.Aligner(open(A).read(), open(B, "rb").read())
    rng = random.Random(1)
    pool = " \n\n   \t\r\x0b\x0c\x00\x1c\x85 ​　 éÀ̀ａ你好한ابпр🙂'sdlrv019.,!?-_<>abcdeTheth"
    for _ in range(3000):
        text = "".join(rng.choice(pool) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(rng.randrange(1, 30)))
        if cross_align.MARK in text:
            continue
        segments = list(cross_align.split(text))
        assert "".join(segments) == " " + text
        a, b = own.encoded(segments)
        assert [i for x in a for i in x] == tools[0].encode(" " + text, add_special_tokens=False).ids
        assert [i for x in b for i in x] == tools[1].encode(text)


def test_texts_with_a_segment_that_does_not_come_back(spark):
    """Other segments of such a text count nowhere."""
    lists = spark.createDataFrame([(0, k, k != 2, 1, 1, f"{k}|{k}", k.to_bytes(4, "little"), 1 if k != 2 else None) for k in range(3)], "block long, k long, ok boolean, n_a int, n_b int, groups string, links binary, times long")
    texts = spark.createDataFrame([(0, i, np.array(s, np.uint32).tobytes()) for i, s in ((1, [0, 1, 2]), (2, [0, 1]), (3, [1, 2, 0]))], "block long, id long, seq binary")
    less = {r.k: r.less for r in cross_align.failing(texts, lists.filter("NOT ok").select("block", "k")).collect()}
    assert less == {0: 2, 1: 2, 2: 2}
    scored = cross_align.scored(lists, spark.sparkContext.broadcast((np.array([5, 7, 0]), np.array([True, False, False]))))
    out = {r.id: tuple(r)[1:7] for r in cross_align.composed(texts, scored, "id").collect()}
    assert out == {1: (0,) * 6, 2: (2, 2, 2, 2, 1, 12), 3: (0,) * 6}


def test_vocabularies_are_checked():
    with pytest.raises(ValueError):
        cross_align.checked(open(A).read(), ["▁of▁the"])
    with pytest.raises(ValueError):
        cross_align.checked(open(public_tokenizers.path("word_bpe_49k.json")).read(), [])


def test_empty_table(spark):
    assert cross_align.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
