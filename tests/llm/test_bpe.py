import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH) as f:
        return bpe.ByteBpe(f.read())


def texts():
    rng = random.Random(7)
    alphabet = "abe '’\n\t  1 é́tsxyz你\U0001f600\u0085\x1c"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    return [*made, "", "<|endoftext|>", "a<|endoftext|> b", "<|endoftext", "x" * 3000, "ab" * 4000, "a   b \n c  ", "   "]


def test_agrees_with_the_library(codec):
    lib, all_texts = Tokenizer.from_file(PATH), texts()
    for text, coded, want in zip(all_texts, codec.encode_many(all_texts), lib.encode_batch(all_texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(coded, np.int32).tolist()
        assert ids == want.ids, text
        assert codec.decode(ids) == lib.decode(want.ids, skip_special_tokens=False)


def test_one_word_and_many_words_merge_alike(codec):
    words = ["a", "the", " tokenization", "öäü", "x" * 60, " 你好"]
    alone = [bpe.merge([codec.first[b] for b in w.encode()], codec.ranks, codec.made) for w in words]
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.merge_many([w.encode() for w in words])] == alone


def test_invalid_bytes_decode_to_replacement(codec):
    assert codec.decode([codec.first[0xFF], codec.first[65]]) == "�A"


def test_rows(spark):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (2, None, "y"), (None, "", None), (3, "w " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    lib = Tokenizer.from_file(PATH)

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = [(i, len(ids := lib.encode(t or "", add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))) for i, t, _ in rows]
    assert sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def test_both_ways_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "<|endoftext|> é")], "doc_id long, text string")
    apart = bpe.bpe_decode(bpe.bpe_encode(docs, PATH).withColumnRenamed("n_tokens", "n"), PATH, keep=("n", "ids")).collect()
    at_once = bpe.bpe_round_trip(docs, PATH).collect()
    assert sorted((r.doc_id, r.n, r.ids, r.decoded) for r in apart) == sorted((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in at_once)


def test_whole_table_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
