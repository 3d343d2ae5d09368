"""Token lengths and loss masks against the libraries."""

from functools import cache

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quillon import plans  # noqa: F401  registers the queries
from quillon.functions import tokens as tk
from quillon.registry import QUERIES

D = "/root/testdata/sf0.001"
BYTES = str(path("byte_bpe_50k.json"))
TEXTS = [None, "", " ", "one two", "naïve 北京 🙂", "x" * 5000, "<|endoftext|> a", "one two"]
CHAT = "array<struct<role string, content string>>"


LOADED = cache(Tokenizer.from_file)


def library(text):
    return LOADED(BYTES).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_ids_and_lengths_are_the_library_s(spark, file):
    at = str(path(file))
    encode = SentencePieceProcessor(model_file=at).encode if at.endswith("model") else (lambda x, t=Tokenizer.from_file(at): t.encode(x, add_special_tokens=False).ids)
    t = tk.Tokens(spark, at)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").select("i", t.ids(F.col("text")).alias("ids"), t.length(F.col("text")).alias("n")).collect()
    for r in rows:
        assert r.ids == encode(TEXTS[r.i] or "") and r.n == len(r.ids)


def test_a_tokenizer_of_a_store_that_spark_reads(spark):
    one = spark.createDataFrame([("one two",)], "text string")
    assert one.select(tk.Tokens(spark, f"file://{BYTES}").ids(F.col("text"))).first()[0] == library("one two")


def test_a_tokenizer_that_is_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(tk, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        tk.Tokens(spark, BYTES)


def test_masks_of_chats(spark):
    chats = [
        (0, [("system", "Be brief."), ("user", "Hi"), ("assistant", "Hello there"), ("user", ""), ("assistant", None)]),
        (1, []), (2, None), (3, [(None, "no role")]), (4, [("assistant", "a" * 3000)]), (5, [("assistant", "same"), ("assistant", "same")]),
    ]
    df = spark.createDataFrame(chats, f"conv_id int, messages {CHAT}").withColumn("ids", F.lit("of the user"))
    out = {r.conv_id: r for r in tk.multi_turn(df, "messages", tk.Tokens(spark, BYTES)).collect()}
    for i, messages in chats:
        ids, mask = [], []
        for role, content in messages or []:
            for part, bit in ((f"<|im_start|>{role or ''}\n", 0), (f"{content or ''}<|im_end|>\n", int(role == "assistant"))):
                ids += library(part)
                mask += [bit] * len(library(part))
        assert (out[i].input_ids, out[i].loss_mask, out[i].ids) == (ids, mask, "of the user")


def test_empty_table(spark):
    df = spark.createDataFrame([], f"conv_id int, messages {CHAT}")
    assert tk.multi_turn(df, "messages", tk.Tokens(spark, BYTES)).collect() == []


def test_the_limit_reaches_the_scan(spark):
    df = QUERIES["filter_overlong_tokens"](spark, D)
    assert "LessThanOrEqual(token_len,246)" in df._jdf.queryExecution().toString()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    lengths = {i: len(library(x or "")) for i, x in texts.items()}
    assert {r.doc_id: r.token_len for r in df.collect()} == {i: n for i, n in lengths.items() if n <= 246}


def test_masks_over_the_table(spark):
    roles = spark.read.parquet(f"{D}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    said = {r.conv_id: sum(len(library(f"{m.text or ''}<|im_end|>\n")) for m in r.m if m.role == "assistant") for r in roles.collect()}
    rows = QUERIES["mt_loss_mask_tokens"](spark, D).collect()
    assert {r.conv_id: sum(r.loss_mask) for r in rows} == said
    assert all(len(r.loss_mask) == len(r.input_ids) for r in rows)
