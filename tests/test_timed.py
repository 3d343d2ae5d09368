"""Time limits of scorers."""

import math
import os
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions import plugins
from quillon.functions.timed import Children


def scorer(source, text, gold):
    if text == "sleep":
        time.sleep(60)
    if text == "spin":
        while True:
            pass
    if text == "end":
        os._exit(1)
    if text == "fail":
        raise ValueError(text)
    return float(len(text or "")) + (text == gold)


ROWS = [("s", t, "abc") for t in ("abc", "sleep", "x", None, "end", "spin", "fail", "", "abc", "abc")]
WANT = [4.0, -1.0, 1.0, 0.0, -1.0, -1.0, -1.0, 0.0, 4.0, 4.0]


@pytest.mark.parametrize("processes", [1, 2, 20])
def test_others_keep_their_scores(processes):
    begun = time.monotonic()
    with Children(scorer, processes) as c:
        assert c.scores(ROWS, 0.5, -1.0) == WANT
        assert c.scores(ROWS[:1], 0.5, -1.0) == [4.0]
        assert c.scores([], 0.5, -1.0) == []
        children = [x[1] for x in c.idle]
    assert time.monotonic() - begun < 20
    assert not any(x.is_alive() for x in children)


def test_as_a_column(spark):
    rows = [(i, *r) for i, r in enumerate(ROWS * 3)]
    df = spark.createDataFrame(rows, "i int, source string, text string, gold string").repartition(3)
    begun = time.monotonic()
    score = plugins.timed_reward(scorer, 0.5, on_error=-1.0)
    got = {r.i: r.score for r in df.select("i", score("source", "text", "gold").alias("score")).collect()}
    assert [got[i] for i in range(len(rows))] == WANT * 3
    assert time.monotonic() - begun < 60


def test_agrees_with_the_scorer_without_a_limit(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("source"), "text", F.col("lang").alias("gold"))
    f = lambda s, t, g: math.sqrt(len(t or "")) + len(g or "")
    both = df.select(plugins.timed_reward(f, 30.0)("source", "text", "gold").alias("a"), plugins.python_reward(f)("source", "text", "gold").alias("b"))
    assert both.filter("a <> b OR a IS NULL").count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "source string, text string, gold string")
    assert df.select(plugins.timed_reward(scorer, 1.0)("source", "text", "gold")).collect() == []
