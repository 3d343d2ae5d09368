import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import batch as b
from quillon.operators.retrieval import pooled
from quillon.sources import files


@pytest.mark.parametrize("part_rows", [3, 20, 10**6])
def test_places(spark, part_rows):
    rng = random.Random(part_rows)
    rows = [(rng.choice([None, 5, 5, 5, 5, 5, rng.randrange(30)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "v long, k long").repartition(5)
    want = {k: i for i, (v, k) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert {r.k: r.ord for r in b.numbered(df, "v", "k", part_rows=part_rows).collect()} == want
    assert b.numbered(df.limit(0), "v", "k").collect() == []


def test_many_cuts(spark):
    rng = random.Random(9)
    cuts = sorted({float(rng.randrange(1000)) for _ in range(300)})
    got = spark.range(-1, 1001).select("id", b._place("id", cuts).alias("p")).collect()
    assert all(r.p == sum(c < r.id for c in cuts) + sum(c <= r.id for c in cuts) for r in got)


def test_no_task_sorts_a_shared_value_whole(spark):
    df = spark.range(4000).select(F.lit(1).alias("v"), F.col("id").alias("k"))
    out = b.numbered(df, "v", "k", part_rows=50)
    assert {r.k: r.ord for r in out.collect()} == {i: i for i in range(4000)}


@pytest.mark.parametrize("values", [10**6, 7, 1])
def test_first_rows(spark, values):
    rng = random.Random(values)
    rows = [(rng.choice([None, *[rng.randrange(values)] * 20]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v long, k long").repartition(4)
    order = sorted((v, i) for v, i in rows if v is not None)
    for n in (0, 1, 30, 1500, len(order) - 1, len(order), 5000):
        got = {r.k for r in b.marked_first(df, "v", "k", n=n).collect() if r.first}
        assert got == {i for _, i in order[:n]}
    assert b.marked_first(df, "v", "k", n=30).count() == 3000


def test_orders(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(50)], "id long, hard int")
    order = lambda *a, **k: [r.id for r in sorted(b.sampled_order(df, "id", *a, **k).collect(), key=lambda r: r.place)]
    assert order("sequential") == list(range(50))
    assert order("curriculum", difficulty="hard") == sorted(range(50), key=lambda i: ((i * 7) % 5, i))
    one, two = order("shuffle", 1), order("shuffle", 2)
    assert one == order("shuffle", 1) != two and sorted(one) == sorted(two) == list(range(50))
    with pytest.raises(ValueError):
        order("other")
    assert b.select_mask(df, F.when(F.col("id") < 9, F.col("id") % 2 == 0)).count() == 5


def test_draws_follow_the_weights(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, 5.0).otherwise(0.5).alias("w"))
    got = {r.id: r.times for r in b.drawn(df, "w", "id").collect()}
    assert sum(got.values()) == 2000 and len(got) == 2000
    heavy = sum(n for i, n in got.items() if i % 10 == 0) / 2000
    assert abs(heavy - 5 / 9.5) < 0.05
    assert {r.id: r.times for r in b.drawn(df, "w", "id").collect()} == got


def test_interleaving_follows_the_weights(spark):
    parts = [spark.range(k * 1000, k * 1000 + 1000).withColumnRenamed("id", "k") for k in range(3)]
    got = sorted(files.interleaved(parts, [0.6, 0.3, 0.1], "k").collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(3000))
    head = Counter(r.part for r in got[:500])
    assert abs(head[0] / 500 - 0.6) < 0.08 and abs(head[1] / 500 - 0.3) < 0.08


def test_days(spark):
    days = [f"19{y}-{m:02d}-{d:02d}" for y in (98, 99) for m in (1, 6, 12) for d in (1, 2, 28)]
    df = spark.createDataFrame([(x,) for x in days], "t string").withColumn("d", F.to_date("t"))
    for start, end in (("1998-06-01", "1999-01-00"), ("1998", "1999-06"), ("1998-06-02x", "1999-12-28"), ("", "z")):
        got = sorted(r.t for r in df.filter(files.days_between(F.col("d"), start, end)).collect())
        assert got == [x for x in days if start <= x < end], (start, end)


def test_days_reach_the_scan(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = t.filter(files.days_between(F.col("o_orderdate"), "1998-06-01", "1999-01-00"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0], [7.0, 8.0])], "t array<array<double>>, m array<int>, p array<double>")
    got = df.select(*(pooled(k, F.col("t"), F.col("m"), F.col("p")).alias(k) for k in ("mean", "cls", "pooler"))).first()
    assert tuple(map(list, got)) == ([2.0, 4.0], [1.0, 2.0], [7.0, 8.0])
    with pytest.raises(NotImplementedError):
        pooled("max", F.col("t"), F.col("m"), F.col("p"))


def test_dump_leaves_out_short_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d")], "step int, ord int, output string")
    extra = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 7)], "step int, ord int, acc int")
    files.dump_generations(rows, str(tmp_path), extras={"acc": extra})
    got = spark.read.schema("ord int, output string, acc int, step int").json(str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(0, "a", 5, 1), (0, "c", None, 2), (1, "b", 6, 1), (1, "d", None, 2)]
