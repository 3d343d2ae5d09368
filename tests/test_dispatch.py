"""Dispatch and collect modes."""

import pytest

from quillon.operators import dispatch


def seen(worker, batch):
    return batch.assign(by=worker)


def numbers(spark, n):
    return spark.range(n).selectExpr("id * 3 AS k", "cast(id % 2 AS int) AS worker", "'x' AS by_user").repartition(3)


@pytest.mark.parametrize("n,workers", [(0, 3), (1, 4), (3, 8), (10, 3), (12, 4), (101, 7)])
def test_data_parallel_gives_back_the_input_s_order(spark, n, workers):
    out = dispatch.run(numbers(spark, n), "k", workers, seen, "by int").orderBy("_ord").collect()
    assert [r.k for r in out] == [3 * i for i in range(n)]
    share = -(-n // workers) or 1
    assert [r.by for r in out] == [i // share for i in range(n)] == [r._worker for r in out]


@pytest.mark.parametrize("n,workers", [(1, 4), (3, 8), (10, 3)])
def test_all_workers_have_as_many_rows(spark, n, workers):
    out = dispatch.run(numbers(spark, n), "k", workers, seen, "by int", collect="all").orderBy("_ord").collect()
    share = -(-n // workers)
    assert [(r.k, r.by) for r in out] == [(3 * (i % n), i // share) for i in range(share * workers)]


def test_one_task_for_each_share(spark):
    out = dispatch.run(numbers(spark, 100), "k", 5, seen, "by int")
    where = out.selectExpr("by", "spark_partition_id() AS p").distinct().collect()
    assert sorted((r.by, r.p) for r in where) == [(i, i) for i in range(5)]


def test_one_to_all(spark):
    every = dispatch.run(numbers(spark, 4), "k", 3, seen, "by int", "one_to_all", "all").collect()
    assert sorted((r.k, r.by) for r in every) == [(3 * i, w) for i in range(4) for w in range(3)]
    first = dispatch.run(numbers(spark, 4), "k", 3, seen, "by int", "one_to_all", "first_worker").collect()
    assert sorted((r.k, r.by) for r in first) == [(3 * i, 0) for i in range(4)]


def test_all_to_all(spark):
    out = dispatch.run(numbers(spark, 9), "k", 2, seen, "by int", "all_to_all", "all").collect()
    assert len(out) == 9 and all(r.by == r.worker for r in out)
    with pytest.raises(Exception, match="no such worker"):
        dispatch.run(numbers(spark, 9), "k", 1, seen, "by int", "all_to_all", "all").collect()


def test_rows_of_one_key_are_all_there(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, None)], "k long, v string")
    out = dispatch.run(rows, "k", 3, seen, "by int").orderBy("_ord").collect()
    assert [r.k for r in out] == [None, 1, 1, 1, 2] and sorted(map(str, (r.v for r in out))) == ["None", "a", "a", "b", "c"]


def test_names(spark):
    with pytest.raises(ValueError, match="no dispatch mode"):
        dispatch.run(numbers(spark, 1), "k", 1, seen, "by int", "nowhere")
    with pytest.raises(ValueError, match="no collect mode"):
        dispatch.run(numbers(spark, 1), "k", 1, seen, "by int", collect="nowhere")
