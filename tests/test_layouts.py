"""Registered tables in buckets and folders."""

import glob

from quillon import plans  # noqa: F401  registers the queries
from quillon.registry import QUERIES
from quillon.sources.files import Registry, buckets_for

D = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_join_of_buckets_has_no_exchange(spark):
    assert "Exchange" not in plan(QUERIES["join_bucketed"](spark, D))


def test_a_registered_dataset_is_its_folders(spark):
    shown = plan(QUERIES["scan_pruned"](spark, D))
    assert "PartitionFilters: [isnotnull(event_type" in shown or "PartitionFilters: [event_type" in shown


def test_null_keys_repeats_and_empty_tables(spark, tmp_path):
    known = Registry({})
    left = [(1, "a"), (1, "a"), (None, "b"), (7, None), (2, "c")]
    right = [(1, 10), (1, 11), (None, 12), (2, None)]
    known.store(spark.createDataFrame(left, "k long, v string"), "left", str(tmp_path / "l"), ["k"], 4)
    known.store(spark.createDataFrame(right, "k long, w long"), "right", str(tmp_path / "r"), ["k"], 4)
    known.store(spark.createDataFrame([], "k long, w long"), "none", str(tmp_path / "n"), ["k"], 4)
    joined = known.read(spark, "left").hint("merge").join(known.read(spark, "right"), "k")
    assert "Exchange" not in plan(joined)
    assert sorted(joined.collect(), key=str) == sorted([(1, "a", 10), (1, "a", 11)] * 2 + [(2, "c", None)], key=str)
    assert known.read(spark, "left").join(known.read(spark, "none"), "k").count() == 0
    assert known.read(spark, "left").count() == 5


def test_one_file_a_bucket(spark, tmp_path):
    known = Registry({})
    known.store(spark.range(1000).repartition(5), "rows", str(tmp_path / "t"), ["id"], 8)
    assert len(glob.glob(f"{tmp_path}/t/*.parquet")) == 8


def test_buckets_grow_with_the_rows(spark):
    assert [buckets_for(spark.range(n), 8000, 2) for n in (0, 1000, 2000, 5000, 9000)] == [2, 2, 2, 8, 16]


def test_null_folders(spark, tmp_path):
    known = Registry({})
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "x int, kind string")
    known.store_partitioned(df, "some", str(tmp_path / "p"), "kind", ["a"])
    known.store_partitioned(df, "all", str(tmp_path / "q"), "kind")
    assert sorted(r.x for r in known.read(spark, "some").collect()) == [1, 4]
    assert sorted(r.x for r in known.read(spark, "all").collect()) == [1, 2, 3, 4]


def test_buckets_without_an_estimate(spark):
    rows = spark.createDataFrame([(1,)], "x int")
    assert buckets_for(rows, least=2) == 8  # the session's shuffle partitions
