import os
from types import SimpleNamespace

import pytest

from quillon import session


def local(path):
    return path.removeprefix("file://")


def test_scopes_delete_what_was_made_inside(spark):
    df = spark.range(5)
    with session.scope(spark):
        kept = session.materialised(spark, df, "kept", outer=True)
        with session.scope(spark):
            inner = session.scratch(spark, "inner")
            df.write.parquet(inner)
            left = session.materialised(spark, df, "left", outer=True)
        assert not os.path.exists(local(inner)) and left.count() == 5
        gone = left.inputFiles()[0]
    assert not os.path.exists(local(gone))
    assert kept.count() == 5
    session.clear_scratch(spark)
    assert not os.path.exists(local(session._own_dir(spark)))


def test_a_scope_that_fails_deletes_too(spark):
    with pytest.raises(ValueError), session.scope(spark):
        path = session.scratch(spark, "x")
        spark.range(1).write.parquet(path)
        raise ValueError
    assert not os.path.exists(local(path))


def test_threads_have_scopes_of_their_own(spark):
    import threading

    made = []
    with session.scope(spark):
        t = threading.Thread(target=lambda: made.append(session.scratch(spark, "other")))
        t.start()
        t.join()
        spark.range(1).write.parquet(made[0])
    assert os.path.exists(local(made[0]))


def test_a_cluster_needs_a_shared_folder():
    unset = SimpleNamespace(get=lambda key, default=None: default)
    for master, fails in (("spark://host:7077", True), ("yarn", True), ("local-cluster[2,1,1024]", True)):
        spark = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.shared_dir(spark)
    for key in ("file:///shared/", "hdfs://x/y"):
        conf = SimpleNamespace(get=lambda k, d=None, key=key: key)
        spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: unset))
        assert session.shared_dir(spark) == key.rstrip("/")
