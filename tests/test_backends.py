"""Metric backends: commit, abort, repeats, restarts."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.sources import backends as b
from quillon.streaming import table_stream


def files(path):
    return sorted(f for f in glob.glob(f"{path}/**/*", recursive=True) if os.path.isfile(f))


def lines(path):
    return sorted(x for f in files(path) for x in open(f).read().splitlines())


def test_two_at_once(spark, tmp_path):
    df = spark.createDataFrame([("é", 1, float("nan"), None), ("b", 2, 0.25, [1, 2])], "k string, n int, x double, a array<int>").repartition(2)
    b.log(df, ["jsonl", "console", "jsonl"], str(tmp_path), 7)
    assert lines(f"{tmp_path}/console") == ["step:7 - k:b - n:2 - x:0.25 - a:[1, 2]", "step:7 - k:é - n:1 - x:nan"]
    assert sorted(map(json.loads, lines(f"{tmp_path}/jsonl")), key=lambda r: r["n"]) == [{"k": "é", "n": 1, "x": None, "a": None}, {"k": "b", "n": 2, "x": 0.25, "a": [1, 2]}]
    assert all("/step=7/" in f for f in files(tmp_path))


def test_a_repeated_step_replaces_itself(spark, tmp_path):
    for n in (3, 1):
        b.log(spark.range(n), ["jsonl"], f"file://{tmp_path}", 0)
    b.log(spark.range(2), ["jsonl"], f"file://{tmp_path}", 1)
    assert lines(f"{tmp_path}/jsonl/step=0") == ['{"id": 0}'] and len(lines(f"{tmp_path}/jsonl/step=1")) == 2


def test_an_empty_step(spark, tmp_path):
    b.log(spark.range(0), ["jsonl"], str(tmp_path), 0)
    assert lines(tmp_path) == []


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    b.log(spark.range(2), ["jsonl"], str(tmp_path), 0)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    to = str(tmp_path / "jsonl")
    with pytest.raises(Exception, match="no"):
        bad.write.format(b.source(spark, "jsonl")).mode("append").option("path", to).option("step", 1).save()
    assert lines(tmp_path) == ['{"id": 0}', '{"id": 1}'] and not os.path.exists(f"{to}/step=1")


def test_a_commit_that_fails_leaves_nothing(tmp_path, monkeypatch):
    w = b.BatchLines({"path": str(tmp_path), "step": "0"}, b.json_line, "json")

    class One:
        def asDict(self, recursive):  # noqa: N802
            return {"a": 1}

    staged = [w.write(iter([One()])) for _ in range(3)]
    with pytest.raises(FileNotFoundError):
        w.commit([*staged, b.Staged(w.id, "never-written.json")])
    assert files(tmp_path) == []


def test_an_unknown_backend(spark, tmp_path):
    with pytest.raises(ValueError, match="no metric backend"):
        b.log(spark.range(1), ["nowhere"], str(tmp_path), 0)


def test_one_of_the_user_s(spark, tmp_path):
    b.BACKENDS.found.pop("ids", None)
    b.BACKENDS.add("ids")((lambda row, step: f"{step}/{row['id']}", "log"))
    b.log(spark.range(2), ["ids"], str(tmp_path), 4)
    assert lines(tmp_path) == ["4/0", "4/1"]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "checkpoint")}
    seen = 0
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(at["in"])
        b.drained(table_stream(spark, at["in"], "id long"), "jsonl", at["out"], at["checkpoint"])
        seen += 10
        assert [json.loads(x)["id"] for x in sorted(lines(at["out"]), key=lambda x: json.loads(x)["id"])] == list(range(seen))
    assert {f.split("/step=")[1].split("/")[0] for f in files(at["out"])} == {"0", "1", "2"}
