"""Stateful steps as Structured Streaming: accumulation of rollout groups,
adaptive coefficients, growing datasets, curricula, and event-time windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.advantages import filter_groups
from quillon.operators.batch import sampled_order
from quillon.session import materialised


def table_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a step, or with None all
    that are new."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def drained(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over all that is there; the checkpoint makes a restart go on
    where the last step ended."""
    q = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


class _Steps:
    """One row for each step, in a folder of its own: what a sink has done so far
    is read from there, so a restart from the checkpoint goes on with it, and a step
    that is repeated after a failure overwrites itself."""

    def __init__(self, path: str, schema: str) -> None:
        self.path, self.schema = path, schema

    def before(self, spark: SparkSession, step: int | None = None) -> DataFrame:
        """Rows of the steps before ``step``, or of all."""
        try:
            rows = spark.read.schema(f"{self.schema}, step long").json(self.path)
        except AnalysisException:  # nothing is there yet
            return spark.createDataFrame([], f"{self.schema}, step long")
        return rows if step is None else rows.filter(F.col("step") < step)

    def put(self, spark: SparkSession, step: int, *values) -> None:
        spark.createDataFrame([values], self.schema).coalesce(1).write.mode("overwrite").json(f"{self.path}/step={step}")


class KeptGroups:
    """Accumulates steps until ``wanted`` kept prompt groups are there, in the
    order of steps and uids; more steps than ``most_steps`` without them are an
    error.  Groups are kept if their values differ.  How many there are is read
    from what earlier steps have written."""

    def __init__(self, path: str, uid: str, value: str, wanted: int, most_steps: int) -> None:
        self.path, self.uid, self.value, self.wanted, self.most_steps = path, uid, value, wanted, most_steps
        self._steps = _Steps(f"{path}-steps", "n long")

    def have(self, spark: SparkSession, step: int | None = None) -> tuple[int, int]:
        """(groups, steps) so far."""
        return tuple(self._steps.before(spark, step).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())

    def __call__(self, batch: DataFrame, step: int) -> None:
        spark = batch.sparkSession
        have, steps = self.have(spark, step)
        if have >= self.wanted:
            return
        if steps >= self.most_steps:
            raise RuntimeError(f"{have} of {self.wanted} groups after {steps} steps")
        to = f"{self.path}/step={step}"
        filter_groups(batch, self.uid, self.value).write.mode("overwrite").parquet(to)
        self._steps.put(spark, step, spark.read.parquet(to).select(self.uid).distinct().count())

    def rows(self, spark: SparkSession) -> DataFrame:
        all_rows = spark.read.parquet(self.path)
        first = all_rows.select("step", self.uid).distinct().orderBy("step", self.uid).limit(self.wanted)
        return all_rows.join(first, ["step", self.uid], "left_semi")


class AdaptiveKl:
    """The coefficient follows the measured divergence, by at most a fifth of
    the step's share of the horizon."""

    def __init__(self, value: float, target: float, horizon: int) -> None:
        self.value, self.target, self.horizon = value, target, horizon

    def update(self, current: float, n_steps: int) -> float:
        self.value *= 1 + max(-0.2, min(0.2, current / self.target - 1)) * n_steps / self.horizon
        return self.value


class KlSteps:
    """An adaptive coefficient over the steps of a stream: each goes on from the
    value that the step before has written."""

    def __init__(self, path: str, value: float, target: float, horizon: int, divergence: Column) -> None:
        self.start, self.target, self.horizon, self.divergence = value, target, horizon, divergence
        self._steps = _Steps(path, "coefficient double")

    def __call__(self, batch: DataFrame, step: int) -> None:
        spark = batch.sparkSession
        last = self._steps.before(spark, step).agg(F.max_by("coefficient", "step")).first()[0]
        now, n = batch.agg(F.avg(self.divergence), F.count(F.lit(1))).first()
        control = AdaptiveKl(self.start if last is None else last, self.target, self.horizon)
        self._steps.put(spark, step, control.update(now or 0.0, n))

    def values(self, spark: SparkSession) -> DataFrame:
        """``step``, ``coefficient``."""
        return self._steps.before(spark).select("step", "coefficient")


class Metrics:
    """Appends a step's metrics as nested JSON lines, one folder a step, so that a
    repeated step overwrites itself."""

    def __init__(self, path: str, compute: Callable[[DataFrame], DataFrame]) -> None:
        self.path, self.compute = path, compute

    def __call__(self, batch: DataFrame, step: int) -> None:
        self.compute(batch).write.mode("overwrite").json(f"{self.path}/step={step}")


class Curriculum:
    """Difficulty of each key: mean value over the steps so far, kept as sums in
    one folder a step."""

    def __init__(self, path: str, key: str, value: str) -> None:
        self.path, self.key, self.value = path, key, value

    def __call__(self, batch: DataFrame, step: int) -> None:
        batch.groupBy(self.key).agg(F.sum(self.value).alias("total"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/step={step}")

    def order(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).groupBy(self.key).agg((F.sum("total") / F.sum("n")).alias("difficulty")).orderBy("difficulty", self.key)


class Growing:
    """A dataset that rows derived from each batch are appended to."""

    def __init__(self, path: str, generate: Callable[[DataFrame], DataFrame]) -> None:
        self.path, self.generate = path, generate

    def __call__(self, batch: DataFrame, step: int) -> None:
        self.generate(batch).write.mode("overwrite").parquet(f"{self.path}/step={step}")


def windows(events: DataFrame, kind: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and event-time window: ``tumbling`` and
    ``sliding`` of an hour, or ``session`` with a gap of 30 minutes by user."""
    e = events.withWatermark("ts", late)
    total = (F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    if kind == "session":
        w = F.session_window("ts", "30 minutes")
        return e.groupBy(w.alias("w"), "user_id").agg(*total)
    w = F.window("ts", "1 hour") if kind == "tumbling" else F.window("ts", "1 hour", "30 minutes")
    return e.groupBy(w.alias("w"), "event_type").agg(*total)


def appended(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there, in append mode into files: a window is
    written once the watermark has passed its end, and its state is dropped then.
    Windows that are still open are written by a later run with the same
    checkpoint."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Loader:
    """Batches of ``size`` rows in an order that is drawn anew for each epoch, or by
    ``key``; its state is a small text, and a loader made from it goes on with the
    batch that comes next."""

    def __init__(self, df: DataFrame, key: str, size: int, shuffle: bool = True, seed: int = 42, state: str | None = None) -> None:
        self.df, self.key, self.size, self.kind, self.seed = df, key, size, "shuffle" if shuffle else "sequential", seed
        at = json.loads(state) if state else {"epoch": 0, "position": 0}
        self.epoch, self.position = at["epoch"], at["position"]

    def state(self) -> str:
        return json.dumps({"epoch": self.epoch, "position": self.position})

    def __iter__(self) -> Iterator[DataFrame]:
        """The batches that are left of the epoch."""
        order = materialised(self.df.sparkSession, sampled_order(self.df, self.key, self.kind, self.seed + self.epoch), "epoch")
        total = order.count()
        while self.position * self.size < total:
            low = self.position * self.size
            self.position += 1
            yield order.filter((F.col("place") >= low) & (F.col("place") < low + self.size)).drop("place")
        self.epoch, self.position = self.epoch + 1, 0


def save_state(spark: SparkSession, state: str, path: str) -> None:
    """Keep a loader's state in a folder of any store."""
    spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def saved_state(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(path).first()
    except AnalysisException:
        return None
    return row.value if row else None
