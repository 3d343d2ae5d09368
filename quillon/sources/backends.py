"""Metric backends by name, as data sources that batches and streams write to.

Each task writes a file of its own under ``_staged``, which readers pass over.
The commit gathers the files of all tasks in one folder and renames that to
``step=<n>``, so a step is there whole or not at all; a step that is repeated
replaces itself.  An abort, or a commit that fails, leaves nothing behind.  Paths
are of any store that ``pyarrow`` knows and driver and executors share."""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from quillon.functions.plugins import Names
from quillon.session import materialised, scope, ship

#: name -> (a row as a dict and the step or None, to a line of text; ending of files).
BACKENDS = Names("metric backend")


#: Lines that are written at once.
WRITTEN = 1024


def _finite(x):
    if isinstance(x, dict):
        return {k: _finite(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_finite(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


_ENCODE = json.JSONEncoder(ensure_ascii=False, default=str).encode


def json_line(row: dict, step: int | None) -> str:
    """The row as JSON; what is not finite is null."""
    return _ENCODE(_finite(row))


def text_line(row: dict, step: int | None) -> str:
    """``step:3 - a:1 - b:0.25``, without nulls, in the order of columns."""
    said = [f"{k}:{v}" for k, v in row.items() if v is not None]
    return " - ".join(said if step is None else [f"step:{step}", *said])


BACKENDS.add("jsonl")((json_line, "json"))
BACKENDS.add("console")((text_line, "txt"))


@dataclass
class Staged(WriterCommitMessage):
    """A task's file.  A stream is committed by another writer than the one that
    tasks had, so the folder is said too."""

    folder: str
    name: str


class _Lines:
    """What batch and stream writers share."""

    def __init__(self, options: dict, line: Callable[[dict, int | None], str], ending: str) -> None:
        self.path, self.line, self.ending = options["path"].rstrip("/"), line, ending
        self.step = int(options["step"]) if "step" in options else None
        self.id = uuid.uuid4().hex

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if ":" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator[Row]) -> Staged:
        store, base = self._store()
        name = f"{uuid.uuid4().hex}.{self.ending}"
        at = f"{base}/_staged/{self.id}"
        store.create_dir(at, recursive=True)
        try:
            with store.open_output_stream(f"{at}/{name}") as out:
                lines = (self.line(row.asDict(recursive=True), self.step) + "\n" for row in rows)
                while some := "".join(itertools.islice(lines, WRITTEN)):
                    out.write(some.encode())
        except BaseException:
            store.delete_file(f"{at}/{name}")
            raise
        return Staged(self.id, name)

    def _publish(self, messages: list[Staged | None], to: str) -> None:
        store, base = self._store()
        whole, target = f"{base}/_staged/{self.id}-whole", f"{base}/{to}"
        try:
            store.create_dir(whole, recursive=True)
            for m in messages:
                if m is not None:
                    store.move(f"{base}/_staged/{m.folder}/{m.name}", f"{whole}/{m.name}")
            if store.get_file_info(target).type != pafs.FileType.NotFound:
                store.delete_dir(target)
            store.move(whole, target)
        except BaseException:
            self._clear(messages)
            raise
        self._clear(messages)

    def _clear(self, messages: list[Staged | None]) -> None:
        """Also what attempts have left that failed or lost to another one."""
        store, base = self._store()
        folders = {self.id, f"{self.id}-whole", *(m.folder for m in messages if m is not None)}
        for at in (f"{base}/_staged/{x}" for x in folders):
            if store.get_file_info(at).type != pafs.FileType.NotFound:
                store.delete_dir(at)


class BatchLines(_Lines, DataSourceWriter):
    def commit(self, messages: list[Staged | None]) -> None:
        self._publish(messages, f"step={self.id if self.step is None else self.step}")

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(messages)


class StreamLines(_Lines, DataSourceStreamWriter):
    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803  Spark's name
        self._publish(messages, f"step={batchId}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self._clear(messages)


def source(spark: SparkSession, name: str) -> str:
    """Make a backend known to Spark; returns the name of its format."""
    line, ending = BACKENDS.get(name)
    ship(spark)

    class Backend(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"metrics_{name}"

        def writer(self, schema, overwrite) -> DataSourceWriter:
            return BatchLines(dict(self.options), line, ending)

        def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:  # noqa: N802  Spark's name
            return StreamLines(dict(self.options), line, ending)

    spark.dataSource.register(Backend)
    return Backend.name()


def log(df: DataFrame, backends: list[str], path: str, step: int) -> None:
    """A step's metrics to several backends, each in the folder of its name.  The
    metrics are computed once.  A step is repeated whole if a backend fails: those
    that had it replace it."""
    spark = df.sparkSession
    formats = {name: source(spark, name) for name in dict.fromkeys(backends)}
    with scope(spark):
        once = materialised(spark, df, "metrics")
        for name, kind in formats.items():
            once.write.format(kind).mode("append").option("path", f"{path}/{name}").option("step", step).save()


class Logged:
    """The same for each step of a stream, by ``foreachBatch``."""

    def __init__(self, path: str, backends: list[str], compute: Callable[[DataFrame], DataFrame]) -> None:
        self.path, self.backends, self.compute = path, backends, compute

    def __call__(self, batch: DataFrame, step: int) -> None:
        log(self.compute(batch), self.backends, self.path, step)


def drained(df: DataFrame, backend: str, path: str, checkpoint: str) -> None:
    """Rows of a stream, over all that is there, to one backend."""
    q = df.writeStream.format(source(df.sparkSession, backend)).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
