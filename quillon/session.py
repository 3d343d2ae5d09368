"""Session factory, table loader and the shared scratch area."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = 8, name: str = "quillon", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; the path may be on any
    file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor,
    also where it is not installed there.  Done once per application; the
    files go through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import tempfile

    root = Path(__file__).resolve().parent
    to = Path(os.path.realpath(tempfile.mkdtemp())) / "quillon.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"quillon/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``
    as the cluster sets it.  Only on one machine, where it may be unset, a local
    folder is taken and set; a cluster without it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Paths of the scopes that are open in this thread, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillon/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str, outer: bool = False) -> str:
    """A new path in the shared folder.  It goes with the innermost open scope, or
    with ``outer`` with the one around it; without a scope it stays until
    ``clear_scratch``."""
    to = f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    if len(scopes) > outer:
        scopes[-1 - outer].append(to)
    return to


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are made inside are deleted at the end: what still
    reads them must have been written by then."""
    made: list[str] = []
    mark = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(mark)
        for path in made:
            removed(spark, path)


def materialised(spark: SparkSession, df: DataFrame, what: str, outer: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it
    back, so that a lost executor costs no recomputation upstream."""
    to = scratch(spark, what, outer)
    df.write.mode("overwrite").option("compression", "zstd").parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a scratch folder through Hadoop's file system; False if there is none."""
    jvm = spark.sparkContext._jvm
    p, q = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(p):
        return False
    store.mkdirs(q.getParent())
    if not store.rename(p, q):
        raise OSError(f"{path} cannot be moved to {to}")
    return True


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.  Results that still
    read them must have been written elsewhere."""
    removed(spark, _own_dir(spark))
