"""Files in the layouts that recommendation and rollout data come in."""

from __future__ import annotations

import datetime
import functools
import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.batch import numbered, uniform

ITEM = "title string, description string, categories string"


def parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of all files, also of one that is named twice."""
    return functools.reduce(DataFrame.unionByName, (spark.read.parquet(p) for p in paths))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each line that is not blank."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_json(spark: SparkSession, path: str, value: str = ITEM) -> DataFrame:
    """One object whose keys become ``id``; missing values are empty."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", f"map<string, struct<{value.replace(' string', ': string')}>>")).alias("id", "x")).select("id", "x.*")
    return rows.fillna("")


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """``user_id``, ``item_ids``; lines with fewer than two tokens are skipped."""
    parts = F.split(F.trim("value"), r"(?U)\s+")
    return spark.read.text(path).filter(F.size(parts) > 1).select(F.get(parts, 0).alias("user_id"), F.slice(parts, 2, 1 << 30).alias("item_ids"))


def neighbours(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``anchor``, ``neighbours`` (the first ``n``); the header is skipped, of equal
    anchors the last line counts."""
    parts = F.split(F.trim("value"), r"(?U)\s+")
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).filter("at > 0")
    rows = lines.select(F.get(parts, 0).alias("anchor"), F.slice(parts, 2, n).alias("neighbours"), "at")
    return rows.groupBy("anchor").agg(F.max_by("neighbours", "at").alias("neighbours"))


def step_dumps(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines below ``<step>.jsonl``, with ``step`` from the name."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return rows.withColumn("step", F.regexp_extract(F.input_file_name(), r"/(\d+)\.jsonl", 1).cast("int"))


def dump_generations(df: DataFrame, path: str, step: str = "step", extras: dict[str, DataFrame] | None = None, ord_col: str = "ord") -> None:
    """JSON lines in a folder for each step.  ``extras``: further columns by name,
    each a frame of ``step``, ``ord_col`` and that column; in a step in which it has
    another number of values than there are rows, it is left out."""
    out = df
    for name, extra in (extras or {}).items():
        sizes = df.groupBy(step).agg(F.count(F.lit(1)).alias("n")).join(extra.groupBy(step).agg(F.count(F.lit(1)).alias("m")), step)
        whole = sizes.filter("n = m").select(step)  # a row for each step
        out = out.join(extra.join(F.broadcast(whole), step).select(step, ord_col, name), [step, ord_col], "left")
    out.write.mode("append").partitionBy(step).json(path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def make_folder(spark: SparkSession, path: str) -> None:
    """Also if it is there already."""
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at)


def cached_copy(spark: SparkSession, path: str, cache: str, always: bool = False) -> str:
    """Copy a file or folder of any store below ``cache``, into a folder named by
    the MD5 of its path, and return where it is.  A copy that is there already is
    kept, unless ``always``; one is only there once it is whole."""
    key = hashlib.md5(path.encode()).hexdigest()
    to = f"{cache.rstrip('/')}/{key}/{path.rstrip('/').rsplit('/', 1)[-1]}"
    target, at = _hadoop(spark, to)
    if target.exists(at):
        if not always:
            return to
        target.delete(at, True)
    source, start = _hadoop(spark, path)
    if not source.exists(start):
        raise FileNotFoundError(path)
    part = _hadoop(spark, f"{to}.part-{uuid.uuid4().hex}")[1]
    target.mkdirs(at.getParent())
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.FileUtil.copy(source, start, target, part, False, spark.sparkContext._jsc.hadoopConfiguration())
    if not target.rename(part, at):  # another one was first
        target.delete(part, True)
    return to


def sink(df: DataFrame, path: str, kind: str = "both") -> None:
    """Snappy Parquet, JSON lines, or both in folders of their own."""
    if kind in ("parquet", "both"):
        df.write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/parquet")
    if kind in ("jsonl", "both"):
        df.write.mode("overwrite").json(f"{path}/jsonl")


def merged(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, list[str]]:
    """(rows of all files that can be read, those that were skipped)."""
    found, skipped = [], []
    for p in paths:
        try:
            found.append(spark.read.schema(schema).json(p))
        except AnalysisException:
            skipped.append(p)
    return functools.reduce(DataFrame.unionByName, found, spark.createDataFrame([], schema)), skipped


def interleaved(parts: list[DataFrame], weights: list[float], key: str, seed: int = 42) -> DataFrame:
    """All rows of all parts with ``part`` and ``place``, an order in which a part
    comes up in proportion to its weight: that of a seeded exponential clock of
    each row."""
    out = None
    for i, (x, w) in enumerate(zip(parts, weights, strict=True)):
        x = x.withColumn("part", F.lit(i)).withColumn("clock", -F.log(uniform(seed + i, key)) / w)
        out = x if out is None else out.unionByName(x)
    return numbered(out, "clock", key, name="place").drop("clock")


def first_day(bound: str) -> datetime.date:
    """The first day whose ISO text is not less than ``bound``: texts of days are in
    the order of days, so a bound on the text is one on the day."""
    low, high = 1, datetime.date.max.toordinal()
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if datetime.date.fromordinal(mid).isoformat() >= bound else (mid + 1, high)
    return datetime.date.fromordinal(low)


def days_between(day: Column, start: str, end: str) -> Column:
    """Whether the ISO text of a day is in ``[start, end)``, as a comparison of days
    that a scan can use."""
    return (day >= F.lit(first_day(start).isoformat()).cast("date")) & (day < F.lit(first_day(end).isoformat()).cast("date"))


def nested(names: list[str]) -> Column:
    """JSON text in which ``a/b`` is ``{"a": {"b": ..}}``."""
    tree: dict = {}
    for n in names:
        at = tree
        *heads, leaf = n.split("/")
        for h in heads:
            at = at.setdefault(h, {})
        at[leaf] = n
    def build(t: dict) -> Column:
        return F.struct(*((build(v) if isinstance(v, dict) else F.col(f"`{v}`")).alias(k) for k, v in t.items()))

    return F.to_json(build(tree))


MOST_BUCKETS = 65_536
#: Spark's estimate of rows that it knows nothing of is at least this.
UNKNOWN = 1 << 62


def buckets_for(rows: DataFrame, bytes_each: int = 256 << 20, least: int = 8) -> int:
    """Buckets of about so many bytes by Spark's own estimate: a power of two, so that
    tables of different sizes still meet bucket by bucket.  Where Spark has no
    estimate, as many as a shuffle has; at most ``MOST_BUCKETS``, as Spark allows no
    more than 100,000."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN:
        size = bytes_each * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BUCKETS, 1 << max(least - 1, -(-size // bytes_each) - 1).bit_length())


class Registry:
    """Logical names of datasets: path and format or a table of the catalog, columns
    to rename, and for partitioned ones the values that belong to the dataset."""

    def __init__(self, entries: dict[str, dict]) -> None:
        self.entries = entries

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.entries:
            raise KeyError(f"no dataset is called {name}")
        e = self.entries[name]
        df = spark.table(e["table"]) if "table" in e else spark.read.format(e.get("format", "parquet")).load(e["path"])
        for column, values in e.get("partitions", {}).items():
            df = df.filter(F.col(column).isin(*values))
        return df.select(*(F.col(c).alias(to) for c, to in e["columns"].items())) if e.get("columns") else df

    def store(self, df: DataFrame, name: str, path: str, keys: list[str], buckets: int, columns: dict[str, str] | None = None) -> None:
        """Keep rows as a table below ``path`` in ``buckets`` by ``keys``, sorted by
        them, one file a bucket, and register it.  Joins and groups by the keys of
        tables with as many buckets move no rows.  All rows of a key are one bucket's:
        not for keys of which one holds a large share."""
        table = f"{name}_{uuid.uuid4().hex}"
        df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        self.entries[name] = {"table": table} | ({"columns": columns} if columns else {})

    def store_partitioned(self, df: DataFrame, name: str, path: str, by: str, values: list | None = None) -> None:
        """Keep rows as folders by a column, and register those of ``values`` (or all):
        a scan lists no other folder.  A value's rows are dealt to as many tasks as
        the table's size asks for, so a frequent one is not one task's."""
        slices = buckets_for(df)
        df.repartition(slices, by, F.xxhash64(*(c for c in df.columns if c != by)) % slices).write.partitionBy(by).parquet(path)
        self.entries[name] = {"path": path} | ({"partitions": {by: values}} if values is not None else {})
