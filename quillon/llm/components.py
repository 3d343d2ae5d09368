"""Connected components: links are contracted within tasks of a bounded number
of links, then by alternating large and small stars across them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_batches
from quillon.session import materialised

SALTS = 8
#: Links that one task contracts.
LOCAL_LINKS = 500_000


def _least(edges: DataFrame) -> DataFrame:
    """``u``, ``v``, ``m``: each edge with the least of u and its neighbours.  A
    node may have any share of the edges: they meet its row by node and salt."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(salted, ["u", "salt"]).select("u", "v", "m")


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Each task's links as links to the least node of their component there."""
    kind = edges.schema["u"].dataType

    def run(batches):
        up, at = {}, None

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y] if y in up else y
            return x

        for b in batches:
            at = b.column(0).type
            for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = (tuple(v.values()) if isinstance(v, dict) else v for v in (x, y))
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
        names = [f.name for f in at] if at is not None and pa.types.is_struct(at) else None
        out = [(x, r) for x in up if (r := root(x)) != x]
        for k in range(0, len(out), 100_000):
            part = out[k : k + 100_000]
            cols = [[dict(zip(names, p[i], strict=True)) if names else p[i] for p in part] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, at) for c in cols], ["u", "v"])

    return map_batches(edges.repartition(parts), run, f"u {kind.simpleString()}, v {kind.simpleString()}")


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for all nodes of
    ``links`` (``a``, ``b``, of one orderable type; not null).  If the links are
    more than a task contracts, the rounds that follow are logarithmic in the
    number of nodes; each is written to the shared folder."""
    spark = links.sparkSession
    edges = materialised(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    parts = max(1, -(-edges.count() // local_links))
    edges = materialised(spark, _contracted(edges, parts), "cc")
    before = None
    while parts > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = _least(large)
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialised(spark, small.filter("u <> v").distinct(), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
