"""Rows to workers and back, by named modes.

A dispatch mode says which worker has which rows, a collect mode what becomes of
the workers' rows.  Between them, a worker's share is one partition, whose place is
its ordinal, and is streamed through the worker's function in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.plugins import Names
from quillon.operators.batch import numbered
from quillon.session import materialised

#: (rows with ``_ord``, number of workers) to rows with ``_worker`` and ``_padded``.
DISPATCH = Names("dispatch mode")
#: Rows with ``_ord``, ``_worker``, ``_padded`` to those that are returned.
COLLECT = Names("collect mode")


@DISPATCH.add("one_to_all")
def one_to_all(df: DataFrame, workers: int) -> DataFrame:
    """Every worker has all rows."""
    return df.withColumn("_worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1)))).withColumn("_padded", F.lit(False))


@DISPATCH.add("all_to_all")
def all_to_all(df: DataFrame, workers: int) -> DataFrame:
    """Column ``worker`` of the rows says whose each is; one that is not there is
    an error."""
    w = F.col("worker").cast("int")
    good = w.between(0, workers - 1)
    return df.withColumn("_worker", F.when(good, w).otherwise(F.raise_error(F.lit("no such worker")).cast("int"))).withColumn("_padded", F.lit(False))


@DISPATCH.add("data_parallel")
def data_parallel(df: DataFrame, workers: int) -> DataFrame:
    """Stretches of equal length in the order of rows; the last is padded with the
    first rows, over and over if there are too few."""
    n = df.count()
    pad = -n % workers
    out = df.withColumn("_padded", F.lit(False))
    if pad:
        first = df.filter(F.col("_ord") < pad)  # fewer than there are workers
        places = F.sequence(F.col("_ord"), F.lit(pad - 1).cast("long"), F.lit(n).cast("long"))
        more = first.withColumn("_ord", F.explode(F.transform(places, lambda i: i + n))).withColumn("_padded", F.lit(True))
        out = out.unionByName(more)
    share = (n + pad) // workers or 1
    return out.withColumn("_worker", F.floor(F.col("_ord") / share).cast("int"))


@COLLECT.add("all")
def collect_all(df: DataFrame) -> DataFrame:
    """All workers' rows."""
    return df.drop("_padded")


@COLLECT.add("unpadded")
def unpadded(df: DataFrame) -> DataFrame:
    return df.filter("NOT _padded").drop("_padded")


@COLLECT.add("first_worker")
def first_worker(df: DataFrame) -> DataFrame:
    return df.filter("_worker = 0").drop("_padded")


def run(
    df: DataFrame,
    key: str,
    workers: int,
    f: Callable[[int, pd.DataFrame], pd.DataFrame],
    added: str,
    dispatch: str = "data_parallel",
    collect: str = "unpadded",
) -> DataFrame:
    """What workers make of the rows, in the order of ``key``: ``f`` has the worker's
    ordinal and a batch, and returns the batch's rows with ``added`` columns.  The
    result has ``_ord``, the row's place in the input, and ``_worker``.  The places
    are written first, so rows of one key keep theirs if a task is run again."""
    if workers < 1:
        raise ValueError("there must be a worker")
    placed = materialised(df.sparkSession, numbered(df, key, name="_ord"), "places")
    dealt = DISPATCH.get(dispatch)(placed, workers)
    finish = COLLECT.get(collect)
    shares = dealt.repartitionById(workers, F.col("_worker"))
    schema = T.StructType([*shares.schema.fields, *T._parse_datatype_string(added).fields])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield f(int(batch["_worker"].iloc[0]), batch)

    return finish(shares.mapInPandas(work, schema))
