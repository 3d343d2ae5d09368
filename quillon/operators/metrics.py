"""Aggregation of scores: batch statistics, validation metrics, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import ship


def two_level_mean(df: DataFrame, outer: str, inner: str, score: str) -> DataFrame:
    """Mean of the inner groups' means."""
    return df.groupBy(outer, inner).agg(F.avg(score).alias("m")).groupBy(outer).agg(F.avg("m").alias("score"))


def reduced(df: DataFrame, key: str, value: str) -> DataFrame:
    """By the key's name: maximum if it contains max, else minimum if it
    contains min, else mean."""
    k = F.col(key)
    return df.groupBy(key).agg(F.when(k.contains("max"), F.max(value)).when(k.contains("min"), F.min(value)).otherwise(F.avg(value)).alias("value"))


def majority(df: DataFrame, group: list[str], vote: str, value: str, order: str) -> DataFrame:
    """Value of the first row with the most frequent vote; ties go to the vote
    seen first."""
    votes = df.groupBy(*group, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("value"))
    return votes.groupBy(*group).agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("maj"))


def explained_variance(returns: Column, values: Column) -> Column:
    return 1 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)


@lru_cache(maxsize=256)
def resamples(n: int, size: int, times: int, seed: int) -> np.ndarray:
    """``times`` seeded draws of ``size`` places out of ``n``; they hang on nothing
    else, so groups of one size share them."""
    rng = np.random.RandomState(seed)
    return np.stack([rng.choice(n, size, replace=True) for _ in range(times)])


#: Numbers that a block of groups draws at once.
DRAWN = 1 << 21


def grouped_values(df: DataFrame, group: list[str], order: str, *values: str) -> DataFrame:
    """``group`` and an array of each of ``values`` in order.  A group is the
    answers to one prompt."""
    rows = F.array_sort(F.collect_list(F.struct(order, *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))))
    return df.groupBy(*group).agg(rows.alias("rows")).select(*group, *(F.col(f"rows.v{i}").alias(f"v{i}") for i in range(len(values))))


def _stacked(lists: list, width: int = 1):
    """(places, matrix) of the lists of each length, in blocks of which each draws
    at most ``DRAWN`` numbers, ``width`` for each list."""
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(lists):
        by_size.setdefault(len(x), []).append(i)
    for n, places in sorted(by_size.items()):
        step = max(1, DRAWN // width)
        for k in range(0, len(places), step):
            part = places[k : k + step]
            yield n, part, np.array([lists[i] for i in part])


def bootstrap(df: DataFrame, group: list[str], value: str, order: str, size: int, times: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and population std of the best and worst of ``size`` draws with
    replacement, over ``times`` seeded resamples of each group.  Groups of one size
    have the same draws, so they are drawn and reduced together."""
    ship(df.sparkSession)
    names = ["best_mean", "best_std", "worst_mean", "worst_std"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty((b.num_rows, 4))
            for n, places, x in _stacked(b.column(len(group)).to_pylist(), times * size):
                drawn = x.astype(np.float64)[:, resamples(n, size, times, seed)]
                best, worst = drawn.max(2), drawn.min(2)
                out[places] = np.stack([best.mean(1), best.std(1), worst.mean(1), worst.std(1)], 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(out[:, i]) for i in range(4))], [*group, *names])

    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    rows = grouped_values(df.filter(F.col(value).isNotNull()), group, order, value).withColumnRenamed("v0", "x").select(*group, "x")
    return rows.mapInArrow(run, kinds + "".join(f", {n} double" for n in names))


def ladder(n: int) -> list[int]:
    """2, 4, 8, ... below ``n``, and ``n``; nothing for a single answer."""
    return [] if n < 2 else [*(2**k for k in range(1, n.bit_length()) if 2**k < n), n]


def _majority_values(votes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Value of the first of the most frequent votes along the last axis."""
    often = (votes[..., :, None] == votes[..., None, :]).sum(-1)
    return np.take_along_axis(values, often.argmax(-1)[..., None], -1)[..., 0]


def validation_metrics(df: DataFrame, source: str, prompt: str, order: str, value: str, vote: str | None = None, times: int = 1000, seed: int = 42) -> DataFrame:
    """``source``, ``metric``, ``value``: ``mean@n``, ``std@n`` (population) of each
    prompt's n answers, and of seeded resamples of 2, 4, .., n of them
    ``best@k/mean``, ``best@k/std``, ``worst@k/..`` and, with a ``vote`` column,
    ``maj@k/..`` (value of the most frequent vote, the first seen on a tie), all
    averaged over the prompts of a source.  Null values are left out."""
    ship(df.sparkSession)

    def reduced_draws(name: str, k: int, drawn: np.ndarray) -> list[tuple[str, np.ndarray]]:
        return [(f"{name}@{k}/mean", drawn.mean(1)), (f"{name}@{k}/std", drawn.std(1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = np.asarray(b.column(0).to_pylist(), object)
            values = b.column(1).to_pylist()
            codes = [[seen.setdefault(v, len(seen)) for v in row] for row in b.column(2).to_pylist() for seen in ({},)] if vote else None
            names, sources, found = [], [], []
            for n, places, x in _stacked(values, times * max(map(len, values), default=1) ** (2 if vote else 1)):
                x = x.astype(np.float64)
                rows = [(f"mean@{n}", x.mean(1)), (f"std@{n}", x.std(1))]
                for k in ladder(n):
                    at = resamples(n, k, times, seed)
                    drawn = x[:, at]
                    rows += reduced_draws("best", k, drawn.max(2)) + reduced_draws("worst", k, drawn.min(2))
                    if vote:
                        rows += reduced_draws("maj", k, _majority_values(np.array([codes[i] for i in places])[:, at], drawn))
                for name, v in rows:
                    names += [name] * len(places)
                    sources.append(where[places])
                    found.append(v)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sources).tolist(), b.column(0).type), pa.array(names), pa.array(np.concatenate(found))], [source, "metric", "value"])

    rows = grouped_values(df.filter(F.col(value).isNotNull()), [source, prompt], order, value, *([vote] if vote else [])).drop(prompt)
    each = rows.mapInArrow(run, f"`{source}` {df.schema[source].dataType.simpleString()}, metric string, value double")
    return each.groupBy(source, "metric").agg(F.avg("value").alias("value"))


def best_of_exact(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """Expected best of ``k`` draws with replacement, by order statistics."""
    w = W.partitionBy(*group)
    r = df.withColumn("r", F.row_number().over(w.orderBy(value))).withColumn("n", F.count(F.lit(1)).over(w))
    share = F.pow(F.col("r") / F.col("n"), F.lit(k)) - F.pow((F.col("r") - 1) / F.col("n"), F.lit(k))
    return r.groupBy(*group).agg(F.sum(F.col(value) * share).alias("best"))


def routed(source: Column, var: Column, metric: Column, n: Column, n_max: Column, core: Column) -> Column:
    """``val-core`` for the core variable's mean, majority, best and pass at the
    largest n, else ``val-aux``."""
    main = (var == core) & metric.rlike("^(mean|maj|best|pass)@") & (n == n_max)
    return F.concat_ws("/", F.when(main, "val-core").otherwise("val-aux"), source, var, metric)
