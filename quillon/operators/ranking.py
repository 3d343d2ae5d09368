"""Similarity search, ranked lists and their metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import materialised, ship

#: Rows of a block, and of its queries that are multiplied with a block at once.
BLOCK_ROWS, AT_ONCE = 4096, 512
MOST_PIVOTS = 1024
#: Tasks that share out the blocks, at most, unless one had more than half of the blocks
#: of queries that a task holds the best rows of at once.
TASKS, HELD = 400, 16


def unit(c: Column) -> Column:
    """L2-normalised vector, in double precision."""
    v = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # the outer lambda holds the norm, which is not computed anew for each number
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.try_divide(x, n))), 0)


BLOCK = "block long, ids array<{kind}>, flat array<double>, center array<double>, radius double"


def _vectors(column: pa.Array) -> np.ndarray:
    """A matrix of the vectors of a list column."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def blocks(df: DataFrame, id_col: str, vec_col: str, rows: int, what: str = "vector-blocks", bounded: bool = True) -> tuple[DataFrame, bool]:
    """(the blocks, whether there is one at most): ``block``, ``ids``, ``flat`` (their
    vectors, one after the other), ``center`` and ``radius`` (the greatest distance
    from it; a single block has neither unless ``bounded``), a row for each block of
    about ``rows`` vectors that are near each other.  Vectors go to the nearest of at
    most ``MOST_PIVOTS`` drawn ones, and a pivot with many is cut by hash."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    x = df.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda v: v.cast("double")).alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    parts = max(1, -(-x.count() // rows))

    def grouped(rows: DataFrame) -> DataFrame:
        made = rows.repartition(min(parts, TASKS), "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("x"))
        return made.select("block", F.col("x.id").alias("ids"), F.flatten("x.v").alias("flat"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centers, radii = [], []
            for i in range(b.num_rows):
                m = b.column(2)[i].values.to_numpy(zero_copy_only=False).reshape(len(b.column(1)[i]), -1)
                centers.append(m.mean(0))
                radii.append(float(np.sqrt(((m - centers[-1]) ** 2).sum(1).max())))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tolist() for c in centers], pa.list_(pa.float64())), pa.array(radii, pa.float64())], ["block", "ids", "flat", "center", "radius"])

    if parts == 1:
        whole = grouped(x.withColumn("block", F.lit(0).cast("long")))
        return (materialised(spark, whole.mapInArrow(described, BLOCK.format(kind=kind)), what) if bounded else whole), True
    drawn = x.orderBy(F.xxhash64("id"), "id").limit(min(parts, MOST_PIVOTS)).select("v").toArrow().column("v").combine_chunks()
    held = spark.sparkContext.broadcast(_vectors(drawn))  # at most MOST_PIVOTS vectors

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = held.value
            near = np.argmax(_vectors(b.column(1)) @ p.T - (p * p).sum(1) / 2, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], ["id", "v", "pivot"])

    near = x.mapInArrow(assigned, f"id {kind}, v array<double>, pivot long")
    sizes = dict(near.groupBy("pivot").count().collect())  # at most MOST_PIVOTS numbers
    cut = F.get(F.array(*(F.lit(-(-sizes.get(i, 1) // rows)) for i in range(max(sizes) + 1))), F.col("pivot").cast("int"))
    near = near.withColumn("block", F.col("pivot") * (1 << 32) + F.pmod(F.xxhash64("id"), cut))

    return materialised(spark, grouped(near).mapInArrow(described, BLOCK.format(kind=kind)), what), False


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)


def _ball(side: str) -> tuple[Column, ...]:
    """Center, its length and the radius of a block of a side, named after it."""
    return F.col("center").alias(f"{side}c"), F.sqrt(_dot(F.col("center"), F.col("center"))).alias(f"{side}s"), F.col("radius").alias(f"{side}r")


def _bound() -> Column:
    return _dot(F.col("qc"), F.col("cc")) + F.col("qs") * F.col("cr") + F.col("cs") * F.col("qr") + F.col("qr") * F.col("cr")


def bounds(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``q``, ``c``, ``bound``: for each block of queries and of the corpus no less
    than the product of any two of their vectors, by Cauchy and Schwarz."""
    left, right = queries.select(F.col("block").alias("q"), *_ball("q")), corpus.select(F.col("block").alias("c"), *_ball("c"))
    return left.crossJoin(right).select("q", "c", _bound().alias("bound"))  # a row for each two blocks, without their vectors


def inner_topk(queries: DataFrame, corpus: DataFrame, k: int, id_col: str, vec_col: str, skip_self: bool, first: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id_col``, ``rank`` (1..k), ``item_id``, ``similarity``: for each query
    the corpus rows of ranks ``first`` to ``first + k - 1`` by inner product, ties
    by id.  Rows without a vector are left out.

    Vectors are in blocks of near ones.  Each block of queries first meets the block
    of the corpus that may be best; what it finds is a score that the last of the
    wanted ranks reaches at least, and of all other blocks only those whose bound is
    not below that are met.  A task has a block of queries, or a few, and the blocks of
    the corpus stream past them from where they are stored: no block is shuffled to meet
    another.  Of all that a block of queries meets the best of each query go on once, as
    often as there are vectors and no more; only where there are fewer blocks of queries
    than cores the corpus is dealt out, to as many tasks as there are cores.  A window merges
    what was kept.  The result is exact, and no vectors pass through the driver but the
    drawn pivots."""
    spark = queries.sparkSession
    ship(spark)
    keep = first + k - 1
    kind = queries.schema[id_col].dataType.simpleString()

    def better(own: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, held: tuple | None) -> tuple:
        """Rows, ids and scores of the best of each query, and the score that others
        must reach, of a block and those ``held`` so far."""
        scores = q @ c.T
        if not np.isfinite(scores.sum()):
            scores[~np.isfinite(scores)] = -np.inf
        if skip_self:
            near = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            hit = ids[near] == own
            scores[np.flatnonzero(hit), near[hit]] = -np.inf
        least = np.full(len(own), -np.inf) if held is None else held[3]
        if len(ids) > keep and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep])
        row, col = np.divmod(np.flatnonzero((scores >= least[:, None]) & (scores > -np.inf) if np.isneginf(least).any() else scores >= least[:, None]), len(ids))
        found, best = ids[col], scores[row, col]
        if held is not None:
            row, found, best = np.concatenate([held[0], row]), np.concatenate([held[1], found]), np.concatenate([held[2], best])
        number = np.unique(found, return_inverse=True)[1] if found.dtype == object else found
        order = np.lexsort((number, -best, row))
        row, found, best = row[order], found[order], best[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == keep - 1
        least = np.full(len(own), -np.inf)
        least[row[last]] = best[last]
        top = rank < keep
        return row[top], found[top], best[top], least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``q``, ``q_ids``, ``q_flat``, ``c_ids``, ``c_flat``; blocks of queries may take turns."""
        turns: dict[int, tuple] = {}

        def kept(block: int) -> pa.RecordBatch:
            own, _, held = turns.pop(block)
            row = np.concatenate([h[0] + i * AT_ONCE for i, h in enumerate(held)])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), block)), pa.array(own[row]), pa.array(np.concatenate([h[1] for h in held])), pa.array(np.concatenate([h[2] for h in held]))], ["q", id_col, "item_id", "similarity"])

        for b in batches:
            for at in range(b.num_rows):
                block = b.column(0)[at].as_py()
                if block not in turns:
                    if len(turns) == HELD:
                        yield kept(next(iter(turns)))
                    own, x = (b.column(i)[at].values.to_numpy(zero_copy_only=False).copy() for i in (1, 2))
                    turns[block] = own, x.reshape(len(own), -1), [None] * -(-len(own) // AT_ONCE)
                own, x, held = turns[block]
                ids, flat = (b.column(i)[at].values.to_numpy(zero_copy_only=False) for i in (3, 4))
                for i in range(len(held)):
                    part = slice(i * AT_ONCE, (i + 1) * AT_ONCE)
                    held[i] = better(own[part], x[part], ids, flat.reshape(len(ids), -1), held[i])
        for block in [*turns]:
            yield kept(block)

    right, only = blocks(corpus, id_col, vec_col, block_rows, bounded=False)
    left, one = (right, only) if queries is corpus else blocks(queries, id_col, vec_col, block_rows, bounded=not only)
    if only and not one:
        right, _ = blocks(corpus, id_col, vec_col, block_rows)

    own = left.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), *(() if one and only else _ball("q")))
    others = right.select(F.col("block").alias("c"), F.col("ids").alias("c_ids"), F.col("flat").alias("c_flat"), *(() if one and only else _ball("c")))

    def met(pairs: DataFrame) -> DataFrame:
        return pairs.select("q", "q_ids", "q_flat", "c_ids", "c_flat").mapInArrow(run, f"q long, `{id_col}` {kind}, item_id {kind}, similarity double")

    at = W.partitionBy(id_col).orderBy(F.desc("similarity"), "item_id")

    def ranked(parts: DataFrame) -> DataFrame:
        kept = parts.withColumn("rank", F.row_number().over(at)).filter(F.col("rank").between(first, keep))
        return kept.select(id_col, (F.col("rank") - (first - 1)).alias("rank"), "item_id", "similarity")

    if one and only:  # a single block each: there is nothing to choose
        return ranked(met(own.crossJoin(others)))
    best = materialised(spark, bounds(left, right).groupBy("q").agg(F.max_by("c", F.struct("bound", "c")).alias("best")), "vector-bounds")
    parts = materialised(spark, met(own.join(best, "q").join(others, F.col("c") == F.col("best"))), "vector-parts")
    reached = parts.groupBy("q", id_col).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))
    asked = left.select(F.col("block").alias("q"), F.size("ids").alias("asked"))
    least = reached.groupBy("q").agg(F.count_if(F.col("n") >= keep).alias("full"), F.min("least").alias("least")).join(asked, "q", "right")
    least = least.select("q", F.when(F.coalesce("full", F.lit(0)) == F.col("asked"), F.col("least")).alias("least")).join(best, "q")
    # a row for each block of queries, without its vectors
    n = left.count()
    asking = own.join(F.broadcast(least), "q").repartitionByRange(max(min(n, TASKS), -(-n * 2 // HELD), 1), "q")
    open_pair = (F.col("c") != F.col("best")) & (F.col("least").isNull() | (_bound() >= F.col("least") - 1e-9))
    # the left side streams and the right one is held: a task holds its blocks of queries
    stored = others.coalesce(max(1, spark.sparkContext.defaultParallelism // max(n, 1))).hint("shuffle_replicate_nl")
    return ranked(parts.unionByName(met(stored.join(asking, open_pair))))


def cosine_topk(df: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", skip_best: bool = True) -> DataFrame:
    """Neighbours by cosine, the row itself excluded.  With ``skip_best`` the
    best one is dropped too, so ranks 2 to k + 1 are returned as 1 to k."""
    v = df.select(id_col, unit(F.col(vec_col)).alias(vec_col))
    return inner_topk(v, v, k, id_col, vec_col, True, 2 if skip_best else 1)


def ranked_lists(top: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return top.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("x")).select(id_col, F.col("x.item_id").alias("ranked"))


def hit_rank(ranked: Column, truth: Column) -> Column:
    """1-based position of the truth, 0 if it is missing."""
    return F.coalesce(F.array_position(ranked, truth), F.lit(0))


def recall_at(rank: Column, k: int) -> Column:
    return F.avg(((rank > 0) & (rank <= k)).cast("double"))


def hit_at(rank: Column, k: int) -> Column:
    return F.avg(F.when((rank > 0) & (rank <= k), 1.0).otherwise(0.0))


def ndcg_at(ranked: Column, truth: Column, k: int) -> Column:
    """Binary relevance with an ideal gain of one; a repeated truth gains again."""
    gains = F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(x == truth, 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    return F.avg(F.aggregate(gains, F.lit(0.0), lambda a, x: a + x))


METRICS = {"hit": lambda ranked, truth, k: hit_at(hit_rank(ranked, truth), k), "ndcg": ndcg_at, "recall": lambda ranked, truth, k: recall_at(hit_rank(ranked, truth), k)}


def metric(name: str, ranked: Column, truth: Column) -> Column:
    """Dispatch of ``hit@k``, ``ndcg@k`` and ``recall@k``."""
    kind, _, k = name.partition("@")
    if kind not in METRICS or not k.isdigit():
        raise NotImplementedError(name)
    return METRICS[kind](ranked, truth, int(k))


def hit_positions(df: DataFrame, rank: str) -> DataFrame:
    """Counts and statistics of where the truth was found; statistics of ranks
    are null if it never was."""
    r = F.when(F.col(rank) > 0, F.col(rank))
    hits = F.count(r)
    return df.agg(
        hits.alias("hits"), (F.count(F.lit(1)) - hits).alias("misses"), (hits / F.count(F.lit(1))).alias("hit_rate"), F.avg(r).alias("mean_rank"), F.median(r).alias("median_rank"),
        F.min(r).alias("min_rank"), F.max(r).alias("max_rank"), *(F.count_if(r <= k).alias(f"hit_at_{k}") for k in (1, 5, 10)),
    )
