"""Batch algebra: row-ordered frames with an explicit ordinal column."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Columns by name, or all."""
    return df if names is None else df.select(names)


def pop(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest).  A missing name is an error."""
    if missing := set(names) - set(df.columns):
        raise KeyError(sorted(missing))
    return df.select(names), df.drop(*names)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def select_idxs(df: DataFrame, ord_col: str, idxs: list[int]) -> DataFrame:
    """Rows by index list, with ``pos``, their place in the list; an index may
    come up more than once.  The list is the caller's literal."""
    want = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(idxs)], f"`{ord_col}` long, pos long")
    return df.join(F.broadcast(want), ord_col)


def sliced(df: DataFrame, ord_col: str, start: int | None, stop: int | None, step: int, total: int) -> DataFrame:
    """Python's slice over the ordinal."""
    a, b, s = slice(start, stop, step).indices(total)
    at = F.col(ord_col)
    if s > 0:
        return df.filter((at >= a) & (at < b) & ((at - a) % s == 0))
    return df.filter((at <= a) & (at > b) & ((a - at) % -s == 0))


def union_columns(a: DataFrame, b: DataFrame, ord_col: str) -> DataFrame:
    """Columns of both, row by row.  Columns of one name must be equal, with null
    equal to null and NaN to NaN; else it is an error when the rows are read."""
    both = [c for c in b.columns if c in a.columns and c != ord_col]
    right = b.withColumnsRenamed({c: f"_r_{c}" for c in both})
    out = a.join(right, ord_col)
    for c in both:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType))).drop(f"_r_{c}")
    return out


def repeat(df: DataFrame, ord_col: str, n: int, interleave: bool = True) -> DataFrame:
    """Each row ``n`` times, with ``pos``: aabb if interleaved, else abab."""
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return out.withColumn("pos", F.col(ord_col) * n + F.col("rep"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return out.crossJoin(F.broadcast(total)).withColumn("pos", F.col("rep") * F.col("total") + F.col(ord_col)).drop("total")  # one row


def repeat_by(df: DataFrame, count: Column) -> DataFrame:
    """Each row as often as its count says."""
    return df.withColumn("rep", F.explode(F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count)))


def pad_to(df: DataFrame, ord_col: str, divisor: int, total: int) -> DataFrame:
    """Rows cycled from the start until the count is divisible; ``is_pad``."""
    need = -total % divisor
    times = -(-need // total) if total else 0
    extra = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max(times, 1))))).withColumn(ord_col, F.col(ord_col) + F.col("k") * total).filter(F.col(ord_col) < total + need).drop("k")
    return df.withColumn("is_pad", F.lit(False)).unionByName(extra.withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def chunk(ord_col: str, k: int, total: int) -> Column:
    """Which of ``k`` equal chunks a row is in."""
    if total % k:
        raise ValueError(f"{total} rows do not divide into {k} chunks")
    return F.floor(F.col(ord_col) / (total // k))


def split_size(ord_col: str, size: int) -> Column:
    return F.floor(F.col(ord_col) / size)


def shard(ord_col: str, workers: int, total: int) -> Column:
    """Contiguous shares, the remainder to the last."""
    return F.least(F.floor(F.col(ord_col) / max(1, total // workers)), F.lit(workers - 1))


def fold(df: DataFrame, ord_col: str, size: int, value: str) -> DataFrame:
    """Blocks of ``size`` rows as arrays."""
    x = df.groupBy(F.floor(F.col(ord_col) / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct(ord_col, value))).alias("x"))
    return x.select("block", F.col(f"x.{value}").alias(value))


def unfold(df: DataFrame, size: int, value: str) -> DataFrame:
    return df.select((F.col("block") * size).alias("base"), F.posexplode(value).alias("i", value)).select((F.col("base") + F.col("i")).alias("ord"), value)


#: Rows that one task sorts, about; and places at which a column is cut, at most.
PART_ROWS, MOST_PARTS = 1_000_000, 4096


def _cuts(df: DataFrame, by: str, parts: int) -> list[float]:
    return sorted(set(df.approxQuantile(by, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []


#: Cuts that are compared one by one; of more, first every such one.
STRIDE = 64


def _passed(cuts: list[float], holds: Callable[[Column], Column]) -> Column:
    """How many cuts a value has passed; ``holds`` is true for the first ones only."""
    at = F.array(*(F.lit(float(c)) for c in cuts))
    if len(cuts) <= STRIDE:
        return F.size(F.filter(at, holds))
    whole = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts[STRIDE - 1 :: STRIDE])), holds)) * STRIDE
    return whole + F.size(F.filter(F.slice(at, whole + 1, F.lit(STRIDE)), holds))


def _place(by: str, cuts: list[float]) -> Column:
    """2 i between the cuts, 2 i + 1 at a cut; -1 for null."""
    x = F.col(by)
    below = _passed(cuts, lambda c: c < x) + _passed(cuts, lambda c: c <= x) if cuts else F.lit(0)
    return F.when(x.isNull(), -1).otherwise(below)


def numbered(df: DataFrame, by: str, *ties: str, name: str = "ord", part_rows: int = PART_ROWS) -> DataFrame:
    """``name``: the 0-based place of each row by a numeric column (nulls first),
    then ``ties``.  Rows are cut at quantiles of ``by``, as many as the rows need; a
    value that many rows share is a part of its own, and is cut again at quantiles
    of the first tie, if that is numeric.  Rows are numbered within each part and
    the parts' counts are added up; no task has to sort them all."""
    spark, numeric = df.sparkSession, T.NumericType
    parts = min(MOST_PARTS, max(1, -(-df.count() // part_rows)))
    cut = df.withColumn("_part", _place(by, _cuts(df, by, parts))).withColumn("_sub", F.lit(0))
    counts = {(r._part, 0): r["count"] for r in cut.groupBy("_part").count().collect()}  # at most 2 MOST_PARTS numbers
    if ties and isinstance(df.schema[ties[0]].dataType, numeric):
        for part in sorted(k for (k, _), n in counts.items() if n > 4 * part_rows and (k % 2 or k < 0)):
            cuts = _cuts(cut.filter(F.col("_part") == part), ties[0], min(MOST_PARTS, -(-counts[part, 0] // part_rows)))
            cut = cut.withColumn("_sub", F.when(F.col("_part") == part, _place(ties[0], cuts)).otherwise(F.col("_sub")))
        if len(counts) and any(n > 4 * part_rows for n in counts.values()):
            counts = {(r._part, r._sub): r["count"] for r in cut.groupBy("_part", "_sub").count().collect()}
    base, total = [], 0
    for part, sub in sorted(counts):
        base.append((part, sub, total))
        total += counts[part, sub]
    before = F.broadcast(spark.createDataFrame(base, "_part int, _sub int, _base long"))  # as many as there are parts
    at = F.row_number().over(W.partitionBy("_part", "_sub").orderBy(by, *ties))
    placed = cut.withColumn("_at", at).join(before, ["_part", "_sub"])
    return placed.withColumn(name, F.col("_at") - 1 + F.col("_base")).drop("_part", "_sub", "_at", "_base")


#: How far an approximate quantile may be off, as a share of the rows.
QUANTILE_ERROR = 0.001


def marked_first(df: DataFrame, by: str, *ties: str, n: int, name: str = "first") -> DataFrame:
    """``name``: whether a row is among the first ``n`` by a numeric column, then
    ``ties``; null comes last.  Two quantiles around the ``n``-th row tell nearly all
    rows apart, and only those between them are numbered, so no task sorts ``n`` rows
    however many that are."""
    total = df.filter(F.col(by).isNotNull()).count()
    if n >= total or n <= 0:
        return df.withColumn(name, F.col(by).isNotNull() & F.lit(n > 0))
    share = [max(0.0, n / total - 2 * QUANTILE_ERROR), min(1.0, n / total + 2 * QUANTILE_ERROR)]
    low, high = df.approxQuantile(by, share, QUANTILE_ERROR)
    below, upto = df.agg(F.count_if(F.col(by) < low), F.count_if(F.col(by) <= high)).first()
    if below > n:
        low, below = -math.inf, 0
    if upto < n:
        high = math.inf
    between = numbered(df.filter((F.col(by) >= low) & (F.col(by) <= high)), by, *ties, name=name)
    out = between.withColumn(name, F.col(name) < n - below)
    rest = df.filter(~F.coalesce((F.col(by) >= low) & (F.col(by) <= high), F.lit(False)))
    return out.unionByName(rest.withColumn(name, F.coalesce(F.col(by) < low, F.lit(False))))


def seeded(seed: int, *keys: str | Column) -> Column:
    """A number below 2**52 that hangs on the seed and the keys only: an order that
    it gives is a shuffle that can be repeated anywhere."""
    text = F.concat_ws(":", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.left(F.md5(text), F.lit(13)), 16, 10).cast("long")


def uniform(seed: int, *keys: str | Column) -> Column:
    """In (0, 1), of ``seeded``."""
    return (seeded(seed, *keys) + 0.5) / float(1 << 52)


def sampled_order(df: DataFrame, key: str, kind: str = "shuffle", seed: int = 42, difficulty: str | None = None, name: str = "place") -> DataFrame:
    """The order in which a sampler gives out rows: ``sequential`` by ``key``,
    ``shuffle`` by a seeded draw, ``curriculum`` by ``difficulty``."""
    if kind == "sequential":
        return numbered(df, key, name=name)
    if kind == "curriculum" and difficulty:
        return numbered(df, difficulty, key, name=name)
    if kind != "shuffle":
        raise ValueError(kind)
    return numbered(df.withColumn("_draw", seeded(seed, key)), "_draw", key, name=name).drop("_draw")


def first_or_drawn(df: DataFrame, key: str, n: int, seed: int | None = None) -> DataFrame:
    """The first ``n`` rows by ``key``, or with a seed ``n`` drawn without
    replacement."""
    return df.orderBy(*([] if seed is None else [seeded(seed, key)]), key).limit(n)


def select_mask(df: DataFrame, mask: Column) -> DataFrame:
    """Rows for which a boolean mask holds, in their order; null does not hold."""
    return df.filter(F.coalesce(mask, F.lit(False)))


def drawn(df: DataFrame, weight: str, key: str, seed: int = 42, buckets: int = 64) -> DataFrame:
    """As many draws as rows, with replacement and by weight: ``times``, how often
    each row is drawn.  One seeded number for each row falls on the share of one
    row.  Shares lie one after the other by bucket of ``key`` and by ``key``; a draw
    is looked up in its bucket only.  ``key``: a unique long.

    Where a share begins is a sum of all weights before it.  They are added as whole
    numbers of a small unit, and what is less than one beside them, so no sum is
    rounded before the end, whatever the order of rows."""
    x = df.withColumn("_b", F.pmod(F.col(key), F.lit(buckets)))
    # a power of two, by which the sum of all weights is below 2**62
    unit = df.agg(F.pow(F.lit(2.0), 60 - F.ceil(F.log2(F.sum(weight)))).alias("_unit"))
    x = x.crossJoin(F.broadcast(unit)).withColumn("_n", F.floor(F.col(weight) * F.col("_unit")).cast("long")).withColumn("_r", F.col(weight) - F.col("_n") / F.col("_unit"))  # one row
    share = x.groupBy("_b").agg(F.sum("_n").alias("_bn"), F.sum("_r").alias("_br"), F.first("_unit").alias("_unit"))
    upto = W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row a bucket
    share = share.withColumns({"_bn": F.sum("_bn").over(upto) - F.col("_bn"), "_br": F.sum("_br").over(upto) - F.col("_br"), "_end": F.sum("_bn").over(upto) / F.col("_unit") + F.sum("_br").over(upto)})
    share = share.withColumn("before", F.col("_bn") / F.col("_unit") + F.col("_br"))
    share = share.withColumn("after", F.lead("before").over(W.orderBy("_b")))
    total = share.agg(F.max("_end").alias("total"))
    inside = W.partitionBy("_b").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    low = (F.col("_bn") + F.sum("_n").over(inside) - F.col("_n")) / F.col("_unit") + (F.col("_br") + (F.sum("_r").over(inside) - F.col("_r")))
    spans = x.join(F.broadcast(share.select("_b", "_bn", "_br")), "_b").withColumn("_lo", low)
    u = df.select(uniform(seed, key).alias("u")).crossJoin(F.broadcast(total)).select((F.col("u") * F.col("total")).alias("_at"))  # one row
    dealt = u.join(F.broadcast(share.select("_b", "before", "after")), (F.col("_at") >= F.col("before")) & (F.col("after").isNull() | (F.col("_at") < F.col("after")))).select("_b", "_at")
    # both sides of a bucket in one order: a draw belongs to the share that began last
    none = F.lit(None).cast(df.schema[key].dataType)
    mixed = dealt.select("_b", "_at", F.lit(1).alias("_draw"), none.alias(key)).unionByName(spans.select("_b", F.col("_lo").alias("_at"), F.lit(0).alias("_draw"), key))
    hit = mixed.withColumn(key, F.last(key, True).over(W.partitionBy("_b").orderBy("_at", "_draw", key))).filter("_draw = 1")
    times = hit.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    return df.join(times, key, "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))


def restore(df: DataFrame, pos: str) -> DataFrame:
    """Inverse permutation: ``back`` says where each place went."""
    return numbered(df, pos, name="back")


def concat(*parts: DataFrame) -> DataFrame:
    """Rows of all, with ``part``, the ordinal of the frame."""
    out = None
    for i, x in enumerate(parts):
        x = x.withColumn("part", F.lit(i))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out
