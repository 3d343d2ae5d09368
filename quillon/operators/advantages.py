"""Group-relative advantages, token recurrences and losses."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import ship

EPS = 1e-6
ESTIMATORS: dict[str, Callable] = {}


def estimator(name: str):
    """Register an estimator; another function under the same name is an error.
    Names are case-sensitive."""

    def add(f):
        if ESTIMATORS.setdefault(name, f) is not f:
            raise ValueError(f"estimator {name} is registered already")
        return f

    return add


#: Policy losses by name: (logp, old logp, advantages, mask) to the loss of each token.
POLICY_LOSSES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {}


def policy_loss(name: str):
    """Register a policy loss; another function under the same name is an error."""

    def add(f):
        if POLICY_LOSSES.setdefault(name, f) is not f:
            raise ValueError(f"policy loss {name} is registered already")
        return f

    return add


def policy_loss_of(name: str) -> Callable[[Column, Column, Column, Column], Column]:
    if name not in POLICY_LOSSES:
        raise ValueError(f"no policy loss is called {name}: {sorted(POLICY_LOSSES)}")
    return POLICY_LOSSES[name]


def _over(uid: str) -> W:
    return W.partitionBy(uid)


@estimator("grpo")
def grpo(score: str, uid: str, by_std: bool = True) -> Column:
    """(s - mean) / (std + eps) with the unbiased std; a group of one has mean 0
    and std 1."""
    w, s = _over(uid), F.col(score)
    n = F.count(F.lit(1)).over(w)
    mean, std = F.when(n == 1, 0.0).otherwise(F.avg(s).over(w)), F.when(n == 1, 1.0).otherwise(F.stddev_samp(s).over(w))
    return (s - mean) / (std + EPS) if by_std else s - mean


def grpo_passk(score: str, uid: str, order: str, by_std: bool = False) -> Column:
    """Only the best row (the first of equals) gets best minus second; groups of
    one are an error."""
    w, s = _over(uid), F.col(score)
    ranked = w.orderBy(F.desc(score), order)
    whole = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    gap = F.max(s).over(w) - F.nth_value(score, 2).over(whole)
    gap = gap / (F.stddev_samp(s).over(w) + EPS) if by_std else gap
    alone = F.count(F.lit(1)).over(w) < 2
    return F.when(alone, F.raise_error(F.lit("a group has one row")).cast("double")).when(F.row_number().over(ranked) == 1, gap).otherwise(0.0)


@estimator("rloo")
def rloo(score: str, uid: str) -> Column:
    w, s = _over(uid), F.col(score)
    n = F.count(F.lit(1)).over(w)
    return F.when(n == 1, s).otherwise((s - F.avg(s).over(w)) * n / (n - 1))


@estimator("opo")
def opo(score: str, uid: str, length: str = "len") -> Column:
    w, s, n = _over(uid), F.col(score), F.col(length)
    return F.when(F.count(F.lit(1)).over(w) == 1, s).otherwise(s - F.try_divide(F.sum(n * s).over(w), F.sum(n).over(w)))


@estimator("centred")
def centred(score: str, uid: str) -> Column:
    """s - mean, with mean 0 for a group of one."""
    w, s = _over(uid), F.col(score)
    return s - F.when(F.count(F.lit(1)).over(w) == 1, 0.0).otherwise(F.avg(s).over(w))


def gpg(df: DataFrame, score: str, uid: str, f_norm: float = 1.0) -> DataFrame:
    """``adv`` = rows / max(1, rows with a score) x (s - mean) / f_norm."""
    alpha = df.agg((F.count(F.lit(1)) / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("alpha"))
    return df.withColumn("centred", centred(score, uid)).crossJoin(F.broadcast(alpha)).withColumn("adv", F.col("alpha") * F.col("centred") / f_norm).drop("alpha", "centred")  # one row


def soft_mean(df: DataFrame, score: str, beta: float) -> DataFrame:
    """``baseline``: log-mean-exp over all rows, the plain mean at beta 0."""
    x = F.col(score)
    if beta == 0:
        return df.agg(F.avg(x).alias("baseline"))
    top = df.agg(F.max(beta * x).alias("top"))
    return df.crossJoin(F.broadcast(top)).agg(((F.first("top") + F.log(F.avg(F.exp(beta * x - F.col("top"))))) / beta).alias("baseline"))  # one row


#: Numbers of a block of rows that are scanned together.
SCANNED = 1 << 20


def _right_aligned(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, width - len(x) :] = x
    return out


def _scan(f: Callable[..., np.ndarray], columns: tuple) -> list:
    """``f`` of matrices of rows of like lengths, whose last places are in the last
    column; a row of which an array is null has none."""
    rows = list(zip(*columns, strict=True))
    out: list = [None] * len(rows)
    there = sorted((i for i, r in enumerate(rows) if all(x is not None for x in r)), key=lambda i: len(rows[i][0]))
    at = 0
    while at < len(there):
        to = at + 1
        while to < len(there) and (to - at + 1) * max(1, len(rows[there[to]][0])) <= SCANNED:
            to += 1
        block = there[at:to]
        width = len(rows[block[-1]][0])
        made = f(*(_right_aligned([rows[i][k] for i in block], width) for k in range(len(columns))))
        for i, x in zip(block, made, strict=True):
            out[i] = x[width - len(rows[i][0]) :]
        at = to
    return out


def scanned(f: Callable[..., np.ndarray], *columns: Column) -> Column:
    """An array of numbers for each row by a recurrence from its right end, in time
    linear in its length: rows of a batch are scanned together, place by place.  All
    arrays of a row are of one length and hold no null."""
    spark = SparkSession.getActiveSession()
    if spark:
        ship(spark)

    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series(_scan(f, parts), dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf((one, two, three)[len(columns) - 1], "array<double>")(*columns)


def reverse_cumsum(c: Column) -> Column:
    """Sum from each position to the end."""
    return scanned(lambda x: np.cumsum(x[:, ::-1], axis=1)[:, ::-1], c)


def masked(c: Column, mask: Column) -> Column:
    return F.zip_with(c, mask, lambda x, m: x * m)


def discounted(rewards: Column, mask: Column, gamma: float) -> Column:
    """Return scanned from the right, reset after a masked token."""

    def scan(r: np.ndarray, m: np.ndarray) -> np.ndarray:
        out, run = np.empty_like(r), np.zeros(len(r))
        for j in range(r.shape[1] - 1, -1, -1):
            out[:, j] = r[:, j] + gamma * run
            run = out[:, j] * m[:, j]
        return out

    return scanned(scan, rewards, mask)


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages that skip masked tokens."""

    def scan(r: np.ndarray, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        out, after, last = np.empty_like(r), np.zeros(len(r)), np.zeros(len(r))
        for j in range(r.shape[1] - 1, -1, -1):
            on = m[:, j] == 1
            last = np.where(on, r[:, j] + gamma * after - v[:, j] + gamma * lam * last, last)
            after = np.where(on, v[:, j], after)
            out[:, j] = last
        return out

    return scanned(scan, rewards, values, mask)


def whitened(df: DataFrame, column: str, mask: str) -> DataFrame:
    """``column`` minus the masked mean, over the root of the masked variance
    (Bessel's) + 1e-8, over all tokens of all rows.  A mask sum of 0 or 1 is an
    error."""
    flat = df.select(F.inline(F.arrays_zip(F.col(column).alias("x"), F.col(mask).alias("m"))))
    s = flat.agg(F.sum("m").alias("n"), F.sum(F.col("x") * F.col("m")).alias("sx"), F.sum(F.col("x") * F.col("x") * F.col("m")).alias("sxx"))
    s = s.withColumn("mean", F.col("sx") / (F.col("n") + 1e-8))
    var = (F.col("sxx") - 2 * F.col("mean") * F.col("sx") + F.col("mean") * F.col("mean") * F.col("n")) / (F.col("n") + 1e-8) * F.col("n") / (F.col("n") - 1)
    s = s.select("mean", F.when(F.col("n") <= 1, F.raise_error(F.lit("the mask sums to one at most")).cast("double")).otherwise(1 / F.sqrt(var + 1e-8)).alias("scale"))
    out = df.crossJoin(F.broadcast(s))  # one row
    return out.withColumn(column, F.transform(column, lambda x: (x - F.col("mean")) * F.col("scale"))).drop("mean", "scale")


def kl_token(a: Column, b: Column, kind: str) -> Column:
    """Divergence estimate of one token."""
    if kind in ("kl", "k1"):
        return a - b
    if kind == "abs":
        return F.abs(a - b)
    if kind in ("mse", "k2"):
        return 0.5 * (a - b) * (a - b)
    if kind in ("low_var_kl", "k3"):
        d = F.greatest(F.least(b - a, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(d) - d - 1, F.lit(10.0)), F.lit(-10.0))
    raise NotImplementedError(kind)


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """Per-token divergence estimate of two arrays."""
    return F.zip_with(logp, ref, lambda a, b: kl_token(a, b, kind))


def _loss(mode: str) -> Column:
    """The loss of rows ``t`` (sum of a sequence), ``n`` (its tokens), ``width``."""
    if mode == "token-mean":
        return F.sum("t") / (F.sum("n") + 1e-8)
    if mode == "seq-mean-token-sum":
        return F.try_divide(F.sum("t"), F.count(F.lit(1)))
    if mode == "seq-mean-token-mean":
        return F.avg(F.try_divide("t", "n"))
    if mode == "seq-mean-token-sum-norm":
        return F.sum("t") / F.max("width")
    raise ValueError(mode)


def agg_loss(df: DataFrame, loss: str, mask: str, mode: str) -> DataFrame:
    """``loss`` over all rows in one of four ways."""
    total, n = F.aggregate(masked(F.col(loss), F.col(mask)), F.lit(0.0), lambda a, x: a + x), F.aggregate(mask, F.lit(0.0), lambda a, x: a + x)
    rows = df.select(total.alias("t"), n.alias("n"), F.size(loss).alias("width"))
    return rows.agg(_loss(mode).alias("loss"))


#: Parts that the sequences of a loss are summed in.
PARTS = 4096


def agg_token_loss(tokens: DataFrame, sequence: list[str], place: str, length: str, loss: str, mask: str, modes: list[str], width: int) -> DataFrame:
    """``mode``, ``loss``: what ``agg_loss`` gives in each of the ways, from rows of
    tokens, in one pass and without a group for each sequence.  ``place`` is a token's
    in its sequence, from 0, ``length`` the sum of its sequence's mask, ``width`` the
    length of the arrays; the tokens of a sequence have a loss all or none."""
    t, first = F.col(loss) * F.col(mask), F.col(place) == 0
    share = F.try_divide(t, F.col(length))
    # sums of parts, as a running sum of all tokens would lose digits
    parts = tokens.groupBy(F.pmod(F.xxhash64(*sequence), F.lit(PARTS))).agg(F.sum(t).alias("t"), F.sum(mask).alias("n"), F.sum(share).alias("share"), F.count_if(first).alias("rows"), F.count_if(first & share.isNotNull()).alias("shared"))
    ways = {
        "token-mean": F.sum("t") / (F.sum("n") + 1e-8),
        "seq-mean-token-sum": F.try_divide(F.sum("t"), F.sum("rows")),
        "seq-mean-token-mean": F.try_divide(F.sum("share"), F.sum("shared")),
        "seq-mean-token-sum-norm": F.sum("t") / width,
    }
    made = parts.agg(*(ways[m].alias(m) for m in modes))
    return made.select(F.inline(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"`{m}`").alias("loss")) for m in modes))))


def ppo_loss(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Clipped policy loss per token; for negative advantages bounded by ``dual``."""

    def one(x: Column) -> Column:
        ratio = F.exp(F.greatest(F.least(x["a"] - x["b"], F.lit(20.0)), F.lit(-20.0)))
        plain = -x["adv"] * ratio
        clipped = F.greatest(plain, -x["adv"] * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low)))
        return F.when(x["adv"] < 0, F.least(-x["adv"] * dual, clipped)).otherwise(clipped)

    return F.transform(F.arrays_zip(logp.alias("a"), old.alias("b"), adv.alias("adv")), one)


@policy_loss("vanilla")
def vanilla_loss(logp: Column, old: Column, adv: Column, mask: Column) -> Column:
    return ppo_loss(logp, old, adv)


@policy_loss("gpg")
def gpg_loss(logp: Column, old: Column, adv: Column, mask: Column) -> Column:
    return F.zip_with(logp, adv, lambda x, v: -x * v)


@policy_loss("gspo")
def gspo_loss(logp: Column, old: Column, adv: Column, mask: Column, low: float = 3e-4, high: float = 4e-4) -> Column:
    """Clipped by the ratio of the whole sequence, the mean of its tokens' ratios."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    mean = total(masked(kl(logp, old, "k1"), mask)) / F.greatest(total(mask), F.lit(1.0))
    held = F.array(F.struct(F.exp(F.least(mean, F.lit(10.0))).alias("ratio")))
    token = lambda v, r: F.greatest(-v * r, -v * F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low)))
    return F.get(F.transform(held, lambda h: F.transform(adv, lambda v: token(v, h["ratio"]))), 0)


def value_loss_token(v: Column, o: Column, r: Column, clip: float) -> Column:
    c = F.greatest(F.least(v, o + clip), o - clip)
    return 0.5 * F.greatest((v - r) * (v - r), (c - r) * (c - r))


def value_loss(values: Column, old: Column, returns: Column, clip: float) -> Column:
    return F.transform(F.arrays_zip(values.alias("v"), old.alias("o"), returns.alias("r")), lambda x: value_loss_token(x["v"], x["o"], x["r"], clip))


def token_means(tokens: DataFrame, mask: str, **losses: Column) -> DataFrame:
    """Of each loss the mean over all tokens that are not masked, in one pass."""
    n = F.sum(mask) + 1e-8
    return tokens.agg(*((F.sum(x * F.col(mask)) / n).alias(k) for k, x in losses.items()))


def filter_groups(df: DataFrame, uid: str, value: str) -> DataFrame:
    """Rows of groups whose values differ, and groups of one."""
    w = _over(uid)
    keep = (F.max(value).over(w) != F.min(value).over(w)) | (F.count(F.lit(1)).over(w) == 1)
    return df.withColumn("_keep", keep).filter("_keep").drop("_keep")


def pair_preference(df: DataFrame, ord_col: str, score: str) -> DataFrame:
    """Rows 2i and 2i + 1 are a pair; ``chosen`` marks the better, the first of
    equals.  A row without its pair is an error."""
    w = W.partitionBy(F.floor(F.col(ord_col) / 2))
    lone = F.count(F.lit(1)).over(w) != 2
    first = F.row_number().over(w.orderBy(F.desc(score), ord_col)) == 1
    return df.withColumn("chosen", F.when(lone, F.raise_error(F.lit("a row has no pair")).cast("boolean")).otherwise(first))


def dpo_loss(chosen: Column, rejected: Column, beta: float, smoothing: float = 0.0, kind: str = "sigmoid") -> Column:
    """Loss of a pair from its two log-probability margins."""
    x = chosen - rejected
    if kind == "ipo":
        return (x - 1 / (2 * beta)) * (x - 1 / (2 * beta))
    log_sigmoid = lambda y: -F.log1p(F.exp(-y))
    return -log_sigmoid(beta * x) * (1 - smoothing) - log_sigmoid(-beta * x) * smoothing


def islands(order: W, value: Column) -> Column:
    """Number of the run of equal values that a row is in."""
    return F.sum(F.when(F.lag(value).over(order).eqNullSafe(value), 0).otherwise(1)).over(order)


def resample_weights(score: Column, method: str, power: float = 2.0, top=None, bottom=None) -> Column:
    if method == "pow":
        w = F.pow(F.abs(score), F.lit(power))
    elif method == "max_min":
        w = F.when((score == top) | (score == bottom), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(score == top, 0.4).otherwise(0.1)
    else:
        raise ValueError(method)
    return F.greatest(w, F.lit(1e-8))
