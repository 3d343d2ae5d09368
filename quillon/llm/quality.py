"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins.  Boosting goes round the features, one at
a time: a shallow tree over the feature's bins, fitted to the gradients summed
by bin, is added to that feature's lookup table at a small rate.  Then the
pairs of features whose four-quadrant split takes most of what is left are
boosted in the same way into two-dimensional tables.  A score is the logistic
of the sum of table entries, found by bin for a whole batch at once.

Training uses a bounded sample, ``TRAIN_ROWS`` labelled rows with the smallest
hashes of their id, and happens on the driver over their features.  Scoring
covers all rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bytes_of, map_batches, plain, slices

#: The bound of the training sample.
TRAIN_ROWS = 20_000
FEATURES = ("log_bytes", "word_bytes", "upper", "symbols", "marks", "digits", "non_ascii", "distinct", "top_word", "dup_lines", "line_bytes", "repeats", "short_words", "ratio", "spaces", "other_words")
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "symbols": b"#*$%&|<>~^_=+\\@/{}[]",
    "marks": b"!?",
    "digits": b"0123456789",
    "spaces": b" \t\n\r\x0b\x0c",
    "high": bytes(range(128, 256)),
}
_INDEX = {k: np.frombuffer(v, np.uint8) for k, v in _CLASSES.items()}


def features(data: bytes, compress) -> tuple[float, ...]:
    """Of a whole text; an empty text has zeros."""
    n = len(data)
    if not n:
        return (0.0,) * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of = {k: int(counts[i].sum()) for k, i in _INDEX.items()}
    words = data.split()
    w = max(1, len(words))
    ink = max(1, n - of["spaces"])
    letters = max(1, of["upper"] + of["lower"] + of["high"])
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    return (
        float(np.log1p(n)),
        ink / w,
        of["upper"] / letters,
        of["symbols"] / ink,
        of["marks"] / ink,
        of["digits"] / ink,
        of["high"] / ink,
        float(np.log(len(seen) + 1) / np.log(w + 1)),
        max(seen.values(), default=0) / w,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        sum(map(eq, words, words[1:])) / w,
        sum([k for x, k in seen.items() if len(x) <= 3]) / w,
        n / len(compress(data)),
        of["spaces"] / n,
        sum([k for x, k in seen.items() if not x.isalpha() and x[0] < 128]) / w,
    )


def matrix(texts: list[bytes]) -> np.ndarray:
    compress = zstandard.ZstdCompressor(level=1).compress
    return np.array([features(t, compress) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Gam:
    """``cuts``: inner bin edges by feature; ``tables``: a table by feature;
    ``pairs``: (i, j, cuts of i, cuts of j, table)."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cut, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += t[np.searchsorted(cut, x[:, f], "right")]
        for i, j, a, b, t in self.pairs:
            total += t[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def edges(x: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` inner edges at quantiles, halfway between values."""
    values = np.unique(x)
    if len(values) < 2:
        return np.zeros(0)
    at = np.unique(np.searchsorted(values, np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])))
    at = at[(at > 0) & (at < len(values))]
    return np.unique((values[at - 1] + values[at]) / 2)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, smooth: float, least: float) -> np.ndarray:
    """Leaf values by bin of a tree over ordered bins.  ``g``, ``h``: gradients
    and curvatures summed by bin."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, left: int) -> None:
        gs, hs = g[a:b].sum(), h[a:b].sum()
        best, cut = 1e-9, 0
        if left and b - a > 1:
            cg, ch = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            gain = cg**2 / (ch + smooth) + (gs - cg) ** 2 / (hs - ch + smooth) - gs**2 / (hs + smooth)
            gain[(ch < least) | (hs - ch < least)] = 0
            k = int(np.argmax(gain))
            best, cut = (gain[k], a + k + 1) if gain[k] > best else (best, 0)
        if cut:
            grow(a, cut, left - 1)
            grow(cut, b, left - 1)
        else:
            out[a:b] = gs / (hs + smooth)

    grow(0, len(g), depth)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """The best cut of both axes: (gain, value of each cell)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c):
        a = c[:-1, :-1]
        return a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a

    pg, ph = parts(cg), parts(ch)
    gain = sum(x**2 / (y + smooth) for x, y in zip(pg, ph, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + smooth)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [x[i, j] / (y[i, j] + smooth) for x, y in zip(pg, ph, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 12, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1, depth: int = 2, smooth: float = 1.0, least: float = 1.0) -> Gam:
    """Fit to labels ``y`` (0 or 1).  One label only, or no rows, gives a
    constant score."""
    mean = (y.sum() + 1) / (len(y) + 2)
    cuts = [edges(x[:, f], bins) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = Gam(cuts, [np.zeros(len(c) + 1) for c in cuts], [], float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    raw = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, c in enumerate(cuts):
            if len(c):
                g, h = slopes()
                n = len(c) + 1
                step = rate * shallow_tree(np.bincount(at[f], g, n), np.bincount(at[f], h, n), depth, smooth, least)
                model.tables[f] += step
                raw += step[at[f]]
    coarse = [edges(x[:, f], pair_bins) for f in range(x.shape[1])]
    bin_of = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]

    def sums(i, j):
        g, h = slopes()
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = bin_of[i] * shape[1] + bin_of[j]
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    usable = [f for f, c in enumerate(coarse) if len(c)]
    gains = sorted(((quadrants(*sums(i, j)[1:], smooth)[0], i, j) for i, j in combinations(usable, 2)), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, _a, _b, t in model.pairs:
            cell, g, h = sums(i, j)
            step = rate * quadrants(g, h, smooth)[1]
            t += step
            raw += step.ravel()[cell]
    return model


def held_out(id_col: str):
    """Rows that no label may be learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def feature_rows(df: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """``keep`` (an int column) and the features, as one array."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                x = matrix(bytes_of(b.column(1)))
                ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["id", keep, "x"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(plain(df, id_col, text_col, keep), run, f"id {kind}, {keep} int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Gam:
    """Train on at most ``train_rows`` labelled documents that are not held out,
    those with the smallest hashes of their id.  Null ids and labels are left
    out; an id with several labels counts with the smallest, and one with several
    rows with the smallest features, so no more than ``train_rows`` rows of
    features come to the driver."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = feature_rows(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "doc_id", "text", "quality")  # the sample is bounded
    rows = rows.groupBy("id", "quality").agg(F.min("x").alias("x"))
    got = rows.toPandas().sort_values(["id", "x"], key=lambda c: c.map(tuple) if c.name == "x" else c) if train_rows else None
    if got is None or got.empty:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    return train(np.array(got["x"].tolist()), got["quality"].to_numpy(np.float64))


def scored(df: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """``id_col``, the columns of ``keep`` and ``score_col`` for each row.  Null
    texts are scored as empty; repeated rows have equal scores."""
    held = df.sparkSession.sparkContext.broadcast(model)  # bins by features, some KB
    names = list(dict.fromkeys([id_col, text_col, *keep]))

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                score = held.value.score(matrix(bytes_of(b.column(1))))
                cols = [c for n, c in zip(names, b.columns, strict=True) if n != text_col or n in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score)], [*kept, score_col])

    kept = [n for n in names if n != text_col or n in keep]
    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in kept)
    return map_batches(plain(df, *names), run, schema + f", `{score_col}` double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and class of every document."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
