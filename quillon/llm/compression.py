"""Quality rules: counts of a text and its bands of compression.

Zstandard ratios (bytes / compressed bytes) are taken of the whole text and of
its fixed chunks.  Text that repeats itself compresses too well, random or
encoded text hardly at all, and how well prose compresses depends on its
length, so each class of lengths has its own limits.  Base64 and words of random
letters and digits are below them from 256 bytes on, hexadecimal digits, which
have half a byte of content each, from 8 KiB on only: shorter ones compress as
well as short prose does.  A text is rejected if its
own ratio is outside its band, or if the chunks outside theirs hold more than a
given share of the bytes of all measured chunks.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_batches, plain, slices

#: Fixed value: a word is a run of bytes that are no ASCII white space (bytes.split cuts at the same).
_SYMBOLS = re.compile(rb"[#*$%&|<>]")


@dataclass(frozen=True)
class Bands:
    """``limits``: (bytes from, least ratio, greatest ratio), ascending."""

    limits: tuple[tuple[int, float, float], ...] = ((0, 0.0, 3.0), (256, 1.25, 3.5), (384, 1.3, 3.5), (512, 1.35, 3.5), (1024, 1.5, 4.0), (2048, 1.7, 4.0), (4096, 1.9, 5.0), (8192, 2.0, 5.0), (16384, 2.1, 6.0))
    chunk_bytes: int = 4096
    least_chunk_bytes: int = 1024
    chunk_limits: tuple[float, float] = (1.5, 5.0)
    bad_chunk_share: float = 0.25
    level: int = 3

    def verdict(self, data: bytes, compress) -> tuple[float, float, bool]:
        """(ratio of the whole, share of bytes in chunks outside, passed)."""
        n = len(data)
        if not n:
            return 0.0, 0.0, True
        ratio = n / len(compress(data))
        least, most = next((a, b) for start, a, b in reversed(self.limits) if n >= start)
        bad = all_bytes = 0
        for i in range(0, n, self.chunk_bytes):
            size = min(self.chunk_bytes, n - i)
            if size >= self.least_chunk_bytes:
                all_bytes += size
                bad += size * (not self.chunk_limits[0] <= size / len(compress(data[i : i + size])) <= self.chunk_limits[1])
        share = bad / all_bytes if all_bytes else 0.0
        return ratio, share, least <= ratio <= most and share <= self.bad_chunk_share


def repeated_words(words: list[bytes]) -> int:
    """Words within three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(distinct := set(windows)) == n:
        return 0
    del distinct
    counts = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def duplicate_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


#: Longer texts are counted piece by piece, by numbers of words instead of words.
LONG_BYTES = 1 << 20
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def repeated_numbers(words: np.ndarray) -> int:
    """``repeated_words`` of words given as numbers, in about 40 bytes a word."""
    if len(words) < 4:
        return 0
    pair = words[:-1].astype(np.int64) << 32 | words[1:]
    pair = np.unique(pair, return_inverse=True)[1][:-1]
    window = pair.astype(np.int64) << 32 | words[2:]
    del pair
    order = np.sort(window)
    often = np.unique(order[1:][order[1:] == order[:-1]])
    again = np.isin(window, often)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


def long_counts(data: bytes, piece_bytes: int = LONG_BYTES) -> tuple[int, int, int, int, int]:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` of a long text: one piece of it and its distinct words and
    lines are in memory as objects."""
    number: dict[bytes, int] = {}
    found, chars, symbols, at = [], 0, 0, 0
    while at < len(data):
        cut = _SPACE.search(data, at + piece_bytes)
        piece = data[at : cut.start() if cut else len(data)]
        words = piece.split()
        chars += len(b"".join(words).decode())
        symbols += len(_SYMBOLS.findall(piece))
        found.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        at += len(piece)
    words = np.concatenate(found) if found else np.zeros(0, np.int32)
    seen: set[bytes] = set()
    lines = 0
    for line in io.BytesIO(data):
        if line.split(None, 1):
            lines += 1
            seen.add(line.removesuffix(b"\n"))
    return len(words), chars, symbols, lines - len(seen), repeated_numbers(words)


def measure(df: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words`` (long), ``ratio`` and
    ``bad_chunk_share`` (double), ``in_band`` (boolean).

    Words are runs of anything but ASCII white space.  Null texts count as
    empty: no words, ratio 0, in band.  Repeated rows are measured once each,
    further columns are left out, a text is a task's memory at most once."""
    bands = bands or Bands()

    def run(batches):
        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for whole in batches:
            for b in slices(whole, 1):
                rows = []
                for data in b.column(1).cast(pa.binary()).to_pylist():
                    data = data or b""
                    if len(data) > LONG_BYTES:
                        rows.append((*long_counts(data), *bands.verdict(data, compress)))
                        continue
                    words = data.split()
                    chars = len(b"".join(words).decode())
                    rows.append((len(words), chars, len(_SYMBOLS.findall(data)), duplicate_lines(data), repeated_words(words), *bands.verdict(data, compress)))
                cols = list(zip(*rows, strict=True))
                longs = [pa.array(np.array(c, np.int64)) for c in cols[:5]]
                yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array(cols[5], pa.float64()), pa.array(cols[6], pa.float64()), pa.array(cols[7], pa.bool_())], [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "bad_chunk_share", "in_band"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(plain(df, id_col, text_col), run, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunk_share double, in_band boolean")


def judged(docs: DataFrame, least_words: int = 50, most_repeated_percent: int = 50) -> DataFrame:
    """Base rules on the counts, then the bands of compression."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))
    return measure(docs).withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("in_band")).alias("kept"), "ratio", "bad_chunk_share"
    )
