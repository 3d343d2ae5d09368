"""Removal of long repeated byte strings, as suffix arrays do it, by run-length
indexes.

A window is a string of ``length`` bytes within a text; each byte of a window that
also starts anywhere else goes.

1. Seeds.  The seed of a window is the string of ``length * 8 // 25`` bytes in it with
   the least hash, the leftmost of several.  Equal windows have equal seeds at equal
   places, so only windows of one seed need to meet.  Neighbours that share a seed
   are one stretch, about 70 windows; it is kept as two hashes, of its seed and of
   all its bytes, with its place.
2. What is settled by hashes: a stretch whose bytes are there once more is repeated
   as a whole, one whose seed is nowhere else is not repeated at all.
3. Run-length indexes.  Of seeds with different stretches one of each is read again,
   and stretches meet by seed.  Those of many seeds are one collection, of which the
   Burrows-Wheeler transform is built and kept as runs, with the suffix sampled at
   both ends of each run.  All stretches are streamed through it from their ends: the
   step to the byte before is a step within a run, where the longest match with
   either neighbour grows by one, or comes from a run's end, where the sample tells
   with which suffix to compare anew.  Where a match reaches ``length``, the window is
   there twice.
4. A seed with more than ``MOST`` different stretches, as a passage that a large part
   of all texts have has, does not fit one index.  There the common part that windows
   meet by is widened from the seed to the whole window: equal windows are counted by
   hash, added up before they are shuffled.
5. The places found are gathered by text, merged, and cut out.

Texts that occur more than once are known by hash and length of all rows; one row
stands for them, and they are repeated as a whole.  Equality is that of 64-bit hashes
(of stretches together with that of the seed).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bytes_of, map_batches, plain, slices
from quillon.llm.signature_tree import _BYTE, _powers, mix
from quillon.session import materialised, scope

LENGTH, MOST = 200, 4096
#: Windows that are hashed at once, bytes of texts that an index holds, and rows that are given out at once.
AT_ONCE, INDEX_BYTES, ROWS = 1 << 20, 1 << 20, 200_000
_STRETCH = np.dtype([("seed", "<i8"), ("all", "<i8"), ("start", "<u4"), ("more", "u1"), ("times", "u1")])
_RANGE = np.dtype([("lo", "<u4"), ("hi", "<u4")])


def seeds(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash of the seed) of the stretches of texts that
    lie one after the other in ``data``."""
    size = length * 8 // 25
    width = length - size + 1
    a = np.frombuffer(data, np.uint8)
    first, place, hashes = [], [], []
    for at in range(0, max(0, len(a) - length + 1), AT_ONCE):
        part = a[at : at + AT_ONCE + length - 1]
        up, down = _powers(len(part))
        with np.errstate(over="ignore"):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)])))
            h = mix((run[size:] - run[:-size]) * down[: len(part) - size + 1])
        bits = np.uint64(21)
        value = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        # least of each ``width`` values: of the rest of one block and the start of the next
        n = len(value) - width + 1
        rows = np.full(-(-len(value) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        rows[: len(value)] = value
        rows = rows.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
        spot = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        change = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1])))
        first.append(change + at)
        place.append(spot[change] + at)
        hashes.append(h[spot[change]])
    if not first:
        return (np.zeros(0, np.int64),) * 3
    first, place, hashes = (np.concatenate(x) for x in (first, place, hashes))
    new = np.concatenate(([True], place[1:] != place[:-1]))  # a stretch may go on in the next part
    first, hashes = first[new], hashes[new]
    last = np.append(first[1:], len(a) - length + 1) - 1
    # windows that reach over a text's end go; a stretch may then end earlier, or begin with the next text
    text = np.searchsorted(ends, first, "right")
    low, high = (ends - np.diff(ends, prepend=0))[text], ends[text] - length
    out = [(first, np.minimum(last, high), hashes)]
    over = last >= ends[text]  # windows of the next texts that have this seed: it lies in them
    while over.any():
        f, l, h, t = first[over], last[over], hashes[over], text[over] + 1
        out.append((ends[t - 1], np.minimum(l, ends[t] - length), h))
        first, last, hashes, text = ends[t - 1], l, h, t
        over = last >= ends[text]
    first, last, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = first <= last
    order = np.argsort(first[keep], kind="stable")
    return first[keep][order], last[keep][order], hashes[keep][order].view(np.int64)


def stretches(texts: list[bytes], length: int) -> list[tuple[bytes, bytes]]:
    """Of each text (its stretches, packed, a repeated one once; ranges of windows
    that the text itself has twice)."""
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    out = [(b"", b"")] * len(texts)
    if not long:
        return out
    data = b"".join([texts[i] for i in long])
    ends = np.cumsum([len(texts[i]) for i in long])
    first, last, seed = seeds(data, ends, length)
    whole = np.array([xxhash.xxh3_64_intdigest(data[i:k]) for i, k in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64).view(np.int64)
    text = np.searchsorted(ends, first, "right")
    order = np.lexsort((first, whole, seed, text))
    new = np.concatenate(([True], (np.diff(text[order]) != 0) | (np.diff(seed[order]) != 0) | (np.diff(whole[order]) != 0)))
    group = np.cumsum(new) - 1
    times = np.bincount(group)
    kept = np.zeros(int(new.sum()), _STRETCH)
    own = order[new]
    low = np.concatenate(([0], ends[:-1]))
    kept["seed"], kept["all"], kept["start"], kept["more"], kept["times"] = seed[own], whole[own], first[own] - low[text[own]], last[own] - first[own], np.minimum(times, 2)
    at = np.searchsorted(text[own], np.arange(len(long) + 1))
    twice = order[times[group] > 1]
    twice = twice[np.argsort(first[twice])]
    ranges = np.zeros(len(twice), _RANGE)
    ranges["lo"], ranges["hi"] = first[twice] - low[text[twice]], last[twice] - low[text[twice]]
    there = np.searchsorted(text[twice], np.arange(len(long) + 1))
    for k, i in enumerate(long):
        out[i] = kept[at[k] : at[k + 1]].tobytes(), joined(ranges[there[k] : there[k + 1]]).tobytes()
    return out


def joined(ranges: np.ndarray) -> np.ndarray:
    """Ranges of windows, ascending, without gaps between neighbours that touch."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges["lo"], kind="stable")]
    reach = np.maximum.accumulate(ranges["hi"].astype(np.int64))
    new = np.concatenate(([True], ranges["lo"][1:] > reach[:-1] + 1))
    out = ranges[new].copy()
    out["hi"] = reach[np.append(np.flatnonzero(new)[1:], len(ranges)) - 1]
    return out


class RunIndex:
    """The run-length Burrows-Wheeler transform of a collection of strings, with
    the suffix at both ends of each run.  Each string has an end mark of its own."""

    def __init__(self, strings: list[bytes], most: int) -> None:
        size = np.array([len(s) for s in strings])
        self.size, self.most = size, most
        end = np.cumsum(size + 1) - 1
        text = np.frombuffer(b"\0".join([*strings, bytes(8)]), np.uint8)
        n = int(end[-1]) + 1
        self.of = np.repeat(np.arange(len(strings)), size + 1)
        self.left = end[self.of] - np.arange(n)  # bytes up to the string's end
        symbol = text[:n].astype(np.int64) + 1
        symbol[end] = 0
        self.words = np.ndarray(len(text) - 7, "<u8", text.tobytes(), strides=(1,))
        sa = self._sorted(symbol, n)
        before = np.where(sa > 0, symbol[sa - 1], 0)
        # an end mark is a symbol of its own, so no run has two of them
        new = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0)))
        self.start = np.flatnonzero(new)
        self.stop = np.append(self.start[1:], n) - 1
        self.head = before[self.start]
        self.first, self.last = sa[self.start], sa[self.stop]
        # where the steps back from a run lead to: runs of one symbol lie there in order
        order = np.argsort(self.head, kind="stable")
        length = (self.stop - self.start + 1)[order]
        self.base = np.empty(len(order), np.int64)
        self.base[order] = np.cumsum(length) - length
        # matches with the neighbours at a run's ends, from the samples there
        self.up, self.down = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        a, b = order[:-1], order[1:]
        same = (self.head[a] == self.head[b]) & (self.head[a] > 0)
        a, b = a[same], b[same]
        match = self.common(self.last[a] - 1, self.first[b] - 1)
        self.down[a], self.up[b] = match, match

    def _sorted(self, symbol: np.ndarray, n: int) -> np.ndarray:
        k = 7
        padded = np.concatenate((symbol, np.zeros(k, np.int64)))
        key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(k):  # nothing counts behind an end mark
            key = key << 9 | np.where(open_, padded[i : i + n], 0)
            open_ &= padded[i : i + n] > 0
        sa = np.argsort(key)
        key = key[sa]
        rank, at = np.zeros(n, np.int64), np.arange(n)
        while True:
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank[sa[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            at = at[~(new & np.concatenate((new[1:], [True])))]
            if not len(at):
                return sa
            own = sa[at]
            # strings that are equal up to their end marks are in their own order
            key = rank[own] * (n + 1) + np.where(self.left[own] >= k, rank[np.minimum(own + k, n - 1)], self.of[own])
            order = np.argsort(key)
            sa[at], key = own[order], key[order]
            k *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of two suffixes, as far as it matters."""
        limit = np.minimum(np.minimum(self.left[i], self.left[j]), self.most)
        out, at, step = limit.copy(), np.flatnonzero(limit > 0), 0
        while len(at):
            x = self.words[i[at] + step] ^ self.words[j[at] + step]
            differ = np.flatnonzero(x)
            low = x[differ] & (~x[differ] + np.uint64(1))
            own = at[differ]
            out[own] = np.minimum(limit[own], step + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
            step += 8
            at = at[x == 0]
            at = at[limit[at] > step]
        return out

    def statistics(self):
        """(string, place, longest match with any other suffix) of all suffixes, those
        of one distance to the end at once, from the ends."""
        string = np.arange(len(self.size))
        place = string.copy()  # end marks are the least suffixes, in order
        up = down = np.zeros(len(string), np.int64)
        for step in range(1, int(self.size.max()) + 1):
            keep = self.size[string] >= step
            string, place, up, down = string[keep], place[keep], up[keep], down[keep]
            run = np.searchsorted(self.start, place, "right") - 1
            up = np.where(place == self.start[run], self.up[run], up + 1)
            down = np.where(place == self.stop[run], self.down[run], down + 1)
            place = self.base[run] + place - self.start[run]
            yield string, self.size[string] - step, np.maximum(up, down)


def repeated_windows(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) of the windows that the collection has twice."""
    found = [(s[hit], w[hit]) for s, w, match in RunIndex(strings, length).statistics() if (hit := match >= length).any()]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def scanned(docs: DataFrame, length: int) -> DataFrame:
    """``th``, ``packed`` (stretches), ``known`` (ranges that a text has twice) of
    texts; equal ones of a batch once."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                _, own = np.unique(b.column(0).to_numpy(), return_index=True)
                b = b.take(pa.array(np.sort(own)))
                packed, known = zip(*stretches(bytes_of(b.column(1)), length), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array(known, pa.binary())], ["th", "packed", "known"])

    return map_batches(docs.select("th", "text"), run, "th long, packed binary, known binary")


def rows_of(packed: DataFrame) -> DataFrame:
    """A row for each stretch: ``th``, ``seed``, ``all``, ``start``, ``more``, ``times``
    (2 for several); those of a text with copies count twice."""

    def run(batches):
        for b in batches:
            held = [np.frombuffer(x, _STRETCH) for x in b.column(1).to_pylist()]
            size = [len(x) for x in held]
            if not sum(size):
                continue
            flat, th = np.concatenate(held), np.repeat(b.column(0).to_numpy(), size)
            times = np.where(np.repeat(b.column(2).to_numpy(), size) > 1, 2, flat["times"]).astype(np.int64)
            for i in range(0, len(flat), ROWS):
                x = flat[i : i + ROWS]
                cols = [pa.array(np.ascontiguousarray(x[n])) for n in ("seed", "all")] + [pa.array(x[n].astype(np.int64)) for n in ("start", "more")]
                yield pa.RecordBatch.from_arrays([pa.array(th[i : i + ROWS]), *cols, pa.array(times[i : i + ROWS])], ["th", "seed", "all", "start", "more", "times"])

    return map_batches(packed.select("th", "packed", "copies"), run, "th long, seed long, all long, start long, more long, times long")


def read_again(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of open stretches, ``seed``, ``th``, ``start``, ``single``, ``bytes``; of
    seeds with too many, ``window``, a hash of each of their windows, instead of
    ``bytes``.  ``wanted``: ``th``, ``idh`` and ``items`` (``seed``, ``start``, ``more``, ``single``,
    ``many``)."""
    found = docs.join(wanted.hint("shuffle_hash"), ["th", "idh"]).select("th", "text", "items")

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                items = b.column(2)
                text = np.repeat(np.arange(b.num_rows), np.diff(items.offsets.to_numpy()))
                flat = items.flatten()
                seed, start, more, single, many = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("seed", "start", "more", "single", "many"))
                data, th = bytes_of(b.column(1)), b.column(0).to_numpy()
                for few in (True, False):
                    at = np.flatnonzero(many != few)
                    if not few:  # a row for each window
                        n = more[at] + 1
                        at, shift = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    for i in range(0, len(at), ROWS // 16):
                        own = at[i : i + ROWS // 16]
                        lo = start[own] if few else start[own] + shift[i : i + ROWS // 16]
                        hi = lo + length + (more[own] if few else 0)
                        parts = [data[t][a:z] for t, a, z in zip(text[own].tolist(), lo.tolist(), hi.tolist(), strict=True)]
                        window = pa.nulls(len(own), pa.int64()) if few else pa.array(np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64).view(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(seed[own]), pa.array(th[text[own]]), pa.array(lo), pa.array(single[own]), window, pa.array(parts, pa.binary()) if few else pa.nulls(len(own), pa.binary())], ["seed", "th", "start", "single", "window", "bytes"])

    return map_batches(found, run, "seed long, th long, start long, single boolean, window long, bytes binary")


def indexed(parts: DataFrame, length: int) -> DataFrame:
    """``th``, ``lo``, ``hi``: windows of single stretches that a run-length index of
    the stretches of their seed and others has twice."""

    def run(batches):
        held, size, last = [], 0, None

        def close():
            string, window = repeated_windows([r[3] for r in held], length)
            single, th, start = (np.array([r[i] for r in held]) for i in range(3))
            own = single[string]
            string, window = string[own], window[own]
            order = np.lexsort((window, string))
            string, window = string[order], window[order]
            new = np.flatnonzero(np.concatenate(([True], (string[1:] != string[:-1]) | (window[1:] != window[:-1] + 1)))) if len(string) else np.zeros(0, np.int64)
            stop = np.append(new[1:], len(string))[: len(new)] - 1
            of = string[new]
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (th[of], start[of] + window[new], start[of] + window[stop])], ["th", "lo", "hi"])

        for b in batches:
            for seed, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if seed != last and size >= INDEX_BYTES:
                    yield close()
                    held, size = [], 0
                last = seed
                held.append(row)
                size += len(row[3])
        if held:
            yield close()

    dealt = parts.select("seed", "single", "th", "start", "bytes").repartition("seed").sortWithinPartitions("seed")
    return map_batches(dealt, run, "th long, lo long, hi long")


def cut(docs: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """``th``, ``n_removed``, ``n_spans``, ``kept`` (digest), ``spans`` (of bytes) of
    texts without the bytes of the windows in ``spans`` (structs of ``lo`` and ``hi``)
    and ``known``."""
    found = docs.join(ranges.hint("shuffle_hash"), ["th", "idh"]).select("th", "text", "spans", "known")

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                rows = []
                for data, spans, known in zip(bytes_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    own = np.array([(s["lo"], s["hi"]) for s in spans or ()], np.int64).reshape(-1, 2)
                    windows = np.zeros(len(own) + len(known or b"") // 8, _RANGE)
                    windows["lo"][: len(own)], windows["hi"][: len(own)] = own[:, 0], own[:, 1]
                    windows[len(own) :] = np.frombuffer(known or b"", _RANGE)
                    windows["hi"] += length - 1
                    spans = joined(windows)
                    h, at, gone = hashlib.sha256(), 0, 0
                    for lo, hi in spans.tolist():
                        h.update(data[at:lo])
                        at, gone = hi + 1, gone + hi + 1 - lo
                    h.update(data[at:])
                    rows.append((gone, len(spans), h.hexdigest(), spans.tobytes()))
                cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["th", "n_removed", "n_spans", "kept", "spans"])

    return map_batches(found, run, "th long, n_removed long, n_spans long, kept string, spans binary")


def marked(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """For each row: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs
    of bytes that go; all long), ``kept_sha256`` (of the other bytes) and ``spans``
    (binary: first and last byte of each run, 32 bits each, little-endian).

    Null texts count as empty, texts shorter than ``length`` lose nothing.  Repeated
    rows are repeated texts and lose all, whatever their ids; a null id stays null.
    Further columns are left out."""
    if length < 32:
        raise ValueError("windows of fewer than 32 bytes have no seed to meet by")
    spark = df.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = plain(df, id_col, text_col).toDF("id", "text").withColumns({"th": F.xxhash64(text), "idh": F.xxhash64("id")})
    rows = materialised(spark, docs.select("id", "th", "idh", F.octet_length(text).cast("long").alias("n"), F.sha2(text, 256).alias("sha")), "repeat-rows")
    with scope(spark):  # only the verdicts stay
        texts = materialised(spark, rows.groupBy("th").agg(F.count(F.lit(1)).alias("copies"), F.min("idh").alias("idh"), F.first("n").alias("n")), "repeat-texts")
        once = scanned(docs.filter(F.octet_length("text") >= length), length).groupBy("th").agg(F.first("packed").alias("packed"), F.first("known").alias("known"))
        packed = materialised(spark, once.join(texts, "th"), "repeat-stretches")
        each = rows_of(packed)
        seed = each.groupBy("seed").agg(F.sum("times").alias("times"), (F.min("all") != F.max("all")).alias("mixed")).filter("times > 1").drop("times")
        near = materialised(spark, each.join(materialised(spark, seed, "repeat-seeds"), "seed"), "repeat-near")
        mixed = near.filter("mixed").withColumn("order", F.xxhash64("th", "start"))
        kinds = materialised(spark, mixed.groupBy("seed", "all").agg(F.sum("times").alias("times"), F.min("order").alias("first")), "repeat-kinds")
        counts = materialised(spark, kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("times") == 1).alias("singles")), "repeat-counts")
        told = kinds.join(counts, "seed").select("seed", "all", (F.col("times") == 1).alias("single"), "first", "singles", (F.col("n") > most).alias("many"))
        told = materialised(spark, mixed.drop("times").join(materialised(spark, told, "repeat-told"), ["seed", "all"]), "repeat-open")
        alone = texts.filter("copies = 1")
        # open stretches, one of each, by text
        items = told.filter("singles > 0 AND (single OR order = first)").groupBy("th").agg(F.collect_list(F.struct("seed", "start", "more", "single", "many")).alias("items"))
        parts = materialised(spark, read_again(docs, items.join(texts.select("th", "idh"), "th"), length), "repeat-parts")
        windows = parts.filter("window IS NOT NULL").select("window", "th", "start", "single")
        twice = materialised(spark, windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeat-windows")
        spans = indexed(parts.filter("window IS NULL"), length).unionByName(windows.filter("single").join(twice, "window").select("th", F.col("start").alias("lo"), F.col("start").alias("hi")))
        settled = near.filter("NOT mixed").select("th", "start", "more").unionByName(told.filter("NOT single").select("th", "start", "more"))
        spans = spans.unionByName(settled.select("th", F.col("start").alias("lo"), (F.col("start") + F.col("more")).alias("hi")))
        spans = spans.groupBy("th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        known = packed.filter("octet_length(known) > 0").select("th", "known")
        ranges = alone.select("th", "idh").join(spans.join(known, "th", "full"), "th")
        gone = cut(docs, ranges, length)
        copies = texts.filter(F.col("copies") > 1).select("th", F.when(F.col("n") >= length, F.col("n")).alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"), F.lit(None).cast("binary").alias("spans")).filter("n_removed IS NOT NULL")
        verdicts = materialised(spark, gone.unionByName(copies), "repeat-verdicts", outer=True)
    out = rows.join(verdicts, "th", "left")
    whole = F.concat(F.lit(b"\0\0\0\0"), F.reverse(F.unhex(F.lpad(F.hex(F.col("n") - 1), 8, "0"))))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"), F.when(F.col("n_removed").isNull(), F.lit(b"")).otherwise(F.coalesce("spans", whole)).alias("spans"),
    )
