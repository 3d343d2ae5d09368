"""N-gram Jaccard join with signature trees.

Two documents link when the Jaccard index of their sets of word shingles
reaches a threshold; the result is the components of the links.  It is exact
(up to 64-bit hashes), and no step grows with the square of a group of copies.

1. Sets.  Every document yields its set's size, a 64-bit key of the set and a
   bitmap of its tokens, at least four bits a token.  Equal sets are one class,
   and only classes are joined from here on.
2. Order.  Tokens are ordered by hash, frequent ones last.  The frequent ones,
   at most ``HOT_TOKENS`` and counted over all prefixes of all documents, are
   broadcast.  Any order gives the same links; this one keeps passages that many
   documents share from bringing those documents together.
3. Prefixes.  Of two linked sets, the first ``n - ceil(t n) + 1`` tokens have
   one in common.  Of the classes of the most copies one row each deals them out.  These tokens are dealt by bucket as packed arrays; classes
   that share one are a group, cut by size as linked sets are of like sizes.
   Equal groups are one.  A group of more than ``GROUP`` members is kept in
   blocks of half as many, and a task has two of them.
4. Trees.  A group becomes a binary tree whose nodes hold the OR of their
   members' bitmaps, the range of their sizes and their component.  The tree is
   traversed against itself, level by level: a pair of nodes is pruned if the
   bits in common allow too small an overlap, or if all members of both are in
   one component.  What is left at the leaves are candidates.
5. Links.  The first round asks for a spanning forest of the candidates only, in
   large groups of those within two blocks that follow each other: linear in the
   members.  Pairs are verified on the whole sets.  The second round takes the
   groups that have more than one component then.  Large ones are dealt to blocks
   anew, by component, and every two blocks are traversed against each other but
   those that lie in one component or whose sizes are too unlike; every candidate
   pair between different components is verified.  So a group of copies costs its
   number of members, and only members outside its main component meet all blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bytes_of, map_batches, plain, slices
from quillon.llm.components import components
from quillon.session import materialised, scope

HOT_TOKENS, HOT_COUNT, GROUP, BUCKET_ROWS = 1 << 19, 24, 1024, 60_000
#: Classes of the most copies, of which only one row each deals out prefixes: no other one has more than that part of all rows.
HOT_CLASSES, HOT_COPIES = 1 << 17, 64
#: Bits of a bitmap at most; longer sets have fewer bits a token, and so more candidates.
MOST_BITS = 1 << 17
SALTS, SEEN = 16, 100_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_ROW = np.dtype([("token", "<u4"), ("n", "<u4"), ("key", "<i8")])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For words' hashes: a number for each byte, powers of an odd base and of its inverse.
_BYTE = np.random.default_rng(20260101).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_POWERS: list[np.ndarray] = []
#: Texts that are hashed at once, and words whose bytes are hashed one by one.
CHUNK_BYTES, LONG_WORD = 1 << 20, 256
_SPACES = re.compile(rb"[ \t\n\r\x0b\x0c]")


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, words before each text and after all).
    A-Z are lower-cased, words are cut at ASCII white space.  A word's hash is a
    polynomial of its bytes modulo 2**64, found from running sums, and mixed with
    its length; of long words, where such polynomials can collide, xxhash."""
    data = b" ".join([*texts, b""]).lower()
    a = np.frombuffer(data, np.uint8)
    up, down = _powers(len(a))
    space = np.concatenate(([True], _IS_SPACE[a], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * up[: len(a)])))
        size = end - start
        h = mix((run[end] - run[start]) * down[start] ^ mix(size.astype(np.uint64) * _MULT[4]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]])
    return h, np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def _long_text(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same for a text that is too long to be hashed at once: by parts that
    end before white space."""
    parts, at = [], 0
    while at < len(text):
        m = _SPACES.search(text, at + CHUNK_BYTES)
        to = m.start() if m else len(text)
        part = text[at:to]
        own = part.split(None, 1)
        if len(part) > 2 * CHUNK_BYTES and len(own) == 1:  # one endless word
            parts.append(np.array([xxhash.xxh64_intdigest(own[0].lower())], np.uint64))
        elif len(part) > 2 * CHUNK_BYTES and own:
            head = part.rindex(part.split()[-1])
            parts += [word_hashes([part[:head]])[0], np.array([xxhash.xxh64_intdigest(part[head:].lower())], np.uint64)]
        else:
            parts.append(word_hashes([part])[0])
        at = to
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])


def token_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Of each text the distinct hashes of its word shingles, ascending.  A text
    with fewer words is one shingle, one without words has none."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= CHUNK_BYTES):
            held += len(texts[to])
            to += 1
        h, first = word_hashes(texts[at:to]) if held <= CHUNK_BYTES else _long_text(texts[at])
        with np.errstate(over="ignore"):
            whole = _shingles(h, words)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                t = whole[a : b - words + 1] if b - a >= words else _shingles(h[a:b], b - a) if b > a else h[:0]
                t = np.sort(t)
                yield t[np.concatenate(([True], t[1:] != t[:-1]))] if len(t) else t
        at = to


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    total = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        total = mix(total + h[i : len(total) + i] * _MULT[i % len(_MULT)])
    return total


def tokens(data: bytes, words: int) -> np.ndarray:
    return next(token_sets([data], words))


def set_key(t: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(np.int64(mix(t ^ _MULT[1]).sum().view(np.int64))) if len(t) else 0


def bitmap(t: np.ndarray) -> bytes:
    """A power of two of at least four bits a token, up to ``MOST_BITS``, one set
    for each token."""
    width = min(MOST_BITS, max(64, 1 << max(0, 4 * len(t) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(mix(t ^ _MULT[2]) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def least_overlap(a, b, percent: int):
    """The intersection that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n, percent: int):
    return n - (-(-percent * n // 100)) + 1


def set_rows(df: DataFrame, words: int) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``n``, ``key``, ``bits`` of each row."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                sets = list(token_sets(bytes_of(b.column(1)), words))
                cols = [pa.array([len(t) for t in sets], pa.int64()), pa.array([set_key(t) for t in sets], pa.int64()), pa.array([bitmap(t) if len(t) else b"" for t in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], ["id", "th", "n", "key", "bits"])

    return map_batches(df.select("id", "text", "th"), run, f"id {df.schema['id'].dataType.simpleString()}, th long, n long, key long, bits binary")


def _short(t: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 more bits) of tokens; tokens that agree in both count as one
    here, which can only add candidates."""
    return (t & np.uint64(buckets - 1)).astype(np.int64), (t >> np.uint64(24)).astype(np.uint32)


def ordered_prefix(t: np.ndarray, percent: int, hot: np.ndarray, buckets: int) -> np.ndarray:
    p = prefix_size(len(t), percent)
    if not len(hot):
        return t[:p]
    bucket, low = _short(t, buckets)
    code = bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
    at = np.minimum(np.searchsorted(hot, code), len(hot) - 1)
    return t[np.argsort(hot[at] == code, kind="stable")[:p]]


def hot_classes(sets: DataFrame) -> dict[tuple[int, int], int]:
    """By key and size of the classes of the most copies, at most ``HOT_CLASSES``: a
    hash of the row that stands for the class."""
    top = sets.filter(F.col("copies") > HOT_COPIES).orderBy(F.desc("copies"), "key", "n").limit(HOT_CLASSES)
    return {(r.key, r.n): r.row for r in top.select("key", "n", F.xxhash64("rep.id", "rep.th").alias("row")).collect()}


def prefix_rows(df: DataFrame, words: int, percent: int, buckets: int, hot: np.ndarray | None, classes) -> DataFrame:
    """``bucket``, ``rows``: the prefix tokens of all texts, packed.  A set that occurs
    again within a task is not repeated (but after ``SEEN`` others), and of ``classes``
    (a broadcast of ``hot_classes``) only the row that stands for the class counts.
    Without ``hot`` only tokens."""
    held = df.sparkSession.sparkContext.broadcast(hot if hot is not None else np.zeros(0, np.uint64))  # at most HOT_TOKENS

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for b in slices(whole, 1):
                parts = []
                if len(seen) > SEEN:
                    seen.clear()
                for t, row in zip(token_sets(bytes_of(b.column(1)), words), b.column(2).to_pylist(), strict=True):
                    key = set_key(t)
                    if not len(t) or (key, len(t)) in seen or classes.value.get((key, len(t)), row) != row:
                        continue
                    seen.add((key, len(t)))
                    parts.append((ordered_prefix(t, percent, held.value, buckets), len(t), key))
                if not parts:
                    continue
                bucket, low = _short(np.concatenate([p for p, _, _ in parts]), buckets)
                rows = low
                if hot is not None:
                    rows = np.empty(len(low), _ROW)
                    size = [len(p) for p, _, _ in parts]
                    rows["token"], rows["n"], rows["key"] = low, np.repeat([n for _, n, _ in parts], size), np.repeat(np.array([k for _, _, k in parts], np.int64), size)
                order = np.argsort(bucket, kind="stable")
                bucket, rows = bucket[order], rows[order]
                ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
                out = np.split(rows, ends[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1], pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())], ["bucket", "rows"])

    return map_batches(df.select("id", "text", F.xxhash64("id", "th").alias("row")), run, "bucket long, rows binary")


def _by_bucket(batches, kind):
    """(bucket, all its rows): rows of a bucket follow each other."""
    at, held = None, []
    for b in batches:
        for bucket, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != at:
                if held:
                    yield at, np.concatenate(held)
                at, held = bucket, []
            held.append(np.frombuffer(rows, kind))
    if held:
        yield at, np.concatenate(held)


def hot_tokens(packed: DataFrame, buckets: int) -> np.ndarray:
    """The most frequent prefix tokens, at most ``HOT_TOKENS``: bucket and token
    in one number, ascending."""

    def run(batches):
        for bucket, rows in _by_bucket(batches, "<u4"):
            value, count = np.unique(rows, return_counts=True)
            many = count >= HOT_COUNT
            code = (np.uint64(bucket) << np.uint64(32)) | value[many].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(count[many], pa.int64())], ["code", "n"])

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    counted = materialised(packed.sparkSession, map_batches(dealt, run, "code long, n long"), "near-counts")
    level = F.floor(F.log2("n") * 8)
    sizes = dict(counted.groupBy(level.alias("level")).count().collect())  # at most 512 levels
    total, least = 0, None
    for x in sorted(sizes, reverse=True):
        total += sizes[x]
        if total > HOT_TOKENS:
            break
        least = x
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(counted.filter(level >= least).select("code").toPandas()["code"].to_numpy(np.int64).view(np.uint64))


def groups_of(keys: np.ndarray, sizes: np.ndarray, percent: int):
    """Members that may link, by size: bands of like sizes, each with the next."""
    order = np.lexsort((keys, sizes))
    keys, sizes = keys[order], sizes[order]
    at = 0
    while at < len(keys):
        # a band holds sizes up to 100/percent times its least; partners reach as far again
        end = int(np.searchsorted(sizes, sizes[at] * 100 // percent, "right"))
        reach = int(np.searchsorted(sizes, sizes[end - 1] * 100 // percent, "right"))
        if reach - at > 1:
            yield keys[at:reach], sizes[at:reach]
        if reach == len(keys) and end == len(keys):
            break
        at = end


def shared_groups(packed: DataFrame, percent: int, most: int = GROUP) -> DataFrame:
    """``gid``, ``size``, ``block``, ``keys``, ``sizes``: each group of classes that
    share a prefix token, once, in one block or, of more than ``most`` members, in
    blocks of half as many, by size."""

    def run(batches):
        for _, rows in _by_bucket(batches, _ROW):
            rows = np.unique(rows)  # by token, size, key
            token = rows["token"]
            ends = np.flatnonzero(np.concatenate((token[1:] != token[:-1], [True]))) + 1
            starts = np.concatenate(([0], ends[:-1]))
            many = ends - starts > 1
            seen: dict[int, tuple] = {}
            held = 0
            for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                for keys, sizes in groups_of(rows["key"][a:b], rows["n"][a:b].astype(np.int64), percent):
                    with np.errstate(over="ignore"):
                        gid = int(mix(keys.view(np.uint64) * _MULT[3] + sizes.astype(np.uint64)).sum().view(np.int64))
                    held += 0 if gid in seen else len(keys)
                    seen.setdefault(gid, (keys, sizes))
                if held > 200_000:
                    yield _groups(seen, most)
                    seen.clear()
                    held = 0
            if seen:
                yield _groups(seen, most)

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    found = map_batches(dealt, run, "gid long, size long, block long, keys array<long>, sizes array<long>")
    return found.groupBy("gid", "size", "block").agg(F.first("keys").alias("keys"), F.first("sizes").alias("sizes"))


def _groups(seen: dict, most: int) -> pa.RecordBatch:
    rows = []
    for gid, (keys, sizes) in seen.items():
        step = len(keys) if len(keys) <= most else max(1, most // 2)
        rows += [(gid, len(keys), i // step, keys[i : i + step], sizes[i : i + step]) for i in range(0, len(keys), step)]
    ends = pa.array(np.cumsum([0, *(len(r[3]) for r in rows)]).astype(np.int32))
    cols = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[i] for r in rows]))) for i in (3, 4)]
    return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), *cols], ["gid", "size", "block", "keys", "sizes"])


class Forest:
    """Union-find over positions."""

    def __init__(self, label: np.ndarray) -> None:
        _, first, where = np.unique(label, return_index=True, return_inverse=True)
        self.up = first[where].tolist()

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps of one width, that of the narrowest: halves are OR-combined."""
    width = min(map(len, bits)) // 8
    rows = [np.frombuffer(b, np.uint64) for b in bits]
    return np.stack([np.bitwise_or.reduce(r.reshape(-1, width), 0) for r in rows])


def candidates(sizes: np.ndarray, bits: list[bytes], label: np.ndarray, percent: int, every: bool) -> list[tuple[int, int]]:
    """Pairs of members whose bitmaps allow a link and whose components
    (``label``) differ: all of them, or a spanning forest."""
    maps = folded(bits)
    order = np.lexsort((*maps.T[:4], sizes))
    maps, n = maps[order], sizes[order]
    m = len(n)
    forest, out = Forest(label[order]), []
    extra = n - np.bitwise_count(maps).sum(1)

    def allowed(i, j, maps=maps, low=n, extra=extra):
        common = np.bitwise_count(maps[i] & maps[j]).sum(1, dtype=np.int64)
        return common + np.minimum(extra[i], extra[j]) >= least_overlap(low[i], low[j], percent)

    def links(i, j) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if every or forest.join(a, b):
                out.append((int(order[a]), int(order[b])))

    if not every:  # a heap of neighbours joins most copies, with few pairs a member
        for far in (1, 0):
            child = np.arange(1, m)
            parent = child - 1 if far == 0 else (child - 1) // 2
            ok = allowed(child, parent)
            links(child[ok], parent[ok])
    if m == 2 and not every:
        return out
    #: levels[0] are the leaves: OR, least and greatest size, extra, component or -1.
    comp = forest.roots()
    levels = [(maps, n, n, extra, comp)]
    while len(levels[-1][1]) > 1:
        o, lo, hi, ex, co = levels[-1]
        if len(lo) % 2:
            o, lo, hi, ex, co = (np.concatenate((x, x[-1:])) for x in (o, lo, hi, ex, co))
        levels.append((o[::2] | o[1::2], np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), np.maximum(ex[::2], ex[1::2]), np.where(co[::2] == co[1::2], co[::2], -1)))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        at, i, j = stack.pop()
        o, lo, hi, ex, co = levels[at]
        if len(i) > 32768:
            stack += [(at, i[k : k + 32768], j[k : k + 32768]) for k in range(0, len(i), 32768)]
            continue
        keep = ((co[i] != co[j]) | (co[i] < 0)) & (100 * hi[i] >= percent * lo[j]) & (100 * hi[j] >= percent * lo[i])
        i, j = i[keep], j[keep]
        keep = allowed(i, j, o, lo, ex)
        i, j = i[keep], j[keep]
        if not at:
            apart = i != j
            links(i[apart], j[apart])
            continue
        below = len(levels[at - 1][1])
        pairs = [(2 * i + a, 2 * j + b) for a in (0, 1) for b in (0, 1)]
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        keep = (i <= j) & (j < below) & (i < below)
        if keep.any():
            stack.append((at - 1, i[keep], j[keep]))
    return out


def candidate_pairs(members: DataFrame, percent: int, every: bool) -> DataFrame:
    """``a``, ``an``, ``b``, ``bn``: distinct candidates.  ``members``: ``gid``,
    ``size``, ``task`` (those with the same three meet), ``key``, ``n``, ``bits``,
    ``label``."""

    def run(batches):
        held, at = [], None

        def close():
            found = [] if len(held) < 2 else candidates(np.array([r[1] for r in held]), [r[2] for r in held], np.array([r[3] for r in held]), percent, every)
            rows = [(held[i][:2], held[j][:2]) if held[i][:2] < held[j][:2] else (held[j][:2], held[i][:2]) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([r[x][y] for r in rows], pa.int64()) for x, y in ((0, 0), (0, 1), (1, 0), (1, 1))], ["a", "an", "b", "bn"])

        waiting = []
        for b in batches:
            for gid, size, task, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (gid, size, task) != at:
                    if held:
                        waiting.append(close())
                    held, at = [], (gid, size, task)
                    if len(waiting) > 500:
                        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0] if sum(x.num_rows for x in waiting) else waiting[0]
                        waiting = []
                held.append(tuple(row))
        if held:
            waiting.append(close())
        for x in waiting:
            if x.num_rows:
                yield x

    dealt = members.select("gid", "size", "task", "key", "n", "bits", "label").repartition("gid", "size", "task").sortWithinPartitions("gid", "size", "task", "n", "key")
    return map_batches(dealt, run, "a long, an long, b long, bn long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs with ``linked``, by their whole sets.  ``sets``: ``key``, ``n``,
    ``rep``: id (which may be null) and hash of a text in ``docs`` (``id``,
    ``text``, ``th``) that has the set."""
    ends = pairs.select(F.col("a").alias("key"), F.col("an").alias("n")).unionByName(pairs.select(F.col("b").alias("key"), F.col("bn").alias("n"))).distinct()
    wanted = ends.join(sets, ["key", "n"]).select("key", "n", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    found = docs.join(wanted, docs["id"].eqNullSafe(F.col("rep_id")) & (docs["th"] == F.col("rep_th"))).select("key", "n", "text")

    def matching(batches):
        """Texts of one hash may differ: only that with the set counts."""
        for whole in batches:
            for b in slices(whole, 2):
                own = [set_key(t) == k and len(t) == n for t, k, n in zip(token_sets(bytes_of(b.column(2)), words), b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield b.filter(pa.array(own))

    texts = map_batches(found, matching, "key long, n long, text string").dropDuplicates(["key", "n"])
    texts = materialised(pairs.sparkSession, texts, "near-texts")
    both = pairs.join(texts.toDF("a", "an", "ta"), ["a", "an"]).join(texts.toDF("b", "bn", "tb"), ["b", "bn"])

    def run(batches):
        for whole in batches:
            for b in slices(whole, 4):
                last, rows = {}, []
                for x, y in zip(bytes_of(b.column(4)), bytes_of(b.column(5)), strict=True):
                    last = {t: last[t] if t in last else tokens(t, words) for t in (x, y)}
                    common = len(np.intersect1d(last[x], last[y], assume_unique=True))
                    rows.append(100 * common >= percent * (len(last[x]) + len(last[y]) - common))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(rows, pa.bool_())], ["a", "an", "b", "bn", "linked"])

    return map_batches(both.select("a", "an", "b", "bn", "ta", "tb"), run, "a long, an long, b long, bn long, linked boolean")


def open_blocks(members: DataFrame, percent: int, half: int) -> DataFrame:
    """``gid``, ``size``, ``key``, ``n``, ``label``, ``task``: of groups with several
    labels, blocks of about ``half`` members, and for each two of them that may hold
    a link between labels the members of both.  A label of many members has blocks
    of its own, dealt by hash, and other labels share blocks; only counts are
    needed for that, so no task sees a whole group."""
    names, most = ["gid", "size"], F.lit(max(1, half // 4))
    count = members.groupBy(*names, "label").agg(F.count(F.lit(1)).alias("c"))
    few = count.filter(F.col("c") < most).groupBy(*names).agg(F.ceil(F.sum("c") / half).alias("shared"))
    count = count.join(few, names, "left")
    own = F.xxhash64("label", F.pmod(F.xxhash64("key", "n"), F.ceil(F.col("c") / half)))
    blocks = members.join(count, [*names, "label"]).withColumn("block", F.when(F.col("c") >= most, own).otherwise(F.pmod(F.xxhash64("label"), F.col("shared")))).drop("c", "shared")
    ends = blocks.groupBy(*names, "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("first"), F.max("label").alias("last"))
    a, b = ends.toDF(*names, "i", "lo", "hi", "first", "last"), ends.toDF(*names, "j", "lo2", "hi2", "first2", "last2")
    apart = ~((F.col("first") == F.col("last2")) & (F.col("last") == F.col("first2")))
    like = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
    both = a.join(b, names).filter((F.col("i") <= F.col("j")) & apart & like).select(*names, "i", "j", F.xxhash64("i", "j").alias("task"))
    either = both.select(*names, F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "task")
    return blocks.join(either, [*names, "block"]).drop("block")


def linked_classes(spark: SparkSession, sets: DataFrame, bits: DataFrame, docs: DataFrame, groups: DataFrame, words: int, percent: int, most: int = GROUP) -> DataFrame:
    """``key``, ``n``, ``root``: the linked classes and their components."""
    names = F.struct("key", "n")
    large = F.col("size") > most
    flat = groups.select("gid", "size", "block", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("sizes").alias("n"))))
    members = materialised(spark, flat.join(bits, ["key", "n"]), "near-members")
    # a large group's block meets the one before and the one after it
    windows = members.select("*", F.explode(F.when(large & (F.col("block") > 0), F.array("block", F.col("block") - 1)).otherwise(F.array("block"))).alias("task"))
    pairs = materialised(spark, candidate_pairs(windows.withColumn("label", F.xxhash64(names)), percent, False), "near-pairs")
    tested = materialised(spark, verified(pairs, sets, docs, words, percent), "near-links")

    def roots(links: DataFrame) -> DataFrame:
        found = components(links.filter("linked").select(F.struct(F.col("a").alias("key"), F.col("an").alias("n")).alias("a"), F.struct(F.col("b").alias("key"), F.col("bn").alias("n")).alias("b")))
        return found.select("node.key", "node.n", "root")

    if tested.filter("NOT linked").isEmpty() and members.filter(large).isEmpty():
        return roots(tested)
    known = materialised(spark, roots(tested), "near-roots")
    label = members.select("gid", "size", "block", "key", "n").join(known, ["key", "n"], "left").withColumn("label", F.xxhash64(F.coalesce("root", names))).drop("root")
    open_groups = label.groupBy("gid", "size").agg((F.min("label") != F.max("label")).alias("open")).filter("open").drop("open")
    # a row for each block, so that members meet it by block and no task has all of a large group
    last = F.when(large, F.ceil(F.col("size") / max(1, most // 2)) - 1).otherwise(F.lit(0).cast("long"))
    each = open_groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    left = materialised(spark, label.join(each, ["gid", "size", "block"]).drop("block"), "near-open")
    small = left.filter(~large).withColumn("task", F.lit(0).cast("long"))
    meeting = small.unionByName(open_blocks(left.filter(large), percent, max(1, most // 2))).join(bits, ["key", "n"])
    more = candidate_pairs(meeting, percent, True).join(tested, ["a", "an", "b", "bn"], "left_anti")
    rest = materialised(spark, verified(materialised(spark, more, "near-pairs"), sets, docs, words, percent), "near-links")
    return roots(tested.unionByName(rest))


def joined(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, named: bool = False) -> DataFrame:
    """For each row: ``id_col``, ``n_shingles`` (long; the size of its set),
    ``component_id`` (the smallest id reachable by links, its own included); with
    ``named`` also ``text_hash`` (xxhash64) and ``component`` (the component's name,
    whatever its ids; null without words).

    Null, empty and blank texts have the empty set and link with nothing.  Equal
    sets link, so repeated rows are in one component, and rows of one id with
    different texts are judged by their own.  A null id stays null and is no
    component's smallest id unless all are null; rows without an id link as others
    do.  Further columns are left out."""
    spark = df.sparkSession
    docs = plain(df, id_col, text_col).toDF("id", "text").withColumn("th", F.xxhash64("text"))
    rows = materialised(spark, set_rows(docs, words), "near-sets")
    full = rows.filter("n > 0")
    sets = materialised(spark, full.groupBy("key", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep"), F.count(F.lit(1)).alias("copies")), "near-classes")
    total = sets.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    buckets = max(64, 1 << (int(total) // BUCKET_ROWS).bit_length())
    with scope(spark):  # only the components stay
        classes = spark.sparkContext.broadcast(hot_classes(sets))  # at most HOT_CLASSES
        hot = hot_tokens(prefix_rows(docs, words, percent, buckets, None, classes), buckets)
        groups = materialised(spark, shared_groups(prefix_rows(docs, words, percent, buckets, hot, classes), percent, group), "near-groups")
        bits = full.dropDuplicates(["key", "n"]).select("key", "n", "bits")
        found = materialised(spark, linked_classes(spark, sets.select("key", "n", "rep"), bits, docs, groups, words, percent, group), "near-components", outer=True)
    rooted = sets.join(found, ["key", "n"], "left").withColumn("root", F.coalesce("root", F.struct("key", "n")))
    least = rooted.groupBy("root").agg(F.min("rep.id").alias("component_id"))
    shared = rooted.withColumn("alone", (F.col("copies") == 1) & (F.col("root") == F.struct("key", "n")))
    sizes = shared.groupBy("root").agg(F.count(F.lit(1)).alias("classes"))
    # only classes that are not alone are looked up, by key and salt: one may have any share of the rows
    lookup = shared.join(least, "root").join(sizes, "root").filter("copies > 1 OR classes > 1").select("key", "n", "component_id", "root")
    lookup = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = rows.select("id", "n", "key", "th").withColumn("salt", F.when(F.col("n") == 0, -1 - F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.pmod(F.xxhash64("id"), F.lit(SALTS))))
    out = salted.join(lookup, ["key", "n", "salt"], "left")
    more = (F.col("th").alias("text_hash"), F.when(F.col("n") > 0, F.coalesce("root", F.struct("key", "n"))).alias("component")) if named else ()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *more)
