"""Periodic runs of words by the linear method of Gusfield and Stoye for tandem
repeats.

A run is a stretch of consecutive words with smallest period q that no neighbour
extends; those of at least ``least_exponent`` periods and ``least_words`` words are
wanted.  Each text is judged where it is read, many short ones at once:

0. A run of four periods and six words has a sequence of five words twice.  Texts
   without such a repetition are told apart by hashes, and need none of the rest.
1. Suffix tree: a suffix array by doubling, whose intervals of common prefixes are
   the nodes of the tree; the lengths of longest earlier factors follow from it with
   one stack, and give the blocks of the Lempel-Ziv factorisation.
2. Squares that cover the leftmost ones: for each block and each distance k the
   longest extensions to both sides of the block's ends tell whether a square of
   root length k lies there.  Those with a root that is itself a repetition go: they
   belong to runs of smaller periods.
3. Vocabulary: from each such square suffix links lead to the one with its first
   word moved to the end, as far as that occurs anywhere; stretches within one
   repetition are walked at once, and the walk ends at a square that is marked.
4. Occurrences: the leaves below a square's place in the tree are all its places.
   Places of one root length that follow each other are a run.

Equality of stretches is that of hashes modulo two primes of 31 bits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import bytes_of, map_batches, plain, slices

#: Words of texts that are searched at once, and bytes of texts that are read at once; a longer text is alone.
WORDS_AT_ONCE, SLICE_BYTES = 200_000, 2 << 20
#: Two primes of 31 bits and a base for each.
PRIMES = ((2147483647, 1103515245), (2147483629, 1220703125))
GRAM = 5
_SEED = 20260303


class Sequences:
    """Texts as word numbers, one after the other: ``w``; text ``doc[i]`` of word
    ``i`` begins at ``low[i]`` and ends before ``high[i]``."""

    def __init__(self, w: np.ndarray, sizes: np.ndarray) -> None:
        self.w, self.n = w, len(w)
        ends = np.cumsum(sizes)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.low, self.high = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        value = np.random.default_rng(_SEED).integers(1, PRIMES[1][0], (2, int(w.max()) + 1), np.int64)
        self.sums, self.powers = [], []
        for (p, base), v in zip(PRIMES, value, strict=True):
            powers = np.ones(1, np.int64)
            while len(powers) < self.n + 1:
                powers = np.concatenate((powers, powers * (int(powers[-1]) * base % p) % p))
            self.powers.append(powers[: self.n + 1])
            self.sums.append(np.concatenate((np.zeros(1, np.int64), np.cumsum(v[w] * powers[: self.n] % p) % p)))

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` from i and from j are equal; both must
        lie in their texts."""
        a, b = np.minimum(i, j), np.maximum(i, j)
        same = np.ones(len(a), bool)
        for (p, _), s, powers in zip(PRIMES, self.sums, self.powers, strict=True):
            x, y = s[a + size] - s[a], s[b + size] - s[b]
            same &= ((x + p) % p * powers[b - a] - y) % p == 0
        return same

    def extension(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the longest common stretch from i and j on (with ``back`` up to
        them), at most ``limit``."""
        out = np.zeros(len(i), np.int64)
        left = np.flatnonzero(limit > 0)
        left = left[self.w[i[left]] == self.w[j[left]]]
        out[left] = 1
        failed = np.zeros(len(i), np.int64)
        step = 1

        def more(at: np.ndarray, size: int) -> np.ndarray:
            shift = -(out[at] + size - 1) if back else out[at]
            return self.equal(i[at] + shift, j[at] + shift, np.full(len(at), size))

        while len(left):
            fits = out[left] + step <= limit[left]
            failed[left[~fits]] = step
            left = left[fits]
            good = more(left, step)
            failed[left[~good]] = step
            left = left[good]
            out[left] += step
            step *= 2
        while step > 1:
            step //= 2
            at = np.flatnonzero(failed > step)
            at = at[out[at] + step <= limit[at]]
            out[at[more(at, step)]] += step
        return out

    def suffix_array(self) -> None:
        """``sa``, ``rank``: suffixes in order, text by text."""
        key = self.doc * (int(self.w.max()) + 1) + self.w
        sa = np.argsort(key, kind="stable")
        key = key[sa]
        rank = np.zeros(self.n, np.int64)
        at, k = np.arange(self.n), 1
        while len(at):  # ``at``: places in the order that are not final, with their keys
            new = np.concatenate(([True], key[1:] != key[:-1]))
            start = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            rank[sa[at]] = start
            alone = new & np.concatenate((new[1:], [True]))
            at = at[~alone]
            if not len(at):
                break
            own = sa[at]
            then = own + k
            key = rank[own] * (self.n + 1) + np.where(then < self.high[own], rank[np.minimum(then, self.n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            sa[at], key = own[order], key[order]
            k *= 2
        self.sa, self.rank = sa, rank

    def blocks(self) -> np.ndarray:
        """Starts of the blocks of the factorisation: each is the longest stretch
        that also begins further left, or one new word."""
        sa = self.sa
        common = np.zeros(self.n + 1, np.int64)
        a, b = sa[:-1], sa[1:]
        same = self.doc[a] == self.doc[b]
        common[1:-1] = np.where(same, self.extension(a, b, np.where(same, self.high[a] - np.maximum(a, b), 0)), 0)
        order, lcp, longest = [*sa.tolist(), -1], common.tolist(), [0] * self.n
        stack: list[int] = []
        for i, pos in enumerate(order):
            here = lcp[i]
            while stack:
                top = stack[-1]
                at, before = order[top], lcp[top]
                if pos < at:
                    longest[at] = before if before > here else here
                    if before < here:
                        here = before
                elif here <= before:
                    longest[at] = before
                else:
                    break
                stack.pop()
            lcp[i] = here
            stack.append(i)
        starts, i = [], 0
        while i < self.n:
            starts.append(i)
            i += longest[i] or 1
        return np.array(starts)

    def covering(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, root length) of squares that cover the leftmost ones."""
        h = self.blocks()
        end = np.append(h[1:], self.n)  # no block reaches over a text's end
        after = np.append(end[1:], self.n)
        after = np.where(end < self.high[h], after, end)
        found = []

        def pairs(most: np.ndarray):
            block = np.repeat(np.arange(len(h)), most)
            return block, np.arange(len(block)) - np.repeat(np.cumsum(most) - most, most) + 1

        def kept(c, q, k, block, second: bool):
            """Squares over the border before word c, whose halves are k words apart."""
            low, high = self.low[c], self.high[c]
            ok = self.w[c] == self.w[q]
            if second:
                ok &= (c > low) & (self.w[np.maximum(c - 1, 0)] == self.w[np.maximum(q - 1, 0)])
            c, q, k, block, low, high = (x[ok] for x in (c, q, k, block, low, high))
            right = self.extension(c, q, high - np.maximum(c, q))
            left = self.extension(c - 1, q - 1, np.minimum(c, q) - low, back=True)
            base = np.minimum(c, q)
            start = np.maximum(base - left, base - k + 1)
            ok = (right + left >= k) & (right > 0)
            if second:
                ok &= (start + k <= end[block]) & (left > 0)
            found.append((start[ok], k[ok]))

        inner = np.flatnonzero(end < self.high[h])  # blocks that another one of the text follows
        block, k = pairs(np.where(end < self.high[h], end - h, 0))
        if len(inner):
            kept(end[block], end[block] - k, k, block, False)
        block, k = pairs(np.minimum(after, self.high[h] - 1) - h)
        kept(h[block], h[block] + k, k, block, True)
        start, k = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(start * (self.n + 1) + k)
        start, k = both // (self.n + 1), both % (self.n + 1)
        own = self.primitive(start, k)
        return start[own], k[own]

    def primitive(self, start: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the root of a square is no repetition of a shorter one."""
        keep = np.ones(len(k), bool)
        if not len(k):
            return keep
        least = np.arange(int(k.max()) + 1)  # least prime factor
        for p in range(2, int(len(least) ** 0.5) + 1):
            if least[p] == p:
                own = least[p * p :: p]
                own[own == np.arange(p * p, len(least), p)] = p
        rest = k.copy()
        while (at := np.flatnonzero(rest > 1)).size:
            p = least[rest[at]]
            d = k[at] // p
            keep[at] &= ~self.equal(start[at], start[at] + d, 2 * k[at] - d)
            rest[at] //= p
        return keep

    def interval(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the order of the suffixes that begin as the stretch
        of ``size`` from i does: a place in the tree."""
        ends = []
        for sign, far in ((-1, self.low[i]), (1, self.high[i] - 1)):
            inside, out = self.rank[i].copy(), far + sign
            while (at := np.flatnonzero(np.abs(out - inside) > 1)).size:
                mid = (inside[at] + out[at]) // 2
                p = self.sa[mid]
                fits = p + size[at] <= self.high[i[at]]
                fits[fits] = self.equal(p[fits], i[at][fits], size[at][fits])
                inside[at] = np.where(fits, mid, inside[at])
                out[at] = np.where(fits, out[at], mid)
            ends.append(inside)
        return ends[0], ends[1]

    def turned(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """A place of the square at i with its first word moved to its end, or -1:
        a suffix link, and the branch with that word."""
        size = 2 * k - 1
        first, last = self.interval(i + 1, size)
        want, lo, hi = self.w[i], first.copy(), last + 1
        while (at := np.flatnonzero(lo < hi)).size:
            mid = (lo[at] + hi[at]) // 2
            then = self.sa[mid] + size[at]
            word = np.where(then < self.high[i[at]], self.w[np.minimum(then, self.n - 1)], -1)
            lo[at] = np.where(word < want[at], mid + 1, lo[at])
            hi[at] = np.where(word < want[at], hi[at], mid)
        p = self.sa[np.minimum(lo, self.n - 1)]
        then = p + size
        ok = (lo <= last) & (then < self.high[i])
        ok[ok] = self.w[then[ok]] == want[ok]
        return np.where(ok, p, -1)

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """(first place in the order, root length) of each distinct square."""
        i, k = self.covering()
        marked = np.zeros(0, np.int64)
        left = k - 1  # turns until the square itself is back
        while len(i):
            # words that the repetition goes on for
            more = np.minimum(self.extension(i, i + k, self.high[i] - i - k) - k, left)
            at = np.repeat(np.arange(len(i)), more + 1)
            place = i[at] + np.arange(len(at)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            marked = np.union1d(marked, self.interval(place, 2 * k[at])[0] * (self.n + 1) + k[at])
            i, k, left = i + more, k, left - more - 1
            go = left >= 0
            i, k, left = i[go], k[go], left[go]
            i = self.turned(i, k)
            go = i >= 0
            i, k, left = i[go], k[go], left[go]
            mark = self.interval(i, 2 * k)[0] * (self.n + 1) + k
            _, first = np.unique(mark, return_index=True)
            go = np.zeros(len(i), bool)
            go[first] = True
            go &= ~np.isin(mark, marked)
            i, k, left = i[go], k[go], left[go]
        return marked // (self.n + 1), marked % (self.n + 1)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of all runs of two periods and more."""
        self.suffix_array()
        first, k = self.vocabulary()
        _, last = self.interval(self.sa[first], 2 * k)
        places = last - first + 1
        of = np.repeat(np.arange(len(k)), places)
        place = self.sa[np.arange(len(of)) - np.repeat(np.cumsum(places) - places, places) + first[of]]
        both = np.sort(k[of] * (self.n + 1) + place)
        begin = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1] + 1))) if len(both) else np.zeros(0, np.int64)
        final = np.append(begin[1:], len(both))[: len(begin)] - 1
        start, period = both[begin] % (self.n + 1), both[begin] // (self.n + 1)
        return start, both[final] - both[begin] + 2 * period, period


def repeating(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text whether a sequence of ``GRAM`` words may occur twice."""
    out = np.zeros(len(sizes), bool)
    if len(w) < GRAM:
        return out
    rng = np.random.default_rng(_SEED)
    value = rng.integers(0, 1 << 63, int(w.max()) + 1, np.int64).astype(np.uint64)[w]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    odd = rng.integers(0, 1 << 62, GRAM + 1, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    m = len(w) - GRAM + 1
    with np.errstate(over="ignore"):
        h = doc[:m].astype(np.uint64) * odd[GRAM]
        for i in range(GRAM):
            x = value[i : i + m] * odd[i]
            h += x ^ (x >> np.uint64(29))
    inside = doc[:m] == doc[GRAM - 1 :]
    doc, h = doc[:m][inside], h[inside]
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        out[doc[twice[at] == h]] = True
    return out


def runs_of(texts: list[list[bytes]], least_exponent: int = 4, least_words: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the wanted runs of each text, by start and then
    period."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    w = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = np.cumsum(sizes)
    left = np.flatnonzero(sizes >= least_words)
    if (least_exponent - 1) * 2 >= GRAM and least_words > GRAM:
        left = left[repeating(w, sizes)[left]]
    while len(left):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[left]), WORDS_AT_ONCE, "right")))
        own, left = left[:n], left[n:]
        part = np.concatenate([w[ends[d] - sizes[d] : ends[d]] for d in own.tolist()])
        _, part = np.unique(part, return_inverse=True)
        s = Sequences(part, sizes[own])
        start, length, period = s.runs()
        keep = np.flatnonzero(length >= np.maximum(least_words, least_exponent * period))
        keep = keep[np.lexsort((period[keep], start[keep]))]
        for i in keep.tolist():
            d = int(s.doc[start[i]])
            out[own[d]].append((int(start[i] - s.low[start[i]]), int(length[i]), int(period[i])))
    return out


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact exponent; the smallest start and period of
    several."""
    best = None
    for r in runs:
        if best is None or (more := r[1] * best[2] - best[1] * r[2]) > 0 or (more == 0 and (r[0], r[2]) < (best[0], best[2])):
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what any run repeats after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", changed: Callable[[list[bytes], object], list[bytes]] | None = None, least_exponent: int = 4, least_words: int = 6) -> DataFrame:
    """For each row: ``id_col``, ``words`` (binary, the words joined by one space),
    ``runs`` (``start``, ``length``, ``period``, by start and then period) and
    ``collapsed`` (binary, the words that no run repeats, joined by one space).

    Words are what ASCII white space separates.  Null and empty texts have no words
    and no runs; repeated rows have a result each; further columns are left out.
    ``changed`` may give other words for a row's words and id.  A text is searched
    in one task, with memory in proportion to its words."""
    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(plain(df, id_col, text_col), lambda batches: _judged(batches, changed, least_exponent, least_words, _rows(id_col)), f"`{id_col}` {kind}, words binary, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def _judged(batches, changed, least_exponent: int, least_words: int, made) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, 1, SLICE_BYTES):
            words = [t.split() for t in bytes_of(b.column(1))]
            if changed:
                words = [changed(w, i) for w, i in zip(words, b.column(0).to_pylist(), strict=True)]
            runs = runs_of(words, least_exponent, least_words)
            yield made(b.column(0), words, runs)


def _rows(id_col: str):
    def made(ids: pa.Array, words, runs) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        cols = [pa.array([b" ".join(w) for w in words], pa.binary()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], kind), pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)], pa.binary())]
        return pa.RecordBatch.from_arrays([ids, *cols], [id_col, "words", "runs", "collapsed"])

    return made


DIGEST = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", changed: Callable[[list[bytes], object], list[bytes]] | None = None, least_exponent: int = 4, least_words: int = 6) -> DataFrame:
    """``found`` as digests: ``id_col``, ``n_runs``; ``start``, ``length``, ``period``
    and ``exponent_milli`` of the run with the greatest exponent (null without runs),
    all long; ``runs_sha256`` and ``collapsed_sha256``."""

    def made(ids: pa.Array, words, runs) -> pa.RecordBatch:
        rows = []
        for w, own in zip(words, runs, strict=True):
            best = greatest(own)
            four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in own).encode()
            rows.append((len(own), *four, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(collapsed(w, own))).hexdigest()))
        cols = [pa.array([r[i] for r in rows], pa.string() if i > 4 else pa.int64()) for i in range(7)]
        return pa.RecordBatch.from_arrays([ids, *cols], [id_col, *DIGEST])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(plain(df, id_col, text_col), lambda batches: _judged(batches, changed, least_exponent, least_words, made), f"`{id_col}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
