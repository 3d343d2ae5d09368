"""Benchmark decontamination: every passage of the corpus is a query against a
BM25 inverted index of the test items.

Scores are divided by the item's score for itself, so 1 means that a passage
has all the words of an item, whatever their weights, and one threshold serves
all items.  Postings are in blocks of ``BLOCK`` items with the greatest impact
of each block.

Items are dealt to classes by length, and each class has an index and a stride
``s`` of its own, a power of two above its lengths, so what is found of an item
does not hang on how long others are.  A document is cut into passages of ``2 s``
words, one every ``s`` words, so each run of up to ``s + 1`` words lies wholly in
one.  For all passages of a batch at once the block maxima of their words are added up; where no block reaches the
threshold, no item can.  The other passages are queried by block-max WAND:
cursors over the postings, a pivot from the words' maxima, blocks skipped by
their maxima, full scores only where both allow it.

What is retrieved is verified: the shares of the question's and of the answer's
word trigrams that the passage has must both reach a limit.

Only indexes are shipped.  A bundle of them, one for each class, holds at most
``INDEX_ITEMS`` items and ``INDEX_BYTES`` of text, with word statistics of all
items; a scan of the documents takes up to ``SCAN_BUNDLES``, and only a larger
benchmark needs a further scan.  Documents are never shuffled.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bytes_of, map_batches, plain, slices

K1, B, BLOCK = 1.2, 0.75, 4
#: Block maxima that are added up at once, and sums that are held for that, for bounded memory.
ADD_AT_ONCE, SUMS_AT_ONCE = 1 << 19, 1 << 22
INDEX_ITEMS, INDEX_BYTES, SCAN_BUNDLES = 20_000, 16 << 20, 4
LEAST_STRIDE = 64
#: Fixed value: A-Z lower-cased, ASCII punctuation and white space as spaces.
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\r\x0b\x0c"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _PUNCT, bytes(range(97, 123)) + b" " * len(_PUNCT))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(data: bytes) -> list[bytes]:
    return [w for w in data.translate(_FOLD).split(b" ") if w]


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """(question, answer) as words: the answer is the last sentence, or of a
    single sentence the last third of its words."""
    sentences = [s for x in _SENTENCE.split(text) if (s := words_of(x.encode()))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def grams(words: list[bytes], n: int = 3) -> set[bytes]:
    n = min(n, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """The share of the part's trigrams that are in the passage; a shorter part
    is one gram.  A part without words is there."""
    want = grams(part)
    return len(want & grams(passage, min(3, len(part)))) / len(want) if want else 1.0


@dataclass
class Index:
    ids: list[int]
    question: list[list[bytes]]
    answer: list[list[bytes]]
    stride: int
    vocab: dict[bytes, int] = field(default_factory=dict)
    #: By term: items, impacts, greatest impact, blocks, block maxima.
    items: list[array] = field(default_factory=list)
    impacts: list[array] = field(default_factory=list)
    most: list[float] = field(default_factory=list)
    blocks: list[array] = field(default_factory=list)
    block_most: list[array] = field(default_factory=list)


def build(rows: list[tuple[int, str]], n_items: int, mean_words: float, doc_freq: dict[bytes, int], stride: int) -> Index:
    one: dict[bytes, bytes] = {}  # a word is held once
    both = [tuple([one.setdefault(w, w) for w in part] for part in parts(t)) for _, t in rows]
    index = Index([i for i, _ in rows], [q for q, _ in both], [a for _, a in both], stride)
    postings: dict[bytes, list[tuple[int, float]]] = {}
    for at, (q, a) in enumerate(both):
        words = q + a
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        impact = {w: np.log(1 + (n_items - doc_freq[w] + 0.5) / (doc_freq[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words)) for w, tf in counts.items()}
        own = sum(impact[w] for w in sorted(impact))
        for w, x in impact.items():
            postings.setdefault(w, []).append((at, x / own))
    for k, w in enumerate(sorted(postings)):
        index.vocab[w] = k
        items = np.array([i for i, _ in postings[w]], np.int64)
        impacts = np.array([x for _, x in postings[w]])
        starts = np.flatnonzero(np.diff(items // BLOCK, prepend=-1))
        index.items.append(array("l", items.tolist()))
        index.impacts.append(array("d", impacts.tolist()))
        index.most.append(float(impacts.max()))
        index.blocks.append(array("l", (items[starts] // BLOCK).tolist()))
        index.block_most.append(array("d", np.maximum.reduceat(impacts, starts).tolist()))
    return index


def wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of each item whose score for the distinct ``terms`` reaches
    the threshold, by block-max WAND."""
    end = len(index.ids)
    found = []
    cursors = [[index.items[t][0], t, 0] for t in terms]
    slack = threshold - 1e-9  # sums in another order may differ in the last bits

    def move(c: list, to: int) -> None:
        items = index.items[c[1]]
        c[2] = k = bisect_left(items, to, c[2])
        c[0] = items[k] if k < len(items) else end

    while True:
        cursors = [c for c in cursors if c[0] < end]
        cursors.sort()
        bound, pivot = 0.0, -1
        for p, c in enumerate(cursors):
            bound += index.most[c[1]]
            if bound >= slack:
                pivot = p
                break
        if pivot < 0:
            return found
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        block, bound, until = item // BLOCK, 0.0, end
        for c in cursors[: pivot + 1]:
            blocks = index.blocks[c[1]]
            k = bisect_left(blocks, block)
            if k < len(blocks) and blocks[k] == block:
                bound += index.block_most[c[1]][k]
        if bound < slack:  # no item of this block can reach it with these words
            until = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                until = min(until, cursors[pivot + 1][0])
            for c in cursors[: pivot + 1]:
                if c[0] < until:
                    move(c, until)
        elif cursors[0][0] == item:
            score = sum(index.impacts[c[1]][c[2]] for c in sorted(cursors[: pivot + 1], key=lambda c: c[1]))
            if score >= slack:
                found.append((item, score))
            for c in cursors[: pivot + 1]:
                move(c, item + 1)
        else:
            for c in cursors[:pivot]:
                if c[0] < item:
                    move(c, item)


def matches(index: Index, texts: list[bytes], threshold: float, question_share: float, answer_share: float) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(text, item, score, question's share, answer's share, passage) of the
    best verified passage of each text and item."""
    s, n_blocks, n_terms = index.stride, -(-len(index.ids) // BLOCK), len(index.vocab)
    get = index.vocab.get
    all_words = [words_of(t) for t in texts]
    terms = [np.array([get(w, -1) for w in words], np.int64) for words in all_words]
    #: Passage p of a text covers its words [p s, p s + 2 s).
    first, keys = [0], []
    for ids in terms:
        n = max(1, -(-(len(ids) - s) // s)) if len(ids) else 0
        at = np.flatnonzero(ids >= 0)
        own, p = ids[at], at // s
        keys += [(first[-1] + q[there]) * n_terms + own[there] for q, there in ((p, p < n), (p - 1, p > 0))]
        first.append(first[-1] + n)
    if not n_terms or not first[-1]:
        return
    distinct = np.unique(np.concatenate(keys))
    passage_of, term = distinct // n_terms, distinct % n_terms
    size = np.array([len(b) for b in index.blocks])
    start = np.cumsum(size) - size
    flat_block, flat_most = (np.concatenate([np.asarray(x) for x in y]) for y in (index.blocks, index.block_most))
    added = np.cumsum(size[term])
    best: dict[tuple[int, int], tuple] = {}
    lo = 0
    while lo < len(distinct):
        hi = int(np.searchsorted(added, added[lo] + ADD_AT_ONCE))
        hi = min(hi, int(np.searchsorted(passage_of, passage_of[lo] + max(1, SUMS_AT_ONCE // n_blocks), "left")))
        if hi < len(distinct):  # whole passages
            hi = int(np.searchsorted(passage_of, passage_of[hi], "left"))
        if hi <= lo:
            hi = int(np.searchsorted(passage_of, passage_of[lo], "right"))
        own, count, where = term[lo:hi], size[term[lo:hi]], passage_of[lo:hi] - passage_of[lo]
        at = np.repeat(start[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        n = int(where[-1]) + 1
        bound = np.bincount(np.repeat(where, count) * n_blocks + flat_block[at], flat_most[at], n * n_blocks).reshape(n, n_blocks)
        for k in np.flatnonzero((bound >= threshold - 1e-9).any(1)):
            t = int(np.searchsorted(first, passage_of[lo] + k, "right")) - 1
            p = int(passage_of[lo] + k) - first[t]
            words = all_words[t][p * s : (p + 2) * s]
            for item, score in wand(index, own[where == k].tolist(), threshold):
                q, a = overlap(index.question[item], words), overlap(index.answer[item], words)
                if q >= question_share and a >= answer_share:
                    rank = (-(q + a), -score, p)
                    if (t, item) not in best or rank < best[t, item][0]:
                        best[t, item] = (rank, score, q, a, p)
        lo = hi
    for (t, item), (_, score, q, a, p) in sorted(best.items()):
        yield t, item, score, q, a, p


def stride_of(n_words: int) -> int:
    return max(LEAST_STRIDE, 1 << int(n_words).bit_length())


def bundles(benchmark: DataFrame, item_col: str, text_col: str, index_items: int, index_bytes: int) -> Iterator[list[Index]]:
    """Indexes of all items with text, by class of length, in bundles of bounded
    size, with statistics of all items."""
    spark = benchmark.sparkSession
    items = plain(benchmark, item_col, text_col).toDF("item", "text").filter("item IS NOT NULL AND text IS NOT NULL").distinct()

    def counted(batches):
        for whole in batches:
            for b in slices(whole, 1):
                found = [[*q, *a] for q, a in map(parts, b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([sorted(set(w)) for w in found], pa.list_(pa.binary())), pa.array([len(w) for w in found], pa.int64())], ["words", "n"])

    words = map_batches(items, counted, "words array<binary>, n long").filter("n > 0")
    n, mean = words.agg(F.count("*"), F.avg("n")).first()
    if not n:
        return
    freq = words.select(F.explode("words").alias("w")).groupBy("w").count()

    def made(rows: list[tuple[int, str]]) -> list[Index]:
        classes: dict[int, list[tuple[int, str]]] = {}
        vocab: set[bytes] = set()
        for row in rows:
            own = [w for p in parts(row[1]) for w in p]
            vocab.update(own)
            classes.setdefault(stride_of(len(own)), []).append(row)
        known = spark.createDataFrame([(w,) for w in sorted(vocab)], "w binary")
        doc_freq = {bytes(r.w): r["count"] for r in freq.join(known, "w").collect()}  # as many as one bundle has
        return [build(own, n, mean, doc_freq, stride) for stride, own in sorted(classes.items())]

    held, size = [], 0
    for r in items.sort("item", "text").toLocalIterator():
        if not any(parts(r.text)):
            continue
        held.append((r.item, r.text))
        size += len(r.text.encode())
        if len(held) >= index_items or size >= index_bytes:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def scans(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, index_items: int, index_bytes: int):
    """A broadcast of indexes for each scan of the documents."""
    found = bundles(benchmark, item_col, text_col, index_items, index_bytes)
    while group := [i for bundle in islice(found, SCAN_BUNDLES) for i in bundle]:
        yield docs.sparkSession.sparkContext.broadcast(group)  # bounded by index_items, index_bytes and SCAN_BUNDLES


SCHEMA = "item_id {}, score double, question_share double, answer_share double, passage long"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, question_share: float = 0.6, answer_share: float = 0.6, index_items: int = INDEX_ITEMS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``id_col``, ``item_id``, ``score``, ``question_share``, ``answer_share`` and
    ``passage`` (number of the best one, among those of the item's class) for each
    row of ``docs`` and item of which a passage is retrieved and verified.

    Null and empty texts have no passage; items with a null id or text or without
    words match nothing; equal items are one; repeated rows have a result each;
    further columns are left out."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {SCHEMA.format(item_kind)}"
    out = None
    for held in scans(docs, benchmark, item_col, item_text_col, index_items, index_bytes):

        def run(batches, held=held):
            for whole in batches:
                for b in slices(whole, 1):
                    texts = bytes_of(b.column(1))
                    rows = [(t, index.ids[i], *rest) for index in held.value for t, i, *rest in matches(index, texts, threshold, question_share, answer_share)]
                    if rows:
                        t, item, *rest = zip(*rows, strict=True)
                        cols = [b.column(0).take(pa.array(t)), pa.array(item), *(pa.array(c) for c in rest)]
                        yield pa.RecordBatch.from_arrays(cols, [id_col, "item_id", "score", "question_share", "answer_share", "passage"])

        found = map_batches(plain(docs, id_col, text_col), run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, question_share: float = 0.6, answer_share: float = 0.6, index_items: int = INDEX_ITEMS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that have no contaminated passage.  Each
    row is judged by its own text where it is read, whatever its id; null and
    empty texts stay."""
    out, at = docs, docs.columns.index(text_col)
    for held in scans(docs, benchmark, item_col, item_text_col, index_items, index_bytes):

        def run(batches, held=held):
            for whole in batches:
                for b in slices(whole, at):
                    texts = bytes_of(b.column(at))
                    keep = np.ones(len(texts), bool)
                    for index in held.value:
                        keep[[t for t, *_ in matches(index, texts, threshold, question_share, answer_share)]] = False
                    yield b.filter(pa.array(keep))

        out = map_batches(out, run, docs.schema)
    return out
