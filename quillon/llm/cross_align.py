"""Alignment of two tokenizers over a corpus by segment deduplication.

A text is encoded by a byte-level BPE (A: with a space before it) and a piece BPE
with byte fallback (B: which puts that space itself).  Both sequences of tokens
cover the same bytes; where a token of each ends, a group ends and those two tokens
are linked.

1. Segments.  A text is split before runs of spaces and line feeds that follow
   something else than white space.  No token reaches over such a place: A's scanner
   has no match that goes on from another character into white space and none that
   looks back, and no piece of B has a space after another character, which
   ``checked`` verifies for the given vocabulary.  So the tokens of a text are those
   of its segments.
2. Blocks.  Texts that follow each other in a task are a block of bounded size with
   its own list of distinct segments, and are kept as places in that list.
3. Lists meet by segment.  Each distinct segment is encoded and aligned there once,
   and what is found goes to all its rows; its links are weighted by how often it
   occurs.  Of two tokens that end together one's bytes end with the other's, so the
   vocabularies bound the number of pairs of ids; their counts, and nothing else, go
   through the driver.
4. Lists with alignments and texts meet by block, and documents are put together
   from their segments.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_batches, plain, slices, texts_of
from quillon.session import materialised

#: Bytes of the texts of a block; a longer text is a block of its own.
BLOCK_BYTES = 24 << 20
#: Rows of a list that are held as one, and segments that are encoded at once.
LIST_ROWS, AT_ONCE = 20_000, 20_000
#: White space of any kind and format characters next to which no text is split.
ODD = "\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿"
#: A run of spaces and line feeds and what follows it.
SEGMENT = re.compile(rf"[ \n]+[^ \n]*(?:(?<=[{ODD}])[ \n]+[^ \n]*)*")
#: B writes a space so, and reads this character as one: a text that has it comes back with other bytes.
MARK = "▁"


def byte_values() -> dict[str, int]:
    """A byte-level vocabulary's character for each byte: printable ones stand for
    themselves, the others are numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def checked(spec: str, pieces: list[str]) -> None:
    """Whether segments are independent with these vocabularies."""
    told = json.loads(spec)
    scan = told["pre_tokenizer"] or {}
    if told["normalizer"] or scan.get("type") != "ByteLevel" or not scan.get("use_regex") or scan.get("add_prefix_space"):
        raise ValueError("the first tokenizer must be a byte-level BPE that scans texts as they stand")
    if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
        raise ValueError("a piece reaches over a split: it has a space after another character, or a line feed")


class Aligner:
    """Both tokenizers: ids, bytes and links of segments."""

    def __init__(self, spec: str, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=model)
        value, added = byte_values(), {i for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = {i: bytes(value[c] for c in t) for t, i in self.a.get_vocab().items() if i not in added}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i))}
        self.space = self.b.piece_to_id(MARK)
        self.a_size, self.b_size = (np.zeros(max(x) + 1, np.int64) for x in (self.a_bytes, self.b_bytes))
        for size, x in ((self.a_size, self.a_bytes), (self.b_size, self.b_bytes)):
            for i, t in x.items():
                size[i] = len(t)

    def pairs(self) -> np.ndarray:
        """Codes of all pairs of ids of which one's bytes end with the other's,
        ascending."""
        by_bytes: tuple[dict[bytes, list[int]], ...] = ({}, {})
        for held, x in zip(by_bytes, (self.a_bytes, self.b_bytes), strict=True):
            for i, t in x.items():
                held.setdefault(t, []).append(i)
        found = set()
        for t, ids in by_bytes[0].items():
            for k in range(len(t)):
                found.update(self.code(a, b) for b in by_bytes[1].get(t[k:], ()) for a in ids)
        for t, ids in by_bytes[1].items():
            for k in range(1, len(t)):
                found.update(self.code(a, b) for a in by_bytes[0].get(t[k:], ()) for b in ids)
        return np.array(sorted(found), np.int64)

    @staticmethod
    def code(a, b):
        return a * (1 << 20) + b

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each segment as within a text; B's own first space stands for the
        segment's, or is taken off."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        spaced = [s[0] == " " for s in segments]
        b = self.b.encode([s[1:] if x else s for s, x in zip(segments, spaced, strict=True)], num_threads=1)
        return a, [(ids if x else ids[1:]) if len(s) > 1 or not x else [self.space] for s, x, ids in zip(segments, spaced, b, strict=True)]

    def aligned(self, segments: list[str], codes: np.ndarray) -> Iterator[tuple[bool, int, int, str, bytes]]:
        """Of each segment: whether both sequences have its bytes, tokens of A and
        B, its groups as text, its links as 32-bit places in ``codes``."""
        ids_a, ids_b = self.encoded(segments)
        get_a, get_b = self.a_bytes.get, self.b_bytes.get
        ok = [b"".join([get_a(i, b"") for i in a]) == (d := s.encode()) and b"".join([get_b(i, b"") for i in b]) == d for a, b, s in zip(ids_a, ids_b, segments, strict=True)]
        # of those that agree, all one after the other: ends that both have end groups, and no group reaches over a segment's end
        flat_a, flat_b = (np.array([i for ids, good in zip(x, ok, strict=True) if good for i in ids], np.int64) for x in (ids_a, ids_b))
        _, at_a, at_b = np.intersect1d(np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b]), assume_unique=True, return_indices=True)
        links = np.searchsorted(codes, self.code(flat_a[at_a], flat_b[at_b])).astype(np.uint32)
        last_a, last_b = at_a.tolist(), at_b.tolist()
        k = first_a = first_b = 0
        for a, b, good in zip(ids_a, ids_b, ok, strict=True):
            if not good:
                yield False, 0, 0, "", b""
                continue
            groups, own, i, j = [], k, 0, 0
            while i < len(a):
                m, n = last_a[k] + 1 - first_a, last_b[k] + 1 - first_b
                groups.append(f"{','.join(map(str, a[i:m]))}|{','.join(map(str, b[j:n]))}")
                i, j, k = m, n, k + 1
            first_a, first_b = first_a + len(a), first_b + len(b)
            yield True, len(a), len(b), ";".join(groups), links[own:k].tobytes()


_HELD: dict[int, tuple[str, bytes]] = {}


@lru_cache(maxsize=2)
def _aligner(key: int) -> Aligner:
    return Aligner(*_HELD[key])


def aligner(held) -> Aligner:
    """The worker's own one, from the broadcast files."""
    key = hash(held.value)
    _HELD[key] = held.value
    return _aligner(key)


def split(text: str) -> Iterator[str]:
    """Segments of a text with its space before it."""
    whole = " " + text
    return iter(SEGMENT.findall(whole)) if len(whole) < 1 << 22 else (m.group() for m in SEGMENT.finditer(whole))


def coded(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of texts (``id``, ``seq``: places of the segments in the block's list as
    32-bit numbers, null if there are no tokens) and of lists (``first``, ``keys``,
    ``times``), each with its ``block``."""
    kind = docs.schema["id"].dataType

    def run(batches):
        made, held, places, seqs = 0, 0, {}, []
        base = TaskContext.get().partitionId() << 32
        none = pa.nulls

        def lists():
            keys = list(places)
            times = np.bincount(np.concatenate(seqs), minlength=len(keys)) if seqs else np.zeros(0, np.int64)
            for at in range(0, len(keys), LIST_ROWS):
                own, n = keys[at : at + LIST_ROWS], times[at : at + LIST_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([base + made]), none(1, id_type), none(1, pa.binary()), pa.array([at]), pa.array([own], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64()))], names)

        names, id_type = ["block", "id", "seq", "first", "keys", "times"], None
        for whole in batches:
            id_type = whole.column(0).type
            for b in slices(whole, 1):
                rows = []
                for text in texts_of(b.column(1)):
                    if not text or MARK in text:
                        rows.append(None)
                        continue
                    seq = np.array([places.setdefault(s, len(places)) for s in split(text)], np.uint32)
                    seqs.append(seq)
                    rows.append(seq.tobytes())
                    held += len(text)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, base + made)), b.column(0), pa.array(rows, pa.binary()), none(n, pa.int64()), none(n, pa.list_(pa.string())), none(n, pa.list_(pa.int64()))], names)
                if held >= block_bytes:
                    yield from lists()
                    made, held, places, seqs = made + 1, 0, {}, []
        if id_type is not None:
            yield from lists()

    return map_batches(docs, run, f"block long, id {kind.simpleString()}, seq binary, first long, keys array<string>, times array<long>")


def aligned_lists(lists: DataFrame, held, codes) -> DataFrame:
    """Lists (``block``, ``k``, ``key``, ``times``) met by segment: ``block``, ``k``,
    ``ok``, ``n_a``, ``n_b``, ``groups``, ``links`` (32-bit places of the pairs), and
    ``times``, how often the segment occurs in all of them, once for each batch that
    has it and else null.  A segment is encoded where its rows meet, once."""

    def run(batches):
        own = aligner(held)
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                coding = b.column(2).dictionary_encode()
                where = coding.indices.to_numpy()
                cols = [pa.array(x, k) for x, k in zip(zip(*own.aligned(coding.dictionary.to_pylist(), codes.value), strict=True), (pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)]
                total = np.bincount(where, b.column(3).to_numpy()).astype(np.int64)
                _, first = np.unique(where, return_index=True)
                other = np.ones(len(where), bool)
                other[first] = False
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(c.take(coding.indices) for c in cols), pa.array(total[where], mask=other)], ["block", "k", "ok", "n_a", "n_b", "groups", "links", "times"])

    met = lists.select("block", "k", "key", "times").repartition("key").sortWithinPartitions("key")
    return map_batches(met, run, "block long, k long, ok boolean, n_a int, n_b int, groups string, links binary, times long")


def pair_counts(rows: DataFrame, pairs: int) -> DataFrame:
    """``pair``, ``n``: how many links of ``rows`` (``times``, ``links``) have it; a
    row for each task and pair at most before the sum."""

    def run(batches):
        total = np.zeros(pairs, np.int64)
        for b in batches:
            links = b.column(1).to_pylist()
            each = np.repeat(b.column(0).to_numpy(), [len(x) // 4 for x in links])
            np.add.at(total, np.frombuffer(b"".join(links), np.uint32), each)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return map_batches(rows.select("times", "links"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(lists: DataFrame, counts) -> DataFrame:
    """Aligned lists with ``n_groups``, ``n_best``, ``count_sum`` of one occurrence."""

    def run(batches):
        count, best = counts.value
        for b in batches:
            links = b.column(6).to_pylist()
            flat, n = np.frombuffer(b"".join(links), np.uint32), np.array([len(x) // 4 for x in links])
            ends = np.concatenate(([0], np.cumsum(n)))
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (best[flat].astype(np.int64), count[flat])]
            cols = [pa.array(x, k) for x, k in ((n, pa.int32()), (sums[0], pa.int32()), (sums[1], pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *cols], ["block", "k", "ok", "n_a", "n_b", "groups", "n_groups", "n_best", "count_sum"])

    columns = ["block", "k", "ok", "n_a", "n_b", "groups", "links"]
    return map_batches(lists.select(columns), run, "block long, k long, ok boolean, n_a int, n_b int, groups string, n_groups int, n_best int, count_sum long")


def failing(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """``block``, ``k``, ``less``: how often each segment occurs in texts that have one
    of the segments ``bad`` (``block``, ``k``) too: those texts have no tokens, so their
    links count nowhere."""

    def run(key, texts: pa.Table, places: pa.Table) -> pa.Table:
        seqs = [np.frombuffer(x, np.uint32) for x in texts.column("seq").to_pylist()]
        wrong = places.column("k").to_numpy()
        out = [s for s in seqs if np.isin(s, wrong).any()]
        k, n = np.unique(np.concatenate(out), return_counts=True) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"block": pa.array(np.full(len(k), key[0].as_py())), "k": pa.array(k.astype(np.int64)), "less": pa.array(n.astype(np.int64))})

    near = rows.filter("seq IS NOT NULL").select("block", "seq").join(bad.select("block").distinct(), "block", "left_semi")
    return near.toDF("of", "seq").groupBy("of").cogroup(bad.groupBy("block")).applyInArrow(run, "block long, k long, less long")


def composed(rows: DataFrame, lists: DataFrame, id_col: str) -> DataFrame:
    """Documents from their segments: lists and texts meet by block."""
    names = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]

    def run(key, texts: pa.Table, words: pa.Table) -> pa.Table:
        place = words.column("k").to_numpy()
        table = np.zeros((len(place), len(names)), np.int64)
        ok = np.zeros(len(place), bool)
        text: list[str] = [""] * len(place)
        for i, n in enumerate(names):
            table[place, i] = words.column(n).to_numpy()
        ok[place] = words.column("ok").to_numpy()
        for k, g in zip(place.tolist(), words.column("groups").to_pylist(), strict=True):
            text[k] = g
        out, digests = np.zeros((texts.num_rows, len(names)), np.int64), []
        for i, x in enumerate(texts.column("seq").to_pylist()):
            seq = np.frombuffer(x or b"", np.uint32)
            if not len(seq) or not ok[seq].all():
                digests.append("")
                continue
            out[i] = table[seq].sum(0)
            h = hashlib.sha256()
            for at in range(0, len(seq), 100_000):
                h.update((";" * bool(at) + ";".join([text[k] for k in seq[at : at + 100_000].tolist()])).encode())
            digests.append(h.hexdigest())
        n_a, n_b, n_groups, n_best, count_sum = (pa.array(out[:, i]) for i in range(len(names)))
        return pa.table([texts.column("id"), n_a, n_b, n_groups, n_groups, n_best, count_sum, pa.array(digests, pa.string())], [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.toDF("of", "id", "seq").groupBy("of").cogroup(lists.groupBy("block")).applyInArrow(run, schema)


def aligned(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: ``id_col``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``
    (a group's last tokens end together and no others do, so as many), ``n_best``
    (links whose pair of ids is the most frequent of its B id, ties included),
    ``count_sum`` (over links, how often the pair is linked in the corpus), all long,
    and ``groups_sha256``.

    Null and empty texts, and those of which a tokenizer does not give back the
    bytes, have no tokens: zeros and an empty digest.  Special strings in a text are
    plain text; repeated rows count once each; further columns are left out."""
    spark = df.sparkSession
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:  # vocabularies, a few MB
        files = f.read(), g.read()
    own = Aligner(*files)
    checked(files[0], [own.b.id_to_piece(i) for i in own.b_bytes if not own.b.is_byte(i)])
    held, codes = spark.sparkContext.broadcast(files), own.pairs()

    docs = plain(df, id_col, text_col).toDF("id", "text")
    both = materialised(spark, coded(docs, block_bytes), "align-coded")
    rows = both.filter("keys IS NULL").select("block", "id", "seq")
    pieces = both.filter("keys IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.col("times").alias("times"))).alias("at", "x"))
    lists = pieces.select("block", (F.col("first") + F.col("at")).alias("k"), "x.key", "x.times")
    known = materialised(spark, aligned_lists(lists, held, spark.sparkContext.broadcast(codes)), "align-lists")
    counts = pair_counts(known.filter("ok AND times IS NOT NULL"), len(codes))
    bad = known.filter("NOT ok").select("block", "k")
    if not bad.isEmpty():
        less = failing(rows, bad).join(known.filter("ok").select("block", "k", "links"), ["block", "k"])
        taken = pair_counts(less.select((-F.col("less")).alias("times"), "links"), len(codes))
        counts = counts.unionByName(taken).groupBy("pair").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # no more rows than codes
    count, of = np.zeros(len(codes), np.int64), codes % (1 << 20)
    count[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    most = np.zeros(of.max() + 1, np.int64)
    np.maximum.at(most, of, count)
    best = (count > 0) & (count == most[of])
    return composed(rows, scored(known, spark.sparkContext.broadcast((count, best))), id_col)
