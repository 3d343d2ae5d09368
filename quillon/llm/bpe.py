"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

Encoding.  A text is cut at added special strings and then by the byte-level
pre-token pattern; each pre-token's bytes are the first symbols.  The leaves of
a segment tree hold ``rank << 32 | position`` of each adjacent pair, inner nodes
the smaller child, so the root is the leftmost pair of the lowest rank.  A
merge changes three leaves, each in logarithmic time, until the root is empty:
``n`` symbols cost ``O(n log n)`` however long a pre-token is.

Pre-tokens repeat, so each worker keeps a bounded memo of them, and merges the
new ones of a slice together: the same trees, a row of an array for each.  Decoding
concatenates the tokens' bytes and reads them as UTF-8 with replacement.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_batches, plain, slices, texts_of

#: Fixed value: the byte-level pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker's memo is emptied when it holds so many pre-tokens, and takes none of more characters than that.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 64
_NONE, _LOW = 1 << 62, (1 << 32) - 1
#: Text of a slice that is encoded at once; its pieces live in memory meanwhile.
SLICE_BYTES = 2 << 20
_TWO = re.compile(r"\s\s|\A\s").search
_RUN = re.compile(r"\s (?:\s|\Z)|\A (?:\s|\Z)").search


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those that
    are printable stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge until no pair has a rank.  ``ranks``: ``left << 32 | right`` to
    rank; ``made``: the symbol that each rank makes."""
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << max(0, (n - 2).bit_length())
    get = ranks.get
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        r = get(symbols[i] << 32 | symbols[i + 1])
        if r is not None:
            tree[width + i] = r << 32 | i
    for p in range(width - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) < _NONE:
        i = top & _LOW
        j = after[i]
        k = after[j]
        symbols[i] = own = made[top >> 32]
        symbols[j] = -1
        after[i] = k
        changed = [(j, _NONE)] if j < n - 1 else []
        if k < n:
            before[k] = i
            r = get(own << 32 | symbols[k])
            changed.append((i, _NONE if r is None else r << 32 | i))
        else:
            changed.append((i, _NONE))
        h = before[i]
        if h >= 0:
            r = get(symbols[h] << 32 | own)
            changed.append((h, _NONE if r is None else r << 32 | h))
        for leaf, key in changed:
            p = width + leaf
            if width == 1:
                tree[1] = key
                continue
            tree[p] = key
            while p > 1:
                p >>= 1
                a, b = tree[2 * p], tree[2 * p + 1]
                if b < a:
                    a = b
                if tree[p] == a:
                    break
                tree[p] = a
    return [s for s in symbols if s >= 0]


class ByteBpe:
    """A byte-level BPE vocabulary from the text of a ``tokenizers`` file."""

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        model, pre = d["model"], d["pre_tokenizer"]
        plain_bpe = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain_bpe or d.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level BPE files are supported")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        self.ranks, self.made = {}, []
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in d.get("added_tokens", [])):
            raise ValueError("added tokens with options are not supported")
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._words = regex.compile(PATTERN).findall
        order = np.array(sorted(self.ranks), np.int64)
        self._keys = np.append(order, np.iinfo(np.int64).max)
        self._rank_of = np.array([*map(self.ranks.__getitem__, order.tolist()), 0], np.int64)
        self._made = np.array(self.made, np.int64)
        self._pretokens: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _leaf_keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        pos = np.searchsorted(self._keys, key)
        return np.where(self._keys[pos] == key, self._rank_of[pos] << 32 | at, _NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` for many words at once, a row of the arrays for each; all
        trees have the width of the longest word."""
        size = np.array([len(w) for w in words])
        width = 1 << max(0, int(size.max() - 2).bit_length())
        symbols = np.full((len(words), width + 1), -1, np.int64)
        there = np.arange(width + 1) < size[:, None]
        symbols[there] = np.array(self.first, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((len(words), 2 * width), _NONE, np.int64)
        tree[:, width:] = np.where(there[:, 1:], self._leaf_keys(symbols[:, :-1], symbols[:, 1:], np.arange(width)), _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, width + 2), (len(words), 1))
        before = np.tile(np.arange(-1, width), (len(words), 1))
        row = np.arange(len(words))
        while True:
            top = tree[row, 1]
            live = top < _NONE
            row, top = row[live], top[live]
            if not len(row):
                break
            i, own = top & _LOW, self._made[top >> 32]
            j = after[row, i]
            k = after[row, j]
            symbols[row, i], symbols[row, j], after[row, i] = own, -1, k
            has, h = k < size[row], before[row, i]
            before[row[has], k[has]] = i[has]
            back, inner = h >= 0, j < width
            changed = [
                (row, width + i, np.where(has, self._leaf_keys(own, symbols[row, np.minimum(k, width)], i), _NONE)),
                (row[inner], width + j[inner], np.full(int(inner.sum()), _NONE)),
                (row[back], width + h[back], self._leaf_keys(symbols[row[back], h[back]], own[back], h[back])),
            ]
            for r, p, key in changed:
                tree[r, p] = key
            for r, p, _ in changed:
                while width > 1 and len(p) and p[0] > 1:
                    p = p >> 1
                    tree[r, p] = np.minimum(tree[r, 2 * p], tree[r, 2 * p + 1])
        left = symbols >= 0
        flat, ends = symbols[left].astype("<i4").tobytes(), 4 * np.cumsum(left.sum(1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, pretokens: set[str]) -> None:
        """Put pre-tokens into the memo; those of like length go together."""
        by_width: dict[int, list[str]] = {}
        for w in pretokens:
            n = len(w.encode())
            if n > 65:
                self._pretokens[w] = np.array(merge([self.first[b] for b in w.encode()], self.ranks, self.made), "<i4").tobytes()
            else:
                by_width.setdefault((n - 2).bit_length() if n > 1 else 0, []).append(w)
        for words in by_width.values():
            self._pretokens |= zip(words, self.merge_many([w.encode() for w in words]), strict=True)

    def _pieces_of(self, text: str) -> list[str]:
        """Parts whose pre-tokens are those of the text: cut before each space,
        which no pre-token holds but at its start.  Only a space between white
        space can belong to a longer run; then the pre-tokens are the parts."""
        if _TWO(text) and _RUN(text):
            return self._words(text)
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit numbers."""
        memo, known = self._pieces, self._pretokens
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        if len(known) > MEMO_ENTRIES:
            known.clear()
        memo |= {t: i.to_bytes(4, "little") for t, i in self.added.items()}
        cut, cold = [], set()
        for text in texts:
            parts, at = [], 0
            for m in self._cut.finditer(text) if self._cut else ():
                parts += [*self._pieces_of(text[at : m.start()]), m[0]]
                at = m.end()
            parts += self._pieces_of(text[at:]) if at < len(text) else []
            cold.update(set(parts).difference(memo))
            cut.append(parts)
        # a blank and letters, or letters only, are one pre-token
        split = {p: (p,) if p.isascii() and p.removeprefix(" ").isalpha() else self._words(p) for p in cold}
        self._learn({w for words in split.values() for w in words}.difference(known))
        memo |= {p: known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words]) for p, words in split.items()}
        coded = [b"".join([memo[p] for p in parts]) for parts in cut]
        for p, words in split.items():
            if len(p) > MEMO_CHARS:
                del memo[p]
                for w in words:
                    if len(w) > MEMO_CHARS:
                        known.pop(w, None)
        return coded

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of token ids; ids outside the vocabulary are an error."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _codec(spec: str) -> ByteBpe:
    return ByteBpe(spec)


_SPECS: dict[str, str] = {}


def _held(broadcast) -> ByteBpe:
    """One codec for each file and worker; its memo outlives the task."""
    spec = broadcast.value
    key = hashlib.sha1(spec.encode()).hexdigest()
    return _codec(_SPECS.setdefault(key, spec))


def _spec(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:  # a file of the driver, a few MB
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` (long) and ``ids`` (array of int) for each row.

    ``path``: a byte-level BPE file of the ``tokenizers`` library, read on the
    driver and broadcast (its size is that of the vocabulary).  Null texts are
    empty, empty texts have no tokens, a null id stays null, repeated rows are
    encoded once each, further columns are left out.
    """
    spec = _spec(df, path)

    def run(batches):
        codec = _held(spec)
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                coded = codec.encode_many(texts_of(b.column(1)))
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends).astype(np.int64)), ids], [id_col, "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(plain(df, id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids array<int>")


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep`` and ``decoded``, the text of
    ``ids_col``; special tokens are written out.  Null or empty ids give the
    empty text; bytes that are no UTF-8 become U+FFFD."""
    spec = _spec(df, path)
    names = [id_col, *keep]

    def run(batches):
        codec = _held(spec)
        for b in batches:
            ids = b.column(len(names))
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            texts = [codec.decode(flat[ends[i] : ends[i + 1]].tolist()) if ids[i].is_valid else "" for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], [*names, "decoded"])

    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return map_batches(plain(df, *names, ids_col), run, schema + ", decoded string")


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bpe_encode`` and ``bpe_decode`` in one pass: ``id_col``, ``n_tokens``,
    ``ids`` and ``decoded``.  A row's ids do not leave the worker in between, and
    a task needs one worker."""
    spec = _spec(df, path)

    def run(batches):
        codec = _held(spec)
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                coded = [np.frombuffer(x, np.int32) for x in codec.encode_many(texts_of(b.column(1)))]
                ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded)))
                texts = pa.array([codec.decode(x.tolist()) for x in coded], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends).astype(np.int64)), ids, texts], [id_col, "n_tokens", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(plain(df, id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The digest of an encoding and of what it decodes to, for each row."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return bpe_round_trip(docs, path).select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
