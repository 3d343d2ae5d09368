"""Token counts of whole texts, huge ones by overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap by
``overlap_chars``, and the library encodes each chunk with offsets.  Two chunks
are spliced at a place in their overlap where a token begins in both and that is
proven to be stable, so that what follows depends on nothing before it, and what
is before it on nothing that follows:

* No added string holds the place, so none is cut there.
* The character before it is white space of ASCII, which no pre-token, added
  string or Unicode composition spans; or the characters on both sides are of
  those of which none composes with a neighbour, and every scanner cuts between
  them whatever stands around: after or before a digit, between a letter and a
  mark (but for what may be an English contraction).  The scanner of the
  pre-tokenizer has no look-behind, so both encodings go on alike from there.
* It is before the earlier chunk's end, so that its scanner has seen the character
  at which the pre-token before the place ended.

The earlier chunk's tokens before the place and the later one's from it on are
counted; two chunks are held at a time.  If an overlap has no such place
it is widened, twofold each time, to the left as far as the last splice and then
to the right, until it has one or the text ends: only a single endless word is
thus encoded at once, as it is one pre-token for the library too.

Shorter texts need no chunks.  Their pieces between white space are independent
by the same proof, so a worker keeps a bounded memo of the library's counts for
short pieces and encodes only new ones, all of a slice in one call.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillon.llm.common import map_batches, plain, slices, texts_of

SPACE = " \t\n\r"
#: Fixed value: the pre-tokenizer's pattern for which the classes below are proven.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ranges of letters, digits and marks that compose with no neighbour.
LETTERS = (("A", "Z"), ("a", "z"), ("А", "я"), ("一", "龥"))
DIGITS = (("0", "9"),)
MARKS = (("!", "/"), (":", "@"), ("[", "`"), ("{", "~"), ("、", "〃"), ("〈", "】"), ("！", "／"), ("：", "＠"))
SLICE_BYTES = 2 << 20
MEMO_ENTRIES, MEMO_CHARS = 600_000, 48


def _class(ranges) -> str:
    return "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in ranges)


_L, _N, _M = (_class(x) for x in (LETTERS, DIGITS, MARKS))
_PIECES = re.compile(rf"[^{SPACE}]+")
#: ASCII separators that Python, but not the library, takes for white space, and those that only the library's \s has.
_ODD = re.compile(r"[\x0b\x0c\x1c-\x1f]").search
_AFTER_SPACE = re.compile(rf"(?<=[{SPACE}])[^{SPACE}]")
_PLACE = re.compile(rf"(?<=[{SPACE}])[^{SPACE}]|(?<=[{_N}])[{_L}{_N}{_M}]|(?<=[{_L}{_M}])[{_N}]|(?<=[{_L}])[{_M}]|(?<=[{_M}])(?<!')[{_L}]")


class ChunkEncoder:
    """Counts tokens through a tokenizer of the ``tokenizers`` library.  It must
    drop white space and split at it."""

    def __init__(self, tokenizer) -> None:
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._tok = tokenizer
        probe = tokenizer.encode_batch(["a b", "a\nb", "a \t\r b", "a", "b"], add_special_tokens=False)
        if any(e.ids != probe[3].ids + probe[4].ids for e in probe[:3]):
            raise ValueError("this tokenizer does not drop and split at white space")
        added = list(tokenizer.get_added_tokens_decoder().values())
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or set(t.content) & set(SPACE) for t in added):
            raise ValueError("added strings must be matched as they stand and hold no white space")
        self._added = [t.content for t in added]
        self._memo: dict[str, int] = {}
        steps = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
        found = [s.get("pattern", {}).get("Regex") for s in steps.get("pretokenizers", [steps])]
        self._place = _PLACE if PATTERN in found else _AFTER_SPACE

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts, from those of their pieces."""
        memo = self._memo
        pieces = [t.split() if t.isascii() and not _ODD(t) else _PIECES.findall(t) for t in texts]
        new = list({w for p in pieces for w in p if w not in memo})
        memo |= zip(new, map(len, self._tok.encode_batch_fast(new, add_special_tokens=False)), strict=True)
        out = [sum([memo[w] for w in p]) for p in pieces]
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        else:
            for w in new:
                if len(w) > MEMO_CHARS:
                    del memo[w]
        return out

    def encode(self, chunk: str):
        """The library's encoding of a chunk, with offsets."""
        return self._tok.encode(chunk, add_special_tokens=False)

    def stable(self, text: str, low: int, high: int) -> list[int]:
        """The stable places of ``text`` in ``(low, high)``, the last one first."""
        part, base = text[low:high], low
        return [base + m.start() for m in reversed(list(self._place.finditer(part))) if m.start() and not self._held(text, base + m.start())]

    def _held(self, text: str, at: int) -> bool:
        """Whether an added string begins before ``at`` and ends after it."""
        return any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in self._added)


def before(encoding, place: int) -> int | None:
    """The tokens before ``place``, if one begins there."""
    k = encoding.char_to_token(place)
    return k if k is not None and encoding.token_to_chars(k)[0] == place else None


def resynchronised(text: str, encode: Callable, stable: Callable[[str, int, int], list[int]], chunk_chars: int, overlap_chars: int) -> tuple[int, int, int]:
    """(tokens, chunks, widened overlaps) of a text.  ``encode(chunk)`` gives the
    library's encoding, ``stable(text, low, high)`` the stable places between two
    places, from the right."""
    n = len(text)
    total, chunks, widened = 0, 1, 0
    last = at = 0  # the last splice; where the current chunk begins
    skip = 0  # tokens of the current chunk before the last splice
    end = min(n, chunk_chars)
    now = encode(text[:end])
    while end < n:
        wide, size, found = overlap_chars, chunk_chars, None
        while found is None:
            left = max(last, end - wide)
            to = min(n, max(left + size, end + 1))
            then = encode(text[left:to])
            places = ((c, before(now, c - at), before(then, c - left)) for c in stable(text, left, end) if c > last)
            found = next((x for x in places if x[1] is not None and x[2] is not None), None)
            if found is None:
                widened += 1
                wide, size = 2 * wide, max(size, 4 * wide)
                if left == last:  # nothing more to the left: the chunk itself is widened
                    at, end, skip = last, min(n, last + 2 * (end - last)), 0
                    now = encode(text[at:end])
                    if end == n:
                        return total + len(now), chunks, widened
        last, first, again = found
        total += first - skip
        at, end, now, skip = left, to, then, again
        chunks += 1
    return total + len(now) - skip, chunks, widened


@lru_cache(maxsize=4)
def _encoder(spec: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return ChunkEncoder(Tokenizer.from_str(spec))


_HELD: dict[int, str] = {}


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16384, overlap_chars: int = 512) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``n_chunks`` and
    ``n_widened`` (overlaps that had to be widened), all long, for each row.

    ``path``: a file of the ``tokenizers`` library that drops white space.  No
    special tokens are added; special strings in a text are handled as by the
    library's default.  Null texts count as empty (0 tokens), repeated rows are
    counted once each, further columns are left out."""
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("overlap_chars must be between 0 and chunk_chars")
    with open(path, encoding="utf-8") as f:  # a vocabulary, a few MB
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = _encoder(_HELD.setdefault(hash(spec.value), spec.value))
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                texts = texts_of(b.column(1))
                rows = np.ones((len(texts), 3), np.int64)
                short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
                rows[short, 0], rows[short, 2] = encoder.counts([texts[i] for i in short]), 0
                for i, t in enumerate(texts):
                    if len(t) > chunk_chars:
                        rows[i] = resynchronised(t, encoder.encode, encoder.stable, chunk_chars, overlap_chars)
                sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), sizes, *(pa.array(rows[:, i]) for i in range(3))], [id_col, "n_bytes", "n_tokens", "n_chunks", "n_widened"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(plain(df, id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, n_chunks long, n_widened long")
