import random

import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")


def lib():
    return Tokenizer.from_file(PATH)


class Watched(tc.ChunkEncoder):
    """Remembers the length of each chunk that the library gets."""

    def __init__(self):
        super().__init__(lib())
        self.got = []

    def encode(self, chunk):
        self.got.append(len(chunk))
        return super().encode(chunk)


def spliced(encoder, text, chunk, overlap):
    return tc.resynchronised(text, encoder.encode, encoder.stable, chunk, overlap)


def random_texts(rng, n, size):
    alphabets = ["abe '\u2019\n\t 1 \u00e9\u0301\u03a3\u03c2\u0130<|endoftext|>xyz\u4f60\U0001f600\u0085\x1c\u200b\x0b", "ab'stred1.,|<>", "\u4f60\u597d\u3002\uff0c\u304b\u3099\u1112\u1161\u11ab\uac00", "A\u0300e\u0327\u0438\u0306'm\u0131\u212a;\u037e\u2000\u1e9b\u0323"]
    strings = ["<|endoftext|>", "<|startoftext|>", "'re", "'s", "'ll", "<|endof", "text|>", "o'd'd", "\r\n"]
    for _ in range(n):
        alphabet = rng.choice(alphabets) if rng.random() < 0.8 else "".join(alphabets)
        yield "".join(rng.choice(strings) if rng.random() < 0.15 else rng.choice(alphabet) for _ in range(rng.randrange(size)))


def test_spliced_counts_are_the_librarys():
    rng, encoder = random.Random(2), Watched()
    made = list(random_texts(rng, 1500, 300))
    made += ["x" * 900, "<|endoftext|><|startoftext|>a", "", "   ", "no-space" * 100 + " end", "1" * 300, "<|endoftext|>" * 30]
    wanted = lib().encode_batch(made, add_special_tokens=False)
    assert encoder.counts(made) == encoder.counts(made) == [len(w.ids) for w in wanted]
    for text, want in zip(made, wanted, strict=True):
        for chunk, overlap in ((40, 8), (17, 3), (100, 50)):
            encoder.got.clear()
            tokens, chunks, widened = spliced(encoder, text, chunk, overlap)
            assert tokens == len(want.ids), (text, chunk)
            if not widened:
                assert max(encoder.got) <= chunk and len(encoder.got) == chunks


def test_stable_places_are_where_the_library_cuts():
    """From a stable place on, the rest of a text is encoded as in the text."""
    rng, encoder, tok = random.Random(3), Watched(), lib()
    n = 0
    for text in random_texts(rng, 600, 60):
        whole = tok.encode(text, add_special_tokens=False).ids
        for c in encoder.stable(text, 0, len(text)):
            a, b = (tok.encode(x, add_special_tokens=False).ids for x in (text[:c], text[c:]))
            assert a + b == whole, (text, c)
            n += 1
    assert n > 5000


def test_every_chunk_goes_to_the_library():
    rng, encoder = random.Random(4), Watched()
    for text in (" ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(40_000)), "".join(rng.choice("abcdef.,1") for _ in range(200_000)), "".join(rng.choice("\u4f60\u597d\u3002\uff0c") for _ in range(100_000))):
        encoder.got.clear()
        tokens, chunks, widened = spliced(encoder, text, 16384, 512)
        assert tokens == len(lib().encode(text, add_special_tokens=False).ids)
        assert not widened and len(encoder.got) == chunks == -(-(len(text) - 512) // (16384 - 512))
        assert max(encoder.got) == 16384 and sum(encoder.got) >= len(text) + 500 * (chunks - 1)


def test_overlap_is_widened():
    encoder = Watched()
    for text in ("one two " * 10 + "y" * 100 + " three four" * 10, "y" * 500, "y" * 500 + " z" * 50, "a " * 50 + "\u0301" * 300 + "b 1"):
        tokens, chunks, widened = spliced(encoder, text, 60, 10)
        assert widened > 0 and tokens == len(lib().encode(text, add_special_tokens=False).ids)


def test_huge_text_without_white_space_needs_bounded_memory():
    import tracemalloc

    rng, encoder = random.Random(5), Watched()
    part = "".join(rng.choice("abcdefgh.,;1") for _ in range(1_000_000))
    tracemalloc.start()
    peaks = []
    for text in (part, part * 5):
        tracemalloc.reset_peak()
        base = tracemalloc.get_traced_memory()[0]
        spliced(encoder, text, 16384, 512)
        peaks.append(tracemalloc.get_traced_memory()[1] - base)
    tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] < 40 << 20


def test_tokenizers_that_do_not_fit_are_refused():
    import pytest

    with pytest.raises(ValueError, match="white space"):
        tc.ChunkEncoder(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_rows(spark):
    rows = [(1, "Hello World", "a"), (1, "Hello World", "a"), (2, None, None), (None, "", "b"), (3, "Long text. " * 9000, "c"), (4, "z" * 40000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = sorted(((i, len((t or "").encode()), len(lib().encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows), key=repr)
    got = tc.count_tokens(docs, PATH).select("doc_id", "n_bytes", "n_tokens").collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert tc.count_tokens(docs.limit(0), PATH).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tok = lib()
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, PATH, chunk_chars=2000, overlap_chars=100).collect()} == want
