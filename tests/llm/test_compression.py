import base64
import random
import re

from quillon.llm import compression as c


def brute_repeated(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_repeated_words_and_lines():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(25))]
        assert c.repeated_words(words) == brute_repeated(words)
    assert c.duplicate_lines(b"a\n\n\n \na\na \n") == 1


def test_long_texts_are_counted_as_short_ones():
    rng = random.Random(5)
    pool = [b"a", b"bb", "\u00e9".encode(), b"#x", b"\x1c", b"word"]
    for _ in range(200):
        data = b"".join(rng.choice(pool) + rng.choice([b" ", b"\n", b"\t ", b"\r\n", b"\n\n", b"\x0b"]) for _ in range(rng.randrange(120)))
        words = data.split()
        want = (len(words), len(b"".join(words).decode()), len(c._SYMBOLS.findall(data)), c.duplicate_lines(data), c.repeated_words(words))
        for piece in (1, 7, 50, 10**6):
            assert c.long_counts(data, piece) == want


def test_long_text_needs_bounded_memory():
    import tracemalloc

    rng = random.Random(6)
    data = " ".join(f"w{rng.randrange(20_000)}" for _ in range(1_000_000)).encode()
    tracemalloc.start()
    got = c.long_counts(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == 1_000_000 and peak < 100 << 20


def planted(rng, kind, n):
    """At least ``n`` bytes and 50 words, none of three words in a row repeated."""
    words, size = [], 0
    while size <= n or len(words) < 50:
        if kind == "repetitive":
            w = "abcabcabc" * (1 + (n >= 1024)) + str(len(words))
        else:
            w = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.randrange(2, 8)))
        words.append(w)
        size += len(w) + 1
    return " ".join(words)


def test_bands_reject_what_the_base_rules_pass(spark):
    rng = random.Random(7)
    rows = [(n, kind, planted(rng, kind, n)) for n in (256, 384, 500, 512, 1024, 2048, 4096, 8192, 16384, 60000, 2 << 20) for kind in ("repetitive", "incompressible")]
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in c.judged(docs).collect()}
    for i, (n, kind, _) in enumerate(rows):
        assert not got[i].base_failed and got[i].n_repeat_words == 0 and not got[i].kept, (n, kind, got[i])


def test_bands():
    rng = random.Random(2)
    z = c.zstandard.ZstdCompressor(level=3).compress
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(900)).encode()
    bands = c.Bands()
    assert bands.verdict(prose, z)[2]
    assert not bands.verdict(b"again and again " * 300, z)[2]
    assert not bands.verdict(rng.randbytes(5000), z)[2]
    assert not bands.verdict(prose + b"ab" * 4000, z)[2]
    assert bands.verdict(b"", z) == (0.0, 0.0, True)


def encoded(rng, kind, n):
    if kind == "words":
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return " ".join("".join(rng.choices(letters, k=rng.randrange(3, 10))) for _ in range(n // 3)).encode()[:n]
    data = base64.b64encode(rng.randbytes(n)) if kind == "base64" else rng.randbytes(n).hex().encode()
    return b"\n".join(data[i : i + 76] for i in range(0, len(data), 76))[:n]


def test_encoded_texts_are_out_of_band():
    rng = random.Random(3)
    z = c.zstandard.ZstdCompressor(level=3).compress
    for n in (300, 500, 900, 1024, 2000, 3000, 4096, 12158, 30000, 100000):
        for kind in ("base64", "words"):
            assert not c.Bands().verdict(encoded(rng, kind, n), z)[2], (kind, n)
    for n in (8192, 12158, 30000, 100000):
        assert not c.Bands().verdict(encoded(rng, "hex", n), z)[2], n


def test_encoded_document_is_not_kept(spark):
    text = encoded(random.Random(4), "base64", 12158).decode()
    got = c.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_words > 50 and not got.base_failed and not got.kept


def test_rows(spark):
    text = "alpha beta gamma\nalpha beta gamma\n\t\n" + " ".join(f"w{i}" for i in range(60)) + " é# <|>"
    rows = [(1, text, 5), (1, text, 5), (2, None, 1), (3, "", 1), (None, "x", None), (4, "same words here " * 40, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = c.judged(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), brute_repeated(words))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
    by = {r.doc_id: r.kept for r in got}
    assert by[1] and not by[4] and not by[2]
    assert c.judged(docs.limit(0)).collect() == []


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1")
    out = c.judged(spark.read.parquet(f"{d}/documents.parquet")).join(good, "doc_id")
    assert out.filter("NOT kept AND NOT base_failed").count() == 0
