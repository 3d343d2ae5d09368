import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillon.llm import decontamination, quality
from quillon.session import materialised
from tests.llm.test_native import brute_lines
from tests.llm.test_signature_tree import brute

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs.toPandas()]
    for name, f in cp.STAGES:
        docs = materialised(spark, f(spark, docs, D), "test")
        out.append(docs.toPandas())
    return out


def rows(frame):
    return list(zip(frame.doc_id.tolist(), frame.text.tolist(), strict=True))


def test_columns(stages):
    for frame in stages[1:-1]:
        assert list(frame.columns) == list(stages[0].columns)
        assert frame.doc_id.is_unique


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.judged(spark.read.parquet(f"{D}/documents.parquet"), labels).collect()}
    assert set(stages[1].doc_id) == {d for d, s in scores.items() if s >= 0.5}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good & set(stages[1].doc_id)) > 0.98 * len(good)


def test_line_stage(stages):
    want = {i: t for i, _, _, t in brute_lines(rows(stages[1]), 10, 1, False)}
    assert dict(rows(stages[2])) == want
    assert all(n == len(t) for n, t in zip(stages[2].n_chars, stages[2].text, strict=True))


def test_near_duplicate_stage(stages):
    assert set(stages[3].doc_id) == {i for i, _, c in brute(rows(stages[2]), 5, 80) if i == c}


def test_decontamination_stage(spark, stages):
    items = [" ".join(decontamination.words_of(r.text.encode())[0:0]) or r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    flat = {i: " ".join(t.split()) for i, t in rows(stages[3])}
    leaks = {i for i, t in flat.items() if any(" ".join(x.split()) in t for x in items)}
    gone = set(stages[3].doc_id) - set(stages[4].doc_id)
    assert leaks <= gone and len(gone) <= len(leaks) + 2


def test_token_stage(stages):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[5].itertuples()}
    want = {}
    for i, t in rows(stages[4]):
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, keep int"
    odd = [(1, "a b c", None, None, None, 0.0, 1), (1, "a b c", None, None, None, 0.0, 1), (2, None, "en", "s", 0, None, None), (None, None, None, None, None, None, None), (3, "", "en", "s", 0, 1.0, 2)]
    docs = spark.createDataFrame(odd, schema)
    for name, f in cp.STAGES[:-1]:
        out = f(spark, docs, D)
        assert out.columns == docs.columns
        assert f(spark, docs.limit(0), D).collect() == []
    left = cp.near_duplicates(spark, docs, D).collect()
    assert sorted((r.doc_id for r in left), key=repr) == sorted([1, 2, None, 3], key=repr)
    assert len(cp.token_ids(spark, docs, D).collect()) == len(odd)


def test_near_duplicates_go_by_row(spark):
    """Ids that repeat with other texts, near copies of one id, no ids."""
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abce")
    near = a + " more"
    rows = [(3, a), (5, b), (5, a), (3, near), (3, a), (None, c), (None, c), (None, c + " x"), (None, a), (9, e), (9, e + " y"), (1, ""), (1, ""), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, D).collect()]
    for i, texts in ((3, (a, near)), (5, (b,)), (None, (c, c + " x")), (9, (e, e + " y")), (1, ("",)), (2, (None,))):
        own = [t for k, t in left if k == i]
        assert len(own) == 1 and own[0] in texts, (i, own)
    assert len(left) == 6
