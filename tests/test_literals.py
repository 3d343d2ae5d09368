"""Cases with known results, and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import streaming
from quillon.functions import answers as x
from quillon.functions import kernels as k
from quillon.functions import rewards as r
from quillon.operators import advantages as a
from quillon.operators import batch as b
from quillon.operators import catalogue as c
from quillon.operators import metrics as m
from quillon.operators import ranking


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def test_chunks(spark):
    df = spark.range(6).withColumnRenamed("id", "ord")
    assert [x.c for x in df.orderBy("ord").select(b.chunk("ord", 2, 6).alias("c")).collect()] == [0, 0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        b.chunk("ord", 5, 6)


def test_pop(spark):
    popped, rest = b.pop(spark.createDataFrame([(1, 2)], "a int, b int"), ["a"])
    assert popped.columns == ["a"] and rest.columns == ["b"]
    with pytest.raises(KeyError):
        b.pop(rest, ["a"])


def test_repeat(spark):
    df = spark.range(3).withColumnRenamed("id", "ord")
    assert [x.ord for x in b.repeat(df, "ord", 2).orderBy("pos").collect()] == [0, 0, 1, 1, 2, 2]
    assert [x.ord for x in b.repeat(df, "ord", 2, False).orderBy("pos").collect()] == [0, 1, 2, 0, 1, 2]


def test_pad_and_slice(spark):
    df = spark.range(5).withColumnRenamed("id", "ord")
    padded = b.pad_to(df, "ord", 4, 5)
    assert sorted(x.ord for x in padded.collect()) == list(range(8))
    assert b.unpad(padded).count() == 5
    for s in (slice(1, 4, 1), slice(None, None, -2), slice(-3, None, 1), slice(10, 2, -1)):
        assert sorted(x.ord for x in b.sliced(df, "ord", s.start, s.stop, s.step or 1, 5).collect()) == sorted(range(5)[s])


def test_union_of_unequal_columns_is_an_error(spark):
    x = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "ord long, v double")
    assert b.union_columns(x, x, "ord").count() == 2
    with pytest.raises(Exception, match="differs"):
        b.union_columns(x, x.withColumn("v", F.lit(2.0)), "ord").collect()


def test_masked_positions_do_not_change_gae(spark):
    rng = random.Random(1)
    mask = [1, 1, 0, 0, 1, 1, 0]
    rewards = [rng.random() if x else 0.0 for x in mask]
    out = []
    for _ in range(3):
        values = [0.5 if x else rng.random() * 9 for x in mask]
        df = spark.createDataFrame([(rewards, values, mask)], "r array<double>, v array<double>, m array<int>")
        got = df.select(a.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("g")).first().g
        out.append([x for x, keep in zip(got, mask, strict=True) if keep])
    assert out[0] == out[1] == out[2]


def test_estimator_names():
    with pytest.raises(ValueError):
        a.estimator("grpo")(lambda: None)
    assert "GRPO" not in a.ESTIMATORS
    assert a.estimator("grpo")(a.grpo) is a.grpo


def test_group_of_one(spark):
    df = spark.createDataFrame([(1, 0.5)], "uid int, score double")
    assert abs(df.select(a.grpo("score", "uid")).first()[0] - 0.5 / (1 + 1e-6)) < 1e-12
    with pytest.raises(Exception, match="one row"):
        df.withColumn("o", F.lit(1)).select(a.grpo_passk("score", "uid", "o")).collect()


def test_whitening_needs_two_tokens(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1, 0])], "x array<double>, m array<int>")
    with pytest.raises(Exception, match="mask"):
        a.whitened(df, "x", "m").collect()


def test_majority(spark):
    rows = [(1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "A", 0.7), (2, 0, "A", 0.9), (2, 1, "B", 0.8)]
    got = m.majority(spark.createDataFrame(rows, "u int, o int, v string, x double"), ["u"], "v", "x", "o")
    assert {x.u: x.maj for x in got.collect()} == {1: 0.9, 2: 0.9}


def test_reduction_by_name(spark):
    df = spark.createDataFrame([("minmax_diff", 1.0), ("minmax_diff", 3.0), ("a/min", 1.0), ("a/min", 3.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    assert {x.k: x.value for x in m.reduced(df, "k", "v").collect()} == {"minmax_diff": 3.0, "a/min": 1.0, "b": 2.0}


def test_bootstrap_is_close_to_the_exact_expectation(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(8)], "u int, o int, x double")
    row = m.bootstrap(df, ["u"], "x", "o", 4).first()
    assert abs(row.best_mean - m.best_of_exact(df, ["u"], "x", 4).first().best) < 0.2 and row.worst_mean < row.best_mean


def test_top_k_skips_the_best(spark):
    v = [(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(9)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    std = {(x.vec_id, x.rank): x.item_id for x in ranking.cosine_topk(df, 3, skip_best=False).collect()}
    own = {(x.vec_id, x.rank): x.item_id for x in ranking.cosine_topk(df, 3).collect()}
    assert std[0, 1] == 1 and own[0, 1] == 2 and own[4, 1] == std[4, 2]
    blocks = ranking.inner_topk(df, df, 3, "vec_id", "embedding", True, block_rows=4)
    assert {(x.vec_id, x.rank): x.item_id for x in blocks.collect()} == std
    with pytest.raises(NotImplementedError):
        ranking.metric("mrr@3", F.lit(1), F.lit(1))


def test_row_numbers_without_one_big_task(spark):
    rng = random.Random(4)
    values = [rng.randrange(50) for _ in range(300)] + [None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    got = b.numbered(df, "v", "i", part_rows=43).collect()
    want = {i: n for n, (_, i) in enumerate(sorted(((-1 if v is None else v), i) for i, v in enumerate(values)))}
    assert {x.i: x.ord for x in got} == want
    assert b.numbered(df.limit(0), "v", "i").collect() == []


def test_words_of_answers(spark):
    def words(text):
        return one(spark, c.parse_words(F.col("t")), t=text)

    assert words("x [A, 'b c', d] [e]") == ["a", "b c", "d", "", ""]
    assert words("one two") == ["one", "two", "", "", ""]
    assert words("") == []
    assert words("a,b,c,d,e,f") == ["a", "b", "c", "d", "e"]


def test_last_n_of_a_short_array(spark):
    assert one(spark, c.last_n(F.col("x"), 20), x=[1, 2]) == [1, 2]


def test_answers(spark):
    assert one(spark, r.gsm8k_answer(F.col("t")), t="#### 12 no #### 1,234") == "1234"
    assert one(spark, r.gsm8k_answer(F.col("t"), False), t="it is 3 or 4 .") == "4"
    assert one(spark, r.normalise_answer(F.col("t")), t="The  U.S. an apple!") == "us apple"
    assert one(spark, r.answer_tag(F.col("t")), t="<answer>a</answer>") is None
    assert one(spark, r.qa_em(F.col("t"), F.array(F.lit("Paris"))), t="<answer>x</answer><answer> the paris. </answer>") == 1.0
    assert one(spark, r.think_format(F.col("t")), t="<think>long enough here</think>") == 1.0
    assert one(spark, r.think_format(F.col("t")), t="<think>  a b c  </think>") == 0.0
    with pytest.raises(Exception, match="no scorer"):
        one(spark, r.dispatch(F.col("s"), F.lit("x"), F.lit("y")), s="unknown")


def test_prefix_rewards(spark):
    gold = [["a", "b", "c", "d", "e"]]
    for n, want in enumerate(r.PREFIX):
        pred = [["a", "b", "c", "d", "e"][:n] + ["z"] * (5 - n)]
        assert one(spark, r.hierarchical(F.col("p"), F.col("g")), p=pred, g=gold) == want


def test_boxes():
    assert k.last_boxed("\\boxed{a{b}c} x") == "a{b}c"
    assert k.last_boxed("\\boxed{1} \\boxed{2") is None
    assert k.last_boxed("\\fbox{7}") == "7"
    assert k.last_boxed("\\boxed 3$ y") == "3"
    assert k.last_boxed("none") is None and k.last_boxed(None) is None


def test_math_spelling(spark):
    equal = lambda a, b: one(spark, x.latex_equal(F.col("a"), F.col("b")), a=a, b=b)
    for a, b in (("\\frac12", "\\frac{1}{2}"), ("0.5", "1/2"), ("x = 3", "3"), ("\\dfrac{3}{4}", "3/4"), ("\\sqrt3", "\\sqrt{3}"), ("50\\%", "50")):
        assert equal(a, b), (a, b)
    assert not equal("1", "2") and not equal("", "1")
    assert x.alike("0.5", "50") and x.alike("3.0", "3") and not x.alike("3.1", "3")
    minerva = lambda t, g: one(spark, x.minerva(F.col("t"), F.col("g")), t=t, g=g)
    assert minerva("Answer: $1,234$ dollars", "1234") == 1.0 and minerva("nothing", "1") == -1.0


def test_infix():
    assert k.evaluate("2@3*2") == 0.0 and k.evaluate("-(1+2)*3") == -9.0 and k.evaluate("1/0") is None and k.evaluate("(") is None


def test_repeats():
    assert k.repeatness("ab" * 20) and not k.repeatness("abcdefghij") and not k.repeatness("a") and not k.repeatness(None)


def test_partitions():
    rng = random.Random(2)
    for n, parts in ((16, 4), (40, 5), (7, 7)):
        x = [rng.randrange(1, 100) for _ in range(n)]
        for equal in (False, n % parts == 0):
            p = k.karmarkar_karp(x, parts, equal)
            loads = [sum(v for v, q in zip(x, p, strict=True) if q == i) for i in range(parts)]
            assert sum(loads) == sum(x) and (not equal or all(p.count(i) == n // parts for i in range(parts)))
        assert len(set(k.greedy_partition(x, parts))) <= parts
        mb = k.micro_batches(x, 200)
        assert sorted(set(mb)) == list(range(max(mb) + 1))
    with pytest.raises(ValueError):
        k.karmarkar_karp([1, 2, 3], 2, True)
    assert k.greedy_partition([5, 1, 1, 1], 2) == [0, 1, 1, 1]


def test_python_rounding():
    assert k.python_format3(0.0625) == "0.062" and k.python_format3(0.0005) == "0.001" and k.python_format3(None) is None


def test_traces():
    ask = "intro *user question:* What <answer>is</answer> it? "
    got = k.trace_messages(ask, "I think <code>\n```python\nx=1\n```\n</code>\nout: <interpreter> 1 </interpreter>so <answer>one</answer>")
    assert [(m["role"], m["content"], m["code"]) for m in got] == [("user", "What is it?", None), ("assistant", "I think", "x=1"), ("tool", "1", None), ("assistant", "so one", None)]
    assert k.trace_messages(ask, "<code> y </code>")[1]["code"] == " y "
    assert len(k.trace_messages(ask, "")) == 1
    for bad in ("no turn", "<code>x</code>then", "</code><code>x</code>", "<answer>1</answer> more", "<code>x"):
        assert k.trace_messages(ask, bad) is None, bad
    assert k.trace_messages("no question", "<answer>1</answer>") is None and k.trace_messages(None, None) is None


def test_printed_code(spark):
    for code, want in (("a\nb\n\n", "a\nprint(b)\n\n"), ("say ```python\nx = 1\nx\n``` and ```python\ny\n```", "x = 1\nprint(x)"), ("print(1)", "print(1)"), ("", ""), ("\n\n", "\n\n"), ("  ", "print(  )")):
        assert one(spark, r.printed(F.col("c"), x.SPACES), c=code) == want, code


def test_islands(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate("aabba")], "o int, v string")
    assert [x.run for x in df.withColumn("run", a.islands(W.orderBy("o"), F.col("v"))).orderBy("o").collect()] == [1, 1, 2, 2, 3]


def test_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0, 5.0], [1, 1, 0]), ([3.0, 9.0, 9.0], [1, 0, 0])], "l array<double>, m array<int>")
    want = {"token-mean": 2.0, "seq-mean-token-sum": 3.0, "seq-mean-token-mean": 2.25, "seq-mean-token-sum-norm": 2.0}
    for mode, x in want.items():
        assert abs(a.agg_loss(df, "l", "m", mode).first().loss - x) < 1e-6
    with pytest.raises(ValueError):
        a.agg_loss(df, "l", "m", "other")


def test_divergences(spark):
    x, y = np.array([-1.0, -50.0]), np.array([-1.5, -0.1])
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<double>, b array<double>")
    got = df.select(*(a.kl(F.col("a"), F.col("b"), kind).alias(kind) for kind in ("k1", "abs", "k2", "k3"))).first()
    assert np.allclose(got.k1, x - y) and np.allclose(got.abs, abs(x - y)) and np.allclose(got.k2, (x - y) ** 2 / 2)
    assert got.k3[1] == 10.0
    with pytest.raises(NotImplementedError):
        a.kl(F.col("a"), F.col("b"), "other")


def test_adaptive_coefficient():
    control = streaming.AdaptiveKl(0.2, 0.1, 100)
    assert abs(control.update(0.5, 10) - 0.2 * 1.02) < 1e-12 and abs(control.update(0.0, 10) - 0.2 * 1.02 * 0.98) < 1e-12


def test_kept_groups_give_up(spark, tmp_path):
    keep = streaming.KeptGroups(str(tmp_path / "kept"), "uid", "v", 5, 1)
    batch = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0)], "uid int, v int")
    keep(batch, 0)
    assert keep.have(spark) == (1, 1)
    keep(batch, 0)  # a step that is repeated counts once
    again = streaming.KeptGroups(str(tmp_path / "kept"), "uid", "v", 5, 1)  # after a restart
    with pytest.raises(RuntimeError):
        again(batch, 1)


def test_coefficient_goes_on_after_a_restart(spark, tmp_path):
    batch = spark.createDataFrame([(0.5,)] * 10, "kl double")
    plain = streaming.AdaptiveKl(0.2, 0.1, 100)
    for step in range(3):
        streaming.KlSteps(str(tmp_path / "kl"), 0.2, 0.1, 100, F.col("kl"))(batch, step)
        plain.update(0.5, 10)
    streaming.KlSteps(str(tmp_path / "kl"), 0.2, 0.1, 100, F.col("kl"))(batch, 2)  # repeated
    got = streaming.KlSteps(str(tmp_path / "kl"), 0.2, 0.1, 100, F.col("kl")).values(spark).collect()
    assert len(got) == 3 and abs(max(got).coefficient - plain.value) < 1e-12


def test_loader_goes_on_where_it_stopped(spark, tmp_path):
    df = spark.range(25).withColumnRenamed("id", "k")
    ids = lambda loader: [sorted(r.k for r in b.collect()) for b in loader]
    loader = streaming.Loader(df, "k", 10)
    first, second = ids(loader), ids(loader)
    assert [len(x) for x in first] == [10, 10, 5] and sorted(sum(first, [])) == list(range(25)) and first != second
    again = streaming.Loader(df, "k", 10)
    got = [sorted(r.k for r in next(iter(again)).collect())]
    streaming.save_state(spark, again.state(), str(tmp_path / "s"))
    rest = streaming.Loader(df, "k", 10, state=streaming.saved_state(spark, str(tmp_path / "s")))
    assert got + ids(rest) == first and ids(rest) == second
    assert streaming.saved_state(spark, str(tmp_path / "none")) is None
    assert ids(streaming.Loader(df, "k", 10, shuffle=False))[0] == list(range(10))


def test_windows_are_written_once_closed(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=m), 1, "a", 1.0) for m in (0, 30, 70, 200)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.table_stream(spark, str(tmp_path / "in"), "ts timestamp, user_id long, event_type string, value double")
    out = streaming.appended(streaming.windows(stream, "tumbling"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.n for r in out.collect()) == [1, 2]  # the hour of minute 200 is still open


def test_files(spark, tmp_path):
    from quillon.sources import files

    df = spark.createDataFrame([(1, "a")], "k long, v string")
    files.sink(df, str(tmp_path))
    assert files.parquet(spark, [f"{tmp_path}/parquet"] * 2).count() == 2
    assert files.jsonl(spark, f"{tmp_path}/jsonl", "k long, v string").collect() == df.collect()
    (tmp_path / "x.json").write_text('[{"k": 1}, {"k": 2}]')
    assert files.json_array(spark, str(tmp_path / "x.json"), "k long").count() == 2
    rows, skipped = files.merged(spark, [f"{tmp_path}/jsonl", f"{tmp_path}/none"], "k long")
    assert rows.count() == 1 and len(skipped) == 1
    with pytest.raises(KeyError):
        files.Registry({}).read(spark, "x")
