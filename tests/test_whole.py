"""Nothing is left out: the queries over all rows."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillon.plans import proxies
from quillon.registry import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def test_token_queries_take_all_rollouts(spark):
    n = spark.read.parquet(f"{D}/lineitem.parquet").count()
    longest = spark.read.parquet(f"{D}/lineitem.parquet").agg(F.max("l_quantity")).first()[0]
    for name in ("adv_gae", "eos_mask", "loss_mask", "token_reward"):
        out = QUERIES[name](spark, D)
        sizes = out.select(F.size(out.columns[-1]).alias("n")).groupBy("n").count().collect()
        assert [tuple(r) for r in sizes] == [(longest, n)]
    for name in ("pad_trunc", "assemble_rollout", "kl_est"):
        assert QUERIES[name](spark, D).count() == n


def test_no_query_takes_a_part_of_its_rows():
    assert not any("% 20" in sql for sql in ORACLES.values())


def test_token_sum_by_brute_force(spark):
    rows = spark.sql(f"SELECT l_orderkey o, l_linenumber n, l_partkey p, l_suppkey s, l_quantity q FROM parquet.`{D}/lineitem.parquet`").collect()
    rows.sort(key=lambda r: (r.o, r.n, r.p, r.s))
    seen, total, mask = {}, 0.0, 0
    for r in rows:
        seen[r.o] = k = seen.get(r.o, 0) + 1
        for i in range(int(r.q)):
            logp, value = -((r.o * 7 + k * 11 + i * 7) % 19) / 19, ((r.o * 3 + k * 5 + i * 7) % 17) / 17
            total, mask = total - logp * (value - 0.5), mask + 1
    got = QUERIES["policy_loss_gpg"](spark, D).first()[0]
    assert math.isclose(got, total / mask, abs_tol=2e-6)


def test_batches_are_whole(spark):
    rows = spark.read.parquet(f"{D}/lineitem.parquet").agg(F.count("*"), F.sum("l_quantity")).first()
    for name in ("balance_kk", "balance_greedy", "microbatch"):
        assert tuple(QUERIES[name](spark, D).agg(F.sum("n"), F.sum("tokens")).first()) == tuple(rows)


def test_bootstrap_of_every_prompt(spark):
    by = defaultdict(list)
    for r in sorted(proxies.responses(spark, D).select("uid", "sample", "score").collect()):
        by[r.uid].append(r.score)
    got = {r.uid: r for r in QUERIES["bootstrap"](spark, D).collect()}
    assert set(got) == set(by)
    for uid in sorted(by)[:40]:
        x, rng = np.array(by[uid]), np.random.RandomState(42)
        draws = [x[rng.choice(len(x), 4, replace=True)] for _ in range(1000)]
        want = [np.mean([max(v) for v in draws]), np.std([max(v) for v in draws]), np.mean([min(v) for v in draws]), np.std([min(v) for v in draws])]
        assert np.allclose(got[uid][1:], want, atol=1e-12)
