"""Work that has to grow no faster than its input."""

import duckdb
from pyspark.sql import functions as F

from quillon import plans  # noqa: F401  registers the queries
from quillon import streaming as s
from quillon.operators import batch, catalogue
from quillon.plans import proxies
from quillon.plans.streams import _stepped
from quillon.registry import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_tagged_texts_are_cut_once(spark):
    assert plan(QUERIES["bracket_groups"](spark, D)).count("split(") <= 3  # the output, the filter and what the scan is told of it


def test_tagged_texts_of_odd_words(spark, tmp_path):
    texts = [None, "", " ", "1 2 3", "one", "9a b", "a-b--c d\ne", "x " * 30, "a b c d e f g h i", "a b c d e f g h i ", "..A b C d é f g h i j k l m", "a1b2c3d4e5f6g7h8i9j0k1l2", "\n\n", "a b c d e f g h i j k l " * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"WITH {proxies.TAGGED} SELECT doc_id, pred, gold FROM tagged").fetchall()
    assert sorted(map(tuple, proxies.tagged(spark, str(tmp_path)).collect())) == sorted(want)
    got = {r.doc_id: r.groups for r in QUERIES["bracket_groups"](spark, str(tmp_path)).collect()}
    assert got == dict(con.sql(ORACLES["bracket_groups"]).fetchall())


def test_shares_are_added_without_rounding(spark, monkeypatch):
    """After a share of 2**53 a running sum of doubles takes no ones in."""
    big, n = float(1 << 53), 1024
    monkeypatch.setattr(batch, "uniform", lambda seed, key: (F.col(key) / 64 + big) / (big + n))
    rows = spark.range(n + 1).select((F.col("id") * 64).alias("row"), F.when(F.col("id") == 0, big).otherwise(1.0).alias("w"))
    times = {r.row // 64: r.times for r in batch.drawn(rows, "w", "row").collect()}
    assert sum(times.values()) == n + 1
    assert max(times.values()) <= 8 and sum(t > 0 for t in times.values()) >= n // 4


def test_steps_of_a_stream_are_whole_and_spread(spark, tmp_path):
    """Three batches in order, none of them one file of one task; a step without
    rows is a batch, and rows with a null or negative key are in some step."""
    seen, files = {}, {}

    def step(b, i):
        found = b.select("uid", F.input_file_name().alias("file")).collect()
        seen[i], files[i] = [r.uid for r in found], len({r.file for r in found})

    rows = spark.range(-30, 300).filter("id % 3 <> 1 AND id % 3 <> -2").selectExpr("id AS uid").union(spark.sql("SELECT CAST(NULL AS long)"))
    _stepped(spark, rows.repartition(4), lambda stream: s.drained(stream, step, f"{tmp_path}/checkpoint"))
    assert sorted(seen) == [0, 1, 2] and seen[1] == []
    assert sorted(x for x in seen[0] if x is not None) == list(range(-30, 300, 3)) and seen[0].count(None) == 1
    assert sorted(seen[2]) == list(range(-28, 300, 3))
    assert files[0] > 1 and files[2] > 1


def test_queries_that_weigh_words_alike_are_looked_up_once(spark, monkeypatch):
    """Of forty queries that differ in a word that meets none, one is looked up; all have its answer."""
    made = {}

    def kept(spark, df, what):
        made[what] = df.localCheckpoint()
        return made[what]

    monkeypatch.setattr(catalogue, "materialised", kept)
    tids = [("red,ring,s",), ("red,bolt,s",), ("small,ring,m",), ("blue,bolt,m",), ("s,s,s",)]
    index = catalogue.word_index(spark.createDataFrame(tids, "words string"), F.col("words"))
    queries = spark.createDataFrame([(f"X{i},{w}",) for i in range(40) for w in ("red,rin", "bolt,s")] + [("none,of,it",)], "query string")
    got = {r.query: (r.tid, r.score) for r in catalogue.fuzzy_lookup(queries, index).collect()}
    assert made["fuzzy-weights"].select("query").distinct().count() == 2
    assert got == {f"X{i},red,rin": ("red,ring,s", round(0.5 + 0.8 / 3, 9)) for i in range(40)} | {f"X{i},bolt,s": ("s,s,s", 1.0) for i in range(40)}


def test_losses_read_the_tokens_once(spark, tmp_path):
    """One pass for all ways of a loss and no arrays; rows without a length or a key count as in the SQL."""
    rows = [(i // 4, i % 4, i, i, [50.0, 1.0, 17.0][i % 3], 0.05, "ARN"[i % 3], "O") for i in range(40)] + [(None, 1, 1, 1, 9.0, 0.1, "R", "O"), (99, 1, 1, 1, None, 0.1, "R", "F")]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("agg_loss", "value_loss"):
        df = QUERIES[name](spark, str(tmp_path))
        assert plan(df).count("FileScan") == 1 and "transform(" not in plan(df)
        assert sorted(map(tuple, df.collect())) == sorted(con.sql(ORACLES[name]).fetchall())


def test_scores_are_placed_without_a_function_for_each_token(spark, tmp_path):
    """The place of a score comes from the length; odd lengths, scores and keys as in the SQL."""
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"

    def placed(name, quantities):
        rows = [(i // 4, i % 4, i, i, q, 0.01 * (i % 3), "R", "O") for i, q in enumerate(quantities)]
        rows += [(None, 1, 1, 1, 20.0, 0.1, "R", "O"), (98, 1, 1, 1, quantities[0], None, "R", "F"), (99, 1, 1, 1, None, 0.1, "R", "F")]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        return QUERIES["rm_token_level"](spark, f"{tmp_path}/{name}")

    df = placed("all", [50.0, -3.0, 0.0, *map(float, range(1, 50))])
    assert "transform(" not in plan(df)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/all/lineitem.parquet/*.parquet'")
    key = lambda r: r[:2]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(con.sql(ORACLES["rm_token_level"]).fetchall(), key=key)
    # the arrays are as long as the longest response, of 20, less the first eight
    short = {r.uid: r.scores for r in placed("short", [9.0]).collect()}
    assert short == {0: [0.0] * 12, 98: [None] + [0.0] * 11, 99: [0.0] * 12}
