"""Scores of model outputs and their aggregation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import rewards as r
from quillon.operators import metrics as m
from quillon.plans import proxies as p
from quillon.registry import query
from quillon.session import table

R6 = lambda c: F.round(c, 6)

#: Lists of sorted (after the last think tag) and ordered items of pred and gold.
_ITEMS = f"""WITH {p.TAGGED}, x AS (SELECT *, list_transform(regexp_extract_all(string_split(pred, '</think>')[-1], '\\[(.*?)\\]', 1), lambda g: list_sort(list_filter(list_transform(string_split(g, ','), lambda w: trim(w)), lambda w: w <> ''))) AS ps,
  list_transform(regexp_extract_all(string_split(gold, '</think>')[-1], '\\[(.*?)\\]', 1), lambda g: list_sort(list_filter(list_transform(string_split(g, ','), lambda w: trim(w)), lambda w: w <> ''))) AS gs,
  contains(pred, '<think>') AND contains(pred, '</think>') AS tagged FROM tagged)"""


def _tagged(spark, d):
    return p.tagged(spark, d).withColumns({"ps": r.items_sorted(F.col("pred")), "gs": r.items_sorted(F.col("gold"))})


@query("items_sorted", f"{_ITEMS} SELECT doc_id, ps AS items FROM x")
def items_sorted(spark, d):
    return _tagged(spark, d).select("doc_id", F.col("ps").alias("items"))


@query("items_ordered", f"WITH {p.TAGGED} SELECT doc_id, list_transform(regexp_extract_all(lower(pred), '\\[(.*?)\\]', 1), lambda g: list_filter(list_transform(string_split(g, ','), lambda w: trim(w)), lambda w: w <> '')) AS items FROM tagged")
def items_ordered(spark, d):
    return p.tagged(spark, d).select("doc_id", r.items_ordered(F.col("pred")).alias("items"))


_SID = "'<s_a_' || doc_id % 3 || '><s_b_' || doc_id % 5 || '><s_c_' || doc_id % 7 || '> text <s_a_1><s_b_' || doc_id % 2 || '><s_c_3>'"


def _sids(spark, d):
    at = lambda n: (F.col("doc_id") % n).cast("string")
    text = F.concat(F.lit("<s_a_"), at(3), F.lit("><s_b_"), at(5), F.lit("><s_c_"), at(7), F.lit("> text <s_a_1><s_b_"), at(2), F.lit("><s_c_3>"))
    return table(spark, d, "documents").select("doc_id", r.sid_triples(text).alias("sids"))


@query("sid_triples", f"SELECT doc_id, regexp_extract_all({_SID}, '<s_a_[0-9]+><s_b_[0-9]+><s_c_[0-9]+>') AS sids FROM documents")
def sid_triples(spark, d):
    return _sids(spark, d)


@query("r_partial_sid", """WITH s AS (SELECT doc_id, unnest([doc_id % 3, 1]) AS a, unnest([doc_id % 5, doc_id % 2]) AS b, unnest([doc_id % 7, 3]) AS c FROM documents)
  SELECT doc_id, round(avg(CASE WHEN (a, b, c) = (1, 1, 3) THEN 100 WHEN (a, b) = (1, 1) THEN 10 WHEN a = 1 THEN 1 ELSE 0 END), 6) AS reward FROM s GROUP BY doc_id""")
def r_partial_sid(spark, d):
    return _sids(spark, d).select("doc_id", R6(r.partial_sid(F.col("sids"), F.array(F.lit("<s_a_1><s_b_1><s_c_3>")))).alias("reward"))


@query("r_format_think", f"""WITH {p.TAGGED}, t AS (SELECT doc_id, pred, instr(pred, '<think>') AS s, instr(pred, '</think>') AS e FROM tagged)
  SELECT doc_id, CASE WHEN s > 0 AND e > s AND length(regexp_replace(substr(pred, s + 7, e - s - 7), '[ \\n\\r\\t]', '', 'g')) > 10 THEN 1.0::DOUBLE ELSE 0 END AS reward FROM t""")
def r_format_think(spark, d):
    return p.tagged(spark, d).select("doc_id", r.think_format(F.col("pred")).alias("reward"))


@query("r_partial_hit", f"""{_ITEMS}, pi AS (SELECT doc_id, gs, unnest(ps) AS i FROM x), b AS (SELECT doc_id, i, list_max(list_transform(gs, lambda g: CASE WHEN g = i THEN 100.0::DOUBLE ELSE 50.0::DOUBLE * len(list_intersect(g, i)) / greatest(len(g), len(i)) END)) AS best FROM pi)
  SELECT x.doc_id, round(coalesce(avg(best), 0), 6) AS reward FROM x LEFT JOIN b USING (doc_id) GROUP BY x.doc_id""")
def r_partial_hit(spark, d):
    return _tagged(spark, d).select("doc_id", R6(r.partial_hit(F.col("ps"), F.col("gs"))).alias("reward"))


@query("r_hit", f"{_ITEMS} SELECT doc_id, CASE WHEN tagged THEN round(len(list_distinct(list_filter(ps, lambda i: list_contains(gs, i)))) / len(ps), 6) ELSE 0 END AS reward FROM x")
def r_hit(spark, d):
    return _tagged(spark, d).select("doc_id", R6(r.tagged_only(F.col("pred"), r.hit(F.col("ps"), F.col("gs")))).alias("reward"))


@query("r_pass1", f"{_ITEMS} SELECT doc_id, CASE WHEN tagged AND list_contains(gs, ps[1]) THEN 1.0::DOUBLE ELSE 0 END AS reward FROM x")
def r_pass1(spark, d):
    return _tagged(spark, d).select("doc_id", r.tagged_only(F.col("pred"), r.first_hit(F.col("ps"), F.col("gs"))).alias("reward"))


@query("r_pass", f"{_ITEMS} SELECT doc_id, len(list_filter(ps, lambda i: list_contains(gs, i))) > 0 AS hit FROM x")
def r_pass(spark, d):
    return _tagged(spark, d).select("doc_id", (r.any_hit(F.col("ps"), F.col("gs")) > 0).alias("hit"))


_SIMPLE = """[0.0, 0.6, 0.7, 0.8, 0.9, 1.0][1 + CASE WHEN (p[1] = g[1]) IS NOT TRUE THEN 0 WHEN (p[2] = g[2]) IS NOT TRUE THEN 1 WHEN (p[3] = g[3]) IS NOT TRUE THEN 2 WHEN (p[4] = g[4]) IS NOT TRUE THEN 3 WHEN (p[5] = g[5]) IS NOT TRUE THEN 4 ELSE 5 END]::DOUBLE"""


@query("r_simple", f"""WITH {p.TAGGED}, o AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_extract(lower(pred), '\\[(.*?)\\]', 1), ','), lambda w: trim(w)), lambda w: w <> '') AS p, list_filter(list_transform(string_split(regexp_extract(lower(gold), '\\[(.*?)\\]', 1), ','), lambda w: trim(w)), lambda w: w <> '') AS g FROM tagged)
  SELECT doc_id, round(len(list_intersect(p, g)) / len(list_distinct(list_concat(p, g))), 6) AS jaccard, {_SIMPLE} AS hierarchical FROM o""")
def r_simple(spark, d):
    x = p.tagged(spark, d).select("doc_id", r.items_ordered(F.col("pred")).alias("p"), r.items_ordered(F.col("gold")).alias("g"))
    return x.select("doc_id", R6(r.jaccard_first(F.col("p"), F.col("g"))).alias("jaccard"), r.hierarchical(F.col("p"), F.col("g")).alias("hierarchical"))


@query("score_bundle", f"""{_ITEMS} SELECT doc_id, CASE WHEN tagged AND list_contains(gs, ps[1]) THEN 1.0::DOUBLE ELSE 0 END AS score, CASE WHEN tagged THEN round(len(list_distinct(list_filter(ps, lambda i: list_contains(gs, i)))) / len(ps), 6) ELSE 0 END AS hit_reward FROM x""")
def score_bundle(spark, d):
    first, hit = r.first_hit(F.col("ps"), F.col("gs")), r.hit(F.col("ps"), F.col("gs"))
    b = F.struct(r.tagged_only(F.col("pred"), first).alias("score"), R6(r.tagged_only(F.col("pred"), hit)).alias("hit_reward"))
    return _tagged(spark, d).select("doc_id", b.alias("b")).select("doc_id", "b.*")


def _math(spark, d):
    """Solutions with numbers, some with the final marker."""
    n = F.col("l_quantity").cast("int").cast("string")
    text = F.concat(F.lit("We add 12 and get "), n, F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit(" so\n#### "), n)), F.lit(" done"))
    gold = F.when(F.col("l_linenumber") % 2 == 0, n).otherwise(F.lit("7"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"), gold.alias("gold"))


_MATHSQL = "m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT::VARCHAR AS n, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INT::VARCHAR ELSE '7' END AS gold FROM lineitem)"


@query("s_gsm8k", f"WITH {_MATHSQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN 0.0::DOUBLE WHEN n = gold THEN 1 ELSE 0 END AS strict, CASE WHEN n = gold THEN 1.0::DOUBLE ELSE 0 END AS flexible FROM m")
def s_gsm8k(spark, d):
    return _math(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r.gsm8k_score(F.col("text"), F.col("gold")).alias("strict"), r.gsm8k_score(F.col("text"), F.col("gold"), False).alias("flexible"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("s_qa_em", f"""WITH b AS (SELECT item_id, text, split_part(text, '.', 1) AS first FROM benchmark) SELECT item_id, CASE WHEN item_id % 2 = 0 AND {_NORM.format("first")} = {_NORM.format("text")} THEN 1.0::DOUBLE ELSE 0 END AS em,
  CASE WHEN item_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS sub_em FROM b""")
def s_qa_em(spark, d):
    text = F.concat(F.lit("<answer> x </answer> so <answer> The "), "text", F.when(F.col("item_id") % 2 == 0, "</answer>").otherwise(""))
    gold = F.array(F.get(F.split("text", r"\."), 0))
    return table(spark, d, "benchmark").select("item_id", r.qa_em(text, gold).alias("em"), r.qa_em(text, gold, True).alias("sub_em"))


@query("s_choice", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 1.0::DOUBLE ELSE 0 END AS score FROM documents")
def s_choice(spark, d):
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", r.choice(F.concat(F.lit("I think.\nanswer: $"), letter, F.lit("$")), F.lit("B")).alias("score"))


@query("tool_shape", f"WITH {p.RESP} SELECT uid, sample, round(CASE WHEN score - 0.05 < 0 THEN least(0, score - 0.05 + (sample - 2) / 2 * 0.1) ELSE score - 0.05 END, 9) AS score FROM resp")
def tool_shape(spark, d):
    return p.responses(spark, d).select("uid", "sample", F.round(r.tool_shape(F.col("score") - 0.05, F.col("sample")), 9).alias("score"))


@query("s_code_frac", f"WITH {p.RESP} SELECT uid, round(avg(acc), 6) AS fraction, min(acc) = 1 AS all_passed FROM resp WHERE sample <= 10 GROUP BY uid")
def s_code_frac(spark, d):
    g = p.responses(spark, d).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("sample", "acc"))).alias("x")).select("uid", F.slice("x.acc", 1, 10).alias("x"))
    return g.select("uid", R6(F.aggregate("x", F.lit(0), lambda a, v: a + v) / F.size("x")).alias("fraction"), F.forall("x", lambda v: v == 1).alias("all_passed"))


@query("dispatch", f"WITH {_MATHSQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN 0.0::DOUBLE WHEN n = gold THEN 1 ELSE 0 END AS score FROM m")
def dispatch(spark, d):
    source = F.when(F.col("l_linenumber") % 2 == 0, "openai/gsm8k").otherwise("aime2024")
    scorers = {"openai/gsm8k": r.gsm8k_score, "aime*": r.gsm8k_score}
    return _math(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r.dispatch(source, F.col("text"), F.col("gold"), scorers).alias("score"))


@query("tool_calls", "SELECT doc_id, 'f' || doc_id % 3 AS name, '{\"x\":' || doc_id || '}' AS arguments FROM documents WHERE doc_id % 5 <> 0")
def tool_calls(spark, d):
    i = F.col("doc_id").cast("string")
    block = F.concat(F.lit('text <tool_call>\n{"name": "f'), (F.col("doc_id") % 3).cast("string"), F.lit('", "arguments": {"x":'), i, F.when(F.col("doc_id") % 5 == 0, "").otherwise("}}"), F.lit("\n</tool_call> <tool_call>not json</tool_call>"))
    return table(spark, d, "documents").select("doc_id", F.inline(r.tool_calls(block)))


@query("trunc_tool", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...(truncated)' ELSE text END AS l, CASE WHEN length(text) > 100 THEN '(truncated)...' || right(text, 100) ELSE text END AS r, CASE WHEN length(text) > 100 THEN left(text, 50) || '...(truncated)...' || right(text, 50) ELSE text END AS m FROM documents")
def trunc_tool(spark, d):
    return table(spark, d, "documents").select("doc_id", *(r.truncated(F.col("text"), 100, s).alias(s[0]) for s in ("left", "right", "middle")))


@query("fmt_passages", "SELECT doc_id, 'Doc 1 (Title: ' || split_part(text, chr(10), 1) || ')' || chr(10) || CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END || chr(10) || chr(10) AS passages FROM documents")
def fmt_passages(spark, d):
    return table(spark, d, "documents").select("doc_id", r.passages(F.array("text")).alias("passages"))


@query("clean_text", "SELECT p_partkey AS iid, upper(left(p_name, 1)) || lower(substr(p_name, 2)) || '. x y' AS text FROM part")
def clean_text(spark, d):
    raw = F.concat(F.lit(" "), "p_name", F.lit(" [title]x[b c]  y "))
    return table(spark, d, "part").select(F.col("p_partkey").alias("iid"), r.capitalised(r.clean_activity(raw)).alias("text"))


@query("tool_penalty", f"WITH {p.RESP}, m AS (SELECT uid, sample, score, max(score) OVER (PARTITION BY uid ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM resp) SELECT uid, sample, CASE WHEN score > coalesce(before, 0) THEN 0.0::DOUBLE ELSE -0.05 END AS reward FROM m")
def tool_penalty(spark, d):
    before = F.max("score").over(W.partitionBy("uid").orderBy("sample").rowsBetween(W.unboundedPreceding, -1))
    return p.responses(spark, d).select("uid", "sample", F.when(F.col("score") > F.coalesce(before, F.lit(0.0)), 0.0).otherwise(-0.05).alias("reward"))


# Aggregation


@query("eval_by_source", f"WITH {p.RESP}, u AS (SELECT source, uid, avg(score) AS m FROM resp GROUP BY ALL) SELECT source, round(avg(m), 8) AS score FROM u GROUP BY source")
def eval_by_source(spark, d):
    return m.two_level_mean(p.responses(spark, d), "source", "uid", "score").withColumn("score", F.round("score", 8))


@query("reduce_metrics", "SELECT event_type || '/' || CASE WHEN user_id % 3 = 0 THEN 'max_x' WHEN user_id % 3 = 1 THEN 'min_x' ELSE 'minmax' END AS key, round(CASE WHEN user_id % 3 = 1 THEN min(value) ELSE max(value) END, 6) AS value FROM events GROUP BY event_type, user_id % 3")
def reduce_metrics(spark, d):
    k = F.col("user_id") % 3
    e = table(spark, d, "events").select(F.concat("event_type", F.lit("/"), F.when(k == 0, "max_x").when(k == 1, "min_x").otherwise("minmax")).alias("key"), "value")
    return m.reduced(e, "key", "value").withColumn("value", R6("value"))


@query("batch_metrics", f"""WITH {p.RESP} SELECT round(avg(score), 8) AS score_mean, max(score) AS score_max, min(score) AS score_min, round(avg(len), 6) AS len_mean, max(len) AS len_max, min(len) AS len_min, round(avg((len = 50)::INT), 6) AS clip_ratio,
  round(1 - var_samp(score - len / 500) / (var_samp(score) + 1e-5::DOUBLE), 6) AS explained FROM resp""")
def batch_metrics(spark, d):
    s, n = F.col("score"), F.col("len")
    return p.responses(spark, d).agg(F.round(F.avg(s), 8).alias("score_mean"), F.max(s).alias("score_max"), F.min(s).alias("score_min"), R6(F.avg(n)).alias("len_mean"), F.max(n).alias("len_max"), F.min(n).alias("len_min"), R6(F.avg((n == 50).cast("int"))).alias("clip_ratio"), R6(m.explained_variance(s, n / 500)).alias("explained"))


@query("timing_metrics", "WITH t AS (SELECT event_type AS stage, sum(value) AS seconds FROM events GROUP BY 1), n AS (SELECT count(*) AS tokens FROM lineitem) SELECT stage, round(seconds, 4) AS timing_s, round(seconds * 1000 / tokens, 6) AS per_token_ms FROM t, n")
def timing_metrics(spark, d):
    n = table(spark, d, "lineitem").agg(F.count("*").alias("tokens"))
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("s"))
    return t.crossJoin(F.broadcast(n)).select("stage", F.round("s", 4).alias("timing_s"), R6(F.col("s") * 1000 / F.col("tokens")).alias("per_token_ms"))  # one row


@query("throughput", f"WITH {p.RESP} SELECT sum(len)::BIGINT AS tokens, round(sum(len) / (2.0 * 4), 6) AS throughput FROM resp")
def throughput(spark, d):
    return p.responses(spark, d).agg(F.sum("len").alias("tokens"), R6(F.sum("len") / (2.0 * 4)).alias("throughput"))


@query("maj_vote", f"WITH {p.RESP}, v AS (SELECT uid, source, count(*) AS n, min(sample) AS first, min_by(score, sample) AS value FROM resp GROUP BY ALL) SELECT uid, value AS maj FROM v QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) = 1")
def maj_vote(spark, d):
    return m.majority(p.responses(spark, d), ["uid"], "source", "score", "sample")


@query("val_metrics", f"WITH {p.RESP}, u AS (SELECT status, uid, avg(score) AS mean, stddev_pop(score) AS std, count(*) AS n FROM resp GROUP BY ALL) SELECT status, round(avg(mean), 8) AS mean, round(avg(std), 8) AS std, max(n) AS n_max FROM u GROUP BY status")
def val_metrics(spark, d):
    u = p.responses(spark, d).groupBy("status", "uid").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("n"))
    return u.groupBy("status").agg(F.round(F.avg("mean"), 8).alias("mean"), F.round(F.avg("std"), 8).alias("std"), F.max("n").alias("n_max"))


@query("val_ladder")
def val_ladder(spark, d):
    """Best, worst and majority at every size, over all prompts."""
    return m.validation_metrics(p.responses(spark, d), "status", "uid", "sample", "score", "source")


@query("best_of_exact", f"WITH {p.RESP}, r AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score) AS r, count(*) OVER (PARTITION BY uid) AS n FROM resp) SELECT uid, round(sum(score * (power(r / n, 4) - power((r - 1) / n, 4))), 14) AS best FROM r GROUP BY uid")
def best_of_exact(spark, d):
    return m.best_of_exact(p.responses(spark, d), ["uid"], "score", 4).withColumn("best", F.round("best", 14))


@query("bootstrap")
def bootstrap(spark, d):
    return m.bootstrap(p.responses(spark, d), ["uid"], "score", "sample", 4)


@query("val_route", f"""WITH {p.RESP}, x AS (SELECT status AS source, v.var, v.metric, n FROM (SELECT DISTINCT status, sample AS n FROM resp WHERE sample IN (2, 4)), (VALUES ('reward', 'mean@'), ('reward', 'std@'), ('acc', 'best@'), ('acc', 'maj@')) v(var, metric))
  SELECT concat_ws('/', CASE WHEN var = 'acc' AND metric IN ('best@', 'maj@') AND n = max(n) OVER (PARTITION BY source) THEN 'val-core' ELSE 'val-aux' END, source, var, metric || n) AS key FROM x""")
def val_route(spark, d):
    n = p.responses(spark, d).filter("sample IN (2, 4)").select(F.col("status").alias("source"), F.col("sample").alias("n")).distinct()
    kinds = spark.createDataFrame([("reward", "mean@"), ("reward", "std@"), ("acc", "best@"), ("acc", "maj@")], "var string, metric string")
    x = n.crossJoin(F.broadcast(kinds)).withColumn("n_max", F.max("n").over(W.partitionBy("source"))).withColumn("core", F.lit("acc"))  # four rows
    return x.select(m.routed(F.col("source"), F.col("var"), F.concat("metric", F.col("n").cast("string")), F.col("n"), F.col("n_max"), F.col("core")).alias("key"))


@query("reward_rollup", f"WITH {p.RESP} SELECT coalesce(source, 'all') AS source, round(avg(score), 8) AS mean, max(score) AS max, min(score) AS min, count(*) AS n FROM resp GROUP BY ROLLUP (source)")
def reward_rollup(spark, d):
    return p.responses(spark, d).rollup("source").agg(F.round(F.avg("score"), 8).alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.count("*").alias("n")).withColumn("source", F.coalesce("source", F.lit("all")))


@query("zero_groups", f"WITH {p.RESP}, g AS (SELECT uid, avg((score = 0)::INT) AS z FROM resp GROUP BY uid) SELECT round(avg(z), 8) AS zero_share, round(avg((z = 1)::INT), 8) AS all_zero_ratio, count(*) FILTER (z = 1) AS all_zero FROM g")
def zero_groups(spark, d):
    g = p.responses(spark, d).groupBy("uid").agg(F.avg((F.col("score") == 0).cast("int")).alias("z"))
    return g.agg(F.round(F.avg("z"), 8).alias("zero_share"), F.round(F.avg((F.col("z") == 1).cast("int")), 8).alias("all_zero_ratio"), F.count_if(F.col("z") == 1).alias("all_zero"))


@query("entropy_by_class", f"WITH {p.RESP}, {p.TOK} SELECT CASE WHEN (uid * 31 + i) % 5 = 0 THEN 'special' ELSE 'plain' END AS class, count(*) AS n, round(avg(-logp), 8) AS entropy FROM tok WHERE mask = 1 GROUP BY 1")
def entropy_by_class(spark, d):
    t = p.tokens(spark, d).select("uid", F.posexplode(F.arrays_zip("logp", "mask")).alias("i", "x")).filter("x.mask = 1")
    special = F.when((F.col("uid") * 31 + F.col("i")) % 5 == 0, 151669).otherwise(5).alias("token")
    return t.select(special, (-F.col("x.logp")).alias("e")).groupBy(F.when(F.col("token") >= 151669, "special").otherwise("plain").alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("e"), 8).alias("entropy"))


@query("prob_gap", f"WITH {p.RESP}, {p.TOK}, g AS (SELECT abs(exp(logp) - exp(ref)) AS g FROM tok WHERE mask = 1) SELECT round(max(g), 8) AS max, round(avg(g), 8) AS mean, round(stddev_samp(g), 8) AS std FROM g")
def prob_gap(spark, d):
    g = p.tokens(spark, d).select(F.inline(F.arrays_zip("logp", "ref", "mask"))).filter("mask = 1").select(F.abs(F.exp("logp") - F.exp("ref")).alias("g"))
    return g.agg(F.round(F.max("g"), 8).alias("max"), F.round(F.avg("g"), 8).alias("mean"), F.round(F.stddev_samp("g"), 8).alias("std"))


@query("dup_prompts", "SELECT text AS prompt, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def dup_prompts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("text").alias("prompt")).agg(F.count("*").alias("n")).filter("n > 1")


@query("dist_stats", f"WITH {p.RESP} SELECT round(avg(score), 8) AS mean, max(score) AS max, min(score) AS min, round(stddev_samp(score), 8) AS std, round(sum(score * acc) / (sum(acc) + 1e-8::DOUBLE), 8) AS masked_mean FROM resp")
def dist_stats(spark, d):
    return p.responses(spark, d).repartition(7).agg(F.round(F.avg("score"), 8).alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.round(F.stddev_samp("score"), 8).alias("std"), F.round(F.sum(F.col("score") * F.col("acc")) / (F.sum("acc") + 1e-8), 8).alias("masked_mean"))


@query("slowest", "SELECT event_type, max_by(event_id, (value, -event_id)) AS slowest, round(max(value), 6) AS seconds FROM events GROUP BY event_type")
def slowest(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("slowest"), R6(F.max("value")).alias("seconds"))


@query("dpo_acc", f"""WITH {p.RESP}, r AS (SELECT * FROM resp), j AS (SELECT abs(a.acc - b.acc) AS w, ((a.acc - b.acc) * (a.score - b.score) > 0)::INT AS ok FROM r a JOIN r b ON a.uid = b.uid AND a.sample < b.sample)
  SELECT round(sum(w * ok) / sum(w), 8) AS accuracy, (SELECT round(avg((sign(score - 0.05) = sign(acc - 0.5))::INT), 8) FROM r) AS abs_accuracy FROM j""")
def dpo_acc(spark, d):
    x = p.responses(spark, d)
    a, b = x.select("uid", "sample", "acc", "score"), x.select("uid", F.col("sample").alias("s2"), F.col("acc").alias("a2"), F.col("score").alias("r2"))
    j = a.join(b, "uid").filter("sample < s2").select(F.abs(F.col("acc") - F.col("a2")).alias("w"), (((F.col("acc") - F.col("a2")) * (F.col("score") - F.col("r2"))) > 0).cast("int").alias("ok"))
    total = x.agg(F.round(F.avg((F.signum(F.col("score") - 0.05) == F.signum(F.col("acc") - 0.5)).cast("int")), 8).alias("abs_accuracy"))
    return j.agg(F.round(F.sum(F.col("w") * F.col("ok")) / F.sum("w"), 8).alias("accuracy")).crossJoin(total)  # one row each


@query("append_metrics", f"WITH {p.RESP} SELECT source, count(*) AS n, list(score ORDER BY uid, sample)[:5] AS firsts FROM resp GROUP BY source")
def append_metrics(spark, d):
    g = p.responses(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("uid", "sample", "score"))).alias("x"))
    return g.select("source", "n", F.slice("x.score", 1, 5).alias("firsts"))


@query("val_loss", f"WITH {p.RESP}, b AS (SELECT uid // 32 AS batch, avg(score) AS loss FROM resp GROUP BY 1) SELECT round(avg(loss), 8) AS loss FROM b")
def val_loss(spark, d):
    return p.responses(spark, d).groupBy(F.floor(F.col("uid") / 32).alias("batch")).agg(F.avg("score").alias("loss")).agg(F.round(F.avg("loss"), 8).alias("loss"))


@query("imbalance", f"WITH {p.RESP}, s AS (SELECT uid % 8 AS part, sum(len)::BIGINT AS n FROM resp GROUP BY 1) SELECT min(n) AS min, max(n) AS max, max(n) - min(n) AS diff FROM s")
def imbalance(spark, d):
    return p.responses(spark, d).groupBy((F.col("uid") % 8).alias("part")).agg(F.sum("len").alias("n")).agg(F.min("n").alias("min"), F.max("n").alias("max"), (F.max("n") - F.min("n")).alias("diff"))


@query("ppl_reward", f"WITH {p.RESP}, {p.TOK}, a AS (SELECT uid, sample, avg(logp) AS m FROM tok WHERE mask = 1 GROUP BY ALL) SELECT uid, round(max(m) * 0.1, 8) AS bonus FROM a GROUP BY uid")
def ppl_reward(spark, d):
    a = p.tokens(spark, d).select("uid", "sample", F.inline(F.arrays_zip("logp", "mask"))).filter("mask = 1").groupBy("uid", "sample").agg(F.avg("logp").alias("m"))
    return a.groupBy("uid").agg(F.round(F.max("m") * 0.1, 8).alias("bonus"))
