"""Datasets: chat rows, splits, filters, kernels, retrieval, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import answers
from quillon.functions import kernels as k
from quillon.functions import plugins
from quillon.functions import tokens as tk
from quillon.functions.rewards import sandbox_code as sandbox
from quillon.operators import advantages as a
from quillon.operators import dispatch, ranking
from quillon.operators.retrieval import merged_passages, pooled
from quillon.operators.batch import first_or_drawn, numbered, sampled_order
from quillon.plans import proxies as p
from quillon.registry import query
from quillon.session import materialised, scratch, ship, table
from quillon.sources import files

R6 = lambda c: F.round(c, 6)
CHATS = "chats AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"


@query("chat_rows", "SELECT item_id, 'bench' AS data_source, 'user' AS role, text || chr(10) || 'Answer:' AS content, 'math' AS ability, 'rule' AS style, split_part(text, '.', 1) AS ground_truth, 'train' AS split, row_number() OVER (ORDER BY item_id) - 1 AS index FROM benchmark")
def chat_rows(spark, d):
    b = numbered(table(spark, d, "benchmark"), "item_id", name="i")
    rows = b.select(
        "item_id", F.lit("bench").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.concat("text", F.lit("\nAnswer:")).alias("content"))).alias("prompt"), F.lit("math").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.get(F.split("text", r"\."), 0).alias("ground_truth")).alias("reward_model"), F.struct(F.lit("train").alias("split"), F.col("i").alias("index")).alias("extra_info"),
    )
    return rows.select("item_id", "data_source", F.inline("prompt"), "ability", "reward_model.*", "extra_info.*")


@query("mm_segments", "SELECT p_partkey AS iid, ['<image>', p_name, '<video>', p_type] AS segments FROM part")
def mm_segments(spark, d):
    text = F.concat(F.lit("<image>"), "p_name", F.lit("<video>"), "p_type")
    cut = F.filter(F.split(text, r"(?<=<image>)|(?=<image>)|(?<=<video>)|(?=<video>)"), lambda x: x != "")
    return table(spark, d, "part").select(F.col("p_partkey").alias("iid"), cut.alias("segments"))


@query("prompt_norm", "SELECT conv_id, turn, text || CASE WHEN role = 'user' THEN ' /think' ELSE '' END AS content, 'rule' AS style FROM conversations")
def prompt_norm(spark, d):
    m = F.array(F.struct("role", F.col("text").alias("content")))
    as_json = F.when(F.col("turn") % 2 == 0, F.to_json(m)).otherwise(F.lit("plain"))
    parsed = F.when(as_json.startswith("["), F.from_json(as_json, "array<struct<role string, content string>>")).otherwise(m)
    think = F.transform(parsed, lambda x: F.struct(x["role"].alias("role"), F.when(x["role"] == "user", F.concat(x["content"], F.lit(" /think"))).otherwise(x["content"]).alias("content")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.get(think, 0)["content"].alias("content"), F.coalesce(F.lit(None).cast("string"), F.lit("rule")).alias("style"))


@query("chat_split_last", f"WITH {CHATS} SELECT conv_id, list_transform(messages[:-2], lambda m: m.content) AS prompt, messages[-1].content AS ground_truth FROM chats")
def chat_split_last(spark, d):
    m = F.col("messages")
    return p.chats(spark, d).select("conv_id", F.slice(m, F.lit(1), F.size(m) - 1)["content"].alias("prompt"), F.element_at(m, -1)["content"].alias("ground_truth"))


@query("pref_unpivot", f"WITH {p.RESP}, x AS (SELECT uid, max(score) AS c, min(score) AS r FROM resp GROUP BY uid) SELECT uid, 'chosen' AS kind, c AS score FROM x UNION ALL SELECT uid, 'rejected', r FROM x")
def pref_unpivot(spark, d):
    x = p.responses(spark, d).groupBy("uid").agg(F.max("score").alias("chosen"), F.min("score").alias("rejected"))
    return x.unpivot("uid", ["chosen", "rejected"], "kind", "score")


@query("gen_transpose", f"WITH {p.RESP} SELECT uid, list(score ORDER BY sample) AS responses FROM resp GROUP BY uid")
def gen_transpose(spark, d):
    return p.responses(spark, d).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("sample", "score"))).alias("x")).select("uid", F.col("x.score").alias("responses"))


@query("filter_overlong", "SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) <= 200 - 10")
def filter_overlong(spark, d):
    n = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != ""))
    return table(spark, d, "documents").filter(n <= 200 - 10).select("doc_id")


def _byte_bpe(spark):
    from public_tokenizers import path

    return tk.Tokens(spark, str(path("byte_bpe_50k.json")))


@query("filter_overlong_tokens")
def filter_overlong_tokens(spark, d):
    """By tokens instead of words: the counts are a column of a table."""
    docs = tk.with_length(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), _byte_bpe(spark)).select("doc_id", "token_len")
    return materialised(spark, docs, "lengths").filter("token_len <= 256 - 10")


@query("max_samples", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 64")
def max_samples(spark, d):
    return first_or_drawn(table(spark, d, "documents").select("doc_id"), "doc_id", 64)


@query("max_samples_seeded", f"SELECT doc_id FROM documents ORDER BY {p.seeded_sql(5, 'doc_id')}, doc_id LIMIT 64")
def max_samples_seeded(spark, d):
    return first_or_drawn(table(spark, d, "documents").select("doc_id"), "doc_id", 64, seed=5)


@query("label_present", "SELECT doc_id FROM documents WHERE length(lang) > 0 AND lang <> 'en'")
def label_present(spark, d):
    return table(spark, d, "documents").filter("length(lang) > 0 AND lang <> 'en'").select("doc_id")


@query("date_str_range", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1998-06-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1999-01-00'")
def date_str_range(spark, d):
    return table(spark, d, "orders").filter(files.days_between(F.col("o_orderdate"), "1998-06-01", "1999-01-00")).select("o_orderkey")


@query("percent_slice", "SELECT doc_id, CASE WHEN rn <= floor(0.75 * n) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents)")
def percent_slice(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    first = int(0.75 * t.count())
    return numbered(t, "doc_id").select("doc_id", F.when(F.col("ord") < first, "train").otherwise("test").alias("split"))


@query("dedup_adjacent", "SELECT conv_id, turn FROM conversations QUALIFY NOT (role = 'user' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM 'user')")
def dedup_adjacent(spark, d):
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").withColumn("before", before).filter("NOT (role = 'user' AND before <=> 'user')").select("conv_id", "turn")


_RUNS = "r AS (SELECT conv_id, turn, role, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new FROM conversations))"


@query("tool_blocks", f"WITH {_RUNS} SELECT conv_id, run::BIGINT AS run, any_value(role) AS role, count(*) AS n FROM r GROUP BY ALL")
def tool_blocks(spark, d):
    c = table(spark, d, "conversations").withColumn("run", a.islands(W.partitionBy("conv_id").orderBy("turn"), F.col("role")))
    return c.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.count("*").alias("n"))


@query("num_turns", f"WITH {_RUNS} SELECT conv_id, count(DISTINCT run) FILTER (role <> 'system') AS turns FROM r GROUP BY conv_id")
def num_turns(spark, d):
    c = table(spark, d, "conversations").withColumn("run", a.islands(W.partitionBy("conv_id").orderBy("turn"), F.col("role")))
    return c.groupBy("conv_id").agg(F.count_distinct(F.when(F.col("role") != "system", F.col("run"))).alias("turns"))


@query("mt_loss_mask", "SELECT conv_id, list_concat_agg(m ORDER BY turn) AS mask FROM (SELECT conv_id, turn, list_transform(range(len(string_split(text, ' '))), lambda i: (role = 'assistant')::INT) AS m FROM conversations) GROUP BY conv_id".replace("list_concat_agg(m ORDER BY turn)", "flatten(list(m ORDER BY turn))"))
def mt_loss_mask(spark, d):
    n = lambda m: F.size(F.split(m["content"], " "))
    return p.chats(spark, d).select("conv_id", F.flatten(F.transform("messages", lambda m: F.array_repeat((m["role"] == "assistant").cast("int"), n(m)))).alias("mask"))


@query("mt_loss_mask_tokens")
def mt_loss_mask_tokens(spark, d):
    return tk.multi_turn(p.chats(spark, d), "messages", _byte_bpe(spark)).select("conv_id", "input_ids", "loss_mask")


@query("stop_reason", "SELECT conv_id, CASE WHEN sum(length(text)) > 4000 THEN 'length' WHEN count(*) FILTER (role = 'assistant') >= 3 THEN 'turns' ELSE 'no tool call' END AS reason FROM conversations GROUP BY conv_id")
def stop_reason(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.when(F.sum(F.length("text")) > 4000, "length").when(F.count_if(F.col("role") == "assistant") >= 3, "turns").otherwise("no tool call").alias("reason"))


@query("tool_span_mask", "WITH x AS (SELECT doc_id, unnest(range(20)) AS i FROM documents), s AS (SELECT doc_id, i, coalesce(sum(((i * 3 + doc_id) % 5 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM x) SELECT doc_id, list((span % 2 = 0)::INT ORDER BY i) AS mask FROM s GROUP BY doc_id")
def tool_span_mask(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.sequence(F.lit(0), F.lit(19))).alias("i", "t")).withColumn("eos", ((F.col("i") * 3 + F.col("doc_id")) % 5 == 0).cast("int"))
    span = F.coalesce(F.sum("eos").over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    y = x.withColumn("m", (span % 2 == 0).cast("int")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("x"))
    return y.select("doc_id", F.col("x.m").alias("mask"))


@query("registry_scan", "SELECT n_name AS name, n_regionkey AS grp FROM nation")
def registry_scan(spark, d):
    reg = files.Registry({"nations": {"path": f"{d}/nation.parquet", "format": "parquet", "columns": {"n_name": "name", "n_regionkey": "grp"}}})
    return reg.read(spark, "nations")


@query("scan_parquet", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def scan_parquet(spark, d):
    return files.parquet(spark, [f"{d}/supplier.parquet", f"{d}/supplier.parquet"]).select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))


def _written(spark, df: DataFrame, kind: str) -> str:
    to = scratch(spark, kind)
    getattr(df.write, kind)(to)
    return to


@query("scan_jsonl", "SELECT p_partkey, p_name FROM part")
def scan_jsonl(spark, d):
    return files.jsonl(spark, _written(spark, table(spark, d, "part").select("p_partkey", "p_name"), "json"), "p_partkey long, p_name string")


@query("scan_sequences", f"WITH {p.SEQS} SELECT user_id::VARCHAR AS user_id, list_transform(items, lambda x: x::VARCHAR) AS item_ids FROM seqs")
def scan_sequences(spark, d):
    line = F.concat_ws(" ", F.col("user_id").cast("string"), F.array_join(F.col("items").cast("array<string>"), " "))
    to = _written(spark, p.sequences(spark, d).select(line.alias("value")).unionByName(spark.createDataFrame([("",), ("lonely",)], "value string")), "text")
    return files.sequences(spark, to)


@query("scan_sims", "SELECT p_partkey::VARCHAR AS anchor, list_transform(range(1, 6), lambda i: (p_partkey + i)::VARCHAR) AS neighbours FROM part")
def scan_sims(spark, d):
    line = F.concat_ws(" ", F.col("p_partkey").cast("string"), *((F.col("p_partkey") + i).cast("string") for i in range(1, 9)))
    rows = table(spark, d, "part").select(F.lit(1).alias("o"), "p_partkey", line.alias("value")).unionByName(spark.createDataFrame([(0, -1, "anchor neighbours")], "o int, p_partkey long, value string"))
    return files.neighbours(spark, _written(spark, rows.coalesce(1).sortWithinPartitions("o", "p_partkey").select("value"), "text"), 5)


@query("scan_keyed_json", "SELECT p_partkey::VARCHAR AS id, p_name AS title, '' AS description, p_type AS categories FROM part")
def scan_keyed_json(spark, d):
    return _keyed_json(spark, table(spark, d, "part"))


def _keyed_json(spark, part):
    obj = part.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("categories")))))).alias("value"))  # the format is one object
    return files.keyed_json(spark, _written(spark, obj, "text"))


@query("scan_step_dumps", "SELECT (doc_id % 3)::INT AS step, doc_id, '***' AS masked FROM documents")
def scan_step_dumps(spark, d):
    to = scratch(spark, "dumps")
    for s in range(3):
        table(spark, d, "documents").filter(F.col("doc_id") % 3 == s).select("doc_id", F.lit("<p>").alias("secret")).coalesce(1).write.json(f"{to}/{s}.jsonl")
    return files.step_dumps(spark, to, "doc_id long, secret string").select("step", "doc_id", F.regexp_replace("secret", ".", "*").alias("masked"))


@query("generation_dump", f"WITH {p.RESP}, o AS (SELECT uid % 4 AS step, uid * 100 + sample AS ord, score, len FROM resp) SELECT step, ord, score, len AS kept, CASE WHEN step <> 2 THEN len END AS dropped FROM o")
def generation_dump(spark, d):
    """Of two further columns one lacks a value in step 2, and is left out there."""
    to = scratch(spark, "generations")
    rows = p.responses(spark, d).select((F.col("uid") % 4).alias("step"), (F.col("uid") * 100 + F.col("sample")).alias("ord"), "score", "len")
    first = rows.filter("step = 2").agg(F.min("ord")).first()[0]  # one number
    extras = {"kept": rows.select("step", "ord", F.col("len").alias("kept")), "dropped": rows.filter(F.col("ord") != F.lit(first)).select("step", "ord", F.col("len").alias("dropped"))}
    files.dump_generations(rows.drop("len"), to, extras=extras)
    return spark.read.schema("ord long, score double, kept long, dropped long, step long").json(to)


@query("cached_copy", "SELECT r_regionkey, r_name, 1::BIGINT AS copies, false AS missing FROM region")
def cached_copy(spark, d):
    """A table read from its cached copy; a second call does not copy again."""
    cache = scratch(spark, "cache")
    files.make_folder(spark, cache)
    to = {files.cached_copy(spark, f"{d}/region.parquet", cache) for _ in range(2)}
    return spark.read.parquet(*to).select("r_regionkey", "r_name", F.lit(len(to)).cast("long").alias("copies"), F.lit(not files.exists(spark, *to)).alias("missing"))


@query("metric_nest", "SELECT event_type, '{\"val\":{\"n\":' || count(*) || ',\"max\":{\"v\":' || max(user_id) || '}}}' AS nested FROM events GROUP BY event_type")
def metric_nest(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("val/n"), F.max("user_id").alias("val/max/v"))
    return g.select("event_type", files.nested(["val/n", "val/max/v"]).alias("nested"))


@query("merge_sets", "SELECT s_suppkey AS k FROM supplier UNION ALL SELECT c_custkey FROM customer")
def merge_sets(spark, d):
    a1 = _written(spark, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "json")
    b1 = _written(spark, table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "json")
    return files.merged(spark, [a1, f"{a1}-missing", b1], "k long")[0]


@query("interleave", f"SELECT c_custkey, part, row_number() OVER (ORDER BY clock, c_custkey) - 1 AS place FROM (SELECT c_custkey, (c_custkey % 2)::INT AS part, CASE WHEN c_custkey % 2 = 0 THEN -ln({p.uniform_sql(42, 'c_custkey')}) / 0.7::DOUBLE ELSE -ln({p.uniform_sql(43, 'c_custkey')}) / 0.3::DOUBLE END AS clock FROM customer)")
def interleave(spark, d):
    parts = [table(spark, d, "customer").filter(F.col("c_custkey") % 2 == i).select("c_custkey") for i in (0, 1)]
    return files.interleaved(parts, [0.7, 0.3], "c_custkey")


@query("join_bucketed", "SELECT o_custkey AS user_id, o_orderkey AS okey, count(l_orderkey) AS n, count(DISTINCT l_partkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def join_bucketed(spark, d):
    """Purchases by order from two registered tables in the same buckets: neither the
    join nor the groups move rows."""
    orders, lines = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    n, known = files.buckets_for(lines), files.Registry({})
    known.store(orders, "orders", scratch(spark, "orders"), ["o_orderkey"], n, {"o_orderkey": "okey", "o_custkey": "user_id"})
    known.store(lines, "lines", scratch(spark, "lines"), ["l_orderkey"], n, {"l_orderkey": "key", "l_partkey": "iid"})
    both = known.read(spark, "orders").hint("merge").join(known.read(spark, "lines"), F.col("okey") == F.col("key"), "left")
    return both.groupBy("okey", "user_id").agg(F.count("key").alias("n"), F.size(F.collect_set("iid")).cast("long").alias("items"))


@query("scan_pruned", "SELECT event_id, event_type FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY event_type LIMIT 2)")
def scan_pruned(spark, d):
    """A dataset of two of the folders that a table is kept in."""
    events = table(spark, d, "events").select("event_id", "event_type")
    first = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").limit(2).collect()]  # two names
    known = files.Registry({})
    known.store_partitioned(events, "some", scratch(spark, "events"), "event_type", first)
    return known.read(spark, "some")


@query("dispatch_parallel", "WITH o AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS place, (SELECT count(*) FROM customer) AS n FROM customer) SELECT c_custkey, place, (place // ((n + 6) // 7))::INT AS worker, c_acctbal < 0 AS owes FROM o")
def dispatch_parallel(spark, d):
    """Rows dealt to seven workers with padding, and their results in order."""
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    done = dispatch.run(rows, "c_custkey", 7, lambda worker, batch: batch.assign(owes=batch["c_acctbal"] < 0), "owes boolean")
    return done.select("c_custkey", F.col("_ord").alias("place"), F.col("_worker").alias("worker"), "owes")


# Kernels


def _variety(source, text, gold) -> float:
    words = text.split(" ")
    return len(set(words)) / len(words)


@query("s_timed", "SELECT doc_id, round(len(list_distinct(string_split(text, ' ')))::DOUBLE / len(string_split(text, ' ')), 9) AS score FROM documents")
def s_timed(spark, d):
    """A Python scorer with a limit of a minute for each row."""
    score = plugins.timed_reward(_variety, 60.0)("source", "text", "lang")
    ship(spark)
    return table(spark, d, "documents").select("doc_id", F.round(score, 9).alias("score"))


def _case(*rows: tuple[str, str, str]) -> str:
    """SQL for ``iid`` and the value of the spelling that a part has."""
    whens = " ".join(f"WHEN {i} THEN {want}" for i, (_, _, want) in enumerate(rows))
    return f"CASE p_partkey % {len(rows)} {whens} END"


def _spelt(spark, d, rows: tuple[tuple[str, str, str], ...]):
    """``iid``, ``text``, ``gold``: each part has one of the spellings in turn, with
    its size as N, its size and one as M, and twice its size as D."""
    n = F.col("p_size")

    def filled(k: int):
        out = F.get(F.array(*(F.lit(r[k]) for r in rows)), F.col("p_partkey") % len(rows))
        for mark, x in (("N", n), ("M", n + 1), ("D", 2 * n)):
            out = F.replace(out, F.lit(f"@{mark}"), x.cast("string"))
        return out

    return table(spark, d, "part").select(F.col("p_partkey").alias("iid"), filled(0).alias("text"), filled(1).alias("gold"))


_BOXED = (
    ("so \\boxed{1} then \\boxed{a{@N}} end", "", "'a{' || p_size || '}'"),
    ("\\boxed @N$ then \\boxed{2}", "", "p_size::VARCHAR"),
    ("\\fbox{@N} only", "", "p_size::VARCHAR"),
    ("\\boxed{@N} and \\boxed{open", "", "NULL"),
    ("no box of @N", "", "NULL"),
)


@query("last_boxed", f"SELECT p_partkey AS iid, {_case(*_BOXED)} AS boxed FROM part")
def last_boxed(spark, d):
    ship(spark)
    return _spelt(spark, d, _BOXED).select("iid", k.udf(k.last_boxed, "string")(F.col("text")).alias("boxed"))


_LATEX = (
    ("\\dfrac{@N}{3}", "@N/3", "true"),
    ("\\tfrac@N\\frac12", "x", "false"),
    ("x = @N", "@N", "true"),
    ("xyz = @N", "@N", "false"),
    ("@N\\%", "@N", "true"),
    ("@N%", "@N", "false"),
    ("@N\\text{ cm}", "@N", "true"),
    ("\\left(@N, @M\\right)", "(@N,@M)", "true"),
    ("@N", "@M", "false"),
    ("\\sqrt", "\\sqrt", "true"),
    ("@N/@M", "\\frac{@N}{@M}", "true"),
    ("\\frac{@D}{2}", "@N", "false"),
)


@query("s_math", f"SELECT p_partkey AS iid, {_case(*_LATEX)} AS equal FROM part")
def s_math(spark, d):
    return _spelt(spark, d, _LATEX).select("iid", answers.latex_equal(F.col("text"), F.col("gold")).alias("equal"))


_FINAL = (
    ("Answer: 1\nAnswer: $@N$ dollars", "@N", "1.0"),
    ("answer : $@N$ and $@M$", "@N", "1.0"),
    ("Answer: \\boxed{\\frac{@N}{7}}", "\\frac{@N}{7}", "1.0"),
    ("Answer: 1,000,0@N", "10000@N", "1.0"),
    ("Answer: x = @N students", "@N", "1.0"),
    ("Answer: @N.0", "@N", "-1.0"),
    ("Answer: @N\nAnswer: @M", "@N", "-1.0"),
    ("It is @N", "@N", "-1.0"),
    ("Answer: @N" + " and so on" * 40, "@N", "-1.0"),
)


@query("s_minerva", f"SELECT p_partkey AS iid, ({_case(*_FINAL)})::DOUBLE AS score FROM part")
def s_minerva(spark, d):
    return _spelt(spark, d, _FINAL).select("iid", answers.minerva(F.col("text"), F.col("gold")).alias("score"))


_STRICT = (("so \\boxed{a{@N}}", "a{@N}", "1.0"), ("\\boxed{ @N}", "@N", "-1.0"), ("\\boxed{@N}" + " " * 100, "@N", "-1.0"), ("\\fbox{@N}", "@N", "-1.0"), ("\\boxed{@N} \\boxed{@M}", "@M", "1.0"))


@query("s_strict_box", f"SELECT p_partkey AS iid, ({_case(*_STRICT)})::DOUBLE AS score FROM part")
def s_strict_box(spark, d):
    ship(spark)
    return _spelt(spark, d, _STRICT).select("iid", answers.strict_box(F.col("text"), F.col("gold")).alias("score"))


_PRIME = (
    ("The answer is @N.0", "@N", "true"),
    ("So \\boxed{\\frac{@N}{3}}", "@N/3", "true"),
    ("So \\boxed{@N(x+1)}", "@Nx+@N", "true"),
    ("So \\boxed{@N(x+1)}", "@Nx+@M", "false"),
    ("Answer: @N cm", "@N", "true"),
    ("@N is the answer", "@M", "false"),
    ("So \\boxed{(@N, @M)}", "(@N,@M)", "true"),
    ("So \\boxed{(@N, @M)}", "(@M,@N)", "false"),
    ("So \\boxed{@N00}", "@N", "true"),
    ("So \\boxed{@N\\pi}", "@N \\cdot 3.14159265", "true"),
    ("So \\boxed{\\sqrt{@N}\\sqrt{@N}y}", "@Ny", "true"),
    ("no number is there", "@N", "false"),
)


@query("s_prime_math", f"SELECT p_partkey AS iid, {_case(*_PRIME)} AS equal FROM part")
def s_prime_math(spark, d):
    ship(spark)
    return _spelt(spark, d, _PRIME).select("iid", answers.right(F.col("text"), F.col("gold")).alias("equal"))


_VERIFIED = (
    ("So \\boxed{@N.0}", "@N", "1.0"),
    ("So \\boxed{\\frac{@D}{2}}", "@N", "1.0"),
    ("The answer is @N", "@N", "1.0"),
    ("So \\boxed{@M}", "@N", "0.0"),
    ("So \\boxed{@N} or \\boxed{@M}", "@N", "0.0"),
    ("none", "@N", "0.0"),
)


@query("s_math_verify", f"SELECT p_partkey AS iid, ({_case(*_VERIFIED)})::DOUBLE AS score FROM part")
def s_math_verify(spark, d):
    ship(spark)
    return _spelt(spark, d, _VERIFIED).select("iid", answers.verified(F.col("text"), F.col("gold")).alias("score"))


@query("case_codec", "SELECT p_partkey AS iid, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE '{\"inputs\":[\"' || p_name || '\"],\"outputs\":[' || p_size || ']}' END AS cases FROM part")
def case_codec(spark, d):
    """Packed and plain test cases, and some that are neither."""
    ship(spark)
    t = table(spark, d, "part").select(F.col("p_partkey").alias("iid"), F.to_json(F.struct(F.array("p_name").alias("inputs"), F.array("p_size").alias("outputs"))).alias("t"))
    code = F.when(F.col("iid") % 4 == 3, F.concat(F.lit("x"), "t")).when(F.col("iid") % 4 == 0, F.col("t")).otherwise(k.udf(k.packed_cases, "string")(F.col("t")))
    return t.select("iid", code.alias("code")).select("iid", k.udf(k.case_text, "string")(F.col("code")).alias("cases"))


_SANDBOX = (  # error, api, compile status and code, run status, code and output; expected output; code
    ("x", "Success", None, None, "Finished", 0, "1", "1", -1),
    (None, "Success", "Finished", 0, "Finished", 0, "1\n", "1", 1),
    (None, "Success", "Finished", 0, "Finished", 0, "2", "1", 0),
    (None, "Success", None, None, "TimeLimitExceeded", None, None, "1", -1),
    (None, "SandboxError", None, None, None, None, None, "1", -1),
    (None, "Failed", "Error", 1, None, None, None, "1", -4),
    (None, "Failed", "TimeLimitExceeded", None, None, None, None, "1", -4),
    (None, "Failed", "Finished", 1, "Finished", 0, "1", "1", -4),
    (None, "Failed", "Finished", 0, "TimeLimitExceeded", None, None, "1", -3),
    (None, "Failed", None, None, "Error", None, None, "1", -2),
    (None, "Failed", None, None, "Finished", 2, None, "1", -2),
    (None, "Failed", None, None, "Finished", 0, "1", "1", -1),
    (None, "Other", None, None, None, None, None, "1", -1),
)


@query("sandbox_codes", "SELECT p_partkey AS iid, CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN {r[-1]}" for i, r in enumerate(_SANDBOX)) + " END AS code FROM part")
def sandbox_codes(spark, d):
    kinds = "error string, api string, cs string, cc int, rs string, rc int, out string, expected string, code int, i int"
    answers_of = F.broadcast(spark.createDataFrame([(*r, i) for i, r in enumerate(_SANDBOX)], kinds))  # as many as there are above
    x = table(spark, d, "part").select(F.col("p_partkey").alias("iid"), (F.col("p_partkey") % len(_SANDBOX)).cast("int").alias("i")).join(answers_of, "i")
    compiled = F.when(F.col("cs").isNotNull(), F.struct(F.col("cs").alias("status"), F.col("cc").alias("return_code"), F.lit(None).cast("string").alias("stdout")))
    run = F.when(F.col("rs").isNotNull(), F.struct(F.col("rs").alias("status"), F.col("rc").alias("return_code"), F.col("out").alias("stdout")))
    return x.select("iid", sandbox(F.col("error"), F.col("api"), compiled, run, F.col("expected")).alias("code"))


@query("server_choice")
def server_choice(spark, d):
    """Requests of a user stay with a server; each type has servers of its own."""
    e = table(spark, d, "events").select("event_type", "event_id", F.col("user_id").alias("key"))
    return k.partitioned(e, "event_type", "event_id", "key", k.chosen_servers, servers=4, remembered=50)


_COUNT = (("\\boxed{@N}", "@N", "1.0"), ("\\boxed{@N}", "@M", "0.0"), ("\\boxed{@N.0}", "@N", "0.0"), ("@N", "@N", "0.0"), ("\\fbox{@N}", "@N", "0.0"))


@query("s_char_count", f"SELECT p_partkey AS iid, ({_case(*_COUNT)})::DOUBLE AS score FROM part")
def s_char_count(spark, d):
    ship(spark)
    said = k.udf(answers.boxed, "string")(F.col("text"))
    return _spelt(spark, d, _COUNT).select("iid", F.coalesce((said == F.col("gold")).cast("double"), F.lit(0.0)).alias("score"))


_ANY = (("\\boxed{@N}", "none|@N", "1"), ("\\boxed{\\dfrac{@N}{2}}", "@N/2|x", "1"), ("\\boxed{@N}", "@M|0", "2"), ("@N", "@N|@N", "3"))


@query("s_boxed_any", f"SELECT p_partkey AS iid, (c = 1)::INT::DOUBLE AS score, (c < 3)::INT::DOUBLE AS format_score, (c = 1)::INT::DOUBLE AS acc FROM (SELECT p_partkey, {_case(*_ANY)} AS c FROM part)")
def s_boxed_any(spark, d):
    ship(spark)
    said = _spelt(spark, d, _ANY).select("iid", k.udf(k.last_boxed, "string")(F.col("text")).alias("said"), F.split("gold", r"\|").alias("golds"))
    return said.select("iid", F.inline(F.array(answers.box_bundle(F.col("said"), F.col("golds")))))


@query("repeatness", """WITH t AS (SELECT p_partkey AS iid, p_name || p_name AS s, length(p_name) * 2 AS n FROM part), x AS (SELECT iid, n, s, unnest(range(1, n + 1)) AS i FROM t), y AS (SELECT iid, n, substr(s, i) AS a, lag(substr(s, i)) OVER (PARTITION BY iid ORDER BY substr(s, i) COLLATE "C") AS b FROM x),
  z AS (SELECT iid, n, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: left(a, k) = left(b, k))) AS lcp FROM y WHERE b IS NOT NULL) SELECT iid, 2 * sum(lcp) / (any_value(n) * (any_value(n) + 1)) > 0.2 AS repeats FROM z GROUP BY iid""".replace(' COLLATE "C"', ""))
def repeatness(spark, d):
    ship(spark)
    return table(spark, d, "part").select(F.col("p_partkey").alias("iid"), k.udf(k.repeatness, "boolean")(F.concat("p_name", "p_name")).alias("repeats"))


_INFIX = (
    ("(@N @ 4) + 6/3", "", "3 * p_size - 2 * 4 + 6.0 / 3"),
    ("@N*2-3*@M", "", "p_size * 2 - 3 * (p_size + 1)"),
    ("-(@N+1)*2", "", "-(p_size + 1) * 2"),
    ("@N/4/2", "", "p_size / 4 / 2"),
    ("1+2@@N", "", "1 + 6 - 2 * p_size"),
    ("(@N", "", "NULL"),
    ("@N/0", "", "NULL"),
)


@query("infix", f"SELECT p_partkey AS iid, ({_case(*_INFIX)})::DOUBLE AS value FROM part")
def infix(spark, d):
    ship(spark)
    return _spelt(spark, d, _INFIX).select("iid", k.udf(k.evaluate, "double")(F.col("text")).alias("value"))


_TRACE = "CASE doc_id % 4 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} END"
_ONE, _TWO = "'x = ' || doc_id", "'y = ' || doc_id"


@query("trace_to_messages", f"""SELECT doc_id, {_TRACE.format("['user', 'assistant', 'tool', 'assistant']", "['user', 'assistant', 'tool', 'assistant', 'tool', 'assistant']", "['user', 'assistant']")} AS roles,
  {_TRACE.format("['q ' || doc_id, 'I think', doc_id::VARCHAR, 'so ' || doc_id]", "['q ' || doc_id, 'First', 'one', 'then', 'two', 'done']", "['q ' || doc_id, 'It is ' || doc_id]")} AS contents,
  {_TRACE.format(f"[NULL, {_ONE}, NULL, NULL]", f"[NULL, {_ONE}, NULL, {_TWO}, NULL, NULL]", "[NULL::VARCHAR, NULL]")} AS codes FROM documents""")
def trace_to_messages(spark, d):
    """Traces of one call, of two, of none, and one that ends within a turn."""
    ship(spark)
    n = F.col("doc_id").cast("string")
    kinds = (
        F.concat(F.lit("I think <code>```python\nx = "), n, F.lit("\n```</code>\n<interpreter>"), n, F.lit("</interpreter> so <answer>"), n, F.lit("</answer>")),
        F.concat(F.lit("First <code>x = "), n, F.lit("</code><interpreter>one</interpreter>then<code>y = "), n, F.lit("</code> <interpreter> two</interpreter><answer>done</answer>")),
        F.concat(F.lit("It is <answer>"), n, F.lit("</answer>")),
        F.lit("and <code>x</code> is all"),
    )
    f = k.udf(k.trace_messages, "array<struct<role string, content string, code string>>")
    x = table(spark, d, "documents").select("doc_id", f(F.concat(F.lit("*user question:* q "), n), F.get(F.array(*kinds), F.col("doc_id") % 4)).alias("m"))
    return x.select("doc_id", F.col("m.role").alias("roles"), F.col("m.content").alias("contents"), F.col("m.code").alias("codes"))


def _batches(spark, d):
    # all rollouts of 1,024 neighbouring prompt ids: a batch stays as large on any table
    return p.responses(spark, d).select(F.floor(F.col("uid") / 1024).alias("batch"), (F.col("uid") * 100 + F.col("sample")).alias("ord"), "len")


for _name, _kernel, _options in (("balance_kk", k.karmarkar_karp, {"k": 4}), ("balance_greedy", k.greedy_partition, {"k": 4}), ("microbatch", k.micro_batches, {"most_tokens": 2000})):
    query(_name, None)(lambda spark, d, f=_kernel, o=_options: k.partitioned(_batches(spark, d), "batch", "ord", "len", f, **o).groupBy("batch", "part").agg(F.sum("len").alias("tokens"), F.count("*").alias("n")))


@query("sampler", f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS sequential, row_number() OVER (ORDER BY {p.seeded_sql(7, 'doc_id')}, doc_id) - 1 AS shuffled, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS curriculum FROM documents")
def sampler(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars")
    x = sampled_order(x, "doc_id", "sequential", name="sequential")
    x = sampled_order(x, "doc_id", "shuffle", 7, name="shuffled")
    return sampled_order(x, "doc_id", "curriculum", difficulty="n_chars", name="curriculum").drop("n_chars")


# Retrieval


@query("retrieve_dense", """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 = 0), s AS (SELECT q.vec_id, c.vec_id AS item_id, list_inner_product(q.v, c.embedding::DOUBLE[]) AS s FROM q, embeddings c)
  SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, item_id) AS rank, item_id, round(s, 6) AS similarity FROM s QUALIFY rank <= 3""")
def retrieve_dense(spark, d):
    e = table(spark, d, "embeddings")
    return ranking.inner_topk(e.filter("vec_id % 10 = 0"), e, 3, "vec_id", "embedding", False).withColumn("similarity", R6("similarity"))


_BM25 = """WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS tf FROM w GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
  st AS (SELECT count(*) AS n, avg(n) AS mean FROM dl), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM benchmark),
  s AS (SELECT item_id, doc_id, round(sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl.n / mean))), 6) AS score FROM q JOIN tf USING (w) JOIN df USING (w) JOIN dl USING (doc_id), st GROUP BY ALL)
  SELECT item_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {k}"""


@query("retrieve_bm25", _BM25.format(k=3, k1=0.9, b=0.4))
def retrieve_bm25(spark, d):
    from quillon.operators.retrieval import bm25

    return bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", "text", 3, k1=0.9, b=0.4)


@query("retrieve_indexed", f"SELECT 'long' AS ask, * FROM ({_BM25.format(k=10, k1=0.9, b=0.4)}) UNION ALL SELECT 'short', * FROM ({_BM25.format(k=1, k1=1.2, b=0.75)})")
def retrieve_indexed(spark, d):
    """One stored index, asked twice with other parameters."""
    from quillon.operators import inverted_index

    path = scratch(spark, "index")
    inverted_index.build(table(spark, d, "documents"), "doc_id", "text", path)
    ask = lambda name, *options: inverted_index.search(spark, path, table(spark, d, "benchmark"), "item_id", "doc_id", "text", *options).select(F.lit(name).alias("ask"), "*")
    return ask("long", 10, 0.9, 0.4).unionByName(ask("short", 1, 1.2, 0.75))


@query("retrieve_merged", """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 = 0), s AS (SELECT q.vec_id, c.vec_id AS item_id, list_inner_product(q.v, c.embedding::DOUBLE[]) AS s FROM q, embeddings c),
  t AS (SELECT vec_id, item_id, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, item_id) AS r FROM s QUALIFY r <= 3), m AS (SELECT vec_id, string_agg('Doc ' || r || ' (Title: item ' || item_id || ')' || chr(10) || 'text ' || item_id, chr(10) || '---' || chr(10) ORDER BY r) AS text FROM t WHERE vec_id % 70 <> 0 GROUP BY vec_id)
  SELECT q.vec_id, CASE WHEN q.vec_id % 110 = 0 THEN 'api_error' WHEN m.text IS NULL THEN 'no_results' ELSE 'success' END AS status, CASE WHEN q.vec_id % 110 <> 0 THEN m.text END AS text FROM q LEFT JOIN m USING (vec_id)""")
def retrieve_merged(spark, d):
    """Some queries fail and some find nothing."""
    top = retrieve_dense(spark, d).filter("vec_id % 70 <> 0").withColumn("passage", F.concat(F.lit("item "), F.col("item_id").cast("string"), F.lit("\ntext "), F.col("item_id").cast("string")))
    asked = table(spark, d, "embeddings").filter("vec_id % 10 = 0").select("vec_id", (F.col("vec_id") % 110 == 0).alias("failed"))
    return merged_passages(asked, top, "vec_id", "rank", "passage", F.col("failed"))


@query("pool_kinds", """SELECT vec_id, round(1.5::DOUBLE * embedding[1], 6) AS mean, round(embedding[1]::DOUBLE, 6) AS cls, round(embedding[2]::DOUBLE, 6) AS pooler FROM embeddings""")
def pool_kinds(spark, d):
    """Token vectors of three tokens, the last one masked out."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    times = lambda k: F.transform(v, lambda x: x * k)
    x = table(spark, d, "embeddings").select("vec_id", F.array(v, times(2), times(9)).alias("tokens"), F.array(*map(F.lit, (1, 1, 0))).alias("mask"), F.reverse(F.slice(v, 1, 2)).alias("own"))
    return x.select("vec_id", *(F.round(F.get(pooled(k, F.col("tokens"), F.col("mask"), F.col("own")), 0), 6).alias(k) for k in ("mean", "cls", "pooler")))


@query("mean_pool", """WITH g AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM g GROUP BY ALL), n AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-9) AS n FROM m GROUP BY label)
  SELECT label, list(round(m / n, 5) ORDER BY i) AS pooled FROM m JOIN n USING (label) GROUP BY label""")
def mean_pool(spark, d):
    m = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"), F.greatest(F.sqrt(F.sum(F.col("m") * F.col("m"))), F.lit(1e-9)).alias("n"))
    return v.select("label", F.transform("v", lambda x: F.round(x["m"] / F.col("n"), 5)).alias("pooled"))
