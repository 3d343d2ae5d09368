"""Further sources, sinks, prompts, scores and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import answers
from quillon.functions import kernels as k
from quillon.functions import plugins
from quillon.functions import rewards as r
from quillon.operators import advantages as a
from quillon.operators import catalogue as c
from quillon.operators.batch import drawn, first_or_drawn, marked_first, seeded
from quillon.plans import proxies as p
from quillon.plans.datasets import CHATS, _case, _spelt
from quillon.plans.recommend import SIMS, _sims
from quillon.registry import query
from quillon.session import materialised, scratch, ship, table
from quillon.sources import files

R6 = lambda x: F.round(x, 6)


def _text(spark, df: DataFrame, column: str) -> str:
    to = scratch(spark, "text")
    df.select(column).coalesce(1).write.text(to)
    return to


@query("scan_sim_map", "SELECT s_suppkey::VARCHAR AS id, (s_suppkey + 1)::VARCHAR AS item_id, 0.5::DOUBLE AS similarity FROM supplier")
def scan_sim_map(spark, d):
    one = F.struct(F.col("s_suppkey").cast("string").alias("k"), F.array(F.struct((F.col("s_suppkey") + 1).cast("string").alias("item_id"), F.lit(0.5).alias("similarity"))).alias("v"))
    obj = table(spark, d, "supplier").agg(F.to_json(F.map_from_entries(F.collect_list(one))).alias("value"))  # the format is one object
    text = spark.read.option("wholetext", True).text(_text(spark, obj, "value"))
    return text.select(F.explode(F.from_json("value", "map<string, array<struct<item_id: string, similarity: double>>>")).alias("id", "sims")).select("id", F.inline("sims"))


@query("scan_json_array", "SELECT s_suppkey AS k, s_name AS name FROM supplier")
def scan_json_array(spark, d):
    obj = table(spark, d, "supplier").agg(F.to_json(F.collect_list(F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))).alias("value"))  # the format is one array
    return files.json_array(spark, _text(spark, obj, "value"), "k long, name string")


@query("scan_corpus", "SELECT doc_id, text AS contents FROM documents")
def scan_corpus(spark, d):
    to = scratch(spark, "corpus")
    table(spark, d, "documents").select("doc_id", F.col("text").alias("contents")).write.json(to)
    return files.jsonl(spark, to, "doc_id long, contents string")


@query("sink_simplified", "SELECT p_name AS instruction, p_type AS input, p_brand AS output FROM part")
def sink_simplified(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("instruction"), F.col("p_type").alias("input"), F.col("p_brand").alias("output"), "p_size")
    to = scratch(spark, "sft")
    rows.select("instruction", "input", "output").write.json(to)
    return files.jsonl(spark, to, "instruction string, input string, output string")


@query("sink_both", "SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey, p_name FROM part")
def sink_both(spark, d):
    to = scratch(spark, "both")
    files.sink(table(spark, d, "part").select("p_partkey", "p_name"), to)
    return files.parquet(spark, [f"{to}/parquet"]).unionByName(files.jsonl(spark, f"{to}/jsonl", "p_partkey long, p_name string"))


@query("summary_prompt", f"""WITH {p.ITEMS}, {SIMS}, n AS (SELECT s.iid, rank, item_id, similarity, i.title AS st, repeat(i.title || ' ', CASE WHEN s.item_id % 2 = 0 THEN 20 ELSE 3 END) AS sd FROM sims s JOIN items i ON i.iid = s.item_id WHERE rank <= 5),
  g AS (SELECT iid, max_by(sd, rank) FILTER (length(sd) <= 150) AS last_short, string_agg('Similar Item ' || item_id || ': Title: ' || st || CASE WHEN length(sd) > 150 THEN ' Description: ' || left(sd, 150) || '...' ELSE '' END, chr(10) ORDER BY rank) AS similar_items FROM n GROUP BY iid)
  SELECT i.iid, 'Title: ' || title AS title, 'Description: ' || coalesce(last_short, repeat(title || ' ', 2)) AS description, coalesce(similar_items, '') AS similar_items FROM items i JOIN (SELECT DISTINCT iid FROM sims) USING (iid) LEFT JOIN g USING (iid)""")
def summary_prompt(spark, d):
    items = p.items(spark, d).select("iid", "title")
    described = lambda n: F.expr(f"repeat(concat(title, ' '), {n})")
    own = items.withColumn("description", described("2"))
    known = items.withColumn("description", described("CASE WHEN iid % 2 = 0 THEN 20 ELSE 3 END")).select(F.col("iid").alias("item_id"), F.struct("title", "description").alias("item"))
    flat = _sims(spark, d).select("iid", F.posexplode(F.slice("sims", 1, 5)).alias("pos", "s")).select("iid", "pos", "s.item_id", "s.similarity")
    near = flat.join(known, "item_id").groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", "similarity", "item"))).alias("near"))
    rows = own.join(_sims(spark, d).select("iid"), "iid").join(near, "iid", "left")
    parts = c.summary_parts(F.col("title"), F.col("description"), F.coalesce("near", F.array().cast(near.schema["near"].dataType)), lambda s: F.lit(""))
    return rows.select("iid", parts.alias("x")).select("iid", "x.*")


@query("similar_line", f"WITH {SIMS} SELECT iid, rank, item_id FROM sims WHERE rank <= 2")
def similar_line(spark, d):
    """The score in a prompt is rounded as Python does it, which no built-in
    format does; the line is taken apart again for the comparison."""
    ship(spark)
    flat = _sims(spark, d).select("iid", F.posexplode(F.slice("sims", 1, 2)).alias("pos", "s"))
    line = F.concat(F.lit("Similar Item "), F.col("s.item_id").cast("string"), F.lit(" (similarity: "), k.udf(k.python_format3, "string")(F.col("s.similarity")), F.lit("):"))
    ok = flat.withColumn("line", line).filter(F.col("line").rlike(r"^Similar Item \d+ \(similarity: -?\d\.\d{3}\):$"))
    return ok.select("iid", (F.col("pos") + 1).cast("long").alias("rank"), F.regexp_extract("line", r"Item (\d+)", 1).cast("long").alias("item_id"))


@query("nested_access", "SELECT conv_id, turn, text AS value FROM conversations")
def nested_access(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", F.struct(F.struct("text").alias("b")).alias("a"))
    return x.select("conv_id", "turn", F.col("a.b.text").alias("value"))


@query("corpus_fetch", "WITH i AS (SELECT unnest([3, 1, 3]) AS doc_id, unnest([0, 1, 2]) AS pos) SELECT pos, doc_id, text FROM documents JOIN i USING (doc_id)")
def corpus_fetch(spark, d):
    want = spark.createDataFrame([(3, 0), (1, 1), (3, 2)], "doc_id long, pos long")
    return table(spark, d, "documents").select("doc_id", "text").join(F.broadcast(want), "doc_id")


@query("batch_iterator", "SELECT e AS epoch, count(DISTINCT c_custkey // 64) AS batches, count(*) AS n FROM customer, (SELECT unnest(range(2)) AS e) GROUP BY e")
def batch_iterator(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("epoch"))
    return rows.groupBy(F.col("epoch").cast("long").alias("epoch")).agg(F.count_distinct(F.floor(F.col("c_custkey") / 64)).alias("batches"), F.count("*").alias("n"))


@query("val_sample", f"SELECT doc_id, text FROM documents ORDER BY {p.seeded_sql(42, 'doc_id')}, doc_id LIMIT 20")
def val_sample(spark, d):
    return first_or_drawn(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 20, seed=42)


_GOLD = (("steps\n#### @N\n#### 9", "", "p_size::VARCHAR"), ("#### -@N,000.5", "", "'-' || p_size || '000.5'"), ("#### x\n#### @M is it", "", "(p_size + 1)::VARCHAR"))


@query("gold_answer", f"SELECT p_partkey AS iid, {_case(*_GOLD)} AS answer FROM part")
def gold_answer(spark, d):
    found = F.regexp_extract("text", r"#### (-?[0-9.,]+)", 1)
    return _spelt(spark, d, _GOLD).select("iid", F.when(found == "", F.raise_error(F.lit("no answer")).cast("string")).otherwise(F.replace(found, F.lit(","))).alias("answer"))


_GEO = (
    ("<think>\nx</think> \\boxed{@N}", "@N", "1.0"),
    ("<think>\nx</think> \\boxed{@N}", "@M", "0.1"),
    ("no thought \\boxed{@N}", "@N", "0.9"),
    ("no thought \\boxed{@N}", "@M", "0.0"),
    ("<think>x</think> @N", "@N", "0.0"),
)


@query("s_geo3k", f"SELECT p_partkey AS iid, ({_case(*_GEO)})::DOUBLE AS score FROM part")
def s_geo3k(spark, d):
    ship(spark)
    form = F.col("text").rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")
    return _spelt(spark, d, _GEO).select("iid", F.round(0.9 * answers.boxed_score(F.col("text"), F.col("gold")) + 0.1 * form, 6).alias("score"))


_JUDGED = (("So \\boxed{True}", "", "1.0"), ("So \\boxed{False}", "", "0.0"), ("@N", "", "0.0"), ("\\boxed{False} no, \\boxed{True}", "", "1.0"), ("\\boxed{true}", "", "0.0"), ("\\boxed{True", "", "0.0"))


@query("s_judge", f"SELECT p_partkey AS iid, ({_case(*_JUDGED)})::DOUBLE AS score FROM part")
def s_judge(spark, d):
    ship(spark)
    return _spelt(spark, d, _JUDGED).select("iid", F.coalesce((k.udf(k.last_boxed, "string")(F.col("text")) == "True").cast("double"), F.lit(0.0)).alias("score"))


@query("prime_ce", f"WITH {p.RESP}, {p.TOK}, s AS (SELECT uid, sample, sum(reward * mask) * 5 AS z FROM tok GROUP BY ALL) SELECT round(avg(-(r.acc * ln(1 / (1 + exp(-z))) + (1 - r.acc) * ln(1 - 1 / (1 + exp(-z))))), 6) AS loss FROM s JOIN resp r USING (uid, sample)")
def prime_ce(spark, d):
    z = 5 * F.aggregate(a.masked(F.col("rewards"), F.col("mask")), F.lit(0.0), lambda s, x: s + x)
    t = p.tokens(spark, d).select("uid", "sample", (1 / (1 + F.exp(-z))).alias("q")).join(p.responses(spark, d).select("uid", "sample", "acc"), ["uid", "sample"])
    return t.agg(R6(F.avg(-(F.col("acc") * F.log("q") + (1 - F.col("acc")) * F.log(1 - F.col("q"))))).alias("loss"))


@query("prime_dpo", f"""WITH {p.RESP}, r AS (SELECT *, score * 5 AS q FROM resp), o AS (SELECT x.uid, x.sample, any_value(x.q) AS q, any_value(x.acc) AS acc, coalesce(avg(y.q) FILTER (y.acc <> x.acc), 0) AS other FROM r x JOIN r y USING (uid) GROUP BY x.uid, x.sample)
  SELECT round(avg(-ln(1 / (1 + exp(-(q - other) * (acc * 2 - 1))))), 6) AS loss FROM o""")
def prime_dpo(spark, d):
    w = W.partitionBy("uid")
    q, acc = F.col("score") * 5, F.col("acc")
    mean = lambda v: F.coalesce(F.avg(F.when(acc == v, q)).over(w), F.lit(0.0))
    rows = p.responses(spark, d).select(((q - F.when(acc == 1, mean(0)).otherwise(mean(1))) * (acc * 2 - 1)).alias("m"))
    return rows.agg(R6(F.avg(-F.log(1 / (1 + F.exp(-F.col("m")))))).alias("loss"))


@query("seq_logps", "SELECT vec_id, round(embedding[1 + vec_id % 64]::DOUBLE - ln(list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x)))), 6) AS logp FROM embeddings")
def seq_logps(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    z = F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x)))
    return table(spark, d, "embeddings").select("vec_id", R6(F.get(v, (F.col("vec_id") % 64).cast("int")) - z).alias("logp"))


@query("rm_pairs", "SELECT c_custkey AS id, list_concat(range(1, 5), list_concat(range(10, 10 + c_custkey % 6), [99]))[:8] AS chosen, least(8, 5 + c_custkey % 6) AS n FROM customer")
def rm_pairs(spark, d):
    one = lambda x: F.lit(x).cast("long")
    n = (F.col("c_custkey") % 6).cast("int")
    response = F.when(n > 0, F.sequence(one(10), 9 + F.col("c_custkey") % 6)).otherwise(F.array().cast("array<long>"))
    ids = F.concat(F.sequence(one(1), one(4)), response, F.array(one(99)))
    padded = F.concat(F.slice(ids, 1, 8), F.array_repeat(one(0), F.greatest(F.lit(0), 8 - F.size(ids))))
    mask = F.transform(padded, lambda x: (x != 0).cast("int"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.struct(padded.alias("input_ids"), mask.alias("attention_mask")).alias("chosen"))
    return rows.select("id", F.filter("chosen.input_ids", lambda x: x != 0).alias("chosen"), F.aggregate("chosen.attention_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("n"))


_CODE = (
    ("run ```python\nx = @N\nx + 1\n``` ok", "", "'x = ' || p_size || chr(10) || 'print(x + 1)'"),
    ("x = @N\nprint(x)\n", "", "'x = ' || p_size || chr(10) || 'print(x)' || chr(10)"),
    ("f(@N)\n\n", "", "'print(f(' || p_size || '))' || chr(10) || chr(10)"),
    ("```python @N ``` and ```python 2 ```", "", "'print(' || p_size || ')'"),
)


@query("code_block", f"SELECT p_partkey AS iid, {_case(*_CODE)} AS code FROM part")
def code_block(spark, d):
    return _spelt(spark, d, _CODE).select("iid", r.printed(F.col("text"), answers.SPACES).alias("code"))


@query("md5_path", "SELECT p_partkey AS iid, md5(p_name) AS md5 FROM part")
def md5_path(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("iid"), F.md5("p_name").alias("md5"))


_COV = """st AS (SELECT avg(value - 0.5) AS ma, avg(logp) AS ml, count(*) AS n FROM tok WHERE mask = 1), c AS (SELECT t.*, value - 0.5 AS adv, exp(logp - ref) AS ratio, (value - 0.5 - ma) * (logp - ml) AS cov, n FROM tok t, st WHERE mask = 1)"""


def _flat(spark, d) -> DataFrame:
    t = p.tokens(spark, d).select("uid", "sample", F.posexplode(F.arrays_zip("values", "logp", "ref", "mask")).alias("i", "x")).select("uid", "sample", "i", "x.*").filter("mask = 1")
    t = t.select("uid", "sample", "i", (F.col("values") - 0.5).alias("adv"), "logp", (F.col("logp") - F.col("ref")).alias("gap"))
    st = t.agg(F.avg("adv").alias("ma"), F.avg("logp").alias("ml"), F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(st)).withColumn("cov", (F.col("adv") - F.col("ma")) * (F.col("logp") - F.col("ml"))).withColumn("ratio", F.exp("gap"))  # one row


@query("policy_loss_kl_cov", f"WITH {p.RESP}, {p.TOK}, {_COV}, r AS (SELECT *, row_number() OVER (ORDER BY round(cov, 9) DESC, uid, sample, i) AS k FROM c) SELECT round(avg(-adv * ratio + CASE WHEN k <= greatest(1, floor(n * 0.01)) THEN abs(logp - ref) ELSE 0 END), 6) AS loss FROM r")
def policy_loss_kl_cov(spark, d):
    """Tokens of the largest covariance, a share of all, pay for divergence."""
    t = materialised(spark, _flat(spark, d).withColumn("by", -F.round("cov", 9)), "tokens")
    n = t.select(F.greatest(F.lit(1), F.floor(F.col("n") * 0.01)).cast("int")).first()[0]  # one number
    top = marked_first(t, "by", "uid", "sample", "i", n=n, name="pays")
    return top.agg(R6(F.avg(-F.col("adv") * F.col("ratio") + F.when(F.col("pays"), F.abs("gap")).otherwise(0.0))).alias("loss"))


@query("policy_loss_clip_cov", f"""WITH {p.RESP}, {p.TOK}, {_COV}, l AS (SELECT *, -adv * ratio AS l1, -adv * greatest(least(ratio, 1.2), 0.8) AS l2 FROM c),
  b AS (SELECT uid, sample, i, row_number() OVER (ORDER BY {p.seeded_sql(42, "uid || ':' || sample || ':' || i")}, uid, sample, i) AS k FROM l WHERE cov > 0.01 AND cov < 5 AND NOT l2 > l1)
  SELECT round(avg(CASE WHEN b.k <= greatest(1, floor(n * 0.0002)) THEN 0 ELSE greatest(l1, l2) END), 6) AS loss, count(*) FILTER (b.k <= greatest(1, floor(n * 0.0002))) AS clipped FROM l LEFT JOIN b USING (uid, sample, i)""")
def policy_loss_clip_cov(spark, d):
    """A seeded share of the tokens whose covariance is in a band loses its
    gradient: its loss counts as zero."""
    l1 = -F.col("adv") * F.col("ratio")
    l2 = -F.col("adv") * F.greatest(F.least("ratio", F.lit(1.2)), F.lit(0.8))
    band = (F.col("cov") > 0.01) & (F.col("cov") < 5) & ~(l2 > l1)
    t = materialised(spark, _flat(spark, d).withColumns({"l": F.greatest(l1, l2), "by": F.when(band, seeded(42, "uid", "sample", "i"))}), "tokens")
    n = t.select(F.greatest(F.lit(1), F.floor(F.col("n") * 0.0002)).cast("int")).first()[0]  # one number
    out = marked_first(t, "by", "uid", "sample", "i", n=n, name="out")
    return out.agg(R6(F.avg(F.when(F.col("out"), 0.0).otherwise(F.col("l")))).alias("loss"), F.count_if("out").alias("clipped"))


@plugins.TOOLS.add("add")
def _add(arguments: dict) -> tuple[str, float]:
    return str(arguments["a"] + arguments["b"]), 0.5


@plugins.TOOLS.add("same")
def _same(arguments: dict) -> tuple[str, float]:
    return arguments["text"], 0.0


@query("tool_results", """SELECT p_partkey AS iid, unnest(['add', 'same', 'none', 'add']) AS name, unnest([(p_size + p_partkey)::VARCHAR, p_name, 'Error: KeyError', 'Error: TypeError']) AS response, unnest([0.5::DOUBLE, 0, 0, 0]) AS reward FROM part""")
def tool_results(spark, d):
    """Calls of two tools, of one that there is not, and one with wrong arguments;
    a fifth is over the limit."""
    call = lambda name, *x: F.struct(F.lit(name).alias("name"), F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x)).alias("arguments"))
    size, key = F.col("p_size"), F.col("p_partkey")
    calls = F.array(call("add", '{"a": ', size, ', "b": ', key, "}"), call("same", '{"text": "', F.col("p_name"), '"}'), call("none", "{}"), call("add", "[1]"), call("same", "{}"))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("iid"), plugins.called(calls, ("add", "same"), 4).alias("x"))
    return t.select("iid", F.inline("x"))


@plugins.INTERACTIONS.add("until_short")
def _until_short(messages: list[dict]) -> tuple[bool, str, float]:
    last = messages[-1]["content"]
    return (True, "thanks", 1.0) if len(last) <= 100 else (False, f"too long: {len(last)}", 0.0)


@query("interaction", f"WITH {CHATS} SELECT conv_id, length(messages[-1].content) <= 100 AS done, CASE WHEN length(messages[-1].content) <= 100 THEN 'thanks' ELSE 'too long: ' || length(messages[-1].content) END AS reply, (length(messages[-1].content) <= 100)::INT::DOUBLE AS score FROM chats")
def interaction(spark, d):
    return p.chats(spark, d).select("conv_id", plugins.replied(F.col("messages"), "until_short").alias("x")).select("conv_id", "x.*")


@query("reward_manager", f"WITH {p.RESP} SELECT uid, sample, round(CASE WHEN sample % 5 = 0 THEN 7 ELSE CASE WHEN source = 'R' THEN 1 ELSE 0 END + least(-(len - 30) / 10 * 0.5, 0) END, 6) AS reward FROM resp")
def reward_manager(spark, d):
    def scorer(source: str, text: str, gold: str) -> float:
        if source == "N":
            raise ValueError("a scorer may fail")
        return float(text == gold)

    x = p.responses(spark, d).withColumn("rm_scores", F.when(F.col("sample") % 5 == 0, 7.0))
    score = plugins.python_reward(scorer)(F.col("source"), F.col("source"), F.lit("R"))
    return plugins.rewarded(x, score, "len", 40, 10, 0.5).select("uid", "sample", R6("reward").alias("reward"))


@query("pf_resample", f"""WITH {p.RESP}, r AS (SELECT uid, sample, uid * 100 + sample AS row, greatest(power(abs(score), 2), 1e-8::DOUBLE) AS w FROM resp),
  s AS (SELECT *, sum(w) OVER (ORDER BY row % 64, row ROWS UNBOUNDED PRECEDING) - w AS lo, sum(w) OVER () AS total FROM r), u AS (SELECT {p.uniform_sql(42, 'row')} * total AS at FROM s),
  t AS (SELECT s.row, count(*) AS times FROM u ASOF JOIN s ON u.at >= s.lo GROUP BY s.row) SELECT uid, sample, coalesce(times, 0) AS times FROM r LEFT JOIN t USING (row)""")
def pf_resample(spark, d):
    x = p.responses(spark, d).select("uid", "sample", (F.col("uid") * 100 + F.col("sample")).alias("row"), a.resample_weights(F.col("score"), "pow").alias("w"))
    return drawn(x, "w", "row").select("uid", "sample", "times")
