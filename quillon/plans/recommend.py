"""Recommendation data: similarity, term identifiers, sequences, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import catalogue as c
from quillon.operators import ranking as r
from quillon.plans import proxies as p
from quillon.registry import query
from quillon.session import table

KS = (1, 5, 10, 20)
TOP = """sim AS (SELECT a.vec_id, b.vec_id AS item_id, list_inner_product(a.v, b.v) AS s FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
top AS (SELECT vec_id, item_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, item_id) AS rn FROM sim)"""
UNIT = """unit AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"""


def _topk(spark: SparkSession, d: str, skip: bool) -> DataFrame:
    return r.cosine_topk(table(spark, d, "embeddings"), 20, skip_best=skip)


@query("topk_cosine", f"WITH {UNIT}, {TOP} SELECT vec_id, rn - 1 AS rank, item_id, round(s, 6) AS similarity FROM top WHERE rn BETWEEN 2 AND 21")
def topk_cosine(spark, d):
    return _topk(spark, d, True).withColumn("similarity", F.round("similarity", 6))


@query("topk_cosine_std", f"WITH {UNIT}, {TOP} SELECT vec_id, rn AS rank, item_id, round(s, 6) AS similarity FROM top WHERE rn <= 20")
def topk_cosine_std(spark, d):
    return _topk(spark, d, False).withColumn("similarity", F.round("similarity", 6))


@query("pairs_cosine", f"WITH {UNIT}, {TOP} SELECT vec_id, count(*) AS n, round(max(s), 6) AS best FROM top GROUP BY vec_id")
def pairs_cosine(spark, d):
    e = table(spark, d, "embeddings")
    v = e.select("vec_id", r.unit(F.col("embedding")).alias("embedding"))
    best = r.inner_topk(v, v, 1, "vec_id", "embedding", True)
    return best.crossJoin(F.broadcast(e.agg((F.count("*") - 1).alias("n")))).select("vec_id", "n", F.round("similarity", 6).alias("best"))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id``, ``ranked``, ``truth`` (the nearest id of the same label)."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    first = e.groupBy("label").agg(F.min("vec_id").alias("a"))
    second = e.join(first, "label").filter("vec_id > a").groupBy("label").agg(F.min("vec_id").alias("b"))
    truth = e.join(first, "label").join(second, "label").select("vec_id", F.when(F.col("vec_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("truth"))
    return r.ranked_lists(_topk(spark, d, True)).join(truth, "vec_id")


EVAL = f"""WITH {UNIT}, {TOP}, ranked AS (SELECT vec_id, list(item_id ORDER BY rn) AS ranked FROM top WHERE rn BETWEEN 2 AND 21 GROUP BY vec_id),
two AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
truth AS (SELECT e.vec_id, CASE WHEN e.vec_id = a.vec_id THEN b.vec_id ELSE a.vec_id END AS truth FROM embeddings e JOIN two a ON a.label = e.label AND a.k = 1 JOIN two b ON b.label = e.label AND b.k = 2),
ev AS (SELECT vec_id, ranked, truth, coalesce(list_position(ranked, truth), 0) AS rank FROM ranked JOIN truth USING (vec_id))"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    ev = _evaluated(spark, d)
    return ev.agg(*(F.round(r.metric(f"{m}@{k}", F.col("ranked"), F.col("truth")), 6).alias(f"{m}_at_{k}") for m in ("recall", "hit", "ndcg") for k in KS))


def _metric_sql(kinds) -> str:
    parts = []
    for m in kinds:
        for k in KS:
            inner = f"avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0::DOUBLE ELSE 0 END)" if m != "ndcg" else f"avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1 / log2(rank + 1) ELSE 0 END)"
            parts.append(f"round({inner}, 6) AS {m}_at_{k}")
    return f"{EVAL} SELECT {', '.join(parts)} FROM ev"


query("rank_metrics", _metric_sql(("recall", "hit", "ndcg")))(flagship)
for _kind, _name in (("recall", "recall_at_k"), ("hit", "hit_at_k"), ("ndcg", "ndcg_at_k")):
    query(_name, _metric_sql((_kind,)))(lambda spark, d, m=_kind: _evaluated(spark, d).agg(*(F.round(r.metric(f"{m}@{k}", F.col("ranked"), F.col("truth")), 6).alias(f"{m}_at_{k}") for k in KS)))


@query("hit_positions", f"""{EVAL}, h AS (SELECT nullif(rank, 0) AS r FROM ev) SELECT count(r) AS hits, count(*) - count(r) AS misses, round(count(r) / count(*), 6) AS hit_rate, round(avg(r), 6) AS mean_rank,
  median(r) AS median_rank, min(r) AS min_rank, max(r) AS max_rank, count(*) FILTER (r <= 1) AS hit_at_1, count(*) FILTER (r <= 5) AS hit_at_5, count(*) FILTER (r <= 10) AS hit_at_10 FROM h""")
def hit_positions(spark, d):
    out = r.hit_positions(_evaluated(spark, d).withColumn("rank", r.hit_rank(F.col("ranked"), F.col("truth"))), "rank")
    return out.withColumns({"hit_rate": F.round("hit_rate", 6), "mean_rank": F.round("mean_rank", 6), "min_rank": F.col("min_rank").cast("long"), "max_rank": F.col("max_rank").cast("long")})


@query("item_text", "SELECT p_partkey AS iid, concat_ws(' | ', 'Title: ' || nullif(p_name, ''), 'Categories: ' || nullif(p_type, '')) AS text FROM part")
def item_text(spark, d):
    return p.items(spark, d).select("iid", c.item_text(F.col("title"), F.lit(""), F.col("categories")).alias("text"))


@query("sft_meta2tid", f"WITH {p.ITEMS} SELECT iid, 'Title: ' || title || ' Categories: ' || categories AS input, array_to_string(words, ', ') AS output FROM items")
def sft_meta2tid(spark, d):
    return p.items(spark, d).select("iid", F.concat(F.lit("Title: "), "title", F.lit(" Categories: "), "categories").alias("input"), F.array_join("words", ", ").alias("output"))


@query("word_freq", f"WITH {p.ITEMS}, w AS (SELECT unnest(words) AS word FROM items) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 20")
def word_freq(spark, d):
    return c.word_frequency(p.items(spark, d), "words", 20)


@query("word_freq_pos", f"""WITH {p.ITEMS}, w AS (SELECT unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM items), n AS (SELECT pos, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL)
  SELECT pos, word, n, row_number() OVER (PARTITION BY pos ORDER BY n DESC, word) AS rank FROM n QUALIFY rank <= 10""")
def word_freq_pos(spark, d):
    return c.word_frequency_by_position(p.items(spark, d), "words", 10)


@query("tid_collisions", f"""WITH {p.ITEMS}, n AS (SELECT words, count(*) AS n FROM items GROUP BY words)
  SELECT count(*) FILTER (n > 1) AS duplicated, sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END)::BIGINT AS conflicts, round(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) / sum(n), 6) AS rate, max(n) AS largest FROM n""")
def tid_collisions(spark, d):
    return c.collisions(p.items(spark, d), "words").withColumn("rate", F.round("rate", 6))


def _holed(df: DataFrame) -> DataFrame:
    """Some words blank, so that validity has something to count."""
    return df.withColumn("words", F.transform("words", lambda w, i: F.when((F.col("iid") % 10 == 0) | ((F.col("iid") % 7 == 0) & (i == 2)), "").otherwise(w)))


@query("tid_validity", f"""WITH {p.ITEMS}, w AS (SELECT CASE WHEN iid % 10 = 0 THEN 0 WHEN iid % 7 = 0 THEN 4 ELSE 5 END AS n FROM items)
  SELECT count(*) FILTER (n = 5) AS complete, count(*) FILTER (n BETWEEN 1 AND 4) AS partial, count(*) FILTER (n = 0) AS empty FROM w""")
def tid_validity(spark, d):
    return c.validity(_holed(p.items(spark, d)), "words")


def _sims(spark: SparkSession, d: str) -> DataFrame:
    """``iid``, ``sims``: item_id and similarity of neighbours, for those items
    that have a vector; some neighbours are no known items."""
    top = _topk(spark, d, True).select(F.col("vec_id").alias("iid"), "rank", (F.col("item_id") * 7).alias("item_id"), "similarity")
    return top.groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "similarity"))).alias("x")).select("iid", F.transform("x", lambda s: F.struct(s["item_id"].alias("item_id"), s["similarity"].alias("similarity"))).alias("sims"))


SIMS = f"{UNIT}, {TOP}, sims AS (SELECT vec_id AS iid, rn - 1 AS rank, item_id * 7 AS item_id, s AS similarity FROM top WHERE rn BETWEEN 2 AND 21)"


@query("join_sims_left", f"WITH {p.ITEMS}, {SIMS} SELECT iid, list(item_id ORDER BY rank) FILTER (item_id IS NOT NULL) AS top FROM items LEFT JOIN (SELECT * FROM sims WHERE rank <= 5) USING (iid) GROUP BY iid".replace("list(item_id ORDER BY rank) FILTER (item_id IS NOT NULL)", "coalesce(list(item_id ORDER BY rank) FILTER (item_id IS NOT NULL), [])"))
def join_sims_left(spark, d):
    top = F.slice(F.coalesce(F.col("sims.item_id"), F.array().cast("array<long>")), 1, 5)
    return p.items(spark, d).join(_sims(spark, d), "iid", "left").select("iid", top.alias("top"))


@query("join_sims_items", f"WITH {p.ITEMS}, {SIMS} SELECT s.iid, list(i.title ORDER BY rank) AS titles FROM sims s JOIN items i ON i.iid = s.item_id WHERE rank <= 5 GROUP BY s.iid")
def join_sims_items(spark, d):
    flat = _sims(spark, d).select("iid", F.posexplode(F.slice("sims", 1, 5)).alias("pos", "s"))
    known = p.items(spark, d).select(F.col("iid").alias("item_id"), "title")
    x = flat.select("iid", "pos", "s.item_id").join(known, "item_id").groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("x"))
    return x.select("iid", F.col("x.title").alias("titles"))


@query("sim_consistency", f"""WITH {p.ITEMS}, {SIMS}, j AS (SELECT similarity, len(list_intersect(a.words, b.words)) AS shared FROM sims s JOIN items a ON a.iid = s.iid JOIN items b ON b.iid = s.item_id)
  SELECT count(*) AS pairs, round(avg(similarity), 6) AS mean_similarity, round(avg(shared), 6) AS mean_shared, round(corr(similarity, shared), 6) AS pearson FROM j""")
def sim_consistency(spark, d):
    items = p.items(spark, d).select("iid", "words")
    flat = _sims(spark, d).select("iid", F.inline("sims"))
    j = flat.join(items, "iid").join(items.toDF("item_id", "other"), "item_id").withColumn("shared", F.size(F.array_intersect("words", "other")).cast("double"))
    spread = (F.stddev("similarity") > 0) & (F.stddev("shared") > 0)
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.round(F.avg("shared"), 6).alias("mean_shared"), F.round(F.when(spread, F.corr("similarity", "shared")), 6).alias("pearson"))


@query("id2meta", "SELECT p_partkey % 500 AS id, max_by(p_name, p_partkey) AS title, replace(max_by(p_name, p_partkey), ' ', '-') AS hyphenated FROM part GROUP BY 1")
def id2meta(spark, d):
    rows = p.items(spark, d).select((F.col("iid") % 500).alias("id"), F.col("iid").alias("ord"), "title")
    return c.last_by(rows, "id", "ord").select("id", "title", F.get(c.hyphenated(F.array("title")), 0).alias("hyphenated"))


@query("tid_inverted", f"WITH {p.ITEMS} SELECT array_to_string(words, ',') AS tid, list(iid ORDER BY iid) AS iids FROM items GROUP BY 1")
def tid_inverted(spark, d):
    return c.inverted(p.items(spark, d), c.tid_key(F.col("words")), "iid", "iid")


@query("word_index", f"WITH {p.ITEMS}, k AS (SELECT DISTINCT array_to_string(words, ',') AS tid FROM items), w AS (SELECT tid, unnest(string_split(lower(tid), ',')) AS word FROM k) SELECT word, count(*) AS n, min(tid) AS first_tid FROM w GROUP BY word")
def word_index(spark, d):
    return c.word_index(p.items(spark, d), c.tid_key(F.col("words"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("first_tid"))


def _tid_queries(items: DataFrame) -> DataFrame:
    """Identifiers as a model might write them: some whole, some with a word cut."""
    w = F.transform("words", lambda x, i: F.when((F.col("iid") % 2 == 1) & (i == 0), F.substring(x, 1, 4)).otherwise(x))
    return items.filter("iid % 40 < 2").select(F.array_join(w, ",").alias("query")).distinct()


TIDQ = f"""{p.ITEMS}, q AS (SELECT DISTINCT array_to_string(list_transform(words, lambda x, i: CASE WHEN iid % 2 = 1 AND i = 1 THEN substr(x, 1, 4) ELSE x END), ',') AS query FROM items WHERE iid % 40 < 2),
k AS (SELECT DISTINCT array_to_string(words, ',') AS tid FROM items)"""


@query("tid_exact", f"WITH {TIDQ} SELECT query, list(iid ORDER BY iid) AS iids FROM q JOIN items ON array_to_string(words, ',') = query GROUP BY query")
def tid_exact(spark, d):
    items = p.items(spark, d)
    return _tid_queries(items).join(c.inverted(items, c.tid_key(F.col("words")), "iid", "iid"), F.col("query") == F.col("tid")).select("query", "iids")


@query("tid_theta", f"""WITH {TIDQ}, qw AS (SELECT DISTINCT unnest(string_split(query, ',')) AS q FROM q), v AS (SELECT DISTINCT unnest(string_split(lower(tid), ',')) AS word FROM k)
  SELECT q, word, CASE WHEN q = word THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS sim FROM qw JOIN v ON contains(word, q) OR contains(q, word)""")
def tid_theta(spark, d):
    items = p.items(spark, d)
    q = _tid_queries(items).select(F.explode(F.split("query", ",")).alias("q")).distinct()
    return c.containing(q, c.word_index(items, c.tid_key(F.col("words"))))


@query("tid_fuzzy", f"""WITH {TIDQ}, qw AS (SELECT query, unnest(string_split(query, ',')) AS q, generate_subscripts(string_split(query, ','), 1) - 1 AS pos FROM q),
  w AS (SELECT tid, unnest(string_split(lower(tid), ',')) AS word FROM k), s AS (SELECT query, tid, round(sum(CASE WHEN q = word THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END / (pos + 1)), 9) AS score FROM qw JOIN w ON contains(word, q) OR contains(q, word) GROUP BY ALL)
  SELECT query, tid, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, tid) = 1""")
def tid_fuzzy(spark, d):
    items = p.items(spark, d)
    return c.fuzzy_lookup(_tid_queries(items), c.word_index(items, c.tid_key(F.col("words")))).withColumn("score", F.round("score", 6))


@query("rank_list", f"""WITH {p.SEQS}, u AS (SELECT user_id, unnest(items) AS iid, generate_subscripts(items, 1) AS pos FROM seqs), f AS (SELECT user_id, iid, min(pos) AS pos FROM u GROUP BY ALL),
  g AS (SELECT user_id, iid, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM f) SELECT user_id, list(iid ORDER BY pos) AS ranked FROM g WHERE rn <= 20 GROUP BY user_id""")
def rank_list(spark, d):
    return p.sequences(spark, d).select("user_id", c.rank_list(F.transform("items", lambda x: F.array(x))).alias("ranked"))


@query("rank_list_filled", f"""WITH {p.SEQS}, u AS (SELECT user_id, unnest(items[:6]) AS iid, generate_subscripts(items[:6], 1) AS pos FROM seqs), n AS (SELECT user_id, unnest([iid + 1, iid * 3 % 50, iid + 2]) AS iid, 100 + pos * 3 + unnest([0, 1, 2]) AS pos FROM u),
  f AS (SELECT user_id, iid, min(pos) AS pos FROM (SELECT * FROM u UNION ALL SELECT * FROM n) GROUP BY ALL), g AS (SELECT user_id, iid, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM f) SELECT user_id, list(iid ORDER BY pos) AS ranked FROM g WHERE rn <= 20 GROUP BY user_id""")
def rank_list_filled(spark, d):
    """The first six items, filled up from three near ones of each."""
    own = F.transform(F.slice("items", 1, 6), lambda x: F.array(x))
    near = F.transform(F.slice("items", 1, 6), lambda x: F.array(x + 1, x * 3 % 50, x + 2))
    return p.sequences(spark, d).select("user_id", c.rank_list(own, 20, near).alias("ranked"))


@query("last_n", f"WITH {p.SEQS} SELECT user_id, items[-20:] AS items FROM seqs")
def last_n(spark, d):
    return p.sequences(spark, d).select("user_id", c.last_n(F.col("items"), 20).alias("items"))


@query("leave_one_out", f"WITH {p.SEQS} SELECT user_id, items[-1] AS test, items[-2] AS valid, items[:-3] AS context FROM seqs WHERE len(items) >= 3")
def leave_one_out(spark, d):
    return c.leave_one_out(p.sequences(spark, d), "items").drop("items")


@query("valid_sequences", f"""WITH {p.SEQS}, u AS (SELECT user_id, unnest(items) AS iid FROM seqs) SELECT user_id, count(*) AS n_items, count(*) * 5 AS n_words FROM u
  GROUP BY user_id HAVING bool_and(iid % 97 <> 0) AND count(*) >= 3""")
def valid_sequences(spark, d):
    return c.valid_sequences(p.interactions(spark, d), p.items(spark, d).filter("iid % 97 <> 0"))


@query("join_seq_meta", f"""WITH {p.SEQS}, {p.ITEMS}, u AS (SELECT user_id, unnest(s.items) AS iid, generate_subscripts(s.items, 1) AS pos FROM seqs s)
  SELECT user_id, list(title ORDER BY pos) AS titles FROM u LEFT JOIN items USING (iid) GROUP BY user_id HAVING bool_and(iid % 97 <> 0)""")
def join_seq_meta(spark, d):
    known = p.items(spark, d).filter("iid % 97 <> 0").select("iid", "title")
    x = p.interactions(spark, d).join(known, "iid", "left").groupBy("user_id").agg(F.bool_and(F.col("title").isNotNull()).alias("ok"), F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("x"))
    return x.filter("ok").select("user_id", F.col("x.title").alias("titles"))


@query("join_collab", f"""WITH {p.ITEMS}, {SIMS}, known AS (SELECT iid FROM items WHERE iid % 3 <> 0) SELECT s.iid, list(item_id ORDER BY rank) AS neighbours FROM sims s
  WHERE s.iid IN (SELECT iid FROM known) AND item_id IN (SELECT iid FROM known) AND rank <= 5 GROUP BY s.iid""")
def join_collab(spark, d):
    known = p.items(spark, d).filter("iid % 3 <> 0").select("iid")
    flat = _sims(spark, d).join(known, "iid", "left_semi").select("iid", F.posexplode(F.slice("sims.item_id", 1, 5)).alias("pos", "item_id"))
    x = flat.join(known.toDF("item_id"), "item_id", "left_semi").groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("x"))
    return x.select("iid", F.col("x.item_id").alias("neighbours"))


@query("sft_collab", f"""WITH {p.ITEMS}, {SIMS}, k AS (SELECT s.iid, i.title, row_number() OVER (PARTITION BY s.iid ORDER BY rank) AS n FROM sims s JOIN items i ON i.iid = s.item_id WHERE rank <= 5)
  SELECT iid, string_agg(n || '. ' || title, chr(10) || chr(10) ORDER BY n) AS output FROM k GROUP BY iid""")
def sft_collab(spark, d):
    return join_sims_items(spark, d).select("iid", F.array_join(F.transform("titles", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n\n").alias("output"))


_ONE = "'Title: ' || coalesce(title, 'None') || '. Item text ID: [' || array_to_string(words, ', ') || ']. '"


@query("sft_rec", f"""WITH {p.SEQS}, {p.ITEMS}, u AS (SELECT user_id, unnest(s.items) AS iid, generate_subscripts(s.items, 1) AS pos, len(s.items) AS n FROM seqs s),
  t AS (SELECT user_id, pos, n, {_ONE} AS one FROM u JOIN items USING (iid))
  SELECT user_id, any_value(n) AS total_items, string_agg(one, '' ORDER BY pos) FILTER (pos = 1) AS input, coalesce(string_agg(one, '' ORDER BY pos) FILTER (pos BETWEEN 2 AND n - 2), '') AS output FROM t GROUP BY user_id HAVING any_value(n) >= 3""")
def sft_rec(spark, d):
    x = p.interactions(spark, d).join(p.items(spark, d).select("iid", "title", "words"), "iid")
    s = x.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "words"))).alias("items")).filter(F.size("items") >= 3)
    n = F.size("items")
    texts = F.transform("items", c.described)
    return s.select("user_id", n.cast("long").alias("total_items"), F.get(texts, 0).alias("input"), F.array_join(F.slice(texts, F.lit(2), F.greatest(n - 3, F.lit(0))), "").alias("output"))


@query("eval_prompt", f"""WITH {p.SEQS}, {p.ITEMS} SELECT user_id, 'Predict the next item.' || chr(10) || 'History: ' || title || chr(10) || 'Item text ID: ' AS prompt FROM seqs s JOIN items i ON i.iid = s.items[-2] WHERE len(s.items) >= 3""")
def eval_prompt(spark, d):
    s = c.leave_one_out(p.sequences(spark, d), "items").select("user_id", F.col("valid").alias("iid")).join(p.items(spark, d), "iid")
    return s.select("user_id", F.concat(F.lit("Predict the next item.\nHistory: "), "title", F.lit("\nItem text ID: ")).alias("prompt"))


@query("rl_rows", f"""WITH {p.SEQS}, {p.ITEMS} SELECT user_id, 'Next: ' || array_to_string(s.items[:-3], ' ') AS prompt, 'Item text ID: [' || array_to_string(words, ', ') || ']' AS answer, s.items[-1] AS test_ground_truth_id
  FROM seqs s JOIN items i ON i.iid = s.items[-2] WHERE len(s.items) >= 3""")
def rl_rows(spark, d):
    s = c.leave_one_out(p.sequences(spark, d), "items").join(p.items(spark, d).withColumnRenamed("iid", "valid"), "valid")
    rows = s.select("user_id", F.concat(F.lit("Next: "), F.array_join(F.col("context").cast("array<string>"), " ")).alias("prompt"), F.concat(F.lit("Item text ID: ["), F.array_join("words", ", "), F.lit("]")).alias("answer"), F.col("test").alias("test_ground_truth_id"))
    return rows.filter(F.col("prompt").isNotNull() & F.col("answer").isNotNull() & F.col("test_ground_truth_id").isNotNull())


@query("domain_filter", f"WITH {p.ITEMS} SELECT iid, domain FROM items WHERE domain = 'ECONOMY'")
def domain_filter(spark, d):
    return p.items(spark, d).select("iid", F.struct("domain").alias("msg")).filter("msg.domain = 'ECONOMY'").select("iid", "msg.domain")


@query("tid_parse", """SELECT p_partkey AS iid, CASE WHEN p_partkey % 4 = 3 THEN []::VARCHAR[] ELSE [lower(p_type), lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2)), '', ''] END AS words FROM part""")
def tid_parse(spark, d):
    name = F.split("title", " ")
    listed = F.concat_ws(", ", F.col("categories"), F.concat(F.lit("'"), F.get(name, 0), F.lit("'")), F.get(name, 1))
    content = F.when(F.col("iid") % 4 == 0, F.concat(F.lit("Words: ["), listed, F.lit("] done"))).when(F.col("iid") % 4 == 1, F.concat(F.lit("\n"), listed, F.lit("\nmore"))).when(F.col("iid") % 4 == 2, F.concat_ws("  ", "categories", F.get(name, 0), F.get(name, 1))).otherwise("")
    return p.items(spark, d).select("iid", c.parse_words(content).alias("words"))


@query("hyphenate", f"WITH {p.ITEMS} SELECT iid, [replace(title, ' ', '-')] AS words FROM items")
def hyphenate(spark, d):
    return p.items(spark, d).select("iid", c.hyphenated(F.array(F.concat(F.lit(" "), "title", F.lit(" ")))).alias("words"))


@query("tid_key", f"WITH {p.ITEMS} SELECT iid, array_to_string(words, ',') AS tid FROM items")
def tid_key(spark, d):
    return p.items(spark, d).select("iid", c.tid_key(F.transform("words", lambda w: F.concat(F.lit("["), w, F.lit("]")))).alias("tid"))


@query("bracket_groups", f"""WITH {p.TAGGED}, g AS (SELECT doc_id, regexp_extract_all(pred, '\\[(.*?)\\]', 1) AS g FROM tagged), u AS (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM g),
  f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, list(x ORDER BY i) AS groups FROM f GROUP BY doc_id""")
def bracket_groups(spark, d):
    return p.tagged(spark, d).select("doc_id", c.bracket_groups(F.col("pred")).alias("groups")).filter(F.size("groups") > 0)


@query("jaccard", f"""WITH {p.ITEMS} SELECT a.iid, round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))), 6) AS jaccard FROM items a JOIN items b ON b.iid = a.iid + 1""")
def jaccard(spark, d):
    a, b = p.items(spark, d).select("iid", "words"), p.items(spark, d).select((F.col("iid") - 1).alias("iid"), F.col("words").alias("other"))
    return a.join(b, "iid").select("iid", F.round(F.try_divide(F.size(F.array_intersect("words", "other")), F.size(F.array_union("words", "other"))), 6).alias("jaccard"))


_SPLIT = f"SELECT p_partkey AS iid, CASE WHEN row_number() OVER (ORDER BY {p.seeded_sql(42, 'p_partkey')}, p_partkey) <= {{}} THEN 'test' ELSE 'train' END AS split FROM part"


@query("split_random", _SPLIT.format("100"))
def split_random(spark, d):
    return c.random_split(p.items(spark, d).select("iid"), "iid", 100)


@query("split_ratio", _SPLIT.format("(SELECT count(*) - floor(0.9 * count(*)) FROM part)"))
def split_ratio(spark, d):
    items = p.items(spark, d).select("iid")
    n = items.count()
    return c.random_split(items, "iid", n - int(0.9 * n))


@query("anti_split", "SELECT p_partkey AS iid FROM part WHERE p_partkey % 5 <> 0")
def anti_split(spark, d):
    items = p.items(spark, d).select("iid")
    return items.join(items.filter("iid % 5 = 0"), "iid", "left_anti")


