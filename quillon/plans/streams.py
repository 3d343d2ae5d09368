"""Streaming steps over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import streaming as s
from quillon.plans import proxies as p
from quillon.registry import query
from quillon.session import moved, scratch, table
from quillon.sources import backends

_HOUR = "date_trunc('hour', ts)"


def _stepped(spark, df, drain, parts=3, by="uid"):
    """The rows as a stream of a few steps, each of as many files as its rows fill.
    ``drain`` runs the stream to the end of what is there, and does so after each
    step that comes in: one checkpoint makes it go on."""
    rows, to = scratch(spark, "steps"), scratch(spark, "stream")
    step = F.coalesce(F.pmod(F.col(by), F.lit(parts)), F.lit(0)).cast("int")
    df.withColumn("_step", step).write.partitionBy("_step").parquet(rows)
    for i in range(parts):
        if not moved(spark, f"{rows}/_step={i}", f"{to}/{i}"):  # a step without rows
            df.limit(0).write.parquet(f"{to}/{i}")
        drain(s.table_stream(spark, f"{to}/*", df.schema, None))


def _drained(spark, d, sink):
    at = scratch(spark, "checkpoint")
    _stepped(spark, p.responses(spark, d), lambda rows: s.drained(rows, sink, at))


def _events(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    to = scratch(spark, "events")
    e.coalesce(1).write.parquet(to)
    return s.table_stream(spark, to, e.schema)


def _windows(spark, d, kind: str):
    """What append mode has written: windows that the watermark has passed."""
    return s.appended(s.windows(_events(spark, d), kind), scratch(spark, "windows"), scratch(spark, "checkpoint"))


#: Where the watermark is in the end, in seconds.
_MARK = "(SELECT epoch(max(ts)) - 600 FROM events)"


@query("stream_tumbling", f"WITH e AS (SELECT event_type, epoch({_HOUR})::BIGINT AS start, value FROM events) SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM e WHERE start + 3600 <= {_MARK} GROUP BY event_type, start")
def stream_tumbling(spark, d):
    return _windows(spark, d, "tumbling").select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "total")


@query("stream_sliding", f"""WITH e AS (SELECT *, unnest([0, 1]) AS k FROM events), w AS (SELECT event_type, value, (epoch(ts)::BIGINT // 1800 - k) * 1800 AS start FROM (SELECT event_type, value, k, to_timestamp(floor(epoch(ts))) AS ts FROM e))
  SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE start + 3600 <= {_MARK} GROUP BY ALL""")
def stream_sliding(spark, d):
    return _windows(spark, d, "sliding").select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "total")


@query("stream_session", f"""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, run HAVING epoch(max(ts)) + 1800 <= {_MARK}""")
def stream_session(spark, d):
    return _windows(spark, d, "session").select("user_id", "n", "total")


@query("stream_kept_groups", f"""WITH {p.RESP}, g AS (SELECT uid, uid % 3 AS step FROM resp GROUP BY uid HAVING max(acc) <> min(acc) OR count(*) = 1), o AS (SELECT uid, row_number() OVER (ORDER BY step, uid) AS k FROM g)
  SELECT uid, sample FROM resp JOIN o USING (uid) WHERE k <= 100""")
def stream_kept_groups(spark, d):
    keep = s.KeptGroups(scratch(spark, "kept"), "uid", "acc", 100, 10)
    _drained(spark, d, keep)
    return keep.rows(spark).select("uid", "sample")


@query("stream_metrics", f"WITH {p.RESP} SELECT sum(n)::BIGINT AS n, max(hi) AS max_score FROM (SELECT uid % 3 AS step, count(*) AS n, max(score) AS hi FROM resp GROUP BY 1)")
def stream_metrics(spark, d):
    to = scratch(spark, "metrics")
    sink = s.Metrics(to, lambda b: b.agg(F.count("*").alias("n"), F.max("score").alias("hi")))
    _drained(spark, d, sink)
    return spark.read.schema("n long, hi double, step int").json(to).agg(F.sum("n").alias("n"), F.max("hi").alias("max_score"))


@query("stream_backends", f"WITH {p.RESP}, s AS (SELECT uid % 3 AS step, count(*) AS n, sum(len)::BIGINT AS tokens FROM resp GROUP BY 1) SELECT step, n, tokens, 'step:' || step || ' - n:' || n || ' - tokens:' || tokens AS line FROM s")
def stream_backends(spark, d):
    """Each step's metrics in two backends, both read back."""
    to = scratch(spark, "backends")
    sink = backends.Logged(to, ["jsonl", "console"], lambda b: b.agg(F.count("*").alias("n"), F.sum("len").alias("tokens")))
    _drained(spark, d, sink)
    lines = spark.read.text(f"{to}/console").select(F.col("step").cast("long").alias("step"), F.col("value").alias("line"))
    return spark.read.schema("n long, tokens long, step long").json(f"{to}/jsonl").join(lines, "step")


@query("stream_to_backend", f"WITH {p.RESP} SELECT source, count(*) AS n, sum(len)::BIGINT AS tokens FROM resp GROUP BY source")
def stream_to_backend(spark, d):
    """Rows of a stream by the backend's own stream writer."""
    to = scratch(spark, "backend")
    at = scratch(spark, "checkpoint")
    _stepped(spark, p.responses(spark, d), lambda rows: backends.drained(rows.select("source", "len"), "jsonl", to, at))
    return spark.read.schema("source string, len long, step long").json(to).groupBy("source").agg(F.count("*").alias("n"), F.sum("len").alias("tokens"))


_KL = "(1 + greatest(least({x}.m / 0.1 - 1, 0.2), -0.2) * {x}.n / 1000000)"


@query("stream_kl", f"""WITH {p.RESP}, s AS (SELECT uid % 3 AS step, avg(score) AS m, count(*) AS n FROM resp GROUP BY 1), a AS (SELECT * FROM s WHERE step = 0), b AS (SELECT * FROM s WHERE step = 1), c AS (SELECT * FROM s WHERE step = 2)
  SELECT 0::BIGINT AS step, round(0.2 * {_KL.format(x='a')}, 9) AS coefficient FROM a UNION ALL SELECT 1, round(0.2 * {_KL.format(x='a')} * {_KL.format(x='b')}, 9) FROM a, b UNION ALL SELECT 2, round(0.2 * {_KL.format(x='a')} * {_KL.format(x='b')} * {_KL.format(x='c')}, 9) FROM a, b, c""")
def stream_kl(spark, d):
    control = s.KlSteps(scratch(spark, "kl"), 0.2, 0.1, 1_000_000, F.col("score"))
    _drained(spark, d, control)
    return control.values(spark).withColumn("coefficient", F.round("coefficient", 9))


@query("loader_resume", f"WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {p.seeded_sql(42, 'doc_id')}, doc_id) - 1 AS place FROM documents) SELECT doc_id, place // (SELECT count(*) // 3 + 1 FROM documents) AS batch FROM o")
def loader_resume(spark, d):
    """The first batch by one loader, the others by one that is made from its saved
    state."""
    docs = table(spark, d, "documents").select("doc_id")
    size, at = docs.count() // 3 + 1, scratch(spark, "loader")
    loader = s.Loader(docs, "doc_id", size)
    out = [next(iter(loader))]
    s.save_state(spark, loader.state(), at)
    out += list(s.Loader(docs, "doc_id", size, state=s.saved_state(spark, at)))
    rows = None
    for i, x in enumerate(out):
        x = x.withColumn("batch", F.lit(i).cast("long"))
        rows = x if rows is None else rows.unionByName(x)
    return rows


@query("stream_curriculum", f"WITH {p.RESP} SELECT source, round(avg(score), 8) AS difficulty FROM resp GROUP BY source")
def stream_curriculum(spark, d):
    c = s.Curriculum(scratch(spark, "curriculum"), "source", "score")
    _drained(spark, d, c)
    return c.order(spark).withColumn("difficulty", F.round("difficulty", 8))


@query("stream_growing", f"WITH {p.RESP} SELECT count(*) FILTER (score > 0.05) AS grown FROM resp")
def stream_growing(spark, d):
    g = s.Growing(scratch(spark, "growing"), lambda b: b.filter("score > 0.05").select("uid", "sample"))
    _drained(spark, d, g)
    return spark.read.parquet(g.path).agg(F.count("*").alias("grown"))
