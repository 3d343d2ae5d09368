"""A stored inverted index for BM25, built once and asked often.

The corpus is cut into shards of bounded size where it is read.  Of each shard and
term there is one row with the term's postings (places of documents in the shard,
ascending, and how often each has it) and, for each ``BLOCK`` of them, the last place,
the greatest count and the least length: a bound of what the block can score with any
parameters.  Rows are Parquet, in folders by checksum of the term, sorted by term, so
a search reads only what its terms need; another folder has the shards' documents.

A search joins its terms with the postings and answers shard by shard.  A query's
terms are added from the greatest bound on, until those that are left cannot bring a
new document among the best; what is left is added to the documents that may still
be among them, and only where a block's bound allows it.  The best of each shard are
merged by a window.  The result is exact.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.session import ship

#: Documents and bytes of a shard, postings of a block, least and most folders of terms, bytes of text for each.
SHARD_DOCS, SHARD_BYTES, BLOCK = 1 << 14, 32 << 20, 128
FOLDERS, MOST_FOLDERS, FOLDER_BYTES = 8, 4096, 256 << 20
#: Queries that are answered at once; their words are broadcast.
AT_ONCE = 20_000
SCHEMA = "kind string, folder int, shard long, term string, n long, docs binary, counts binary, ends binary, most binary, least binary, ids array<{}>, lengths binary"
#: Fixed value: what words are cut at.
SPACE = " \t\n\r"


def terms_of(text: str) -> list[str]:
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def build(corpus: DataFrame, doc_id: str, text: str, path: str, shard_docs: int = SHARD_DOCS) -> None:
    """Write the index of a corpus below ``path``.  Rows without an id or text are
    not in it; repeated ids are documents of their own."""
    spark = corpus.sparkSession
    ship(spark)
    kind = corpus.schema[doc_id].dataType.simpleString()
    docs = corpus.select(F.col(doc_id).alias("doc"), F.lower(text).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folders = min(MOST_FOLDERS, max(FOLDERS, 1 << int(size // FOLDER_BYTES).bit_length()))
    names = ["kind", "folder", "shard", "term", "n", "docs", "counts", "ends", "most", "least", "ids", "lengths"]

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Stretches of 32-bit numbers that end at ``ends`` as binary values."""
        offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])

    def made(shard: int, ids: list, id_type, texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = defaultdict(count().__next__)
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        both, counts = np.unique(flat * len(texts) + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
        term, doc = both // len(texts), both % len(texts)
        stop = np.searchsorted(term, np.arange(len(number)), "right")
        size = np.diff(stop, prepend=0)
        # blocks of each term: where they begin and end among all postings
        blocks = -(-size // BLOCK)
        last = np.cumsum(blocks)
        begin = np.repeat(stop - size, blocks) + BLOCK * (np.arange(last[-1]) - np.repeat(last - blocks, blocks))
        until = np.append(begin[1:], len(term))
        columns = [lists(doc, stop), lists(counts, stop), lists(doc[until - 1], last), lists(np.maximum.reduceat(counts, begin), last), lists(np.minimum.reduceat(lengths[doc], begin), last)]
        n = len(number)
        folder = [zlib.crc32(w.encode()) % folders for w in number]
        yield pa.RecordBatch.from_arrays([pa.array(["terms"] * n), pa.array(folder, pa.int32()), pa.array(np.full(n, shard)), pa.array(list(number)), pa.array(size), *columns, pa.nulls(n, pa.list_(id_type)), pa.nulls(n, pa.binary())], names)
        none = [pa.nulls(1, pa.binary())] * 5
        yield pa.RecordBatch.from_arrays([pa.array(["docs"]), pa.array([shard % folders], pa.int32()), pa.array([shard]), pa.nulls(1, pa.string()), pa.array([int(lengths.sum())]), *none, pa.array([ids], pa.list_(id_type)), lists(lengths, np.array([len(lengths)]))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, shards, id_type = [], [], 0, 0, None
        base = TaskContext.get().partitionId() << 32
        for b in batches:
            id_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = terms_of(t)
                if own:
                    ids.append(i)
                    texts.append(own)
                    held += len(t)
                if len(ids) >= shard_docs or held >= SHARD_BYTES:
                    yield from made(base + shards, ids, id_type, texts)
                    ids, texts, held, shards = [], [], 0, shards + 1
        if ids:
            yield from made(base + shards, ids, id_type, texts)

    out = docs.mapInArrow(run, SCHEMA.format(kind))
    out.repartition("kind", "folder").sortWithinPartitions("kind", "folder", "term", "shard").write.partitionBy("kind", "folder").option("compression", "zstd").parquet(f"{path}/index")
    spark.createDataFrame([(folders, kind)], "folders int, ids string").coalesce(1).write.json(f"{path}/layout")


def _best(terms: list[tuple], k: int, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of documents among which are the best ``k`` for the terms
    (``docs``, ``scores``, ends and bounds of blocks, bound); ``acc`` is all zero."""
    terms = sorted(terms, key=lambda t: -t[4])
    rest = np.append(np.cumsum([t[4] for t in terms][::-1])[::-1], 0.0)
    level, at = -np.inf, 0
    slack = 2e-6  # scores are compared to six places
    while at < len(terms) and rest[at] + slack >= level:
        docs, scores = terms[at][:2]
        acc[docs] += scores
        at += 1
        if at < len(terms):
            now = acc[acc > 0]
            if len(now) >= k:
                level = np.partition(now, -k)[-k]
    cand = np.flatnonzero(acc)
    part = acc[cand]
    acc[cand] = 0.0
    for i in range(at, len(terms)):
        docs, scores, ends, bounds, _ = terms[i]
        block = np.searchsorted(ends, cand)
        bound = np.where(block < len(ends), bounds[np.minimum(block, len(ends) - 1)], 0.0)
        keep = part + bound + rest[i + 1] + slack >= level
        cand, part = cand[keep], part[keep]
        place = np.minimum(np.searchsorted(docs, cand), len(docs) - 1)
        part = part + np.where(docs[place] == cand, scores[place], 0.0)
        if len(part) >= k:
            level = max(level, np.partition(part, -k)[-k])
    return cand, part


def search(spark: SparkSession, path: str, queries: DataFrame, query_id: str, doc_id: str, text: str, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """``query_id``, ``doc_id``, ``score`` (six places): the best ``k`` documents of an
    index for each query, ties by id.  A query's words count once each; queries
    without an id, text or known word have no row."""
    ship(spark)
    layout = spark.read.schema("folders int, ids string").json(f"{path}/layout").first()
    index = spark.read.schema(SCHEMA.format(layout.ids)).parquet(f"{path}/index")
    shards = index.filter("kind = 'docs'").select("shard", "n", "ids", "lengths")
    schema = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{doc_id}` {layout.ids}, score double"
    out = spark.createDataFrame([], schema)
    n, words = shards.agg(F.sum(F.size("ids")), F.sum("n")).first()
    if not n:
        return out
    asked = queries.select(F.col(query_id).alias("query"), F.lower(text).alias("text")).filter("query IS NOT NULL AND text IS NOT NULL")
    cut = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    own = asked.groupBy("query").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(cut)))).alias("words"))
    rows = ((r.query, r.words) for r in own.sort("query").toLocalIterator())
    query_type = to_arrow_type(queries.schema[query_id].dataType)

    def answered(held):
        def run(key, posts: pa.Table, shard: pa.Table) -> pa.Table:
            asks, terms, idf = held.value
            ids = shard.column("ids").combine_chunks().flatten()
            lengths = np.frombuffer(shard.column("lengths")[0].as_py(), np.int32)
            order = np.empty(len(ids), np.int64)
            order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            norm = lambda size: k1 * (1 - b + b * size / (words / n))
            weight = lambda t, tf, size: idf[t] * tf * (k1 + 1) / (tf + norm(size))
            lists = {}
            for t, *cols in zip(*(posts.column(c).to_pylist() for c in ("t", "docs", "counts", "ends", "most", "least")), strict=True):
                docs, counts, ends, most, least = (np.frombuffer(c, np.int32) for c in cols)
                bounds = weight(t, most, least)
                lists[t] = docs, weight(t, counts, lengths[docs]), ends, bounds, float(bounds.max())
            acc = np.zeros(len(ids))
            q_out, d_out, s_out = [], [], []
            for q, ts in zip(asks, terms, strict=True):
                if own := [lists[t] for t in ts if t in lists]:
                    docs, scores = _best(own, k, acc)
                    scores = np.round(scores, 6)
                    top = np.lexsort((order[docs], -scores))[:k]
                    q_out += [q] * len(top)
                    d_out.append(docs[top])
                    s_out.append(scores[top])
            docs = np.concatenate(d_out) if d_out else np.zeros(0, np.int64)
            return pa.table([pa.array(q_out, query_type), ids.take(pa.array(docs)), pa.array(np.concatenate(s_out) if s_out else np.zeros(0))], [query_id, doc_id, "score"])

        return run

    while part := list(islice(rows, AT_ONCE)):
        vocab = sorted({w for _, ws in part for w in ws})
        folders = sorted({zlib.crc32(w.encode()) % layout.folders for w in vocab})
        known = F.broadcast(spark.createDataFrame(list(enumerate(vocab)), "t int, term string"))  # the words of AT_ONCE queries
        posts = index.filter("kind = 'terms'")
        posts = posts.filter(F.col("folder").isin(folders)) if len(folders) < layout.folders else posts
        found = posts.select("shard", "term", "n", "docs", "counts", "ends", "most", "least").join(known, "term").drop("term")
        freq = {r.t: r.df for r in found.groupBy("t").agg(F.sum("n").alias("df")).collect()}  # one number for each word of the queries
        at = {w: i for i, w in enumerate(vocab)}
        terms = [[at[w] for w in ws if at[w] in freq] for _, ws in part]
        idf = {t: float(np.log(1 + (n - df + 0.5) / (df + 0.5))) for t, df in freq.items()}
        held = spark.sparkContext.broadcast(([q for q, _ in part], terms, idf))
        near = found.groupBy("shard").cogroup(shards.select(F.col("shard").alias("of"), "ids", "lengths").join(found.select(F.col("shard").alias("of")).distinct(), "of", "left_semi").groupBy("of"))
        out = out.unionByName(near.applyInArrow(answered(held), schema))
    return out.withColumn("r", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), doc_id))).filter(F.col("r") <= k).drop("r")
