"""Line deduplication that moves hashes and returns keep bitmaps.

Lines become 128-bit hashes of their keys; no text is moved for finding
duplicates.  The hashes are range-partitioned and sorted by key, document and
position, and streamed: the first line of a document in each run of a key
counts that document once.  A key may have any share of the lines, so ranges
are of (key, salt of the document): a frequent key is spread over ``SALTS``
ranges, and each yields one row to be added up.

Keys that go meet their lines by key and salt.  The decision comes back as a
compressed bitmap for each document: pairs of a word's number and its 64 bits, and
only for words that lose a line.  A document that loses none has no bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import plain
from quillon.llm.native import ascii_lower, lines, stripped
from quillon.session import materialised, scope

SALTS = 32
KEEP = "array<struct<word:int,bits:bigint>>"


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))


def keyed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``pos`` and the key's hashes."""
    key = F.transform(
        lines(F.col("text")),
        lambda x, i: F.struct(ascii_lower(stripped(x)).alias("key"), i.alias("pos")),
    )
    hashed = F.transform(F.filter(key, lambda k: F.length(k["key"]) >= least_chars), lambda k: F.struct(F.xxhash64(k["key"]).alias("h1"), F.xxhash64(F.lit("line"), k["key"]).alias("h2"), k["pos"].alias("pos")))
    return docs.select("id", F.xxhash64("text").alias("th"), F.inline(hashed))


def dropped_lines(rows: DataFrame, least_docs: int, keep_first: bool) -> DataFrame:
    """``id``, ``th``, ``pos`` of the lines that go, once for each row that has
    them.  A document is an id: its rows are next to each other in a run, so lines
    that repeat within them, or in repeated rows, count it once."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    at = W.partitionBy("h1", "h2", "salt").orderBy("id", "pos", "th")
    dealt = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "id", "pos", "th")
    first = dealt.withColumn("n", F.row_number().over(at)).withColumn("last", F.lag("id").over(at))
    firsts = first.filter((F.col("n") == 1) | ~F.col("id").eqNullSafe(F.col("last"))).groupBy("h1", "h2")
    gone = firsts.agg(F.count(F.lit(1)).alias("n_docs"), *([F.min(F.struct("id", "pos", "th")).alias("first")] if keep_first else [])).filter(F.col("n_docs") >= least_docs).drop("n_docs")
    hit = salted.join(gone.withColumn("salt", _salts()), ["h1", "h2", "salt"])
    if keep_first:
        hit = hit.filter(~F.struct("id", "pos", "th").eqNullSafe(F.col("first")))
    return hit.select("id", "th", "pos")


def keep_bitmaps(df: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``th`` (hash of the text), ``n_dropped`` and ``keep``, for each
    document that loses a line.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased.  Keys of at least ``least_chars`` characters in at least
    ``least_docs`` documents lose all their lines, or with ``keep_first`` all
    but the first by document and position.  ``keep`` has a pair (word, bits), in
    ascending order, for each 64 lines of which one goes: bit ``i`` of word ``w`` is
    set if line ``64 w + i`` stays.

    A document is an id: rows that repeat one count it once, whatever their texts,
    and each text has its own bitmap; null ids are ids like any other.  Null texts
    are one empty line.  Further columns are left out."""
    docs = plain(df, id_col, text_col).toDF("id", "text")
    rows = materialised(df.sparkSession, keyed_lines(docs, least_chars), "line-hashes")
    gone = dropped_lines(rows, least_docs, keep_first)
    words = gone.groupBy("id", "th", (F.col("pos") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("id", "th").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"))


def dense(keep: Column) -> Column:
    """Words of a compressed bitmap up to its last one, in time linear in them."""
    before = lambda i: F.when(i > 0, F.get(keep, i - 1)["word"] + 1).otherwise(0)
    return F.flatten(F.transform(keep, lambda e, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), e["word"] - before(i)), F.array(e["bits"]))))


def dropped(df: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``keep_bitmaps``: all rows and columns of ``df``, with the text's
    remaining lines, and ``quillon_lines``, ``quillon_dropped`` (long): its lines
    before and those that went.  A text that loses no line stays as it was; a null
    text stays null unless its line goes.  Columns of ``df`` with these names are
    replaced.

    Texts meet their bitmaps by id and hash, whatever their number: a plan that
    broadcast few bitmaps would be another one at each size."""
    with scope(df.sparkSession):
        maps = materialised(df.sparkSession, keep_bitmaps(df, least_docs, least_chars, keep_first, id_col, text_col), "line-bitmaps", outer=True)
    maps = maps.select(F.col("id").alias("quillon_id"), F.col("th").alias("quillon_th"), F.col("n_dropped").alias("quillon_n"), F.col("keep").alias("quillon_keep"))
    names = [c for c in df.columns if c not in OWN]
    text, all_lines = F.col(f"`{text_col}`"), lines(F.col(f"`{text_col}`"))
    both = df.select(*(F.col(f"`{c}`") for c in names)).join(maps.hint("shuffle_hash"), F.col(f"`{id_col}`").eqNullSafe(F.col("quillon_id")) & (F.xxhash64(text) == F.col("quillon_th")), "left")
    both = both.withColumn("quillon_words", dense(F.col("quillon_keep")))

    def stays(_x: Column, i: Column) -> Column:
        word = F.coalesce(F.get("quillon_words", (i / 64).cast("int")), F.lit(-1).cast("long"))
        return F.getbit(word, i % 64) == 1

    left = F.when(F.col("quillon_words").isNull(), text).otherwise(F.array_join(F.filter(all_lines, stays), "\n"))
    n = F.size(all_lines).cast("long")
    return both.select(*(left.alias(c) if c == text_col else F.col(f"`{c}`") for c in names), n.alias("quillon_lines"), F.coalesce("quillon_n", F.lit(0).cast("long")).alias("quillon_dropped"))


#: Columns that ``dropped`` adds, and those that it needs meanwhile.
OWN = ("quillon_lines", "quillon_dropped", "quillon_id", "quillon_th", "quillon_n", "quillon_keep", "quillon_words")


def digests(docs: DataFrame) -> DataFrame:
    """Lines before, lines lost and the digest of what stays, for each row."""
    out = dropped(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("quillon_lines").alias("n_lines"), F.col("quillon_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
gone AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'null')) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM gone)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM gone)), '')) AS kept_sha256
FROM k GROUP BY r
"""
