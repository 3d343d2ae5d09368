"""Term identifiers (five words that name an item), their statistics, lookup
and the training samples built from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.batch import marked_first, seeded
from quillon.session import materialised


def item_text(title: Column, description: Column, categories: Column) -> Column:
    """The non-empty parts, labelled, joined by `` | ``."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws(" | ", part("Title", title), part("Description", description), part("Categories", categories))


def parse_words(content: Column, n: int = 5) -> Column:
    """Words of a model's answer: the first bracket group, else the first line,
    split at commas or else white space, stripped, lower-cased, cut and padded
    to ``n``.  Empty content gives no words at all."""
    group = F.regexp_extract(content, r"(?s)\[(.*?)\]", 1)
    line = F.get(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != ""), 0)
    text = F.when(group != "", group).otherwise(F.coalesce(line, content))
    cut = F.when(text.contains(","), F.split(text, ",")).otherwise(F.split(F.trim(text), r"(?U)\s+"))
    words = F.transform(cut, lambda w: F.btrim(F.lower(F.btrim(w)), F.lit("\"'[]")))
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.slice(F.concat(words, F.array_repeat(F.lit(""), n)), 1, n))


def hyphenated(words: Column) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(F.trim(w), r"(?U)\s+", "-"))


def tid_key(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.translate(w, "[]", "")), ",")


def bracket_groups(content: Column) -> Column:
    """Distinct bracket groups in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?d)\[(.*?)\]"), 1))


def word_frequency(df: DataFrame, words: str, top: int) -> DataFrame:
    return df.select(F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(top)


def word_frequency_by_position(df: DataFrame, words: str, top: int) -> DataFrame:
    n = df.select(F.posexplode(words).alias("pos", "word")).filter("word <> ''").groupBy("pos", "word").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("pos").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= top)


def collisions(df: DataFrame, words: str) -> DataFrame:
    """How many word tuples several items share (blank ones too), how many items
    that is beyond the first, and their share of all."""
    each = df.groupBy(words).agg(F.count(F.lit(1)).alias("n"))
    extra = F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0))
    return each.agg(F.count_if(F.col("n") > 1).alias("duplicated"), extra.alias("conflicts"), (extra / F.sum("n")).alias("rate"), F.max("n").alias("largest"))


def validity(df: DataFrame, words: str, n: int = 5) -> DataFrame:
    filled = F.size(F.filter(words, lambda w: w != ""))
    return df.agg(F.count_if(filled == n).alias("complete"), F.count_if((filled > 0) & (filled < n)).alias("partial"), F.count_if(filled == 0).alias("empty"))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that comes last."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def inverted(df: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """Values of each key in first-seen order."""
    return df.groupBy(key.alias("tid")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("x")).select("tid", F.col("x.v").alias("iids"))


def word_index(df: DataFrame, key: Column) -> DataFrame:
    """Keys by lower-cased word; a key that repeats a word is listed as often."""
    return df.select(key.alias("tid")).distinct().select("tid", F.explode(F.split(F.lower("tid"), ",")).alias("word"))


#: Words meet by their substrings of up to so many characters.
GRAM = 3


def _substrings(word: Column) -> Column:
    """Distinct substrings of 1 to ``GRAM`` characters, and the empty one."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (k - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(k)))
    return F.array_distinct(F.concat(F.array(F.lit("")), *(of(k) for k in range(1, GRAM + 1))))


def containing(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``q``, ``word``, ``sim``: distinct query words (``q``) and words of which one
    holds the other; equal ones have 1, others 0.8.  The held word's first
    characters are a substring of the other one, so both meet by that as a key,
    and only such pairs are compared."""
    q, w = queries.select("q").distinct(), vocabulary.select("word").distinct()

    def held(short: DataFrame, a: str, long: DataFrame, b: str) -> DataFrame:
        keyed = short.withColumn("key", F.left(a, F.lit(GRAM)))
        return keyed.join(long.select(b, F.explode(_substrings(F.col(b))).alias("key")), "key").filter(F.col(b).contains(F.col(a))).select("q", "word")

    # the second half leaves out equal words, which the first has
    both = held(q, "q", w, "word").unionByName(held(w, "word", q, "q").filter("q <> word"))
    return both.select("q", "word", F.when(F.col("q") == F.col("word"), 1.0).otherwise(0.8).alias("sim"))


def fuzzy_lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``query``, ``tid``, ``score``: the key with the largest sum over query
    words of similarity / (position + 1); equal words count 1, containment 0.8.
    Ties go to the smallest key.

    Queries whose words that meet some word are the same, at the same places, weigh all
    words alike, so one of them is looked up for all.  First each query's weight of each
    word is added up.  Keys with the same matched words score alike for all queries, so of
    these only the smallest goes on.  The keys with a query's heaviest word give a score
    that the best key reaches at least.  A query's lightest words, as many as give no key
    that score together, are passed over when keys are sought: by the sum of their weights
    times the most that a key has of each, and by the heaviest of them times the most
    matched words of a key.  Keys found by the others are scored in full."""
    spark = queries.sparkSession
    words = queries.select("query", F.posexplode(F.split("query", ",")).alias("pos", "q"))
    met = materialised(spark, containing(words, index), "fuzzy-words")
    seen = words.join(met.select("q").distinct(), "q").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "q"))).alias("seen"))
    seen = materialised(spark, seen, "fuzzy-queries")
    one = seen.groupBy("seen").agg(F.min("query").alias("query"))
    weight = one.select("query", F.inline("seen")).join(met, "q").groupBy("query", "word").agg(F.sum(F.col("sim") / (F.col("pos") + 1)).alias("weight"))
    weight = materialised(spark, weight, "fuzzy-weights")
    known = index.join(weight.select("word").distinct(), "word").groupBy("tid", "word").agg(F.count(F.lit(1)).alias("times"))
    alike = known.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("word", "times"))).alias("words")).groupBy("words").agg(F.min("tid").alias("tid"))
    keys = materialised(spark, alike.withColumn("m", F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + w["times"])), "fuzzy-keys")
    postings = keys.select("tid", F.inline("words"))

    def scored(some: DataFrame) -> DataFrame:
        """Scores of the keys that have one of the (query, word) pairs."""
        pairs = some.join(postings, "word").select("query", "tid").distinct()
        full = pairs.join(keys, "tid").select("query", "tid", F.inline("words")).join(weight, ["query", "word"])
        return full.groupBy("query", "tid").agg(F.round(F.sum(F.col("weight") * F.col("times")), 9).alias("score"))

    # of words of equal weight the rarest is the heaviest
    rare = postings.groupBy("word").agg(F.count(F.lit(1)).alias("keys"), F.max("times").alias("times"))
    weighed = weight.join(rare, "word")
    heaviest = weighed.groupBy("query").agg(F.max_by("word", F.struct("weight", -F.col("keys"), "word")).alias("word"))
    reached = scored(heaviest).groupBy("query").agg(F.max("score").alias("least"))
    most = keys.agg(F.max("m").alias("most"))
    # of equal weight the words of the most keys are the first to be passed over
    lightest = W.partitionBy("query").orderBy("weight", F.desc("keys"), "word").rowsBetween(W.unboundedPreceding, W.currentRow)
    given = F.least(F.sum(F.col("weight") * F.col("times")).over(lightest), F.col("weight") * F.col("most"))
    sought = weighed.crossJoin(F.broadcast(most)).withColumn("given", given).join(reached, "query").filter(F.col("given") >= F.col("least") - 1e-6)  # one row
    at = W.partitionBy("query").orderBy(F.desc("score"), "tid")
    found = scored(sought.select("query", "word")).withColumn("r", F.row_number().over(at)).filter("r = 1")
    best = one.join(found, "query").select("seen", "tid", "score")
    return seen.join(best, "seen").select("query", "tid", "score")


def rank_list(groups: Column, most: int = 20, near: Column | None = None) -> Column:
    """Item lists of the answers, in order, each item once, cut to ``most``.  A list
    that is shorter is filled up from ``near``, the item lists of the answers' best
    fuzzy matches; further rounds over them would add nothing."""
    own = F.slice(F.array_distinct(F.flatten(groups)), 1, most)
    return own if near is None else F.slice(F.array_distinct(F.concat(own, F.flatten(near))), 1, most)


def last_n(items: Column, n: int) -> Column:
    """The last ``n``, or all of a shorter array."""
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - (n - 1)), F.lit(n))


def leave_one_out(df: DataFrame, items: str) -> DataFrame:
    """``test`` the last item, ``valid`` the one before, ``context`` the rest."""
    n = F.size(items)
    return df.filter(n >= 3).select("*", F.element_at(items, -1).alias("test"), F.element_at(items, -2).alias("valid"), F.slice(items, F.lit(1), n - 2).alias("context"))


def valid_sequences(interactions: DataFrame, items: DataFrame, least_items: int = 3, least_words: int = 15) -> DataFrame:
    """Users all of whose items are known with five whole words.  One miss
    rejects the sequence."""
    ok = F.col("words").isNotNull() & (F.size("words") >= 5) & F.forall("words", lambda w: w != "")
    rows = interactions.join(items.select("iid", "words"), "iid", "left")
    agg = rows.groupBy("user_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"), F.count(F.lit(1)).alias("n_items"), F.sum(F.coalesce(F.size("words"), F.lit(0))).cast("long").alias("n_words"))
    return agg.filter(F.col("ok") & (F.col("n_items") >= least_items) & (F.col("n_words") >= least_words)).drop("ok")


def described(item: Column) -> Column:
    """One item of a sequence prompt; a missing title reads None."""
    return F.concat(F.lit("Title: "), F.coalesce(item["title"], F.lit("None")), F.lit(". Item text ID: ["), F.array_join(item["words"], ", "), F.lit("]. "))


def random_split(df: DataFrame, key: str, n_test: int, seed: int = 42) -> DataFrame:
    """``split``: the ``n_test`` rows that come first in a seeded order are test, the
    others train; all are test if there are no more."""
    drawn = marked_first(df.withColumn("_draw", seeded(seed, key)), "_draw", key, n=n_test, name="_test")
    return drawn.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_draw", "_test")


def summary_parts(title: Column, description: Column, near: Column, score: Callable[[Column], Column], cut: int = 150) -> Column:
    """What a summariser's prompt says of an item: ``title``, ``description``,
    ``similar_items`` (a line for each of ``near``: item_id, similarity, item).

    Texts over ``cut`` characters are cut and marked.  A similar item with a
    description that is not cut replaces the item's own description instead of
    being quoted, and the last such counts; data built so far has it that way."""
    short = lambda t: F.concat(F.left(t, F.lit(cut)), F.lit("..."))
    own = F.when(F.length(description) > cut, short(description)).otherwise(description)
    start = F.struct(own.alias("description"), F.array().cast("array<string>").alias("lines"))

    def step(acc: Column, s: Column) -> Column:
        text = s["item"]["description"]
        line = F.concat(F.lit("Similar Item "), s["item_id"].cast("string"), score(s), F.lit(": Title: "), s["item"]["title"], F.when(F.length(text) > cut, F.concat(F.lit(" Description: "), short(text))).otherwise(""))
        mine = F.when((text != "") & (F.length(text) <= cut), text).otherwise(acc["description"])
        return F.struct(mine.alias("description"), F.array_append(acc["lines"], line).alias("lines"))

    found = F.aggregate(near, start, step)
    labelled = lambda name, t: F.when(t != "", F.concat(F.lit(f"{name}: "), t)).otherwise("")
    return F.struct(labelled("Title", title).alias("title"), labelled("Description", found["description"]).alias("description"), F.array_join(found["lines"], "\n").alias("similar_items"))
