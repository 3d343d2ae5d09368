"""URL verdicts from rules and, where none fits, from the link graph of hosts.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they
block are blocked seeds, each by its share ``s`` of such pages.  Trust runs along
links as a personalised PageRank: ``(1 - d) s + d * sum(trust of a host that links
here, by the share of its links)``.  Distrust runs against them: ``s + d (1 - s) *
sum(distrust of a host that is linked to, by the share of the own links)``, the
chance that a surfer who stops with ``1 - d`` at each step ends among blocked
pages.  It is between 0 and 1 whatever the size of the graph and however many
others link to the same hosts.  A host is blocked if its distrust is one half or
more and, times ``1 - d``, exceeds its trust.  ``ROUNDS`` rounds leave out at most
``d ** ROUNDS``, 1 %, of a score.

The graph is of hosts, with links counted, so it is far smaller than the pages.
A host may have any share of the pages or links: pages meet their host's verdict,
and links the score that they carry on, by host and salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import plain
from quillon.llm.native import ascii_lower
from quillon.session import materialised

SALTS = 32
#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
DAMPING, ROUNDS, LEAST_DISTRUST = 0.85, 29, 0.5
#: Lineage is cut after so many rounds.
CUT_EVERY = 5
LINK_SALTS = 8


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule, verdict = F.when(fits, at + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``n``: absolute links between different hosts."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1)
    absolute = F.filter(found, lambda x: x.contains("://") | x.startswith("//"))
    hosts = F.transform(absolute, lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(hosts).alias("dst"))
    return links.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _salted(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))


def propagated(seeds: DataFrame, step: DataFrame, rounds: int, damping: float, trust: bool) -> DataFrame:
    """``host``, ``score`` from ``host``, ``seed``: trust along, or distrust against
    the links ``step`` (``host``, whose score goes to ``to`` by ``share``).  A host
    without links passes nothing on."""
    spark = seeds.sparkSession
    step = materialised(spark, step.select("host", "to", "share", F.pmod(F.xxhash64("to"), F.lit(LINK_SALTS)).alias("salt")), "link-steps")
    seed, got = F.sum("seed"), F.sum("got")
    total = (1 - damping) * seed + damping * got if trust else seed + damping * (1 - seed) * got
    own = seeds.select("host", "seed", F.lit(0.0).alias("got"))
    now = own.groupBy("host").agg(total.alias("score"))
    for i in range(rounds):
        sent = step.join(_salted(now, LINK_SALTS), ["host", "salt"]).select(F.col("to").alias("host"), F.lit(0.0).alias("seed"), (F.col("score") * F.col("share")).alias("got"))
        now = own.unionByName(sent).groupBy("host").agg(total.alias("score"))
        if (i + 1) % CUT_EVERY == 0 or i == rounds - 1:
            now = materialised(spark, now, "link-scores")
    return now


def scores(seeds: DataFrame, edges: DataFrame, rounds: int, damping: float) -> tuple[DataFrame, DataFrame]:
    """(trust, distrust) by ``host`` from ``host``, ``trust``, ``distrust`` (shares)
    and links ``src``, ``dst``, ``n``."""
    out = _salted(edges.groupBy("src").agg(F.sum("n").alias("total")), LINK_SALTS)
    links = edges.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(LINK_SALTS))).join(out, ["src", "salt"]).select("src", "dst", (F.col("n") / F.col("total")).alias("share"))
    good, bad = (seeds.select("host", F.col(c).alias("seed")).filter("seed > 0") for c in ("trust", "distrust"))
    return propagated(good, links.toDF("host", "to", "share"), rounds, damping, True), propagated(bad, links.toDF("to", "host", "share"), rounds, damping, False)


def judged(df: DataFrame, rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING, least_distrust: float = LEAST_DISTRUST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each row: ``id_col``, ``host``, ``path``, ``rule`` (or null) and
    ``verdict`` (allow or block).

    A url without ``://`` and a null url have an empty host and path, fit no rule
    and are allowed; null html has no links; repeated rows are judged once each,
    but their links count again; further columns are left out."""
    spark = df.sparkSession
    pages = plain(df, id_col, url_col, html_col).toDF("id", "url", "html")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select("id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))

    def share(kind: str) -> Column:
        return F.count_if(F.col("by_rule") == kind) / F.count(F.lit(1))

    hosts = materialised(spark, ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "hosts")
    edges = materialised(spark, host_links(pages), "host-links")
    good, bad = scores(hosts, edges, 0 if edges.isEmpty() else rounds, damping)  # without links every round gives the same
    both = bad.withColumnRenamed("score", "bad").join(good.withColumnRenamed("score", "good"), "host", "left")
    blocked = both.filter((F.col("bad") >= least_distrust) & ((1 - damping) * F.col("bad") > F.coalesce("good", F.lit(0.0)))).select("host", F.lit("block").alias("by_graph"))
    salted = _salted(blocked, SALTS)
    dealt = ruled.withColumn("salt", F.when(F.col("by_rule").isNull(), F.pmod(F.xxhash64("id", "path"), F.lit(SALTS))).otherwise(-1 - F.pmod(F.xxhash64("id", "path"), F.lit(SALTS))))
    out = dealt.join(salted, ["host", "salt"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", "by_graph", F.lit("allow")).alias("verdict"))


def sql(rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING, least_distrust: float = LEAST_DISTRUST) -> str:
    """The same in DuckDB, the rounds written out."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [(kind, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for kind, h, p in order]
    case = lambda i: "CASE " + " ".join(f"WHEN {x[2]} THEN '{x[i]}'" for x in fits) + " END"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = "coalesce(" + low.format("regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)") + ", '')"
    link = "(?i)href\\s*=\\s*[\"'']?([^\"''\\s>]+)"
    absolute = "CASE WHEN starts_with(x, '//') THEN 'http:' || x ELSE x END"
    parts = [
        f"s AS (SELECT page_id, html, {host.format('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)",
        f"r AS (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS by_rule FROM s)",
        "h AS MATERIALIZED (SELECT host, count(*) FILTER (WHERE by_rule = 'allow') / count(*) AS trust, count(*) FILTER (WHERE by_rule = 'block') / count(*) AS distrust FROM r WHERE host <> '' GROUP BY host)",
        f"u AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS x FROM s)",
        f"v AS (SELECT src, {host.format(absolute)} AS dst FROM u WHERE contains(x, '://') OR starts_with(x, '//'))",
        "e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM v WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst)",
        "w AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e)",
        f"g0 AS (SELECT host, {1 - damping!r} * trust AS score FROM h WHERE trust > 0)",
        "b0 AS (SELECT host, distrust AS score FROM h WHERE distrust > 0)",
    ]
    ends = {"g": ("dst", "src", "trust", f"{1 - damping!r} * sum(seed) + {damping!r} * sum(got)"), "b": ("src", "dst", "distrust", f"sum(seed) + {damping!r} * (1 - sum(seed)) * sum(got)")}
    for k in range(1, rounds + 1):
        for x, (to, start, seed, total) in ends.items():
            parts.append(f"{x}{k} AS MATERIALIZED (SELECT host, {total} AS score FROM (SELECT host, {seed} AS seed, 0.0 AS got FROM h WHERE {seed} > 0 UNION ALL SELECT w.{to}, 0.0, p.score * w.share FROM w JOIN {x}{k - 1} p ON p.host = w.{start}) GROUP BY host)")
    parts.append(f"z AS (SELECT b.host FROM b{rounds} b LEFT JOIN g{rounds} g USING (host) WHERE b.score >= {least_distrust!r} AND {1 - damping!r} * b.score > coalesce(g.score, 0))")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, CASE WHEN by_rule IS NOT NULL THEN by_rule WHEN host IN (SELECT host FROM z) THEN 'block' ELSE 'allow' END AS verdict FROM r"
