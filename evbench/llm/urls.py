"""URL filters by rules and link-graph propagation (operator 8); DataFrame functions only.

A url's host and path come from plain expressions.  The longest fitting rule gives the verdict.  Where none fits, its host's
scores do: trust is the personalised PageRank over host edges from trusted seeds (hosts of which at least half of the
pages are allowed by a rule), distrust is the personalised PageRank over the reversed edges from blocked seeds (at least
half blocked by a rule), so that hosts which link to blocked ones are distrusted.  A walk restarts at every seed with the
same mass, so that scores are in restarts of one seed and don't shrink with the number of hosts: a seed has 0.15 at least.  A
host is blocked where its distrust reaches `threshold` and exceeds its trust.

Host edges are the absolute links of the pages; links within a host don't count.  An edge's weight is its share of the
links that leave its source (for distrust: that enter its target).  Scores of hosts without onward edges are not dealt out
again.  Links are combined map-side into host edges before anything else, and both walks run in one join per step.

Null or malformed urls: empty host and path, no rule, allowed.  Null html: no links.  Null page ids are left out; repeated
ids are judged row by row.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: (host, path, verdict) of the contract's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, STEPS, THRESHOLD = 0.85, 20, 0.05
#: Walk steps after which lineage is cut and convergence is looked at.
STRIDE = 5
#: Tasks over which the edges of one host, and the pages of one host, are dealt.
SALTS = 16


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(""), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.  rules is a short list that the plan holds."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parsed(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, rule_verdict)"""
    ids = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).where("page_id is not null")
    parts = ids.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): absolute links between different hosts."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.col(html_col).alias("html")).where("src <> '' and html is not null")
    targets = rows.select("src", F.explode(links).alias("link")).select("src", ascii_lower(F.regexp_extract("link", r"//([^/?#]*)", 1)).alias("dst"))
    return targets.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _salted(rows: DataFrame) -> DataFrame:
    """Each row once for each salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(kind, host, score) by personalised PageRank; edges: (kind, src, dst, w), seeds: (kind, host, mass)."""
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    edges = cut(edges.select("kind", "src", "dst", "w", salt("dst")).repartition("kind", "src", "salt"))
    start = cut(seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score")))
    scores, before = start, None
    for step in range(1, steps + 1):
        flow = edges.join(_salted(scores.withColumnRenamed("host", "src")), ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
        scores = start.unionByName(flow).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step == 1 or step % STRIDE == 0:
            scores = cut(scores)
            if before is not None or step == 1:
                old = (start if before is None else before).select("kind", "host", F.col("score").alias("old"))
                moved = scores.join(old, ["kind", "host"], "full").agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
                if not moved or moved < 1e-13:
                    break
            before = scores
    return scores


def host_scores(pages: DataFrame, judged: DataFrame, seed_share: float = 0.5, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) of hosts with a score; judged: parsed() of the pages."""
    count = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1).otherwise(0))
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), count("allow").alias("allowed"), count("block").alias("blocked"))
    hosts = hosts.withColumn("kind", F.when(F.col("allowed") >= seed_share * F.col("n"), "trust").when(F.col("blocked") >= seed_share * F.col("n"), "distrust")).where("kind is not null")
    seeds = hosts.select("kind", "host", F.lit(1.0).alias("mass"))
    plain = cut(host_edges(pages))
    sums = plain.groupBy("src").agg(F.sum("n").alias("all"))
    forward = plain.join(sums, "src").select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("w"))
    into = plain.groupBy("dst").agg(F.sum("n").alias("all"))
    reverse = plain.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("w"))
    scores = propagate(forward.unionByName(reverse), seeds, damping, steps)
    pick = lambda kind: F.round(F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)), 9).alias(kind)
    return scores.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust)"""
    judged = parsed(pages, rules)
    scores = host_scores(pages, judged)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    dealt = judged.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    rows = dealt.join(_salted(scores), ["host", "salt"], "left").select("page_id", "host", "path", "rule", "rule_verdict", zero("trust"), zero("distrust"))
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


#: Rows of query() in DuckDB, with the walks as recursive queries of as many steps.
SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages WHERE page_id IS NOT NULL
), j AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p
), v AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rv FROM j
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE rv = 'allow') AS a, count(*) FILTER (WHERE rv = 'block') AS b FROM v WHERE host <> '' GROUP BY host
), k AS (
  SELECT host, CASE WHEN a >= 0.5 * n THEN 'trust' WHEN b >= 0.5 * n THEN 'distrust' END AS kind FROM h
), seeds AS (
  SELECT kind, host, (1.0::DOUBLE * (1 - 0.85::DOUBLE)) AS score FROM k WHERE kind IS NOT NULL
), links AS (
  SELECT host AS src, translate(regexp_extract(l, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1)) AS l FROM p WHERE host <> '' AND html IS NOT NULL)
), e AS (
  SELECT src, dst, count(*) AS n FROM links WHERE dst <> '' AND src <> dst GROUP BY ALL
), edges AS (
  SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM e
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e
), walk AS (
  SELECT 0 AS step, kind, host, score FROM seeds
  UNION ALL
  SELECT step, kind, host, sum(score) FROM (
    SELECT w.step + 1 AS step, e.kind, e.dst AS host, w.score * e.w * 0.85 AS score FROM walk w JOIN edges e ON e.kind = w.kind AND e.src = w.host WHERE w.step < 20
    UNION ALL
    SELECT s.step + 1, seeds.kind, seeds.host, seeds.score FROM (SELECT DISTINCT step FROM walk) s, seeds WHERE s.step < 20
  ) GROUP BY step, kind, host
), scores AS (
  SELECT host, round(coalesce(max(score) FILTER (WHERE kind = 'trust'), 0), 9) AS trust, round(coalesce(max(score) FILTER (WHERE kind = 'distrust'), 0), 9) AS distrust
  FROM walk WHERE step = 20 GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN distrust >= 0.05 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust
FROM v LEFT JOIN scores USING (host)
"""
