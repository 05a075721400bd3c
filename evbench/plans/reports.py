"""Queries on reductions of metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import reports as R
from ..operators import statistics as S
from ..operators.durable import cut
from .base import ORACLE_SQL, query, table
from .metrics import AP, BY, CONFUSION, MCC, PRED, predictions

#: Splits: S0 is the random one; shielded ones hold the events of some users.
SPLITS = """sp AS (SELECT * EXCLUDE (split), 'S' || s AS split FROM test, (VALUES (0), (1), (2), (3)) AS v(s) WHERE s = 0 OR user_id % 4 = s)"""
METRICS = f"""{SPLITS}, ap AS ({AP.format(by='split, model', src='sp')}), cf AS ({CONFUSION.replace('t)', '0.5)')} FROM sp
    GROUP BY ALL), cm AS (SELECT split, model, round({MCC}, 9) AS mcc FROM cf),
bn AS (SELECT split, model, {' + '.join(f'(score >= {e!r}::DOUBLE)::INT' for e in M.ECE_EDGES)} AS bin, count(*) AS n,
    sum(label::INT) AS y, sum(score) AS p FROM sp GROUP BY ALL), ec AS (SELECT split, model, round(sum(abs(p - y)) / sum(n),
    7) AS ece FROM bn GROUP BY ALL),
pk AS (SELECT split, model, round(avg(label::INT), 9) AS p_at_k FROM (SELECT *, row_number() OVER (PARTITION BY split, model
    ORDER BY score DESC, event_id) AS r FROM sp) WHERE r <= 50 GROUP BY ALL),
mt AS (SELECT split, model, auprc, mcc, ece, p_at_k FROM ap JOIN cm USING (split, model) JOIN ec USING (split, model)
    JOIN pk USING (split, model) WHERE NOT (split = 'S3' AND model = 'm2')),
au AS (SELECT split, split = 'S3' AS leaks FROM (SELECT DISTINCT split FROM sp))"""


def metric_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, audit) of three models on four splits, one model missing on one of them."""
    p = predictions(spark, sf_dir).where("part = 'test'").drop("split")
    s = p.withColumn("s", F.explode(F.array(*map(F.lit, range(4))))).where("s = 0 or user_id % 4 = s").withColumn("split", F.concat(F.lit("S"), F.col("s")))
    a = M.average_precision(s, BY, "label", "score")
    c = M.confusion(s, BY, "label", "score", 0.5).select(*BY, "mcc")
    k = M.precision_at(s, BY, "label", "score", "event_id").withColumnRenamed("precision", "p_at_k")
    m = a.join(c, BY).join(M.ece(s, BY, "label", "score"), BY).join(k, BY).where("not (split = 'S3' and model = 'm2')")
    return m, s.select("split").distinct().withColumn("leaks", F.col("split") == "S3")


@query("metric_rows", f"WITH {PRED}, {METRICS} SELECT * FROM mt")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_table(spark, sf_dir)[0]


@query(
    "robust_score",
    f"""WITH {PRED}, {METRICS}, s AS (SELECT model, count(DISTINCT split) AS splits, avg(auprc) AS a, avg(mcc) AS m, avg(p_at_k) AS p,
    min(auprc) AS worst FROM mt WHERE split <> 'S0' AND model <> 'm9' GROUP BY model)
    SELECT model, splits, round(worst, 7) AS worst,
    round(0.5 * a + 0.25 * (m + 1) / 2 + 0.25 * p - 0.2 * (1 - splits / (SELECT count(*) FROM au
    WHERE split <> 'S0')) - 0.1 * (SELECT count(*) FROM au WHERE leaks) - 0.2 * greatest(0, 0.5 - worst), 7) AS robust FROM s""",
)
def robust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, audit = metric_table(spark, sf_dir)
    return R.robust_scores(m, audit, "S0", ["m9"])


@query("collapse_table", f"""WITH {PRED}, {METRICS}, r AS (SELECT model, auprc AS random_auprc FROM mt WHERE split = 'S0'),
    s AS (SELECT model, round(avg(auprc), 7) AS shielded_mean, min(auprc) AS shielded_min FROM mt WHERE split <> 'S0'
    GROUP BY model) SELECT model, random_auprc, shielded_mean, shielded_min, round(random_auprc - shielded_mean, 7) AS drop FROM r
    FULL JOIN s USING (model)""")
def collapse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collapse(metric_table(spark, sf_dir)[0], "S0")


RULES = [("random", "S0", "m0"), ("users", "S1", "m0"), ("hard", "S2", "m1"), ("leaky", "S3", "m2")]


@query(
    "claim_gates",
    f"""WITH {PRED}, {METRICS}, r(claim, split, baseline) AS (VALUES ('random', 'S0', 'm0'), ('users', 'S1', 'm0'), ('hard', 'S2',
    'm1'), ('leaky', 'S3', 'm2')), j AS (SELECT claim, mt.model, mt.mcc, mt.ece, round(mt.auprc - b.auprc, 9) AS margin FROM mt
    JOIN r USING (split) LEFT JOIN mt b ON b.split = r.split AND b.model = baseline WHERE mt.model <> baseline)
    SELECT claim, model, margin, coalesce(margin >= 0.02 AND mcc > 0.05 AND ece < 0.25, false) AS passed FROM j""",
)
def claim_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.claim_gates(metric_table(spark, sf_dir)[0], RULES)


@query("ablation_summary", f"""WITH {PRED}, {METRICS}, s AS (SELECT model, round(avg(auprc), 7) AS mean_auprc FROM mt GROUP BY model)
    SELECT model, mean_auprc, CASE WHEN model LIKE 'm2%' THEN round(mean_auprc - (SELECT mean_auprc FROM s WHERE model = 'm0'),
    7) END AS delta FROM s""")
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ablation_summary(metric_table(spark, sf_dir)[0], "m0", "m2")


@query("leaderboard", f"""WITH {PRED}, {METRICS}, u AS (SELECT 'base' AS family, split, model, auprc FROM mt WHERE model <> 'm2'
    UNION ALL SELECT 'new', split, model, auprc FROM mt WHERE model = 'm2') SELECT *, rank() OVER (PARTITION BY split
    ORDER BY auprc DESC) AS rank FROM u""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metric_table(spark, sf_dir)[0]
    return R.leaderboard({"base": m.where("model <> 'm2'"), "new": m.where("model = 'm2'")})


@query(
    "scorecard",
    f"""WITH {PRED}, {METRICS} SELECT 'no_leaks' AS criterion, CASE WHEN count(*) FILTER (WHERE leaks) = 0 THEN 'met'
    ELSE 'open' END AS status, count(*) FILTER (WHERE leaks) || ' leaking splits' AS evidence FROM au
    UNION ALL SELECT 'beats_chance', CASE WHEN min(mcc) > 0 THEN 'met' ELSE 'open' END, count(*) || ' metric rows' FROM mt""",
)
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, audit = metric_table(spark, sf_dir)
    leaks = F.count_if(F.col("leaks"))
    a = audit.agg((leaks == 0).alias("ok"), F.concat(leaks.cast("string"), F.lit(" leaking splits")).alias("evidence"))
    b = m.agg((F.min("mcc") > 0).alias("ok"), F.concat(F.count(F.lit(1)).cast("string"), F.lit(" metric rows")).alias("evidence"))
    return R.scorecard([("no_leaks", a, ""), ("beats_chance", b, "")])


@query("seed_gate", """WITH s AS (SELECT user_id % 20 AS seed, CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'base' END AS model,
    round(avg(value), 6) AS a FROM events GROUP BY ALL), d AS (SELECT f.a - b.a AS d FROM s f JOIN s b USING (seed)
    WHERE f.model = 'full' AND b.model = 'base') SELECT 'a' AS metric, round(avg(d), 7) AS mean, round(avg((d > 0)::INT),
    7) AS positive, round(avg(d), 7) > 0 AND round(avg((d > 0)::INT), 7) >= 0.8 AS passed FROM d""")
def seed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.groupBy((e.user_id % 20).alias("seed"), F.when(e.event_id % 2 == 0, "full").otherwise("base").alias("model")).agg(F.round(F.avg("value"), 6).alias("a"))
    return R.seed_gate(S.seed_deltas(s, "seed", "model", "full", "base", ["a"]))


@query(
    "topk_enrichment",
    """WITH o AS (SELECT o_orderkey, o_totalprice, o_orderpriority AS st, o_orderstatus = 'F' AS hit FROM orders),
    t AS (SELECT o_orderkey FROM o ORDER BY o_totalprice DESC, o_orderkey LIMIT 200),
    b AS (SELECT st, avg(hit::INT) AS rate FROM o WHERE o_orderkey NOT IN (FROM t) GROUP BY st), s AS (SELECT count(*) AS k_used,
    sum(hit::INT)::BIGINT AS hits, round(sum(coalesce(rate, 0)), 7) AS expected FROM o LEFT JOIN b USING (st)
    WHERE o_orderkey IN (FROM t))
    SELECT k_used, hits, expected, round(hits / expected, 6) AS ratio FROM s""",
)
def topk_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return R.enrichment(o.select("o_orderkey", "o_totalprice", o.o_orderpriority.alias("st"), (o.o_orderstatus == "F").alias("hit")), "o_orderkey", "o_totalprice", "hit", ["st"], 200)


@query(
    "matched_background",
    """WITH c AS (SELECT o_custkey, count(*) AS degree FROM orders GROUP BY 1), h AS (SELECT degree, sum(degree)::BIGINT AS n FROM c GROUP BY 1),
    b AS (SELECT degree, floor((sum(n) OVER (ORDER BY degree) - n) * 5 / (SELECT count(*) FROM orders))::INT AS bin FROM h),
    o AS (SELECT o_orderkey AS id, o_orderpriority AS kind, bin, o_orderstatus = 'F' AS hit, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 300 AS top
    FROM orders JOIN c USING (o_custkey) JOIN b USING (degree)),
    t AS (SELECT kind, bin, count(*) AS top_n, sum(hit::INT)::BIGINT AS top_hits, 4 * count(*) AS wanted FROM o WHERE top GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind, bin ORDER BY md5('11|' || id), id) AS r FROM o WHERE NOT top),
    m AS (SELECT t.kind, t.bin, count(*) AS matched, sum(hit::INT)::BIGINT AS matched_hits FROM r JOIN t ON t.kind = r.kind AND t.bin = r.bin AND r <= wanted GROUP BY ALL)
    SELECT kind, bin, top_n, top_hits, wanted, coalesce(matched, 0) AS matched, coalesce(matched_hits, 0) AS matched_hits, wanted - coalesce(matched, 0) AS shortfall
    FROM t LEFT JOIN m USING (kind, bin)""",
)
def matched_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 largest orders against four others each of their priority and of customers with as many orders."""
    o = table(spark, sf_dir, "orders")
    d = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("degree"))
    rows = o.join(d, "o_custkey").select("o_orderkey", "o_totalprice", "o_orderpriority", "degree", (F.col("o_orderstatus") == "F").alias("hit"))
    return R.matched_background(rows, "o_orderkey", "o_totalprice", "hit", "o_orderpriority", "degree", 300, per_row=4, seed=11)


@query("min_evidence_gate", """SELECT count(*) AS row_count, count(DISTINCT l_orderkey) AS publications,
    count(*) FILTER (WHERE l_suppkey % 97 = 0) AS overlaps, CASE WHEN count(*) >= 50 AND count(DISTINCT l_orderkey) >= 10
    AND count(*) FILTER (WHERE l_suppkey % 97 = 0) = 0 THEN 'validation' ELSE 'pilot' END AS status FROM lineitem""")
def min_evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("o", F.col("l_suppkey") % 97 == 0)
    return R.minimum_evidence(li, "l_orderkey", "o")


@query(
    "readiness",
    f"""WITH {PRED}, {METRICS}, r AS (
      SELECT 'shielded_splits' AS criterion, count(DISTINCT split) >= 3 AND count(*) FILTER (WHERE leaks) = 0 AS ok,
      count(DISTINCT split) || ' splits, ' || count(*) FILTER (WHERE leaks) || ' leaking' AS evidence FROM au WHERE split <> 'S0'
      UNION ALL SELECT 'controls', count(DISTINCT model) FILTER (WHERE model IN ('m0', 'm9')) = 2,
      count(DISTINCT model) FILTER (WHERE model IN ('m0', 'm9')) || ' of 2 controls' FROM mt
      UNION ALL SELECT 'claims', count(*) FILTER (WHERE passed) > 0,
      count(*) FILTER (WHERE passed) || ' of ' || count(*) || ' claims pass' FROM ({ORACLE_SQL["claim_gates"]})
      UNION ALL SELECT 'ablation_gain', max(delta) FILTER (WHERE model = 'm2') > 0, 'delta ' || coalesce(printf('%.3f',
      max(delta) FILTER (WHERE model = 'm2')), 'unknown') FROM ({ORACLE_SQL["ablation_summary"]})
      UNION ALL SELECT 'worst_split', min(auprc) FILTER (WHERE split <> 'S0' AND model = 'm2') >= 0.5,
      'AUPRC ' || coalesce(printf('%.3f', min(auprc) FILTER (WHERE split <> 'S0' AND model = 'm2')), 'unknown') FROM mt
      UNION ALL SELECT 'external_set', max(status) = 'validation', max(row_count) || ' rows, ' || max("overlaps") || ' overlaps'
      FROM ({ORACLE_SQL["min_evidence_gate"]}))
    SELECT criterion, CASE WHEN coalesce(ok, false) THEN 'met' ELSE 'open' END AS status, evidence FROM r""",
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, audit = metric_table(spark, sf_dir)
    m = cut(m)
    return R.readiness(m, audit, R.claim_gates(m, RULES), R.ablation_summary(m, "m0", "m2"), min_evidence_gate(spark, sf_dir), "S0", ["m0", "m9"], "m2")
