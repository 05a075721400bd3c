"""Queries on resampling statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statistics as S
from .base import query, table
from .metrics import AP, PRED, predictions

#: Resamples of an interval, and of a comparison in pairs.
REPS, PAIRED_REPS = 150, 2000


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where("part = 'test' and split = 'S0'")


def _mixed(keep: str, x: str, out: str, src: str) -> str:
    """The 32-bit mix of the resampling, step by step."""
    return f"""SELECT {keep}, {out} FROM (SELECT {keep}, ({x})::UBIGINT AS m0, xor(m0, m0 >> 16::UBIGINT) AS m1, (m1 * 2146121005::UBIGINT) & 4294967295::UBIGINT AS m2,
    xor(m2, m2 >> 15::UBIGINT) AS m3, (m3 * 2221713035::UBIGINT) & 4294967295::UBIGINT AS m4, xor(m4, m4 >> 16::UBIGINT) AS {out} FROM {src})"""


def draws_sql(unit: str, seed: int, reps: int, rows: str = "rows", within: str = "0") -> str:
    """CTEs up to x: the rows with rep and w, their unit's weight in it; within: an integer that tells pools apart."""
    places = ", ".join(f"max(c) FILTER (WHERE k = {k}) AS c{k}" for k in range(S.MOST))
    weight = " + ".join(f"(z >= c{k})::INT" for k in range(S.MOST))
    low = "& 4294967295::UBIGINT"
    return f"""units AS (SELECT pool, unit, row_number() OVER (PARTITION BY pool ORDER BY md5(unit::VARCHAR), unit) - 1 AS i FROM (SELECT DISTINCT {within} AS pool,
    {unit} AS unit FROM {rows})),
    n AS (SELECT pool, count(*) AS n, greatest(0.0::DOUBLE, 1 - {S.MARGIN} / sqrt(count(*)::DOUBLE)) AS rate FROM units GROUP BY pool),
    chances(pool, rate, k, p, c) AS (SELECT pool, rate, 0, exp(-rate), exp(-rate) FROM n UNION ALL SELECT pool, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1)
    FROM chances WHERE k < {S.MOST - 1}),
    places AS (SELECT pool, {places} FROM (SELECT pool, k, floor(c * 4294967296.0::DOUBLE) AS c FROM chances) GROUP BY pool),
    keys1 AS ({_mixed('pool, rep, use', f'(rep + {1_000_003 * seed} + 7368787 * pool + 15485863 * use) & 4294967295', 'a',
    f'(SELECT pool FROM n), (SELECT unnest(range({reps})) AS rep), (VALUES (0), (1), (2)) AS v(use)')}),
    keys AS ({_mixed('pool, rep, use, a', f'(a + 2654435769::UBIGINT) {low}', 'b', 'keys1')}),
    z1 AS ({_mixed('pool, rep, i, b', f'xor(i::UBIGINT {low}, a)', 't', 'units JOIN keys USING (pool) WHERE use = 0')}),
    z2 AS ({_mixed('pool, rep, i', f'(t + b + (i::UBIGINT >> 32::UBIGINT)) {low}', 'z', 'z1')}),
    poisson AS (SELECT pool, rep, i, {weight} AS w FROM z2 JOIN places USING (pool)),
    missing AS (SELECT pool, rep, any_value(n)::BIGINT AS n, unnest(range(any_value(n) - sum(w)::BIGINT)) AS k FROM poisson JOIN n USING (pool) GROUP BY pool, rep),
    f1 AS ({_mixed('pool, rep, n, k, use, b', f'xor(k::UBIGINT {low}, a)', 't', 'missing JOIN keys USING (pool, rep) WHERE use > 0')}),
    f2 AS ({_mixed('pool, rep, n, k, use', f'(t + b + (k::UBIGINT >> 32::UBIGINT)) {low}', 'z', 'f1')}),
    filling AS (SELECT pool, rep, i, count(*) AS w FROM (SELECT pool, rep, k, ((max(z) FILTER (WHERE use = 1) * 4294967296::UBIGINT
    + max(z) FILTER (WHERE use = 2)) % any_value(n)::UBIGINT)::BIGINT AS i FROM f2 GROUP BY pool, rep, k) GROUP BY pool, rep, i),
    weights AS (SELECT pool, rep, i, sum(w)::BIGINT AS w FROM (SELECT pool, rep, i, w FROM poisson WHERE w > 0 UNION ALL SELECT pool, rep, i, w FROM filling)
    GROUP BY pool, rep, i),
    x AS (SELECT r.*, rep, w FROM {rows} r JOIN units u ON u.unit = r.{unit} AND u.pool = {within} JOIN weights v ON v.pool = u.pool AND v.i = u.i)"""


def average_precision_sql(by: str) -> str:
    """(by, value) of the weighted rows x; null where a class is missing."""
    return f"""SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * cp::DOUBLE / (cp + cn)::DOUBLE) / sum(pos)::DOUBLE, 9) END AS value FROM (SELECT *,
    sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS cp, sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC) AS cn
    FROM (SELECT {by}, score, sum(label::INT * w) AS pos, sum((1 - label::INT) * w) AS neg FROM x GROUP BY ALL)) GROUP BY {by}"""


def auroc_sql(by: str) -> str:
    return f"""SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(neg * (2 * cp - pos))::DOUBLE / (2 * sum(pos) * sum(neg))::DOUBLE, 9) END AS value FROM (SELECT *,
    sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS cp FROM (SELECT {by}, score, sum(label::INT * w) AS pos, sum((1 - label::INT) * w) AS neg FROM x
    GROUP BY ALL)) GROUP BY {by}"""


INTERVAL = """SELECT model, count(*) AS reps, round(quantile_cont(value, 0.025), 7) AS lo, round(quantile_cont(value, 0.975),
    7) AS hi FROM v WHERE value IS NOT NULL GROUP BY model"""
S0 = "rows AS (SELECT * FROM test WHERE split = 'S0')"


@query("bootstrap_ci", f"WITH RECURSIVE {PRED}, {S0}, {draws_sql('event_id', 1, REPS)}, v AS ({average_precision_sql('rep, model')}) {INTERVAL}")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interval(S.bootstrap(_rows(spark, sf_dir), ["model"], "event_id", "label", "score", REPS, 1), ["model"])


@query("bootstrap_ci_auroc", f"WITH RECURSIVE {PRED}, {S0}, {draws_sql('event_id', 4, REPS)}, v AS ({auroc_sql('rep, model')}) {INTERVAL}")
def bootstrap_ci_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interval(S.bootstrap(_rows(spark, sf_dir), ["model"], "event_id", "label", "score", REPS, 4), ["model"], "auroc")


@query("cluster_bootstrap", f"WITH RECURSIVE {PRED}, {S0}, {draws_sql('user_id', 2, REPS)}, v AS ({average_precision_sql('rep, model')}) {INTERVAL}")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interval(S.bootstrap(_rows(spark, sf_dir), ["model"], "user_id", "label", "score", REPS, 2), ["model"])


@query("paired_bootstrap", f"""WITH RECURSIVE {PRED}, {S0}, {draws_sql('event_id', 3, PAIRED_REPS)}, v AS ({average_precision_sql('rep, model')}),
    o AS ({AP.format(by='model', src='rows')}), dl AS (SELECT round(f.value - b.value, 9) AS d FROM v f JOIN v b USING (rep)
    WHERE f.model = 'm1' AND b.model = 'm0')
    SELECT (SELECT round(f.auprc - b.auprc, 7) FROM o f, o b WHERE f.model = 'm1' AND b.model = 'm0') AS observed_delta, count(d) AS reps, round(avg(d), 7) AS mean_delta,
    round(quantile_cont(d, 0.025), 7) AS lo, round(quantile_cont(d, 0.975), 7) AS hi, round(avg((d <= 0)::INT), 7) AS share_not_positive FROM dl""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paired(S.bootstrap(_rows(spark, sf_dir), ["model"], "event_id", "label", "score", PAIRED_REPS, 3), [], "model", "m1", "m0")


@query(
    "seed_deltas",
    """WITH s AS (SELECT user_id % 20 AS seed, CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'base' END AS model, round(avg(value),
    6) AS a, round(max(value), 6) AS b FROM events GROUP BY ALL),
    d AS (SELECT f.a - b.a AS a, f.b - b.b AS b FROM s f JOIN s b USING (seed) WHERE f.model = 'full' AND b.model = 'base'),
    l AS (SELECT 'a' AS metric, a AS d FROM d UNION ALL SELECT 'b', b FROM d)
    SELECT metric, count(*) AS n, round(avg(d), 7) AS mean, round(stddev_samp(d), 7) AS sd, round(min(d), 7) AS lo, round(max(d),
    7) AS hi, round(avg((d > 0)::INT), 7) AS positive FROM l GROUP BY metric""",
)
def seed_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.groupBy((e.user_id % 20).alias("seed"), F.when(e.event_id % 2 == 0, "full").otherwise("base").alias("model")).agg(F.round(F.avg("value"), 6).alias("a"), F.round(F.max("value"), 6).alias("b"))
    return S.seed_deltas(s, "seed", "model", "full", "base", ["a", "b"])


@query("ensemble_mean", f"""WITH {PRED} SELECT event_id, split, round(avg(score), 9) AS score, string_agg(model, ','
    ORDER BY model) AS members, count(*) AS n, round(greatest(avg(score), 1 - avg(score)), 9) AS confidence FROM test GROUP BY ALL""")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).where("part = 'test'")
    mean = F.avg("score")
    return p.groupBy("event_id", "split").agg(F.round(mean, 9).alias("score"), F.array_join(F.array_sort(F.collect_list("model")), ",").alias("members"), F.count(F.lit(1)).alias("n"), F.round(F.greatest(mean, 1 - mean), 9).alias("confidence"))


@query("calibration_slope")
def calibration_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.calibration(predictions(spark, sf_dir).where("part = 'test'"), ["split", "model"], "label", "score")
