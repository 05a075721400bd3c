"""Queries on metrics: events are scored rows, purchases are positives, scores come from md5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_int
from ..operators import metrics as M
from .base import query, table

BY = ["split", "model"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, part, split, model, label, score): three models on two splits."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 10 < 3, "valid").otherwise("test").alias("part"), F.when(F.col("user_id") % 2 == 0, "S0").otherwise("S1").alias("split"), (F.col("event_type") == "purchase").alias("label"))
    x = e.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    raw = hash_int(F.col("m"), F.col("event_id")) % 1000 + F.when(F.col("label"), 150 * F.col("m")).otherwise(0)
    return x.select("event_id", "user_id", "part", "split", F.concat(F.lit("m"), F.col("m")).alias("model"), "label", (raw / F.lit(1400.0)).alias("score"))


PRED = """pred AS (
  SELECT event_id, user_id, CASE WHEN event_id % 10 < 3 THEN 'valid' ELSE 'test' END AS part, CASE WHEN user_id % 2 = 0 THEN 'S0'
  ELSE 'S1' END AS split, 'm' || m AS model, event_type = 'purchase' AS label,
         (('0x' || substr(md5(m || '|' || event_id), 1, 8))::BIGINT % 1000 + CASE WHEN event_type = 'purchase' THEN 150 * m
         ELSE 0 END)::DOUBLE / 1400.0::DOUBLE AS score
  FROM events, (VALUES (0), (1), (2)) AS v(m)
), test AS (SELECT * FROM pred WHERE part = 'test'), valid AS (SELECT * FROM pred WHERE part = 'valid')"""

AUROC = """SELECT {by}, CASE WHEN sum(pos) > 0
    AND sum(neg) > 0 THEN round(sum(pos * (2 * (cum - neg) + neg))::DOUBLE / (2 * sum(pos) * sum(neg))::DOUBLE, 9) END AS auroc
    FROM (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score) AS cum FROM (SELECT {by}, score, sum(label::INT) AS pos,
    sum(1 - label::INT) AS neg FROM {src} GROUP BY ALL)) GROUP BY {by}"""
AP = """SELECT {by}, round(sum(pos * cp::DOUBLE / (cp + cn)::DOUBLE) / sum(pos)::DOUBLE, 9) AS auprc FROM (SELECT *,
    sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS cp, sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC) AS cn
    FROM (SELECT {by}, score, sum(label::INT) AS pos, sum(1 - label::INT) AS neg FROM {src} GROUP BY ALL)) GROUP BY {by}"""


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where("part = 'test'")


@query("auroc", f"WITH {PRED} {AUROC.format(by='split, model', src='test')}")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auroc(test_rows(spark, sf_dir), BY, "label", "score")


@query("average_precision", f"WITH {PRED} {AP.format(by='split, model', src='test')}")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_precision(test_rows(spark, sf_dir), BY, "label", "score")


@query(
    "macro_ovr_auroc",
    f"""WITH e AS (SELECT event_id % 2 AS half, event_type, c, event_type = c AS label, (('0x' || substr(md5(c || '|' || event_id), 1,
    8))::BIGINT % 1000)::DOUBLE / 1000.0::DOUBLE AS score FROM events, (VALUES ('click'), ('view'), ('purchase')) AS v(c)),
    a AS ({AUROC.format(by='half, c', src='e')}) SELECT half, round(avg(auroc), 8) AS macro_auroc FROM a GROUP BY half""",
)
def macro_ovr_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = {c: (hash_int(F.lit(c), e.event_id) % 1000 / F.lit(1000.0)).alias(c) for c in ("click", "view", "purchase")}
    rows = e.select((e.event_id % 2).alias("half"), "event_type", *s.values())
    return M.macro_auroc(rows, ["half"], "event_type", {c: c for c in s})


MCC = "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END"
F1 = "(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2"
CONFUSION = """SELECT split, model, count(*) FILTER (WHERE label AND score >= t)::DOUBLE AS tp, count(*) FILTER (WHERE NOT label
    AND score >= t)::DOUBLE AS fp, count(*) FILTER (WHERE label AND score < t)::DOUBLE AS fn, count(*) FILTER (WHERE NOT label
    AND score < t)::DOUBLE AS tn"""


@query(
    "confusion_metrics",
    f"""WITH {PRED}, c AS ({CONFUSION.replace('t)', '0.5)')} FROM test GROUP BY ALL) SELECT split, model, tp::BIGINT AS tp,
    fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
    round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round({F1}, 9) AS macro_f1, round({MCC}, 9) AS mcc
    FROM c""",
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(test_rows(spark, sf_dir), BY, "label", "score", 0.5)


@query("brier_logloss", f"""WITH {PRED}, p AS (SELECT *, label::INT AS y, least(greatest(score, 1e-6), 1 - 1e-6) AS q FROM test)
    SELECT split, model, round(avg((score - y) * (score - y)), 7) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))),
    7) AS log_loss FROM p GROUP BY ALL""")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.brier_and_log_loss(test_rows(spark, sf_dir), BY, "label", "score")


@query("ece", f"""WITH {PRED}, b AS (SELECT split, model, {' + '.join(f'(score >= {e!r}::DOUBLE)::INT' for e in M.ECE_EDGES)} AS bin,
    count(*) AS n, sum(label::INT) AS y, sum(score) AS p FROM test GROUP BY ALL) SELECT split, model,
    round(sum(abs(p - y)) / sum(n), 7) AS ece FROM b GROUP BY ALL""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ece(test_rows(spark, sf_dir), BY, "label", "score")


@query("precision_at_k", f"""WITH {PRED} SELECT split, model, round(avg(label::INT), 9) AS precision FROM (SELECT *,
    row_number() OVER (PARTITION BY split, model ORDER BY score DESC, event_id) AS r FROM test) WHERE r <= 50 GROUP BY ALL""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.precision_at(test_rows(spark, sf_dir), BY, "label", "score", "event_id")


def _sweep(value: str, candidates: str) -> str:
    return f"""WITH {PRED}, cand AS ({candidates}), c AS ({CONFUSION}, t FROM valid JOIN cand USING (split, model) GROUP BY split,
    model, t)
    SELECT split, model, t AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY split, model ORDER BY round({value},
    9) DESC, t) AS r FROM c) WHERE r = 1"""


@query("threshold_mcc", _sweep(MCC, f"""SELECT DISTINCT split, model, unnest(quantile_cont(score,
    [{', '.join(str(i / 100) for i in range(2, 99))}])) AS t FROM valid GROUP BY split, model"""))
def threshold_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = predictions(spark, sf_dir).where("part = 'valid'")
    return M.sweep(v, BY, "label", "score", M.quantile_candidates(v, BY, "score"))


@query("threshold_f1", _sweep(F1, "SELECT DISTINCT split, model, score AS t FROM valid"))
def threshold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = predictions(spark, sf_dir).where("part = 'valid'")
    return M.sweep(v, BY, "label", "score", v.select(*BY, F.col("score").alias("s")), "macro_f1")


# ------------------------------------------------------------------------------------------------------ many classes

#: DuckDB: events with the type that a made-up classifier of each model gives them, right in 2 of 5 to 4 of 5 cases, and never `error`.
TYPED = """t AS (SELECT event_id, 'm' || m AS model, event_type AS truth, CASE WHEN ('0x' || substr(md5('p|' || m || '|' || event_id), 1, 8))::BIGINT % 5 < 2 + m
    AND event_type <> 'error' THEN event_type ELSE ['click', 'view', 'purchase', 'signup'][('0x' || substr(md5('q|' || m || '|' || event_id), 1, 8))::BIGINT % 4 + 1] END AS predicted
    FROM events, (VALUES (0), (1), (2)) AS v(m))"""
CELLS = "c AS (SELECT model, truth, predicted, count(*) AS n FROM t GROUP BY ALL)"
CLASSES = """k AS (SELECT model, class, sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits FROM (SELECT model, truth AS class, n AS t, 0 AS p,
    CASE WHEN truth = predicted THEN n ELSE 0 END AS h FROM c UNION ALL SELECT model, predicted, 0, n, 0 FROM c) GROUP BY ALL),
    f AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
    CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1 FROM k)"""


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, model, truth, predicted)"""
    e = table(spark, sf_dir, "events").withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    known = (hash_int(F.lit("p"), F.col("m"), F.col("event_id")) % 5 < 2 + F.col("m")) & (F.col("event_type") != "error")
    other = F.get(F.array(*map(F.lit, ("click", "view", "purchase", "signup"))), (hash_int(F.lit("q"), F.col("m"), F.col("event_id")) % 4).cast("int"))
    return e.select("event_id", F.concat(F.lit("m"), F.col("m")).alias("model"), F.col("event_type").alias("truth"), F.when(known, F.col("event_type")).otherwise(other).alias("predicted"))


@query("class_confusion", f"WITH {TYPED} SELECT model, truth, predicted, count(*) AS n FROM t GROUP BY ALL")
def class_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_confusion(typed(spark, sf_dir), ["model"], "truth", "predicted")


@query("class_scores", f"""WITH {TYPED}, {CELLS}, {CLASSES} SELECT model, class, support, predicted, hits, round(precision, 9) AS precision, round(recall, 9) AS recall,
    round(f1, 9) AS f1 FROM f""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.class_scores(M.class_confusion(typed(spark, sf_dir), ["model"], "truth", "predicted"), ["model"])
    return c.select("model", "class", "support", "predicted", "hits", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query(
    "class_metrics",
    f"""WITH {TYPED}, {CELLS}, {CLASSES}, s AS (SELECT model, sum(support)::BIGINT AS n, count(*) AS classes, sum(hits)::DOUBLE AS h, avg(recall) FILTER (WHERE support > 0) AS b,
    avg(f1) AS macro, sum(support * f1) / sum(support) AS weighted, sum(support::DOUBLE * predicted) AS tp, sum(support::DOUBLE * support) AS tt, sum(predicted::DOUBLE * predicted) AS pp
    FROM f GROUP BY model)
    SELECT model, n, classes, round(h / n, 9) AS accuracy, round(b, 9) AS balanced_accuracy, round(macro, 9) AS macro_f1, round(weighted, 9) AS weighted_f1,
    round((h * n - tp) / sqrt((n::DOUBLE * n - pp) * (n::DOUBLE * n - tt)), 9) AS mcc FROM s""",
)
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_metrics(typed(spark, sf_dir), ["model"], "truth", "predicted")


@query("class_log_loss", """WITH u AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL), p AS (SELECT e.event_id, e.event_type AS truth, u.event_type AS class,
    u.k / sum(u.k) OVER (PARTITION BY e.event_id) AS p FROM events e JOIN u USING (user_id)) SELECT 1 AS g, round(avg(-ln(least(greatest(p, 1e-15), 1 - 1e-15))), 7) AS log_loss FROM p
    WHERE truth = class""")
def class_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own shares of event types as the probabilities of each of the user's events."""
    e = table(spark, sf_dir, "events")
    u = e.groupBy("user_id", F.col("event_type").alias("class")).agg(F.count(F.lit(1)).cast("double").alias("p"))
    return M.class_log_loss(e.select("event_id", "user_id", F.col("event_type").alias("truth"), F.lit(1).alias("g")).join(u, "user_id"), ["g"], "event_id", "truth", "class", "p")
