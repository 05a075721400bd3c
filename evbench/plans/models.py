"""Queries on baseline models: purchases are predicted from train rows of each split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_int
from ..operators import fits as L
from ..operators import metrics as M
from ..operators import models as K
from ..operators import packs as X
from ..operators.durable import cut
from .base import query, table
from .metrics import predictions


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda p: F.regexp_count("text", F.lit(p)) / n
    part = F.when(hash_int(F.col("doc_id")) % 10 < 7, "train").otherwise("test")
    made = d.select("doc_id", part.alias("part"), (F.col("quality") == 1).alias("label"), "lang", "source", share("[#*$%&|<>]").alias("symbols"), share("[A-Z]").alias("upper"), share("[0-9]").alias("digits"), F.log1p(n.cast("double")).alias("log_n"))
    return cut(made)  # fits read the rows again and again, and the texts once


NUMBERS = ["symbols", "upper", "digits", "log_n"]


def _report(scored: DataFrame) -> DataFrame:
    t = scored.where("part = 'test'").withColumn("g", F.lit("test"))
    return M.auroc(t, ["g"], "label", "score").join(M.average_precision(t, ["g"], "label", "score"), "g").join(M.confusion(t, ["g"], "label", "score", 0.5), "g").drop("g")


@query("model_prior", """WITH r AS (SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1,
    8))::BIGINT % 10 < 7 THEN 'train' ELSE 'test' END AS part, quality = 1 AS label FROM documents JOIN labels USING (doc_id))
    SELECT part, label, count(*) AS n, (SELECT round(avg(label::INT), 9) FROM r WHERE part = 'train') AS score FROM r
    GROUP BY part, label""")
def model_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.prior(rows(spark, sf_dir), "part", "label").groupBy("part", "label", "score").agg(F.count(F.lit(1)).alias("n"))


def with_entries(r: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(rows with entries of the feature families, their sizes)"""
    langs = X.categories(r, ["lang"])["lang"]
    dense = lambda *names: X.dense([F.col(c) for c in names])
    blocks = {"lang": X.one_hot([(F.col("lang"), langs)]), "symbols": dense("symbols"), "letters": dense("upper", "digits"), "numbers": dense(*NUMBERS)}
    packs = {"f_symbols": [X.Part("symbols")], "f_letters": [X.Part("letters")], "f_all": [X.Part("lang"), X.Part("numbers")]}
    return X.with_packs(r, blocks, packs), {name: X.stacked(blocks, parts).size for name, parts in packs.items()}


def _by_part(r: DataFrame, families: dict[str, str], kind: str = "logistic") -> DataFrame:
    """Predictions of the families (model -> column of entries) on the rows' own part."""
    rows, sizes = with_entries(r)
    splits = r.select("doc_id", F.lit("one").alias("split"), "part")
    return K.harness(rows, "doc_id", splits, ["one"], {m: L.Family(c, sizes[c], kind) for m, c in families.items()})[0]


@query("model_logistic")
def model_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_by_part(rows(spark, sf_dir), {"all": "f_all"}))


@query("model_forest")
def model_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(K.fit_score(rows(spark, sf_dir), "part", "label", ["lang"], NUMBERS, "forest"))


@query("model_mlp")
def model_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_by_part(rows(spark, sf_dir), {"all": "f_all"}, "mlp"))


@query("model_ablations")
def model_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _by_part(rows(spark, sf_dir), {"symbols": "f_symbols", "letters": "f_letters", "all": "f_all"}).where("part = 'test'").withColumnRenamed("model", "family")
    by = ["family"]
    return M.auroc(t, by, "label", "score").join(M.average_precision(t, by, "label", "score"), by).join(M.confusion(t, by, "label", "score", 0.5), by)


@query("stacked_scores")
def stacked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).where("not (model = 'm2' and event_id % 5 = 0)")
    return _report(K.stacked(p, "event_id", "part", "label", ["m0", "m1", "m2"]))


@query("aligned_probabilities", """WITH i AS (SELECT DISTINCT user_id FROM events), k AS (SELECT user_id, event_type AS class,
    count(*) AS k FROM events WHERE event_type <> 'error' GROUP BY ALL), p AS (SELECT user_id, class,
    round(k / sum(k) OVER (PARTITION BY user_id), 9) AS p FROM k) SELECT user_id, class, coalesce(p, 0) AS p FROM i CROSS
    JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS c(class) LEFT JOIN p USING (user_id, class)""")
def aligned_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    p = e.groupBy("user_id", F.col("event_type").alias("class")).agg(F.count(F.lit(1)).alias("k")).join(n, "user_id").select("user_id", "class", F.round(F.col("k") / F.col("n"), 9).alias("p"))
    return K.aligned(p, "user_id", ["click", "error", "purchase", "signup", "view"])
