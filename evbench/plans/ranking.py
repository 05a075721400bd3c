"""Queries on ranks, best rows and samples.  Every order is total, since Spark has no row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evidence import first_of_each
from ..operators.evidence import keyword_rows
from .base import query, table


@query("rank_min", """SELECT l_suppkey, n, rank() OVER (PARTITION BY l_suppkey % 10 ORDER BY n DESC) AS rank FROM (SELECT l_suppkey,
    count(*) AS n FROM lineitem GROUP BY 1)""")
def rank_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.rank().over(Window.partitionBy(F.col("l_suppkey") % 10).orderBy(F.desc("n"))))


@query("best_per_group", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderkey IN (SELECT l_orderkey
    FROM lineitem WHERE l_quantity > 40)) WHERE rn = 1""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi")
    return first_of_each(o, ["o_custkey"], [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 250")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(250)


@query("argmax_by_group", """SELECT l_returnflag, arg_max(l_suppkey, (n, -l_suppkey)) AS best, max(n) AS n FROM (SELECT l_returnflag,
    l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY ALL) GROUP BY l_returnflag""")
def argmax_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").where("l_suppkey % 10 <> 0").groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("l_returnflag").agg(F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("best"), F.max("n").alias("n"))


@query("sample_examples", """SELECT event_type, event_id FROM (SELECT event_type, event_id,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 3""")
def sample_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(w).alias("rn")).where("rn <= 3").drop("rn")


@query("dense_category_ids", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_id FROM part")
def dense_category_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    # ranks over the distinct categories, of which there are few, and not over the rows
    ids = p.select("p_brand").distinct().select("p_brand", (F.dense_rank().over(Window.orderBy("p_brand")) - 1).cast("long").alias("brand_id"))
    return p.join(ids, "p_brand").select("p_partkey", "brand_id")


def _selection_sql(words: str) -> str:
    return f"""WITH h AS (SELECT p_partkey, p_name, p_retailprice, regexp_matches(p_name, '(?i){words}') OR regexp_matches(p_type, '(?i){words}') AS hit FROM part),
    r AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM h WHERE hit OR (SELECT count(*) FROM h WHERE hit) < 10)
    SELECT p_partkey, p_name FROM r WHERE r <= CASE WHEN (SELECT count(*) FROM h WHERE hit) < 10 THEN 60 ELSE 80 END"""


def _selection(spark: SparkSession, sf_dir: str, words: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return keyword_rows(p, ["p_name", "p_type"], words, [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "p_name")


@query("keyword_selection", _selection_sql("ring|GEAR|promo"))
def keyword_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sf_dir, "ring|GEAR|promo")


@query("keyword_fallback", _selection_sql("no such word"))
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that too few rows have: the best rows of all."""
    return _selection(spark, sf_dir, "no such word")
