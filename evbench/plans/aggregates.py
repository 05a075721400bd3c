"""Queries on aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.quantiles import exact_quantiles as exact
from .base import query, table


@query("label_distribution", """SELECT lang, coalesce(quality::VARCHAR, '__missing_label__') AS label, count(*) AS n FROM documents
    LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return A.label_distribution(d, F.col("quality"), ["lang"])


@query("distinct_profile", """SELECT count(*) AS row_count, count(DISTINCT l_suppkey) AS l_suppkey,
    count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_orderkey) AS l_orderkey FROM lineitem""")
def distinct_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_profile(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey", "l_orderkey"])


@query(
    "slice_taxonomy",
    """WITH s AS (SELECT unnest([{'axis': 'priority', 'slice': o_orderpriority},
    {'axis': 'year', 'slice': year(o_orderdate)::VARCHAR}, {'axis': 'customer', 'slice': (o_custkey % 1000)::VARCHAR},
    {'axis': 'status', 'slice': o_orderstatus}]) AS x, (o_orderstatus = 'F')::INT AS y FROM orders)
    SELECT x.axis AS axis, x.slice AS slice, count(*) AS n, sum(y)::BIGINT AS positives, round(sum(y) / count(*), 9) AS rate, CASE
    WHEN count(*) < 20 THEN 'small_slice' WHEN round(sum(y) / count(*), 9) < 0.15 OR round(sum(y) / count(*),
    9) > 0.85 THEN 'label_skew' ELSE 'ok' END AS risk FROM s GROUP BY 1, 2""",
)
def slice_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    axes = {"priority": o.o_orderpriority, "year": F.year("o_orderdate"), "customer": o.o_custkey % 1000, "status": o.o_orderstatus}
    return A.slices(o, axes, o.o_orderstatus == "F")


@query("rollup_rates", """SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, count(DISTINCT user_id) AS users,
    round(count(*) FILTER (WHERE value > 50) / count(*), 9) AS high_share FROM events GROUP BY ROLLUP (event_type)""")
def rollup_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return A.overall_and_by(table(spark, sf_dir, "events"), "event_type", n.alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.count_if(F.col("value") > 50) / n, 9).alias("high_share"))


@query("pivot_scores", """SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click,
    round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS purchase, round(avg(value) FILTER (WHERE event_type = 'view'),
    6) AS view FROM events GROUP BY user_id""")
def pivot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.round(F.avg("value"), 6))


@query("joined_set_agg", """SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags,
    count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey""")
def joined_set_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("exact_quantiles", """SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.9) AS q90,
    min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag""")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = exact(li, ["l_returnflag"], "l_quantity", [0.5, 0.9]).withColumnsRenamed({"q0": "median", "q1": "q90"})
    return q.join(li.groupBy("l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")), "l_returnflag")


@query("whole_quantiles", """SELECT 'all' AS g, round(quantile_cont(l_extendedprice, 0.025), 7) AS q0, round(quantile_cont(l_extendedprice, 0.5), 7) AS q1,
    round(quantile_cont(l_extendedprice, 0.975), 7) AS q2 FROM lineitem""")
def whole_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group of all rows, of nearly as many values."""
    q = exact(table(spark, sf_dir, "lineitem").withColumn("g", F.lit("all")), ["g"], "l_extendedprice", [0.025, 0.5, 0.975])
    return q.select("g", *[F.round(c, 7).alias(c) for c in ("q0", "q1", "q2")])


@query("mixed_rollup", """SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS first_flag,
    bool_or(l_linestatus = 'F') AS any_f, max(l_quantity) AS top, min(l_partkey) AS least_part, count(DISTINCT l_partkey) AS parts
    FROM lineitem GROUP BY l_orderkey""")
def mixed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    return g.agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first_flag"), F.bool_or(F.col("l_linestatus") == "F").alias("any_f"), F.max("l_quantity").alias("top"), F.min("l_partkey").alias("least_part"), F.count_distinct("l_partkey").alias("parts"))


@query("metrics_as_rows", """SELECT unnest(['documents', 'texts', 'labelled', 'median_chars']) AS metric, unnest([count(*)::DOUBLE,
    count(DISTINCT text)::DOUBLE, count(quality)::DOUBLE, quantile_cont(n_chars, 0.5)::DOUBLE]) AS value FROM documents
    LEFT JOIN labels USING (doc_id)""")
def metrics_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return A.as_rows(d, {"documents": F.count(F.lit(1)), "texts": F.count_distinct("text"), "labelled": F.count("quality"), "median_chars": F.percentile("n_chars", 0.5)})


@query("missing_rates", """SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS no_quality,
    round(count(*) FILTER (WHERE quality IS NULL) / count(*), 9) AS rate FROM documents LEFT JOIN labels USING (doc_id)
    GROUP BY lang""")
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n, lost = F.count(F.lit(1)), F.count_if(F.col("quality").isNull())
    return d.groupBy("lang").agg(n.alias("n"), lost.alias("no_quality"), F.round(lost / n, 9).alias("rate"))


@query("seed_summary", """SELECT l_returnflag, l_linenumber % 5 AS seed_mod, count(*) AS n, round(avg(l_quantity), 6) AS mean,
    round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_suppkey) AS seeds
    FROM lineitem GROUP BY ALL""")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", (li.l_linenumber % 5).alias("seed_mod")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count_distinct("l_suppkey").alias("seeds"))


@query("group_sizes", """SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM (SELECT l_suppkey, l_partkey
    FROM lineitem) GROUP BY l_suppkey, l_partkey) GROUP BY size""")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("size"))
    return g.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
