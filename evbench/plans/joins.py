"""Queries on joins and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from .base import query, table


@query("lookup_left", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name, n_name FROM lineitem LEFT JOIN (SELECT *
    FROM supplier WHERE s_suppkey % 7 <> 0) ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""")
def lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").withColumnRenamed("s_suppkey", "l_suppkey")
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.lookup(J.lookup(li, s, ["l_suppkey"]), n, ["s_nationkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s_name", "n_name")


@query("fanout_left", """SELECT o_orderkey, count(l_orderkey) AS lines, count(*) AS row_count FROM orders
    LEFT JOIN lineitem ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus GROUP BY o_orderkey""")
def fanout_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), F.lit(1).alias("hit"))
    j = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(li, ["o_orderkey", "o_orderstatus"], "left")
    return j.groupBy("o_orderkey").agg(F.count("hit").alias("lines"), F.count(F.lit(1)).alias("row_count"))


@query("outer_merge", """WITH a AS (SELECT l_orderkey AS k, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R'
    GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS discounted FROM lineitem WHERE l_discount > 0.05
    GROUP BY 1) SELECT k, returned, discounted FROM a FULL JOIN b USING (k)""")
def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    a = li.where("l_returnflag = 'R'").groupBy("k").agg(F.count(F.lit(1)).alias("returned"))
    b = li.where("l_discount > 0.05").groupBy("k").agg(F.count(F.lit(1)).alias("discounted"))
    return a.join(b, "k", "full")


@query(
    "semi_counts",
    """WITH ext AS (SELECT l_suppkey, l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'A'), ben AS (SELECT l_suppkey,
    l_partkey, l_orderkey FROM lineitem WHERE l_returnflag <> 'A')
    SELECT count(*) AS row_count, count(*) FILTER (WHERE l_suppkey IN (SELECT l_suppkey FROM ben)) AS l_suppkey_shared,
    count(*) FILTER (WHERE l_partkey IN (SELECT l_partkey FROM ben)) AS l_partkey_shared,
    count(*) FILTER (WHERE l_orderkey IN (SELECT l_orderkey FROM ben)) AS l_orderkey_shared FROM ext""",
)
def semi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return J.membership(li.where("l_returnflag = 'A'"), li.where("l_returnflag <> 'A'"), ["l_suppkey", "l_partkey", "l_orderkey"])


@query("anti_missing", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("batch_ids", """SELECT p_name, floor((row_number() OVER (ORDER BY p_name) - 1) / 7)::BIGINT AS batch
    FROM (SELECT DISTINCT p_name || '-' || p_brand AS p_name FROM part)""")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return J.batches(p.select(F.concat_ws("-", "p_name", "p_brand").alias("p_name")), "p_name", 7)


@query(
    "nearest_distance",
    """WITH p AS (SELECT event_id, user_id, floor(value * 100)::BIGINT AS v FROM events WHERE event_type = 'click'),
    s AS (SELECT DISTINCT user_id, floor(value * 100)::BIGINT AS w FROM events WHERE event_type = 'purchase' AND user_id % 4 <> 0)
    SELECT p.user_id, event_id, v, min(abs(v - w)) AS distance FROM p LEFT JOIN s ON p.user_id = s.user_id GROUP BY ALL""",
)
def nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100).alias("v"), "event_type")
    return J.nearest(e.where("event_type = 'click'"), e.where("event_type = 'purchase' and user_id % 4 <> 0"), "user_id", "event_id", "v")


@query(
    "interval_containment",
    """WITH r AS (SELECT l_suppkey AS k, min(l_partkey) + 50 AS lo, max(l_partkey) - 50 AS hi FROM lineitem WHERE l_suppkey % 5 <> 0
    GROUP BY 1), c AS (SELECT l_suppkey AS k, l_partkey AS s, l_partkey + l_linenumber * 20 AS e FROM lineitem)
    SELECT CASE WHEN lo IS NULL THEN 'no_range' WHEN s < lo THEN 'before' WHEN e > hi THEN 'after' ELSE 'ok' END AS status,
    count(*) AS n FROM c LEFT JOIN r USING (k) GROUP BY 1""",
)
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    r = li.where("k % 5 <> 0").groupBy("k").agg((F.min("l_partkey") + 50).alias("lo"), (F.max("l_partkey") - 50).alias("hi"))
    c = li.select("k", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber") * 20).alias("end"))
    return J.inside(c, r, "k").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("position_map", """SELECT a.conv_id, a.turn, b.role AS before_role FROM conversations a
    JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def position_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return c.select("conv_id", "turn").join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before_role")), ["conv_id", "turn"])


@query("schema_union", """SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
    NULL::VARCHAR AS brand FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL, NULL FROM supplier
    UNION ALL SELECT 'part', p_partkey, p_name, NULL, NULL, p_brand FROM part""")
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return J.stack([c, s, p])


@query("distinct_union", "SELECT l_suppkey AS k FROM lineitem UNION SELECT l_partkey FROM lineitem")
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("k")).union(li.select("l_partkey")).distinct()


@query("set_difference", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").subtract(li.where("l_returnflag = 'A'").select("l_partkey"))


@query(
    "partition_overlap",
    """WITH k AS (SELECT l_partkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n,
    bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
    SELECT count(*) FILTER (WHERE a) AS A_keys, count(*) FILTER (WHERE n) AS N_keys, count(*) FILTER (WHERE r) AS R_keys,
    count(*) FILTER (WHERE a AND n) AS A_N_overlap, count(*) FILTER (WHERE a AND r) AS A_R_overlap, count(*) FILTER (WHERE n
    AND r) AS N_R_overlap FROM k""",
)
def partition_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.overlap_counts(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_returnflag"), ["A", "N", "R"])


@query(
    "either_direction",
    """WITH c AS (SELECT DISTINCT l_suppkey AS x, l_partkey AS y, l_linenumber AS v FROM lineitem),
    q AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'A' UNION SELECT DISTINCT l_suppkey,
    l_partkey FROM lineitem WHERE l_returnflag <> 'A'),
    w AS (SELECT x AS a, y AS b, v, 0 AS p FROM c UNION ALL SELECT y, x, v, 1 FROM c), m AS (SELECT a, b, min(p) AS p FROM w
    GROUP BY ALL)
    SELECT a, b, v, p = 1 AS reversed FROM q JOIN m USING (a, b) JOIN w USING (a, b, p)""",
)
def either_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y"), F.col("l_linenumber").alias("v")).distinct()
    q = li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).union(li.where("l_returnflag <> 'A'").select("l_suppkey", "l_partkey")).distinct()
    return J.either_direction(q, c, "v")


@query(
    "pair_in_group",
    """WITH g AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS s FROM lineitem), e AS (SELECT DISTINCT l_suppkey AS a,
    (l_suppkey * 7 + l_linenumber) % 100 AS b FROM lineitem)
    SELECT a, b, count(*) AS n FROM e JOIN g ga ON ga.s = a JOIN g gb ON gb.s = b AND gb.g = ga.g GROUP BY a, b""",
)
def pair_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.select(F.col("l_orderkey").alias("g"), F.col("l_suppkey").alias("s")).distinct()
    e = li.select(F.col("l_suppkey").alias("a"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 100).alias("b")).distinct()
    first = e.join(g.withColumnRenamed("s", "a"), "a")
    return first.join(g.withColumnRenamed("s", "b"), ["b", "g"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
