"""Queries on components, communities and train-only graph features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators.durable import cut
from .base import query, table



@query(
    "entity_components",
    """WITH RECURSIVE c AS (SELECT c_custkey AS row, unnest(CASE WHEN c_custkey % 11 = 0 THEN ['A' || (c_custkey % 400),
    'B' || (c_custkey % 55)] WHEN c_custkey % 7 = 0 THEN [] ELSE ['C' || (c_custkey // 3)] END) AS e FROM customer),
    walk(v, l) AS (SELECT row, row FROM c UNION SELECT b.row, w.l FROM walk w JOIN c a ON a.row = w.v JOIN c b ON b.e = a.e
    WHERE b.row > w.l)
    SELECT c_custkey, coalesce(min(l), c_custkey) AS component FROM customer LEFT JOIN walk ON v = c_custkey GROUP BY c_custkey""",
)
def entity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    e = F.when(k % 11 == 0, F.array(F.concat(F.lit("A"), k % 400), F.concat(F.lit("B"), k % 55))).when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("C"), F.floor(k / 3))))
    return G.entity_components(c, "c_custkey", e)


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return G.axis_memberships(o, "o_orderkey", {"customer": o.o_custkey, "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "status": o.o_orderstatus})


AXES = """m AS (SELECT o_orderkey AS row, 'customer' AS axis, o_custkey::VARCHAR AS key FROM orders
    UNION ALL SELECT o_orderkey, 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders),
g AS (SELECT axis, key, count(*) AS n FROM m WHERE key IS NOT NULL GROUP BY ALL)"""


@query("axis_edge_counts", f"""WITH {AXES} SELECT axis, sum(CASE WHEN n <= 350 THEN n * (n - 1) // 2 ELSE 0 END)::BIGINT AS edges,
    count(*) FILTER (WHERE n > 350) AS skipped FROM g GROUP BY axis""")
def axis_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.axis_edge_counts(_axes(spark, sf_dir), 350)


#: Rounds in which the least label reaches every order over shared keys; paths of this table are far shorter.
SPREAD = ", ".join(
    f"""s{k + 1} AS MATERIALIZED (SELECT row, min(least) AS l FROM k JOIN (SELECT axis, key, min(l) AS least FROM k JOIN s{k} USING (row) GROUP BY ALL)
    USING (axis, key) GROUP BY row)""" for k in range(16)
)


@query(
    "multi_axis_components",
    f"""WITH {AXES}, k AS (SELECT m.row, m.axis, m.key FROM m JOIN g USING (axis, key) WHERE n <= 350), s0 AS (SELECT DISTINCT row, row AS l FROM k), {SPREAD},
    c AS (SELECT o_orderkey, coalesce(l, o_orderkey) AS component FROM orders LEFT JOIN s16 ON row = o_orderkey)
    SELECT size, count(*) AS components FROM (SELECT component, count(*) AS size FROM c GROUP BY 1) GROUP BY size""",
)
def multi_axis_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.components(G.stars(_axes(spark, sf_dir), "row", ["axis", "key"], 350))
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


TRAIN = "t AS (SELECT * FROM lineitem WHERE l_orderkey % 10 < 7), q AS (SELECT * FROM lineitem WHERE l_orderkey % 10 >= 7)"


def _train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", F.concat(F.lit("n"), li.l_suppkey).alias("a"), F.concat(F.lit("n"), li.l_partkey).alias("b"), (li.l_suppkey * 10 + li.l_linenumber).alias("site"), (li.l_linestatus == "F").alias("label"))
    return rows.where("l_orderkey % 10 < 7"), rows.where("l_orderkey % 10 >= 7")


@query(
    "degree_features",
    f"""WITH {TRAIN}, e AS (SELECT p, count(*) AS n FROM (SELECT l_suppkey AS p FROM t UNION ALL SELECT l_partkey FROM t) GROUP BY p)
    SELECT l_orderkey, l_linenumber, 'n' || l_suppkey AS a, 'n' || l_partkey AS b, coalesce(na, 0) AS n_a, coalesce(nb, 0) AS n_b,
    coalesce(ns, 0) AS n_site, coalesce(np, 0) AS n_pair, coalesce(ea.n, 0) AS n_any_a, coalesce(eb.n, 0) AS n_any_b FROM q
    LEFT JOIN (SELECT l_suppkey, count(*) AS na FROM t GROUP BY 1) USING (l_suppkey) LEFT JOIN (SELECT l_partkey, count(*) AS nb
    FROM t GROUP BY 1) USING (l_partkey)
    LEFT JOIN (SELECT l_suppkey, l_linenumber, count(*) AS ns FROM t GROUP BY ALL) USING (l_suppkey, l_linenumber)
    LEFT JOIN (SELECT l_suppkey, l_partkey, count(*) AS np FROM t GROUP BY ALL) USING (l_suppkey, l_partkey)
    LEFT JOIN e ea ON ea.p = l_suppkey LEFT JOIN e eb ON eb.p = l_partkey""",
)
def degree_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return G.degree_features(train, test, "a", "b", "site").drop("site", "label")


@query(
    "pair_degree_features",
    f"""WITH {TRAIN}, f AS (SELECT * FROM t WHERE l_linestatus = 'F'),
    d AS (SELECT p, count(*) AS n FROM (SELECT l_suppkey AS p FROM f UNION ALL SELECT l_partkey FROM f) GROUP BY p),
    k AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS lo, greatest(l_suppkey, l_partkey) AS hi FROM f),
    x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(u.n, 0) AS p, coalesce(v.n, 0) AS q,
    (lo IS NOT NULL)::INT AS pair_seen FROM q
      LEFT JOIN d u ON u.p = l_suppkey LEFT JOIN d v ON v.p = l_partkey LEFT JOIN k ON lo = least(l_suppkey, l_partkey)
      AND hi = greatest(l_suppkey, l_partkey))
    SELECT l_orderkey, l_linenumber, 'n' || l_suppkey AS a, 'n' || l_partkey AS b, p AS deg_a, q AS deg_b, p + q AS deg_sum,
    abs(p - q) AS deg_diff, least(p, q) AS deg_min, greatest(p, q) AS deg_max,
      p * q AS deg_product, (p > 0 OR q > 0)::INT AS either_seen, (p > 0 AND q > 0)::INT AS both_seen, pair_seen,
      'train_positive_rows' AS degree_source FROM x""",
)
def pair_degree_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return G.pair_degree_features(train, test, "a", "b", "label").drop("site", "label")


EDGES = """e AS (SELECT DISTINCT least('n' || l_suppkey, 'n' || l_partkey) AS a, greatest('n' || l_suppkey, 'n' || l_partkey) AS b
    FROM lineitem WHERE {where}), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b)"""


#: Ten rounds of least labels reach every vertex of this graph, whose paths are shorter.
LEAST = "c0 AS MATERIALIZED (SELECT v, v AS l FROM (SELECT a AS v FROM e UNION SELECT b FROM e)), " + ", ".join(
    f"""c{k + 1} AS MATERIALIZED (SELECT v, min(l) AS l FROM (SELECT v, l FROM c{k} UNION ALL SELECT u.b, c.l FROM u
    JOIN c{k} c ON c.v = u.a) GROUP BY v)""" for k in range(10)
)


@query(
    "topology_features",
    f"""WITH {EDGES.format(where='l_orderkey % 10 < 7')}, q AS (SELECT DISTINCT 'n' || l_suppkey AS a, 'n' || l_partkey AS b
    FROM lineitem WHERE l_orderkey % 10 >= 7),
    d AS (SELECT v, count(*) AS deg FROM (SELECT a AS v FROM u UNION ALL SELECT unnest([a, b]) FROM e WHERE a = b) GROUP BY v),
    {LEAST}, c AS (FROM c10),
    n AS (SELECT q.a, q.b, count(*) AS common FROM q JOIN u x ON x.a = q.a JOIN u y ON y.a = q.b AND y.b = x.b WHERE x.b <> q.a
    AND x.b <> q.b GROUP BY ALL)
    SELECT q.a, q.b, coalesce(da.deg, 0) AS deg_a, coalesce(db.deg, 0) AS deg_b, coalesce(common, 0) AS common,
    coalesce(ca.l = cb.l, false) AS same_component, e.a IS NOT NULL AS edge_exists
    FROM q LEFT JOIN d da ON da.v = q.a LEFT JOIN d db ON db.v = q.b LEFT JOIN n ON n.a = q.a AND n.b = q.b
    LEFT JOIN c ca ON ca.v = q.a LEFT JOIN c cb ON cb.v = q.b LEFT JOIN e ON e.a = least(q.a, q.b) AND e.b = greatest(q.a, q.b)""",
)
def topology_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    e = li.select(F.concat(F.lit("n"), li.l_suppkey).alias("a"), F.concat(F.lit("n"), li.l_partkey).alias("b"), "l_orderkey", "l_partkey")
    return G.topology_features(e.where("l_orderkey % 10 < 7"), e.where("l_orderkey % 10 >= 7"))


def _vote(src: str) -> str:
    return f"""SELECT v, label FROM (SELECT u.a AS v, l.label, row_number() OVER (PARTITION BY u.a ORDER BY count(*) DESC,
    l.label) AS rn FROM u JOIN {src} l ON l.v = u.b GROUP BY u.a, l.label) WHERE rn = 1"""


LABELS = f"""{EDGES.format(where='true')}, l0 AS (SELECT DISTINCT a AS v, a AS label FROM u), l1 AS ({_vote('l0')}),
    l2 AS ({_vote('l1')}), l3 AS ({_vote('l2')})"""


@query("label_propagation", f"WITH {LABELS} SELECT v, label FROM l3")
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_propagation(_edges(spark, sf_dir), 3)


@query(
    "community_modularity",
    f"""WITH {LABELS}, x AS (SELECT p.label AS la, q.label AS lb FROM e JOIN l3 p ON p.v = e.a JOIN l3 q ON q.v = e.b
    WHERE e.a <> e.b), d AS (SELECT l, count(*) AS d FROM (SELECT la AS l FROM x UNION ALL SELECT lb FROM x) GROUP BY l)
    SELECT (SELECT count(*) FROM d) AS communities, round(2 * (SELECT count(*) FROM x WHERE la = lb) / (SELECT sum(d)
    FROM d) - (SELECT sum(d * d) FROM d) / ((SELECT sum(d) FROM d) * (SELECT sum(d) FROM d)), 9) AS modularity""",
)
def community_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return G.modularity(e, G.label_propagation(e, 3))


@query("modularity_communities", f"""WITH {EDGES.format(where='true')} SELECT (SELECT count(DISTINCT a) FROM u) AS vertices, (SELECT count(*) FROM e WHERE a <> b) AS edges, true AS labelled,
    true AS better""")
def modularity_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by modularity label every vertex, and beat three rounds of votes.

    A vertex's name is n and its key, so that the keys themselves are the vertices.
    """
    li = table(spark, sf_dir, "lineitem")
    e = cut(li.select(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).where("a <> b").distinct())
    found = G.communities(e, simple=True)
    mine, votes = G.modularity(e, found, simple=True), G.modularity(e, G.label_propagation(e, 3, simple=True), simple=True)
    sizes = e.agg(F.count(F.lit(1)).alias("edges"))
    vertices = e.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(found, "v", "left").agg(F.count(F.lit(1)).alias("vertices"), F.bool_and(F.col("label").isNotNull()).alias("labelled"))
    both = mine.select(F.col("modularity").alias("x")).join(F.broadcast(votes.select(F.col("modularity").alias("y"))))  # one row each
    return vertices.join(F.broadcast(sizes)).join(F.broadcast(both)).select("vertices", "edges", "labelled", (F.col("x") >= F.col("y")).alias("better"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("n"), li.l_suppkey).alias("a"), F.concat(F.lit("n"), li.l_partkey).alias("b"))


@query("class_weights", """SELECT quality, count(*) AS n, round((SELECT count(*)
    FROM labels) / (count(*) * (SELECT count(DISTINCT quality) FROM labels)), 9) AS weight FROM labels GROUP BY quality""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import class_weights as weights

    return weights(table(spark, sf_dir, "labels"), "quality").withColumn("weight", F.round("weight", 9))
