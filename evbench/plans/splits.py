"""Queries on splits and audits: suppliers, parts, pairs and orders are the keys that must stay on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assignment as A
from ..operators import splits as S
from .base import query, table

#: DuckDB: groups of the rows in `src` (k), filled size class by size class; `g` gets (k, size, part).
GREEDY = """
{p}g AS (SELECT k, count(*) AS size FROM {src} GROUP BY k),
{p}c AS (SELECT size, count(*) AS n, row_number() OVER (ORDER BY size DESC) AS i FROM {p}g GROUP BY size),
{p}t AS (SELECT sum(size * n)::BIGINT AS total FROM {p}c),
{p}r AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS size, 14 * total AS d0, 3 * total AS d1, 3 * total AS d2, 0::BIGINT AS n0, 0::BIGINT AS n1,
  0::BIGINT AS n2 FROM {p}t
  UNION ALL
  SELECT i, size, d0 - 20 * size * sum((p = 0)::INT)::BIGINT, d1 - 20 * size * sum((p = 1)::INT)::BIGINT,
  d2 - 20 * size * sum((p = 2)::INT)::BIGINT, sum((p = 0)::INT)::BIGINT, sum((p = 1)::INT)::BIGINT, sum((p = 2)::INT)::BIGINT
  FROM (SELECT *, row_number() OVER (ORDER BY CASE p WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END - j * 20 * size DESC, p) AS rn
        FROM (SELECT c.i, c.size, c.n, r.d0, r.d1, r.d2, p, unnest(range(c.n)) AS j FROM {p}r r JOIN {p}c c ON c.i = r.i + 1,
        (VALUES (0), (1), (2)) AS v(p)))
  WHERE rn <= n GROUP BY i, size, d0, d1, d2
),
{p}s AS (
  SELECT k, g.size, CASE WHEN rk <= n0 THEN 'train' WHEN rk <= n0 + n1 THEN 'valid' ELSE 'test' END AS part
  FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY md5('{seed}|' || k), k) AS rk FROM {p}g) g
  JOIN {p}r r ON r.size = g.size
)"""

AUDIT = """SELECT split, sum(train)::BIGINT AS train_rows, sum(valid)::BIGINT AS valid_rows, sum(test)::BIGINT AS test_rows,
    count(*) FILTER (WHERE train > 0 AND valid > 0) AS train_valid_overlap, count(*) FILTER (WHERE train > 0
    AND test > 0) AS train_test_overlap, count(*) FILTER (WHERE valid > 0 AND test > 0) AS valid_test_overlap,
  round(sum(trp) / sum(train), 9) AS train_rate, round(sum(vap) / sum(valid), 9) AS valid_rate, round(sum(tep) / sum(test),
  9) AS test_rate
  FROM (SELECT split, key, sum((part = 'train')::INT) AS train, sum((part = 'valid')::INT) AS valid,
  sum((part = 'test')::INT) AS test, sum((part = 'train' AND label)::INT) AS trp, sum((part = 'valid' AND label)::INT) AS vap,
  sum((part = 'test' AND label)::INT) AS tep FROM long GROUP BY ALL) GROUP BY split"""

PAIRS = """li AS (SELECT least(l_suppkey::VARCHAR, l_partkey::VARCHAR) || '||' || greatest(l_suppkey::VARCHAR,
    l_partkey::VARCHAR) AS pair, l_suppkey::VARCHAR AS supplier, l_partkey::VARCHAR AS part_key, l_linestatus = 'F' AS label
    FROM lineitem)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(T.pair_key(li.l_suppkey, li.l_partkey).alias("pair"), li.l_suppkey.cast("string").alias("supplier"), li.l_partkey.cast("string").alias("part_key"), (li.l_linestatus == "F").alias("label"))


@query("overlap_audit", f"""WITH RECURSIVE {PAIRS}, src AS (SELECT pair AS k FROM li), {GREEDY.format(p='x_', src='src', seed=7)},
    long AS (SELECT 'pair' AS split, pair AS key, part, label FROM li JOIN x_s ON pair = k) {AUDIT}""")
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = rows(spark, sf_dir)
    j = S.attach(li, S.group_split(li, "pair", 7), "pair")
    return S.audit(j.select(F.lit("pair").alias("split"), F.col("pair").alias("key"), "part", "label"))


@query(
    "multi_split",
    f"""WITH RECURSIVE {PAIRS}, src1 AS (SELECT supplier AS k FROM li), src2 AS (SELECT part_key AS k FROM li),
    {GREEDY.format(p='x_', src='src1', seed=11)}, {GREEDY.format(p='y_', src='src2', seed=12)},
    long AS (SELECT 'supplier' AS split, supplier AS key, part, label FROM li JOIN x_s ON supplier = k UNION ALL SELECT 'part',
    part_key, part, label FROM li JOIN y_s ON part_key = k) {AUDIT}""",
)
def multi_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = rows(spark, sf_dir)
    specs = (("supplier", "supplier", 11), ("part", "part_key", 12))
    long = [S.attach(li, S.group_split(li, key, seed), key).select(F.lit(name).alias("split"), F.col(key).alias("key"), "part", "label") for name, key, seed in specs]
    return S.audit(long[0].unionByName(long[1]))


@query("group_split", f"""WITH RECURSIVE src AS (SELECT l_partkey::VARCHAR AS k FROM lineitem),
    {GREEDY.format(p='x_', src='src', seed=3)} SELECT k, size, part FROM x_s""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_split(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("k")), "k", 3)


@query("random_split", """SELECT o_orderkey, CASE WHEN r <= n * 14 // 20 THEN 'train'
    WHEN r <= n * 14 // 20 + n * 3 // 20 THEN 'valid' ELSE 'test' END AS part FROM (SELECT o_orderkey,
    row_number() OVER (ORDER BY md5('5|' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders)""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("temporal_split", """WITH y AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN year(o_orderdate) END AS y
    FROM orders), q AS (SELECT floor(quantile_cont(y, 0.7))::INT AS a, floor(quantile_cont(y, 0.85))::INT AS b FROM y)
    SELECT y AS year, CASE WHEN y > b THEN 'test' WHEN y > a THEN 'valid' ELSE 'train' END AS part, count(*) AS n FROM y, q
    GROUP BY ALL""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.when(o.o_orderkey % 50 != 0, F.date_format("o_orderdate", "yyyy/MM/dd"))
    return S.temporal_split(o.select("o_orderkey", text.alias("d")), F.col("d")).groupBy("year", "part").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_group_split")
def stratified_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = rows(spark, sf_dir)
    j = S.attach(li, S.stratified_group_split(li, "part_key", "label", 9), "part_key")
    return S.audit(j.select(F.lit("part").alias("split"), F.col("part_key").alias("key"), "part", "label"))


@query(
    "entity_leakage_audit",
    """WITH r AS (SELECT ['S' || l_suppkey, 'P' || l_partkey] AS e, CASE WHEN l_suppkey % 10 < 7 THEN 'train'
    WHEN l_suppkey % 10 < 8 THEN 'valid' ELSE 'test' END AS part FROM lineitem), x AS (SELECT e, bool_or(part = 'train') AS a,
    bool_or(part = 'valid') AS b, bool_or(part = 'test') AS c FROM (SELECT unnest(e) AS e, part FROM r) GROUP BY e)
    SELECT count(*) AS n_entities, count(*) FILTER (WHERE a::INT + b::INT + c::INT > 1) AS leaking, count(*) FILTER (WHERE a
    AND c) AS train_test, count(*) FILTER (WHERE a::INT + b::INT + c::INT > 1) = 0 AS passed FROM x""",
)
def entity_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.entity_leakage(_by_supplier(spark, sf_dir), F.array("s", "p"))


@query(
    "entity_functions_audit",
    """WITH r AS (SELECT CASE WHEN l_linenumber > 1 THEN ' s' || l_suppkey ELSE '' END AS a, CASE WHEN l_quantity > 3 THEN 'p' || l_partkey END AS b, CASE WHEN l_returnflag = 'N' THEN 'NA'
    ELSE l_linenumber || ' and ' || l_returnflag END AS site, 'o' || l_orderkey || '; ' || l_returnflag AS publication, CASE l_linestatus WHEN 'F' THEN 'train' ELSE 'test' END AS part
    FROM lineitem), k AS (SELECT *, upper(trim(a)) AS x, upper(trim(coalesce(b, ''))) AS y FROM r), e AS (
    SELECT 'pair' AS kind, least(x, y) || '||' || greatest(x, y) AS e, part FROM k WHERE x <> '' OR y <> ''
    UNION ALL SELECT 'modified', x, part FROM k WHERE x <> ''
    UNION ALL SELECT 'site', CASE WHEN x <> '' THEN x || ':' ELSE '' END || unnest(list_distinct(string_split(site, ' and '))), part FROM k WHERE site <> 'NA'
    UNION ALL SELECT 'publication', upper(trim(unnest(string_split(publication, ';')))), part FROM k)
    SELECT kind, count(*) AS n_entities, count(*) FILTER (WHERE parts > 1) AS leaking FROM (SELECT kind, e, count(DISTINCT part) AS parts FROM e GROUP BY ALL) GROUP BY kind""",
)
def entity_functions_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, modified entities, sites and publications of messy cells, between open and finished lines."""
    li = table(spark, sf_dir, "lineitem")
    r = li.select(
        F.when(li.l_linenumber > 1, F.concat(F.lit(" s"), li.l_suppkey)).otherwise("").alias("a"), F.when(li.l_quantity > 3, F.concat(F.lit("p"), li.l_partkey)).alias("b"),
        F.when(li.l_returnflag == "N", "NA").otherwise(F.concat(li.l_linenumber, F.lit(" and "), li.l_returnflag)).alias("site"), F.concat(F.lit("o"), li.l_orderkey, F.lit("; "), li.l_returnflag).alias("publication"),
        F.when(li.l_linestatus == "F", "train").otherwise("test").alias("part"),
    )
    a, b, site = F.col("a"), F.col("b"), F.col("site")
    kinds = {"pair": T.pair_entities(a, b), "modified": T.value_entities(a), "site": T.site_entities(site, a), "publication": T.value_entities(F.col("publication"))}
    long = r.select("part", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("e")) for k, c in kinds.items()])).alias("x")).select("part", "x.kind", F.explode("x.e").alias("e"))
    per = long.groupBy("kind", "e").agg(F.count_distinct("part").alias("parts"))
    return per.groupBy("kind").agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("parts") > 1).alias("leaking"))


@query("split_column", """SELECT event_type AS part, count(*) AS n, 'Sub_Set' AS found FROM (SELECT CASE WHEN event_type = 'view' THEN 'valid' WHEN event_type = 'click' THEN 'train'
    WHEN event_type = 'error' THEN 'test' END AS event_type FROM events) GROUP BY 1""")
def split_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column that holds the split is found by its name and its values: the one named `split` has none that names a part."""
    e = table(spark, sf_dir, "events")
    named = F.when(e.event_type == "view", " Dev").when(e.event_type == "click", "TRAINING").when(e.event_type == "error", "holdout").otherwise(e.event_type)
    rows = e.select(e.user_id.alias("split"), named.alias("Sub_Set"))
    found = T.find_split_column(rows)
    return rows.groupBy(T.split_name(F.col(found)).alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("found", F.lit(found))


@query(
    "leakage_examples",
    """SELECT entity, string_agg(DISTINCT part, ',' ORDER BY part) AS parts, count(*) AS n FROM (SELECT 'P' || l_partkey AS entity,
    CASE WHEN l_suppkey % 10 < 7 THEN 'train' WHEN l_suppkey % 10 < 8 THEN 'valid' ELSE 'test' END AS part FROM lineitem)
    GROUP BY entity HAVING count(DISTINCT part) > 1 ORDER BY entity LIMIT 10""",
)
def leakage_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leakage_examples(_by_supplier(spark, sf_dir), F.array("s", "p"))


def _by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    m = li.l_suppkey % 10
    return li.select(F.concat(F.lit("S"), li.l_suppkey).alias("s"), F.concat(F.lit("P"), li.l_partkey).alias("p"), F.when(m < 7, "train").when(m < 8, "valid").otherwise("test").alias("part"))


@query(
    "shuffled_labels",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS part, o_orderstatus AS label
    FROM orders),
    a AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS rk FROM r),
    b AS (SELECT part, label AS shuffled, row_number() OVER (PARTITION BY part ORDER BY md5('4|' || o_orderkey), o_orderkey) AS rk
    FROM r)
    SELECT o_orderkey, part, label, shuffled FROM a JOIN b USING (part, rk)""",
)
def shuffled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    r = o.select("o_orderkey", F.when(o.o_orderkey % 10 < 7, "train").otherwise("test").alias("part"), o.o_orderstatus.alias("label"))
    return S.shuffled_labels(r, "o_orderkey", "label", "part", 4)


@query(
    "external_overlap",
    """WITH e AS (SELECT l_suppkey AS supplier, l_partkey AS part_key, CASE
    WHEN l_discount > 0.02 THEN l_orderkey END AS publication, l_shipdate, l_returnflag, l_linestatus = 'F' AS label FROM lineitem),
    x AS (SELECT * FROM e WHERE l_returnflag = 'A'), b AS (SELECT * FROM e WHERE l_returnflag <> 'A')
    SELECT count(*) AS row_count, count(*) FILTER (WHERE supplier IN (SELECT supplier FROM b)) AS supplier_overlap,
    count(*) FILTER (WHERE part_key IN (SELECT part_key FROM b)) AS part_key_overlap,
    count(*) FILTER (WHERE publication IN (SELECT publication FROM b WHERE publication IS NOT NULL)) AS publication_overlap,
    count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2000-01-01') AS after_cutoff, count(*) FILTER (WHERE label) AS positives,
    count(*) FILTER (WHERE NOT label) AS negatives FROM x""",
)
def external_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    e = li.select(li.l_suppkey.alias("supplier"), li.l_partkey.alias("part_key"), F.when(li.l_discount > 0.02, li.l_orderkey).alias("publication"), "l_shipdate", "l_returnflag", (li.l_linestatus == "F").alias("label"))
    return S.external_overlap(e.where("l_returnflag = 'A'"), e.where("l_returnflag <> 'A'"), ["supplier", "part_key", "publication"], F.col("l_shipdate") > F.lit("2000-01-01").cast("timestamp"), "label")


@query("key_manifest", """SELECT DISTINCT concat_ws('||', l_suppkey, l_linenumber) AS site_key, least(l_suppkey::VARCHAR,
    l_partkey::VARCHAR) || '||' || greatest(l_suppkey::VARCHAR, l_partkey::VARCHAR) AS pair_key, l_orderkey, l_linestatus
    FROM lineitem""")
def key_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(T.joined_key(li.l_suppkey, li.l_linenumber).alias("site_key"), T.pair_key(li.l_suppkey, li.l_partkey).alias("pair_key"), "l_orderkey", "l_linestatus").distinct()


@query(
    "scored_group_split",
    f"""WITH {PAIRS} SELECT count(*) AS n_rows, count(DISTINCT part_key) AS n_keys, 0 AS keys_in_two_parts, 3 AS parts, true AS sizes_within, true AS rates_within FROM li""",
)
def scored_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of lineitem's part keys by the scored assignment, audited: whole keys, sizes within half of the largest key, positive rates within 2 %."""
    li = rows(spark, sf_dir)
    split = A.scored_group_split(li, "part_key", "label", 9).withColumnRenamed("size", "rows")
    j = li.join(split, "part_key")
    per = j.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("int")).alias("rate"))
    keys = j.groupBy("part_key").agg(F.count_distinct("part").alias("in"), F.count(F.lit(1)).alias("size"))
    whole = keys.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("in") > 1).alias("keys_in_two_parts"), F.max("size").alias("largest"))
    share = F.when(F.col("part") == "train", 0.70).otherwise(0.15)
    rate = li.agg(F.avg(F.col("label").cast("int")).alias("all"), F.count(F.lit(1)).alias("n_rows"))
    x = per.join(F.broadcast(whole)).join(F.broadcast(rate))  # one row each
    return x.agg(
        F.max("n_rows").alias("n_rows"), F.max("n_keys").alias("n_keys"), F.max("keys_in_two_parts").alias("keys_in_two_parts"), F.count(F.lit(1)).alias("parts"),
        F.bool_and(F.abs(F.col("n") - share * F.col("n_rows")) <= 1 + F.col("largest") / 2).alias("sizes_within"), F.bool_and(F.abs(F.col("rate") - F.col("all")) <= 0.02).alias("rates_within"),
    )
