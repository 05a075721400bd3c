"""Queries that map one coordinate system onto another and audit lineage; benchmark items stand inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as Q
from ..operators import joins as J
from ..operators.features import event_contact_signatures
from .base import query, table


def _needles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return n, t


FOUND = """found AS (SELECT item_id AS needle_id, doc_id AS text_id, strpos(d.text, b.text) - 1 AS start FROM benchmark b,
    documents d WHERE contains(d.text, b.text) AND length(b.text) >= 20)"""


@query("containment_map", f"WITH {FOUND} SELECT needle_id, text_id, start FROM found")
def containment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.contained(*_needles(spark, sf_dir))


@query("match_or_keep", f"""WITH {FOUND}, c AS (SELECT needle_id, count(*) AS n FROM found GROUP BY 1) SELECT item_id AS needle_id,
    text_id, start, text_id IS NOT NULL AS mapped, coalesce(n = 1, false) AS is_unique FROM benchmark
    LEFT JOIN found ON needle_id = item_id LEFT JOIN c ON c.needle_id = item_id""")
def match_or_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = _needles(spark, sf_dir)
    return J.match_or_keep(n, J.contained(n, t))


@query("positional_coverage", """WITH t AS (SELECT l_suppkey AS k, l_partkey AS pos, min(l_linenumber) AS token FROM lineitem
    GROUP BY ALL), c AS (SELECT l_orderkey AS crop_id, min(l_suppkey) AS k, min(l_partkey) AS start, 3 + min(l_linenumber) AS size
    FROM lineitem GROUP BY 1), p AS (SELECT crop_id, k, unnest(range(start, start + size)) AS pos FROM c) SELECT crop_id,
    count(*) FILTER (WHERE token IS NULL) AS n_missing, coalesce(string_agg(token::VARCHAR, ',' ORDER BY pos), '') AS ids FROM p
    LEFT JOIN t USING (k, pos) GROUP BY crop_id""")
def positional_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    t = li.groupBy("k", F.col("l_partkey").alias("pos")).agg(F.min("l_linenumber").alias("token"))
    c = li.groupBy(F.col("l_orderkey").alias("crop_id")).agg(F.min("k").alias("k"), F.min("l_partkey").alias("start"), (F.min("l_linenumber") + 3).alias("size"))
    return J.covered(c, t, "k").select("crop_id", "n_missing", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "strict_manifest",
    """WITH r AS (SELECT l_suppkey AS k, min(l_partkey) + 50 AS lo, max(l_partkey) - 50 AS hi FROM lineitem WHERE l_suppkey % 5 <> 0
    GROUP BY 1), x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN lo IS NULL THEN 'no_range'
    WHEN l_partkey < lo THEN 'before' WHEN l_partkey + 20 > hi THEN 'after' WHEN l_quantity < 3 THEN 'low_coverage' END AS why
    FROM lineitem LEFT JOIN r ON k = l_suppkey)
    SELECT coalesce(why, 'kept') AS reason, count(*) AS n, count(DISTINCT l_suppkey) AS entities FROM x GROUP BY 1""",
)
def strict_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    r = li.where("k % 5 <> 0").groupBy("k").agg((F.min("l_partkey") + 50).alias("lo"), (F.max("l_partkey") - 50).alias("hi"))
    x = J.inside(li.withColumn("start", F.col("l_partkey")).withColumn("end", F.col("l_partkey") + 20), r, "k")
    reason = F.when(F.col("status") != "ok", F.col("status")).when(F.col("l_quantity") < 3, "low_coverage").otherwise("kept")
    return x.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("entities"))


CONTACT = """c AS (SELECT 'C' || (l_suppkey % 9) || ':' || upper(left(l_returnflag || 'la', 3)) || l_partkey || CASE
    WHEN l_linenumber = 7 THEN 'bad' ELSE '' END AS s, l_orderkey, l_linenumber FROM lineitem)"""


@query("contact_parse", rf"""WITH {CONTACT} SELECT regexp_extract(s, '^([A-Za-z0-9_]+):([A-Z]{{3}})(-?\d+)', 1) AS chain,
    regexp_extract(s, '^([A-Za-z0-9_]+):([A-Z]{{3}})(-?\d+)', 2) AS residue, count(*) AS n, sum(regexp_extract(s,
    '^([A-Za-z0-9_]+):([A-Z]{{3}})(-?\d+)', 3)::INT)::BIGINT AS sites FROM c GROUP BY 1, 2""")
def contact_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = F.concat(F.lit("C"), li.l_suppkey % 9, F.lit(":"), F.upper(F.left(F.concat("l_returnflag", F.lit("la")), F.lit(3))), li.l_partkey, F.when(li.l_linenumber == 7, "bad").otherwise(""))
    return li.select(Q.contact_site(s).alias("c")).where("c is not null").groupBy("c.chain", "c.residue").agg(F.count(F.lit(1)).alias("n"), F.sum("c.site").alias("sites"))


@query(
    "contact_signatures",
    """WITH e AS (SELECT l_orderkey AS id, l_suppkey AS s, l_partkey AS p, l_linenumber AS o, l_returnflag AS f FROM lineitem
    WHERE l_quantity > 45), t AS (SELECT id, unnest(['M:S' || s || ':' || o, 'P:P' || p || ':' || o, 'REL:' || printf('%+d',
    o - 4) || ':' || f]) AS t FROM e)
    SELECT o_orderkey AS id, coalesce(string_agg(DISTINCT t, '|' ORDER BY t), CASE WHEN o_orderkey % 2 = 0 THEN 'IFACE_NEAR'
    ELSE '' END) AS signature FROM orders LEFT JOIN t ON id = o_orderkey GROUP BY o_orderkey""",
)
def contact_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    rel = li.l_linenumber - 4
    signed = F.concat(F.when(rel >= 0, "+").otherwise(""), rel)
    tokens = F.array(F.concat(F.lit("M:S"), li.l_suppkey, F.lit(":"), li.l_linenumber), F.concat(F.lit("P:P"), li.l_partkey, F.lit(":"), li.l_linenumber), F.concat(F.lit("REL:"), signed, F.lit(":"), li.l_returnflag))
    t = li.select(li.l_orderkey.alias("id"), F.explode(tokens).alias("t")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("t")), "|").alias("s"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(t, "id", "left").select("id", F.coalesce("s", F.when(F.col("id") % 2 == 0, "IFACE_NEAR").otherwise("")).alias("signature"))


@query(
    "chain_signatures",
    """WITH k AS (SELECT *, 'S' || l_suppkey AS s, 'P' || l_partkey AS p, l_quantity::INT AS q FROM lineitem),
    e AS (SELECT l_orderkey AS cx, 'A' AS chain, s AS own, l_linenumber AS pos, l_returnflag AS oc, p AS other, q AS oat, l_linestatus AS t FROM k
    UNION ALL SELECT l_orderkey, l_returnflag, p, q, 'A', s, l_linenumber, l_linestatus FROM k),
    m AS (SELECT l_orderkey || '-' || l_linenumber AS event_id, l_orderkey AS cx, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE l_returnflag END AS chain, CASE WHEN l_linestatus = 'F' THEN s ELSE p END AS own,
    CASE WHEN l_linestatus = 'F' THEN p ELSE s END AS other, l_discount > 0.05 AS few, l_returnflag AS residue, CASE WHEN l_tax > 0.04 THEN l_linenumber END AS distance FROM k),
    j AS (SELECT m.*, e.pos, e.oat, e.t FROM m LEFT JOIN e ON e.cx = m.cx AND e.chain = m.chain AND e.own = m.own AND e.other = m.other AND (NOT few OR e.oc IN ('A', 'R'))),
    x AS (SELECT event_id, cx, chain, own, other, few, residue, distance, count(pos) AS n, list_distinct(flatten(list([ 'M:' || own || ':' || pos, 'P:' || other || ':' || oat, 'REL:' || printf('%+d', pos - 4) || ':' || t,
    'AA:' || residue || ':' || t]) FILTER (WHERE pos IS NOT NULL))) AS t FROM j GROUP BY ALL),
    y AS (SELECT *, CASE WHEN n > 0 THEN list_sort(t) WHEN distance IS NOT NULL THEN ['IFACE_NEAR:' || own || ':' || distance] ELSE [] END AS tokens FROM x)
    SELECT event_id, cx AS complex_id, chain AS modified_chain, array_to_string(tokens, '|') AS signature_tokens, len(tokens)::BIGINT AS signature_size, n AS mapped_contact_count FROM y""",
)
def chain_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of each line as an event on a chain of its order, whose lines are the contacts."""
    li = table(spark, sf_dir, "lineitem")
    s, p, f = F.concat(F.lit("S"), li.l_suppkey), F.concat(F.lit("P"), li.l_partkey), li.l_linestatus == "F"
    contacts = li.select(li.l_orderkey.alias("complex_id"), F.lit("A").alias("chain_a"), s.alias("entity_a"), li.l_linenumber.alias("site_a"), li.l_returnflag.alias("chain_b"), p.alias("entity_b"), li.l_quantity.cast("int").alias("site_b"), li.l_linestatus.alias("contact_type"))
    mapping = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), li.l_orderkey.alias("complex_id"), F.when(f, "A").otherwise(li.l_returnflag).alias("modified_chain"), F.when(f, s).otherwise(p).alias("modified"),
        F.when(f, p).otherwise(s).alias("partner"), F.when(li.l_discount > 0.05, " A, R,").alias("partner_chains"), F.lit(4).alias("position"), li.l_returnflag.alias("residue"), F.when(li.l_tax > 0.04, li.l_linenumber).alias("distance"),
    )
    return event_contact_signatures(mapping, contacts)


@query(
    "pair_list_remap",
    """WITH p AS (SELECT l_orderkey AS id, l_linenumber AS i, (l_partkey % 40)::INT AS j FROM lineitem), k AS (SELECT DISTINCT id,
    i - 2 AS i, j - 5 AS j FROM p WHERE i - 2 BETWEEN 0 AND 3 AND j - 5 BETWEEN 0 AND 19)
    SELECT o_orderkey AS id, coalesce(string_agg(i || ':' || j, ';' ORDER BY i, j), '') AS pairs
    FROM (SELECT DISTINCT id AS o_orderkey FROM p) LEFT JOIN k ON id = o_orderkey GROUP BY 1""",
)
def pair_list_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    text = li.groupBy(li.l_orderkey.alias("id")).agg(F.array_join(F.collect_list(F.concat("l_linenumber", F.lit(":"), F.col("l_partkey") % 40)), ";").alias("t"))
    moved = Q.remap_pairs(Q.parse_pairs(F.concat("t", F.lit(";x:y"))), F.lit(2), F.lit(5), F.lit(4), F.lit(20))
    return text.select("id", Q.format_pairs(F.array_sort(moved)).alias("pairs"))


@query(
    "lineage_audit",
    """WITH b AS (SELECT DISTINCT l_suppkey AS acc, l_linenumber AS pos, l_returnflag AS res FROM lineitem WHERE l_linestatus = 'F'),
    o AS (SELECT DISTINCT l_suppkey AS acc, l_linenumber - 1 AS pos, l_returnflag AS res FROM lineitem WHERE l_linestatus <> 'F')
    SELECT count(*) AS row_count, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b WHERE b.acc = o.acc AND b.pos = o.pos
    AND b.res = o.res)) AS same_position, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b WHERE b.acc = o.acc AND b.pos = o.pos + 1
    AND b.res = o.res)) AS next_position FROM o""",
)
def lineage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    b = li.where("l_linestatus = 'F'").select(li.l_suppkey.alias("acc"), li.l_linenumber.alias("pos"), li.l_returnflag.alias("res")).distinct()
    o = li.where("l_linestatus <> 'F'").select(li.l_suppkey.alias("acc"), (li.l_linenumber - 1).alias("pos"), li.l_returnflag.alias("res")).distinct()
    same = b.withColumn("same", F.lit(1))
    shifted = b.select("acc", (F.col("pos") - 1).alias("pos"), "res", F.lit(1).alias("next"))
    j = o.join(same, ["acc", "pos", "res"], "left").join(shifted, ["acc", "pos", "res"], "left")
    return j.agg(F.count(F.lit(1)).alias("row_count"), F.count("same").alias("same_position"), F.count("next").alias("next_position"))


@query(
    "null_enrichment",
    """WITH s AS (SELECT DISTINCT l_suppkey AS chain, l_partkey AS site, l_returnflag AS res FROM lineitem),
    i AS (SELECT DISTINCT l_suppkey AS chain, l_partkey AS site FROM lineitem WHERE l_quantity > 40),
    e AS (SELECT DISTINCT l_suppkey AS chain, l_partkey AS site, l_returnflag AS res, l_linestatus AS label FROM lineitem),
    n AS (SELECT s.chain, s.res, count(*) AS total, count(i.site) AS hits FROM s LEFT JOIN i USING (chain, site) GROUP BY ALL),
    x AS (SELECT label, (i.site IS NOT NULL)::INT AS hit, hits / total AS expected FROM e JOIN n USING (chain, res)
    LEFT JOIN i USING (chain, site))
    SELECT coalesce(label, 'all') AS label, count(*) AS n, sum(hit)::BIGINT AS observed, round(sum(expected), 6) AS expected,
    round(sum(hit) / sum(expected), 6) AS ratio FROM x GROUP BY ROLLUP (label)""",
)
def null_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import overall_and_by

    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chain"), F.col("l_partkey").alias("site"), F.col("l_returnflag").alias("res"), F.col("l_linestatus").alias("label"), "l_quantity", "l_orderkey")
    i = li.where("l_quantity > 40").select("chain", "site").distinct().withColumn("hit", F.lit(1))
    n = li.select("chain", "site", "res").distinct().join(i, ["chain", "site"], "left").groupBy("chain", "res").agg((F.count("hit") / F.count(F.lit(1))).alias("rate"))
    e = li.select("chain", "site", "res", "label").distinct()
    x = e.join(n, ["chain", "res"]).join(i, ["chain", "site"], "left").fillna(0, ["hit"])
    return overall_and_by(x, "label", F.count(F.lit(1)).alias("n"), F.sum("hit").alias("observed"), F.round(F.sum("rate"), 6).alias("expected"), F.round(F.sum("hit") / F.sum("rate"), 6).alias("ratio"))


@query(
    "matched_distances",
    """WITH s AS (SELECT DISTINCT l_suppkey AS chain, l_partkey AS site, l_returnflag AS res FROM lineitem),
    i AS (SELECT DISTINCT l_suppkey AS chain, l_partkey AS site FROM lineitem WHERE l_quantity > 47 AND l_suppkey % 10 > 0),
    d AS (SELECT s.chain, s.site, s.res, least(s.site - b.site, a.site - s.site) AS away FROM s ASOF
    LEFT JOIN i b ON b.chain = s.chain AND b.site <= s.site ASOF LEFT JOIN i a ON a.chain = s.chain AND a.site >= s.site),
    n AS (SELECT chain, res, avg((coalesce(away, -1) = 0)::INT) AS rate, avg(away) AS mean_away FROM d GROUP BY ALL),
    e AS (SELECT l_orderkey AS event, l_linestatus AS label, l_suppkey AS chain, l_partkey AS site, l_returnflag AS res
    FROM lineitem),
    p AS (SELECT event, min(label) AS label, max((coalesce(away, -1) = 0)::INT) AS hit, min(away) AS away, avg(rate) AS rate,
    avg(mean_away) AS mean_away FROM e JOIN d USING (chain, site, res) JOIN n USING (chain, res) GROUP BY event)
    SELECT coalesce(label, 'all') AS label, count(*) AS n, round(avg(hit), 6) AS actual, round(avg(rate), 6) AS expected,
    round(avg(hit) / nullif(avg(rate), 0), 6) AS ratio, round(avg(away), 6) AS distance, round(avg(mean_away),
    6) AS null_distance, round(avg(away) / nullif(avg(mean_away), 0), 6) AS distance_ratio FROM p GROUP BY ROLLUP (label)""",
)
def matched_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reports import matched_distances as matched

    li = table(spark, sf_dir, "lineitem")
    rows = li.select(li.l_orderkey.alias("event"), li.l_linestatus.alias("label"), li.l_suppkey.alias("chain"), li.l_partkey.alias("site"), li.l_returnflag.alias("res"))
    return matched(rows.select("chain", "site", "res"), li.where("l_quantity > 47 and l_suppkey % 10 > 0").select(li.l_suppkey.alias("chain"), li.l_partkey.alias("site")), rows)
