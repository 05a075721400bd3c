"""Queries on normalised evidence: suppliers play modified entities, parts partners, orders publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contracts as C
from ..operators import evidence as E
from .base import query, table

HEX, LETTERS = "0123456789abcdef", "ACDEFGHIKLMNPQRS"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as raw evidence, every cell a string."""
    li = table(spark, sf_dir, "lineitem")
    k = T.joined_key(li.l_orderkey, li.l_linenumber, li.l_partkey, li.l_suppkey)
    h = F.md5(k)
    return li.select(
        k.alias("row_key"),
        F.when(~h.startswith("00"), F.concat(F.lit("S"), li.l_suppkey)).alias("modified"),
        F.concat(F.lit("P"), li.l_partkey).alias("partner"),
        F.when(h.startswith("0"), "").when(h.startswith("1"), "XX").otherwise(F.translate(F.substring(h, 2, 1), HEX, LETTERS)).alias("residue"),
        F.when(h.startswith("2"), "x").when(h.startswith("3"), "99").otherwise(li.l_linenumber.cast("string")).alias("position"),
        F.concat(F.lit(" "), li.l_returnflag, F.lit("; "), li.l_linestatus).alias("kinds"),
        li.l_returnflag.alias("kind"),
        li.l_linestatus.alias("label"),
        li.l_orderkey.cast("string").alias("publication"),
    )


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.where("s_suppkey % 17 <> 0").select(F.concat(F.lit("S"), s.s_suppkey).alias("accession"), F.translate(F.md5(s.s_name), HEX, LETTERS).alias("sequence"))


EV = """ev AS (
  SELECT k AS row_key, CASE WHEN h NOT LIKE '00%' THEN concat('S', l_suppkey) END AS modified, concat('P', l_partkey) AS partner,
         CASE WHEN h LIKE '0%' THEN '' WHEN h LIKE '1%' THEN 'XX' ELSE translate(substr(h, 2, 1), '0123456789abcdef',
         'ACDEFGHIKLMNPQRS') END AS residue,
         CASE WHEN h LIKE '2%' THEN 'x' WHEN h LIKE '3%' THEN '99' ELSE l_linenumber::VARCHAR END AS position,
         concat(' ', l_returnflag, '; ', l_linestatus) AS kinds, l_returnflag AS kind, l_linestatus AS label,
         l_orderkey::VARCHAR AS publication
  FROM (SELECT *, md5(k) AS h FROM (SELECT *, concat_ws('||', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem))
), store AS (
  SELECT concat('S', s_suppkey) AS accession, translate(md5(s_name), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS sequence
  FROM supplier WHERE s_suppkey % 17 <> 0
), clean AS (
  SELECT * REPLACE (CASE WHEN residue = '' THEN NULL ELSE residue END AS residue), try_cast(position AS INT) AS pos FROM ev
  LEFT JOIN store ON modified = accession
), checked AS (
  SELECT *, list_filter([
    CASE WHEN modified IS NULL THEN 'missing_id' END,
    CASE WHEN residue IS NULL THEN 'missing_residue' END,
    CASE WHEN residue IS NOT NULL AND NOT (length(residue) = 1 AND contains('ACDEFGHIKLMNPQRSTVWY',
    residue)) THEN 'invalid_residue' END,
    CASE WHEN pos IS NULL THEN 'invalid_position' END,
    CASE WHEN sequence IS NULL THEN 'missing_sequence' END,
    CASE WHEN sequence IS NOT NULL AND pos <> 0 AND NOT (pos BETWEEN 1 AND length(sequence)) THEN 'position_out_of_range' END,
    CASE WHEN sequence IS NOT NULL AND pos BETWEEN 1 AND length(sequence) AND residue IS NOT NULL AND substr(sequence, pos,
    1) <> residue THEN 'residue_mismatch' END], lambda x: x IS NOT NULL) AS reasons
  FROM clean
)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evidence(spark, sf_dir).withColumn("residue", T.clean_text(F.col("residue")))
    return E.validate(ev, store(spark, sf_dir), "modified", "residue", "position")


@query("normalize_validate", f"""WITH {EV} SELECT row_key, modified, residue, pos AS position, len(reasons) = 0 AS valid,
    array_to_string(reasons, ';') AS reasons FROM checked""")
def normalize_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checked(spark, sf_dir)
    return c.select("row_key", "modified", "residue", T.lenient_int(F.col("position")).alias("position"), (F.size("reasons") == 0).alias("valid"), F.array_join("reasons", ";").alias("reasons"))


@query("quarantine_reasons", f"WITH {EV} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM checked) GROUP BY reason")
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reason_counts(checked(spark, sf_dir))


@query("quarantine_rows", f"""WITH {EV} SELECT row_key, array_to_string(reasons, ';') AS reasons, CASE
    WHEN pos >= 1 THEN nullif(substr(sequence, pos, 1), '') END AS found_residue FROM checked WHERE len(reasons) > 0""")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.route(checked(spark, sf_dir))[1].select("row_key", "reasons", "found_residue")


@query(
    "filter_funnel",
    f"""WITH {EV}, f AS (SELECT *, label = 'F' AS a, label = 'F' AND sequence IS NOT NULL AS b, label = 'F' AND sequence IS NOT NULL
    AND coalesce(substr(sequence, pos, 1) = residue, false) AS c FROM checked)
    SELECT count(*) AS rows_in, count(*) FILTER (WHERE a) AS labelled, count(*) FILTER (WHERE b) AS with_sequence,
    count(*) FILTER (WHERE c) AS matching,
           count(DISTINCT CASE WHEN c THEN modified END) AS entities, count(DISTINCT CASE WHEN c THEN least(modified,
           partner) || '||' || greatest(modified, partner) END) AS pairs, count(DISTINCT CASE
           WHEN c THEN publication END) AS publications FROM f""",
)
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = {"labelled": F.col("label") == "F", "with_sequence": F.col("sequence").isNotNull(), "matching": F.substring("sequence", T.lenient_int(F.col("position")), F.lit(1)) == F.col("residue")}
    keys = {"entities": F.col("modified"), "pairs": T.pair_key(F.col("modified"), F.col("partner")), "publications": F.col("publication")}
    return E.funnel(checked(spark, sf_dir), stages, keys)


@query("dedup_first", """SELECT l_suppkey, l_partkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *,
    row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)
    WHERE rn = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")
    return E.first_of_each(li, ["l_suppkey", "l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber"])


@query("derive_keys", f"""WITH {EV} SELECT row_key, least(modified, partner) || '||' || greatest(modified, partner) AS pair_key,
    concat_ws('||', modified, position, kind) AS site_key, concat_ws('||', modified, partner) AS directed_key FROM ev
    WHERE modified IS NOT NULL""")
def derive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir).where("modified is not null")
    m, p = F.col("modified"), F.col("partner")
    return e.select("row_key", T.pair_key(m, p).alias("pair_key"), T.joined_key(m, F.col("position"), F.col("kind")).alias("site_key"), T.joined_key(m, p).alias("directed_key"))


@query("tokenize_entities", f"""WITH {EV} SELECT token, count(*) AS n, count(DISTINCT row_key) AS row_count FROM (SELECT row_key,
    upper(trim(unnest(regexp_split_to_array(kinds || ' and NA|' || partner, '[;,|]|\\band\\b')))) AS token FROM ev)
    WHERE token NOT IN ('', 'NA', 'NAN', 'NONE', 'NULL') GROUP BY token""")
def tokenize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir).select("row_key", F.explode(T.tokens(F.concat("kinds", F.lit(" and NA|"), "partner"))).alias("token"))
    return e.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_key").alias("row_count"))


#: (pattern, family) in order of precedence.
METHODS = (("widget", "screen"), ("^small|^red", "pulldown"), (r"gear\b", "spectrum"), ("o.*l", "array"))


@query("regex_classify", r"""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%widget%' THEN 'screen'
    WHEN regexp_matches(lower(p_name), '^small|^red') THEN 'pulldown' WHEN regexp_matches(lower(p_name), 'gear\b') THEN 'spectrum'
    WHEN regexp_matches(lower(p_name), 'o.*l') THEN 'array' ELSE 'other' END AS family FROM part""")
def regex_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.first_match(p.p_name, METHODS).alias("family"))


@query(
    "rule_label_ratio",
    """WITH r AS (SELECT round(log2(l_quantity / 15), 9) AS ratio, l_returnflag = 'R' AS p, l_returnflag = 'A'
    OR l_discount > 0.08 AS w, l_tax > 0.04 AS m FROM lineitem)
    SELECT effect, why, count(*) AS n FROM (SELECT
      CASE WHEN ratio <= -1 THEN 'enhance' WHEN ratio >= 1 THEN 'inhibit' WHEN p AND NOT w AND NOT m THEN 'enhance' WHEN w
      AND NOT p THEN 'inhibit' END AS effect,
      CASE WHEN ratio <= -1 AND p THEN 'ratio and modified flag' WHEN ratio >= 1 AND w THEN 'ratio and unmodified flag'
      WHEN ratio <= -1 OR ratio >= 1 THEN 'ratio alone' WHEN p AND NOT w AND NOT m THEN 'modified flag alone' WHEN w
      AND NOT p THEN 'unmodified flag alone' ELSE 'ambiguous' END AS why FROM r) GROUP BY ALL""",
)
def rule_label_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    e = T.signed_effect(F.round(F.log2(li.l_quantity / 15), 9), li.l_returnflag == "R", (li.l_returnflag == "A") | (li.l_discount > 0.08), li.l_tax > 0.04)
    return li.select(e.alias("e")).groupBy("e.effect", "e.why").agg(F.count(F.lit(1)).alias("n"))


@query("year_parse", r"""SELECT y AS year, count(*) AS n, min(d) AS first_date, max(d) AS last_date
    FROM (SELECT nullif(regexp_extract(s, '(19|20)\d{2}', 0), '')::INT AS y, replace(substr(s, 1, 10), '/', '-') AS d
    FROM (SELECT strftime(o_orderdate, '%Y/%m/%d') || ' issue ' || o_orderkey AS s FROM orders)) GROUP BY y""")
def year_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" issue "), o.o_orderkey.cast("string"))
    return o.select(T.year_of(s).alias("year"), T.slashed_date(s).alias("d")).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_date"), F.max("d").alias("last_date"))


@query("alias_resolve", "SELECT c_custkey::VARCHAR AS accession, c_mktsegment AS label, NULL::VARCHAR AS disease FROM customer")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.resolve_columns(table(spark, sf_dir, "customer"), {"accession": ["uniprot", "C CustKey"], "label": ["effect", "c_MktSegment"], "disease": ["phenotype"]})
    return c.withColumn("accession", F.col("accession").cast("string"))


@query(
    "class_guard",
    """WITH s AS (SELECT o_orderpriority AS split, o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS part,
    o_orderstatus AS label FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderkey % 10 >= 7 AND o_orderstatus <> 'F')),
    g AS (SELECT split FROM s GROUP BY split HAVING count(*) FILTER (WHERE part = 'test') >= 25 AND count(DISTINCT CASE
    WHEN part = 'test' THEN label END) > 1 AND count(DISTINCT CASE WHEN part = 'train' THEN label END) > 1)
    SELECT split, part, count(*) AS n FROM s WHERE split IN (SELECT split FROM g) GROUP BY ALL""",
)
def class_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = o.select(o.o_orderpriority.alias("split"), F.when(o.o_orderkey % 10 < 7, "train").otherwise("test").alias("part"), o.o_orderstatus.alias("label"))
    s = s.where(~((F.col("split") == "5-LOW") & (F.col("part") == "test") & (F.col("label") != "F")))
    return E.class_guard(s, "split", "part", "label").groupBy("split", "part").agg(F.count(F.lit(1)).alias("n"))


@query("strict_lookup", "SELECT n_regionkey, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return E.strict_lookup(table(spark, sf_dir, "nation"), r, "n_regionkey").groupBy("n_regionkey", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "schema_contract",
    """WITH e AS (SELECT event_id AS id, CASE WHEN user_id % 50 <> 0 THEN user_id::VARCHAR END AS user, event_type FROM events)
    SELECT id, 'user' AS "column", 'missing' AS violation FROM e WHERE user IS NULL UNION ALL SELECT id, 'event_type',
    'not allowed' FROM e WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')""",
)
def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(e.user_id % 50 != 0, e.user_id.cast("string")).alias("user"), "event_type")
    return E.contract_violations(rows, "event_id", ["user"], {"event_type": ["view", "click", "purchase", "signup"]})


@query("conflict_collapse", """SELECT pair, count(*) AS n, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS labels
    FROM (SELECT least(l_suppkey::VARCHAR, l_partkey::VARCHAR) || '||' || greatest(l_suppkey::VARCHAR,
    l_partkey::VARCHAR) AS pair, l_linestatus FROM lineitem) GROUP BY pair HAVING count(DISTINCT l_linestatus) > 1""")
def conflict_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return E.conflicts(li.select(T.pair_key(li.l_suppkey, li.l_partkey).alias("pair"), "l_linestatus"), "pair", "l_linestatus")


@query(
    "evidence_tier",
    """WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n, bool_or(l_returnflag = 'R') AS direct,
    bool_or(l_orderkey % 100 = 0) AS overlap FROM lineitem GROUP BY ALL)
    SELECT CASE WHEN overlap THEN 'excluded' WHEN direct AND n > 1 THEN 'tier1' WHEN direct THEN 'tier2' ELSE 'tier3' END AS tier,
    count(*) AS pairs, sum(n)::BIGINT AS row_count FROM c GROUP BY 1""",
)
def evidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    c = li.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(li.l_returnflag == "R").alias("direct"), F.bool_or(li.l_orderkey % 100 == 0).alias("overlap"))
    return c.groupBy(E.evidence_tier(F.col("direct"), F.col("n") > 1, F.col("overlap")).alias("tier")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("row_count"))


@query("canonical_labels", """SELECT event_type, CASE event_type WHEN 'purchase' THEN 'enhance' WHEN 'error' THEN 'inhibit'
    WHEN 'signup' THEN 'enhance' END AS label, count(*) AS n, CASE event_type WHEN 'purchase' THEN true WHEN 'signup' THEN true
    WHEN 'error' THEN false END AS positive FROM events GROUP BY ALL""")
def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    label = T.canonical(e.event_type, {"Purchase": "enhance", "ERROR": "inhibit", "signup": "enhance"}, keep_unknown=False)
    return e.select("event_type", label.alias("label")).groupBy("event_type", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("positive", T.positive_label(F.col("label")))


# Fields of the two evidence contracts, what they require, and their types.
SIGNED_CONTRACT = (
    ("source", "yes", "string"), ("source_record_id", "no", "string"), ("source_url", "no", "string"), ("modified_uniprot", "yes", "string"), ("modified_gene", "no", "string"),
    ("partner_uniprot", "yes", "string"), ("partner_gene", "no", "string"), ("organism", "no", "string"), ("ptm_type", "yes", "string"), ("residue", "yes", "string"), ("position", "yes", "integer"),
    ("effect_label", "yes_for_signed", "string"), ("source_effect_label", "no", "string"), ("pmid", "yes", "string"), ("publication_date", "yes_for_temporal", "date"),
    ("detection_method", "no", "string"), ("disease", "no", "string"), ("evidence_score", "no", "float"), ("evidence_direction_basis", "yes_for_signed", "string"), ("row_key", "yes", "string"),
    ("site_key", "yes", "string"), ("pair_key", "yes", "string"), ("inclusion_tier", "yes", "string"), ("adjudication_status", "yes", "string"),
)
NO_EFFECT_CONTRACT = (
    "modified_uniprot modified_gene partner_uniprot partner_gene organism ptm_type residue position effect_label assay_type perturbation pmid publication_date source evidence_sentence "
    "curator curation_confidence notes"
).split()
ALLOWED = {"ptm_type": "Phos|Ac|Ub", "effect_label": "enhance|inhibit", "inclusion_tier": "Tier1_signed_prospective|Tier2_signed_independent|Tier3_support_only|excluded"}
PATTERNS = {"residue": "[ACDEFGHIKLMNPQRSTVWY]", "pair_key": r".+\|\|.+"}


def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as rows that claim to follow the contract of signed evidence; some cells don't."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "left")
    signed = F.col("l_returnflag") != "N"
    return j.select(
        T.joined_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("row_key"), F.col("o_orderpriority").alias("source"), F.concat(F.lit("S"), "l_suppkey").alias("modified_uniprot"), F.concat(F.lit("P"), "l_partkey").alias("partner_uniprot"),
        F.coalesce(F.when(F.col("l_linenumber") < 6, F.get(F.array(*map(F.lit, ("Phos", "Ac", "Me", "Ub"))), F.col("l_linenumber") % 4)), F.lit(" ")).alias("ptm_type"),
        F.translate(F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 1), HEX, "ACDEFGHIKLMNOPQB").alias("residue"), F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("int").cast("string")).otherwise(F.col("l_quantity").cast("string")).alias("position"),
        F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "A", "enhance").otherwise("none")).alias("effect_label"), F.col("l_orderkey").alias("pmid"),
        F.when(F.col("l_discount") > 0.02, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.when(F.col("l_discount") > 0.01, F.date_format("l_shipdate", "yyyy/MM"))).alias("publication_date"),
        F.col("l_tax").alias("evidence_score"), F.concat_ws("||", "l_suppkey", F.nullif("o_orderstatus", F.lit("P"))).alias("pair_key"), F.lit("Tier1_signed_prospective").alias("inclusion_tier"), F.lit("included").alias("adjudication_status"),
        signed.alias("is_signed"), (F.col("l_discount") > 0.015).alias("is_temporal"),
    )


def signed_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, r, t, ALLOWED.get(f, ""), PATTERNS.get(f, "")) for f, r, t in SIGNED_CONTRACT], "field string, required string, type string, allowed string, pattern string")


_CONTRACT_ROWS = f"""c AS (SELECT concat_ws('||', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key, o_orderpriority AS source, CASE WHEN l_linenumber < 6
    THEN ['Phos', 'Ac', 'Me', 'Ub'][l_linenumber % 4 + 1] END AS ptm_type, translate(substr(md5(l_partkey::VARCHAR), 1, 1), '{HEX}', 'ACDEFGHIKLMNOPQB') AS residue,
    CASE WHEN l_quantity > 5 THEN l_quantity::INT::VARCHAR ELSE l_quantity::VARCHAR END AS position, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'A' THEN 'enhance' ELSE 'none' END END AS effect_label,
    CASE WHEN l_discount > 0.02 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN l_discount > 0.01 THEN strftime(l_shipdate, '%Y/%m') END AS publication_date,
    concat_ws('||', l_suppkey, nullif(o_orderstatus, 'P')) AS pair_key, l_returnflag <> 'N' AS signed, l_discount > 0.015 AS temporal FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "contract_report",
    f"""WITH {_CONTRACT_ROWS}, v AS (SELECT unnest([
      CASE WHEN source IS NULL THEN 'source: missing' END, CASE WHEN ptm_type IS NULL THEN 'ptm_type: missing' WHEN ptm_type NOT IN ('Phos', 'Ac', 'Ub') THEN 'ptm_type: not allowed' END,
      CASE WHEN NOT regexp_full_match(residue, '[ACDEFGHIKLMNPQRSTVWY]') THEN 'residue: pattern' END, CASE WHEN NOT regexp_full_match(position, '[+-]?[0-9]+') THEN 'position: not integer' END,
      CASE WHEN signed AND effect_label IS NULL THEN 'effect_label: missing' WHEN effect_label NOT IN ('enhance', 'inhibit') THEN 'effect_label: not allowed' END,
      CASE WHEN temporal AND publication_date IS NULL THEN 'publication_date: missing' WHEN NOT regexp_full_match(publication_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'publication_date: not date' END,
      CASE WHEN signed THEN 'evidence_direction_basis: no column' END, 'site_key: no column', CASE WHEN pair_key NOT LIKE '%_||_%' THEN 'pair_key: pattern' END]) AS v FROM c)
    SELECT split_part(v, ': ', 1) AS field, split_part(v, ': ', 2) AS violation, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL""",
)
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each rule of the contract of signed evidence."""
    rows = contract_rows(spark, sf_dir)
    found = C.violations(rows, "row_key", signed_rules(spark), {"signed": F.col("is_signed"), "temporal": F.col("is_temporal")})
    return found.groupBy("field", "violation").agg(F.count(F.lit(1)).alias("n"))


@query("no_effect_contract", f"""WITH {_CONTRACT_ROWS} SELECT field, violation, (SELECT count(*) FROM c)::BIGINT AS n FROM (VALUES {', '.join(f"('{f}', 'no column')" for f in NO_EFFECT_CONTRACT
    if f not in ('modified_uniprot', 'partner_uniprot', 'ptm_type', 'residue', 'position', 'effect_label', 'pmid', 'publication_date', 'source'))}) AS t(field, violation)
    UNION ALL SELECT 'effect_label', 'missing', count(*) FROM c WHERE effect_label IS NULL UNION ALL SELECT 'effect_label', 'not allowed', count(*) FROM c WHERE effect_label IS NOT NULL
    UNION ALL SELECT 'publication_date', 'missing', count(*) FROM c WHERE publication_date IS NULL UNION ALL SELECT 'ptm_type', 'missing', count(*) FROM c WHERE ptm_type IS NULL""")
def no_effect_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of evidence without effect, on rows that were made for the other one."""
    rules = spark.createDataFrame([(f, "True", "no_effect" if f == "effect_label" else "") for f in NO_EFFECT_CONTRACT], "field string, required string, allowed string")
    found = C.violations(contract_rows(spark, sf_dir).drop("is_signed", "is_temporal"), "row_key", rules)
    return found.groupBy("field", "violation").agg(F.count(F.lit(1)).alias("n"))
