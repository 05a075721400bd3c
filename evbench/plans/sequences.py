"""Queries on sequences, sketches and similarity; documents, cleaned to the alphabet, play sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as Q
from ..operators import features as X
from ..operators import similarity as M
from .base import query, table

CLEAN = "regexp_replace(regexp_replace(upper(replace({c}, 'ß', 'ss')), '[^A-Z]', '', 'g'), '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g')"
SEQ = f"seq AS (SELECT item_id AS id, {CLEAN.format(c='text')} AS s FROM benchmark)"
DOC = f"seq AS (SELECT doc_id AS id, {CLEAN.format(c='text')} AS s FROM documents)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(d.doc_id.alias("id"), Q.clean_sequence(d.text).alias("s"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(b.item_id.alias("id"), Q.clean_sequence(b.text).alias("s"))


@query("seq_window", f"""WITH {DOC} SELECT id, p AS pos, CASE WHEN p BETWEEN 1 AND length(s) THEN substr(s, greatest(1, p - 15)::INT,
    (least(length(s), p + 15) - greatest(1, p - 15) + 1)::INT) ELSE '' END AS w FROM (SELECT *, (id * 37 % 2500)::INT AS p
    FROM seq)""")
def seq_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("pos", (F.col("id") * 37 % 2500).cast("int"))
    return d.select("id", "pos", Q.window_around(F.col("s"), F.col("pos")).alias("w"))


@query("seq_crop", f"""WITH {DOC}, c AS (SELECT id, s, (id % length(s) + 1)::INT AS p, greatest(0, least((id % length(s))::INT - 64,
    length(s) - 128))::INT AS st FROM seq WHERE length(s) > 0) SELECT id, substr(s, st + 1, 128) AS crop, st AS start,
    p - 1 - st AS at FROM c""")
def seq_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where(F.length("s") > 0)
    return d.select("id", Q.crop_around(F.col("s"), (F.col("id") % F.length("s") + 1).cast("int"), 128).alias("c")).select("id", "c.*")


@query("crop_median", f"""WITH {DOC}, c AS (SELECT id, s, CASE WHEN id % 3 = 0 THEN length(s) // 2 + 1
    ELSE list_sort(list_distinct([(id % 50 + 1)::INT, (id % 90 + 7)::INT, (id % 50 + 1)::INT,
    400]))[len(list_distinct([(id % 50 + 1)::INT, (id % 90 + 7)::INT, (id % 50 + 1)::INT, 400])) // 2 + 1] END::INT AS m FROM seq)
    SELECT id, substr(s, greatest(0, least(m - 1 - 50, length(s) - 100))::INT + 1, 100) AS crop, greatest(0, least(m - 1 - 50,
    length(s) - 100))::INT AS start FROM c""")
def crop_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    places = F.when(i % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((i % 50 + 1).cast("int"), (i % 90 + 7).cast("int"), (i % 50 + 1).cast("int"), F.lit(400)))
    return docs(spark, sf_dir).select("id", Q.crop_around_median(F.col("s"), places, 100).alias("c")).select("id", "c.*")


@query("head_tail_clip", f"WITH {DOC} SELECT id, CASE WHEN length(s) <= 301 THEN s ELSE left(s, 150) || right(s, 151) END AS clipped FROM seq")
def head_tail_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("id", Q.head_and_tail(F.col("s"), 301).alias("clipped"))


GRAMS = "grams AS (SELECT DISTINCT id, substr(s, i, {k}) AS g FROM (SELECT id, s, unnest(range(1, length(s) - {k} + 2)) AS i FROM seq))"


@query("kmer_set", f"WITH {SEQ}, {GRAMS.format(k=3)} SELECT id, count(*) AS n, string_agg(g, ',' ORDER BY g) AS kmers FROM grams GROUP BY id")
def kmer_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = Q.kmers(F.col("s"), 3)
    return items(spark, sf_dir).where(F.length("s") >= 3).select("id", F.size(k).cast("long").alias("n"), F.array_join(F.array_sort(k), ",").alias("kmers"))


@query("kmer_sketch", f"""WITH {SEQ}, {GRAMS.format(k=3)}, h AS (SELECT DISTINCT id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h
    FROM grams), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h) AS r FROM h) SELECT id, string_agg(h::VARCHAR, ','
    ORDER BY h) AS sketch FROM r WHERE r <= 64 GROUP BY id""")
def kmer_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = items(spark, sf_dir).where(F.length("s") >= 3)
    return s.select("id", F.array_join(F.transform(Q.sketch(F.col("s")), lambda x: x.cast("string")), ",").alias("sketch"))


GROUPS = {"aliphatic": "AILMV", "aromatic": "FWY", "basic": "KRH", "acidic": "DE", "polar": "STNQ", "cysteine": "C"}


@query("composition", f"""WITH {DOC} SELECT id, length(s) AS n,
    {', '.join(f'''CASE WHEN length(s) > 0 THEN round((length(s) - length(regexp_replace(s, '[{g}]', '', 'g'))) / length(s), 9) ELSE 0 END AS {k}''' for k, g in GROUPS.items())},
    round(ln(1 + length(s)), 9) AS log_n FROM seq""")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return docs(spark, sf_dir).select("id", F.length(s).cast("long").alias("n"), *[F.round(Q.letter_share(s, g), 9).alias(k) for k, g in GROUPS.items()], F.round(F.log1p(F.length(s).cast("double")), 9).alias("log_n"))


@query("local_cluster_key", f"""WITH {SEQ}, w AS (SELECT id, left(s, 31) AS s FROM seq), g AS (SELECT DISTINCT id, substr(s, i,
    2) AS g FROM (SELECT id, s, unnest(range(1, length(s))) AS i FROM w)) SELECT id,
    'motif' || (id % 3) || '|' || left(md5(string_agg(g, '' ORDER BY g)), 8) AS key FROM g GROUP BY id""")
def local_cluster_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", Q.local_key(F.left("s", F.lit(31)), F.concat(F.lit("motif"), F.col("id") % 3)).alias("key"))


@query(
    "hashed_kmer_vector",
    f"""WITH {SEQ}, g AS (SELECT id, substr(s, unnest(range(1, length(s) - 1)), 3) AS m FROM seq), v AS (SELECT id,
    ('0x' || substr(md5('mod' || m), 1, 8))::BIGINT % 32 AS bucket, sum(1 - 2 * (('0x' || substr(md5('mod' || m), 9,
    2))::BIGINT % 2)) AS v FROM g GROUP BY ALL HAVING v <> 0) SELECT id, bucket,
    round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 9) AS value FROM v""",
)
def hashed_kmer_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.hashed_kmer_counts(items(spark, sf_dir), "id", F.col("s"), 3, 32, "mod").withColumn("value", F.round("value", 9))


#: DuckDB: pairs of `sets` (id, t) that share a token of at most {cap} ids, their similarity over all tokens, and components.
EDGES = """few AS (SELECT t FROM {block} GROUP BY t HAVING count(*) BETWEEN 2 AND {cap}), pairs AS (SELECT DISTINCT x.id AS a,
    y.id AS b FROM {block} x JOIN {block} y USING (t) JOIN few USING (t) WHERE x.id < y.id),
size AS (SELECT id, count(*) AS n FROM sets GROUP BY id), inter AS (SELECT a, b, count(*) AS k FROM pairs JOIN sets x ON x.id = a
    JOIN sets y ON y.id = b AND y.t = x.t GROUP BY ALL),
edges AS (SELECT a, b, k / (p.n + q.n - k) AS score FROM inter JOIN size p ON p.id = a JOIN size q ON q.id = b
    WHERE k / (p.n + q.n - k) >= {least})"""
CLUSTERS = """u AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), walk(v, l) AS (SELECT DISTINCT id, id FROM sets UNION
    SELECT u.b, w.l FROM walk w JOIN u ON u.a = w.v WHERE u.b > w.l)"""
TOKENS = "sets AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS t FROM lineitem)"


@query("token_jaccard_edges", f"WITH {TOKENS}, {EDGES.format(block='sets', cap=250, least=0.25)} SELECT a, b, round(score, 9) AS score FROM edges")
def token_jaccard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.jaccard_edges(_token_sets(spark, sf_dir), "id", "t", 250, 0.25).withColumn("score", F.round("score", 9))


@query("token_jaccard_clusters", f"""WITH RECURSIVE {TOKENS}, {EDGES.format(block='sets', cap=250, least=0.4)}, {CLUSTERS}
    SELECT v AS id, min(l) AS cluster FROM walk GROUP BY v""")
def token_jaccard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _token_sets(spark, sf_dir)
    return M.jaccard_clusters(s, "id", "t", 250, 0.4)


def _token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(li.l_orderkey.alias("id")).agg(F.collect_set("l_partkey").alias("t"))


@query(
    "sketch_clusters",
    f"""WITH RECURSIVE {SEQ.replace('item_id', 'conv_id * 1000 + turn').replace('FROM benchmark', 'FROM conversations')},
    {GRAMS.format(k=3)}, h AS (SELECT DISTINCT id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS t FROM grams), r AS (SELECT *,
    row_number() OVER (PARTITION BY id ORDER BY t) AS r FROM h), sets AS (SELECT id, t FROM r WHERE r <= 64), block AS (SELECT id,
    t FROM r WHERE r <= 8), {EDGES.format(block='block', cap=200, least=0.72)}, {CLUSTERS} SELECT v AS id, min(l) AS cluster
    FROM walk GROUP BY v""",
)
def sketch_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    s = c.select((c.conv_id * 1000 + c.turn).alias("id"), Q.clean_sequence(c.text).alias("s")).where(F.length("s") >= 3)
    s = s.select("id", Q.sketch(F.col("s")).alias("sketch")).withColumn("head", F.slice("sketch", 1, 8))
    return M.jaccard_clusters(s, "id", "sketch", 200, 0.72, "head")


@query("pair_vector_features", """SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding),
    lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 5) AS l1, round(list_sum(list_transform(list_zip(a.embedding, b.embedding),
    lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 5) AS dot, 4 * len(a.embedding) AS dims FROM embeddings a
    JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_vector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.size("v").alias("n"), X.pair_vector(F.col("v"), F.col("w")).alias("f"))
    add = lambda i: F.round(F.aggregate(F.slice("f", F.col("n") * i + 1, F.col("n")), F.lit(0.0), lambda s, x: s + x), 5)
    return j.select("vec_id", add(2).alias("l1"), add(3).alias("dot"), F.size("f").cast("long").alias("dims"))


@query("embedding_pool", """SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS first,
    round(avg(embedding[64]::DOUBLE), 6) AS last FROM embeddings GROUP BY label""")
def embedding_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    return p.select("label", "n", F.round(F.get("pooled", F.lit(0)), 6).alias("first"), F.round(F.get("pooled", F.lit(63)), 6).alias("last"))


@query("mechanism_columns", """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'unknown' ELSE c_mktsegment END AS segment,
    round(ln(1 + length(c_name)), 9) AS log_name FROM customer""")
def mechanism_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.when(c.c_custkey % 9 != 0, c.c_mktsegment).alias("segment"), c.c_name.alias("name"))
    return X.mechanism_columns(rows, {"segment": "unknown"}, ["name"]).select("c_custkey", "segment", F.round("log_name", 9).alias("log_name"))


@query(
    "mechanism_frame",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN p_brand END AS k, CASE WHEN p_partkey % 8 > 0 THEN left(p_name,
    1) END AS r, p_type AS o,
      CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 40 END AS s, CASE WHEN p_partkey % 6 > 0 THEN p_name ELSE '' END AS a, CASE
      WHEN p_partkey % 5 > 0 THEN p_type END AS b, CASE WHEN p_partkey % 4 > 0 THEN left(p_name, 5) ELSE '' END AS w FROM part)
    SELECT p_partkey, coalesce(k, 'unknown') AS ptm, upper(coalesce(r, 'unknown')) AS residue, coalesce(o, 'unknown') AS organism,
    coalesce(s, -1)::DOUBLE AS site, round(ln(1 + coalesce(s, 0)), 9) AS site_log1p,
      round(ln(1 + length(a)), 9) AS mod_length_log1p, round(ln(1 + coalesce(length(b), 0)), 9) AS partner_length_log1p,
      length(w)::DOUBLE AS window_length, CASE WHEN a <> '' THEN round(coalesce(s, 0) / length(a), 9) ELSE 0 END AS site_fraction,
      p_partkey % 3 = 0 AS same_entity, a <> '' AS has_mod_sequence, b IS NOT NULL AS has_partner_sequence, w <> '' AS has_window
      FROM r""",
)
def mechanism_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = p.p_partkey
    rows = p.select(
        k,
        F.when(k % 9 > 0, p.p_brand).alias("kind"),
        F.when(k % 8 > 0, F.left("p_name", F.lit(1))).alias("aa"),
        p.p_type.alias("species"),
        F.when(k % 7 > 0, (k % 40).cast("string")).otherwise("n/a").alias("place"),
        F.when(k % 6 > 0, p.p_name).otherwise("").alias("a"),
        F.when(k % 5 > 0, p.p_type).alias("b"),
        F.when(k % 4 > 0, F.left("p_name", F.lit(5))).otherwise("").alias("w"),
        (k % 3).alias("id_a"),
        F.lit(0).alias("id_b"),
    )
    made = X.mechanism_frame(rows, "kind", "aa", "species", "place", "a", "b", "w", "id_a", "id_b").drop("kind", "aa", "species", "place", "a", "b", "w", "id_a", "id_b")
    return made.withColumns({c: F.round(c, 9) for c in ("site_log1p", "mod_length_log1p", "partner_length_log1p", "site_fraction")})


@query("attach_sequences", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '-own' ELSE coalesce(quality::VARCHAR,
    '') END AS sequence FROM documents LEFT JOIN labels USING (doc_id)""")
def attach_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.when(d.doc_id % 2 == 0, F.concat("lang", F.lit("-own"))).otherwise("").alias("own"))
    store = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("other"))
    return X.prefer_own(rows, store, "doc_id", "own", "other").select("doc_id", "sequence")


SITE = """w AS (SELECT p_partkey AS id, ['Phos', 'Ac', 'Me', 'Ub', 'Sumo', 'Glyco', 'Other'][p_partkey % 7 + 1] AS kind, ['K', 'R',
    'S', 'Y', 'T'][p_partkey % 5 + 1] AS residue, left(translate(md5(p_name || p_partkey), '0123456789abcdef',
    'ACDEFGHIKLMNPQRS'), 31) AS s, CASE WHEN p_partkey % 13 = 0 THEN 'ywhaz' ELSE p_brand END AS partner FROM part),
    x AS (SELECT *, length(s) // 2 AS c, substr(s, greatest(length(s) // 2 - 5, 0)::INT + 1, 5) AS up, substr(s,
    length(s) // 2 + 2, 1) AS nxt, substr(s, length(s) // 2 + 2, 6) AS down FROM w)"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pick = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (p.p_partkey % m + 1).cast("int"))
    s = F.left(F.translate(F.md5(F.concat("p_name", "p_partkey")), "0123456789abcdef", "ACDEFGHIKLMNPQRS"), F.lit(31))
    partner = F.when(p.p_partkey % 13 == 0, "ywhaz").otherwise(p.p_brand)
    return p.select(p.p_partkey.alias("id"), pick(["Phos", "Ac", "Me", "Ub", "Sumo", "Glyco", "Other"], 7).alias("kind"), pick(["K", "R", "S", "Y", "T"], 5).alias("residue"), s.alias("s"), partner.alias("partner"))


@query(
    "site_classifiers",
    f"""WITH {SITE} SELECT id,
      CASE WHEN kind = 'Phos' THEN CASE WHEN upper(partner) LIKE 'YWHA%' THEN 'reader_14_3_3_edge'
      WHEN residue = 'Y' THEN 'phosphotyrosine_reader_candidate' WHEN nxt = 'P' THEN 'proline_directed_pin1_ww_candidate'
      WHEN regexp_matches(up, 'R.{{1,3}}$') THEN 'basophilic_phosphosite_candidate' WHEN regexp_matches(up, '[DE].{{0,3}}$')
      OR regexp_matches(down, '^[DE]') THEN 'acidic_phosphosite_candidate' ELSE 'other_phosphosite' END
           WHEN kind = 'Ac' AND residue = 'K' THEN 'acetyl_lysine_reader_candidate' WHEN kind = 'Me' AND residue IN ('K',
           'R') THEN 'methyl_reader_candidate' WHEN kind IN ('Ub', 'Sumo') AND residue = 'K' THEN 'ubiquitin_like_lysine'
           WHEN kind = 'Glyco' THEN 'glycosylation_site' ELSE 'other_ptm' END AS motif,
      CASE WHEN kind <> 'Phos' THEN 'non_phos_' || kind WHEN residue = 'Y' THEN 'tyrosine_kinase_proxy'
      WHEN nxt = 'P' THEN 'proline_directed_kinase_proxy' WHEN regexp_matches(up, '[RK].{{0,3}}$') THEN 'basophilic_kinase_proxy'
      WHEN regexp_matches(up, '[DE].{{0,4}}$') THEN 'acidophilic_kinase_proxy' ELSE 'other_ser_thr_kinase_proxy' END AS kinase,
      round(ln(1 + CASE kind WHEN 'Phos' THEN 79.966 WHEN 'Ac' THEN 42.011 WHEN 'Me' THEN 14.016 WHEN 'Ub' THEN 8564
      WHEN 'Sumo' THEN 11000 WHEN 'Glyco' THEN 203 ELSE 0 END::DOUBLE), 7) AS log_mass FROM x""",
)
def site_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import site as P

    w = _sites(spark, sf_dir)
    args = F.col("kind"), F.col("residue"), F.col("s")
    return w.select("id", P.motif_family(*args, F.lit(""), F.col("partner")).alias("motif"), P.kinase_proxy(*args).alias("kinase"), F.round(F.get(P.chemistry(F.col("kind")), F.lit(0)), 7).alias("log_mass"))


@query("variant_parse", r"""WITH v AS (SELECT p_partkey AS id, p_brand || '_' || CASE WHEN p_partkey % 3 = 0 THEN 'Thr'
    ELSE 'Zzz' END || p_size || CASE WHEN p_partkey % 5 = 0 THEN '?' ELSE 'Ile' END AS t FROM part) SELECT id, regexp_extract(t,
    '^(.+)_', 1) AS gene, CASE WHEN id % 3 = 0 THEN 'T' ELSE 'Zzz' END AS wild, regexp_extract(t, '(\d+)Ile$', 1)::INT AS pos,
    'I' AS variant FROM v WHERE id % 5 <> 0""")
def variant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import site as P
    from ..sources.readers import RESIDUES

    p = table(spark, sf_dir, "part")
    t = F.concat("p_brand", F.lit("_"), F.when(p.p_partkey % 3 == 0, "Thr").otherwise("Zzz"), "p_size", F.when(p.p_partkey % 5 == 0, "?").otherwise("Ile"))
    return p.select(p.p_partkey.alias("id"), P.parse_variant(t, RESIDUES).alias("v")).where("v is not null").select("id", "v.*")


@query("assay_family", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'co_ip' WHEN p_partkey % 4 = 1 THEN 'biophysical'
    WHEN p_partkey % 4 = 2 THEN 'blot_overlay' ELSE 'other' END AS family FROM part""")
def assay_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import site as P
    from ..functions.text import first_match

    p = table(spark, sf_dir, "part")
    text = F.element_at(F.array(F.lit("Co-IP, western"), F.lit("SPR assay"), F.lit("Western"), F.lit("md run")), (p.p_partkey % 4 + 1).cast("int"))
    return p.select("p_partkey", first_match(text, P.ASSAYS).alias("family"))
