"""Queries on sources: text formats are written from the tables into the shared folder and scanned back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as Q
from ..functions import text as T
from ..operators.durable import shared_folder
from ..sources import readers as R
from .base import query, table


def _landing(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


CLEAN = "regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]', '', 'g'), '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g')"


@query("fasta_scan", f"""SELECT 'B' || item_id AS accession, CASE WHEN item_id % 2 = 0 THEN s || s ELSE s END AS sequence
    FROM (SELECT item_id, {CLEAN} AS s FROM benchmark)""")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    s = Q.clean_sequence(b.text)
    wrapped = F.regexp_replace(s, "(.{60})", "$1\n")
    record = F.concat(F.lit(">sp|B"), b.item_id, F.lit("|NAME some words\n"), wrapped)
    path = _landing(spark, "fasta")
    b.select(F.when(b.item_id % 2 == 0, F.concat_ws("\n", record, record)).otherwise(record).alias("value")).write.text(path)
    return R.fasta(spark, path)


@query("atom_scan", """SELECT 'Complex' || (p_partkey // 5000) AS complex_id, chr((65 + p_partkey % 5)::INT) AS chain,
    count(*) AS residues, min(p_size) AS first_size, max(p_size) AS last_size FROM part GROUP BY ALL""")
def atom_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.floor(F.col("p_partkey") / 5000).alias("file"))
    line = F.format_string("ATOM  %5d  CA  GLY %s%4d    ", (p.p_partkey % 99999).cast("int"), F.char(65 + p.p_partkey % 5), (p.p_partkey % 5000).cast("int"))
    path = _landing(spark, "atoms")
    # a folder for each complex, as its name is part of the path
    p.select(line.alias("value"), F.concat(F.lit("Complex"), "file").alias("complex")).write.partitionBy("complex").text(path)
    got = R.atoms(spark, path).select("complex_id", "chain", (F.regexp_extract("complex_id", r"(\d+)$", 1).cast("long") * 5000 + F.col("site")).alias("p_partkey"))
    return got.join(p.select("p_partkey", "p_size"), "p_partkey").groupBy("complex_id", "chain").agg(F.count(F.lit(1)).alias("residues"), F.min("p_size").alias("first_size"), F.max("p_size").alias("last_size"))


@query("delimited_roundtrip", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _landing(spark, "tsv")
    R.write_delimited(table(spark, sf_dir, "part"), path, ["p_partkey", "p_name", "p_brand"])
    return R.delimited(spark, path, "\t", ["p_partkey", "p_brand"])


@query("tsv_profile", """SELECT 'conv-' || (conv_id % 7) AS file, count(*) - 1 AS row_count, 2 AS columns, false AS looks_like_html
    FROM conversations GROUP BY 1""")
def tsv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    lines = c.select(F.concat(F.lit("conv-"), c.conv_id % 7).alias("file"), (c.conv_id * 1000 + c.turn).alias("at"), F.concat_ws("\t", "role", "turn").alias("value"))
    noise = lines.select("file", F.lit(-1).cast("long").alias("at"), F.lit("# comment").alias("value")).distinct()
    return R.tsv_profile(lines.unionByName(noise)).drop("header")


@query("id_extract", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z]{4}[0-9A-Z]{8,}'))) AS id FROM documents")
def id_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ids = F.regexp_extract_all("text", F.lit(r"[A-Z]{4}[0-9A-Z]{8,}"), F.lit(0))
    return d.select("doc_id", F.explode(F.array_distinct(ids)).alias("id"))


@query("basename_paths", """SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS tail, lower(trim(CASE
    WHEN page_id % 2 = 0 THEN ' TRUE' ELSE 'no' END)) = 'true' AS even FROM pages""")
def basename_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.basename(p.url).alias("tail"), T.as_bool(F.when(p.page_id % 2 == 0, " TRUE").otherwise("no")).alias("even"))


@query("summary_json", """SELECT '{"documents":' || count(*) || ',"langs":' || count(DISTINCT lang) || '}' AS summary FROM documents""")
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = _landing(spark, "summary")
    R.write_summary(d.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("lang").alias("langs")), path)
    return spark.read.text(path).withColumnRenamed("value", "summary")


@query("keyed_store", """SELECT 'D' || doc_id AS accession, CASE WHEN quality = 1 THEN 'label' ELSE lang END AS sequence
    FROM documents LEFT JOIN labels USING (doc_id)""")
def keyed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("D"), "doc_id").alias("accession"), F.col("lang").alias("sequence"))
    over = table(spark, sf_dir, "labels").select(F.concat(F.lit("D"), "doc_id").alias("accession"), F.when(F.col("quality") == 1, "label").otherwise("").alias("sequence"))
    return R.keyed_store([d, over])
