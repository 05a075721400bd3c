"""From raw documents to packed training sequences: each stage works on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
docs.  All but the last return the columns of documents.  Rows with a null id can't be judged by stages that work on ids;
they pass through them and are left out by packing.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evbench.llm import linededup, neardup, packing, quality, suffixdedup
from evbench.llm.common import discard, shared_path, table

#: Words of a shared passage, whatever their bytes: passages of over 50 words are to go.
PASSAGE = 51


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; n_chars, where there is one, follows the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the line labels reject; the labels of the corpus fit the field."""
    return quality.filtered(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document of smaller id holds too."""
    return _same_columns(linededup.dedup(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of smallest id, of each group that shares four fifths of its five-word shingles."""
    lost = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(lost.hint("shuffle_hash"), docs["doc_id"].cast("long") == lost["__id"], "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of PASSAGE words or more that stand in the corpus twice."""
    return _same_columns(suffixdedup.removed(docs, words=PASSAGE), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("packing", pack),
]

#: Several stages can't be expressed in SQL; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; what a stage wrote is deleted as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
