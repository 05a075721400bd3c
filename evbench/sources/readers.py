"""Readers and writers of the formats that evidence arrives in.  Rows come from Spark's own scans; nothing is parsed on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import require_columns

# Three-letter residue names and their letters.
RESIDUES = dict(
    ALA="A", ARG="R", ASN="N", ASP="D", CYS="C", GLN="Q", GLU="E", GLY="G", HIS="H", ILE="I",
    LEU="L", LYS="K", MET="M", PHE="F", PRO="P", SER="S", THR="T", TRP="W", TYR="Y", VAL="V",
)


def delimited(spark: SparkSession, path: str, sep: str = ",", required: Sequence[str] = (), quoted_breaks: bool = False) -> DataFrame:
    """All columns as strings; a byte-order mark before the first header is dropped; missing columns are an error that names them.

    Files are read in splits.  quoted_breaks: cells may hold line breaks within quotes, so that only a reader from the file's start knows where a row
    ends, and a file is one task.
    """
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=quoted_breaks, escape='"')
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return require_columns(df, required)


def any_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: csv, tsv, txt (tab unless the header has more commas), json (rows, or an object that holds them), jsonl, parquet.

    Parquet cells become strings and nulls empty ones.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return delimited(spark, path)
    if suffix == "tsv":
        return delimited(spark, path, "\t")
    if suffix == "txt":
        head = spark.read.text(path).first()  # the header line
        return delimited(spark, path, "," if head and head[0].count(",") > head[0].count("\t") else "\t")
    if suffix in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if suffix == "json":
        df = spark.read.json(path, multiLine=True)
        for wrapper in ("rows", "data", "records"):
            if df.columns == [wrapper] or (wrapper in df.columns and df.schema[wrapper].dataType.typeName() == "array"):
                return df.select(F.explode(wrapper).alias("r")).select("r.*")
        return df
    if suffix == "parquet":
        df = spark.read.parquet(path)
        return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    raise ValueError(f"unknown table format: {suffix}")


def fasta(spark: SparkSession, path: str, strip_isoform: bool = False) -> DataFrame:
    """(accession, sequence): the accession is the second `|` field or the first word; parts of one accession are joined in the order of the files'
    paths and of their place in the file.

    A file is read in splits, of which Spark packs several into a task, larger ones first; so a part's place is its split's start and its number within the task, which
    rises within a split.
    """
    of = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("within"))
    records = spark.read.text(path, lineSep=">").select("value", of.alias("at")).where("trim(value) <> ''")
    head = F.trim(F.split("value", "\n")[0])
    acc = F.when(F.contains(head, F.lit("|")), F.split(head, r"\|")[1]).otherwise(F.split(head, r"\s+")[0])
    if strip_isoform:
        acc = F.regexp_replace(acc, r"-\d+$", "")
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    rows = records.select(acc.alias("accession"), body.alias("s"), "at")
    return rows.groupBy("accession").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x.s), "").alias("sequence"))


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """(complex_id, chain, ord, site, residue): CA atoms of fixed-width records, first of each residue, in file order.

    A blank chain is `_`, an unknown residue `X`; the complex is the end of the file's name or, for a complex of several files,
    of its folder's.  A residue whose number isn't an
    integer is dropped after it has counted as seen.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "t"))
    part = lambda lo, n: F.trim(F.substring("t", lo, n))
    ca = files.where((F.substring("t", 1, 4) == "ATOM") & (part(13, 4) == "CA"))
    table = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    named = lambda c: F.nullif(F.regexp_extract(c, r"(Complex\d+(?:_\d+)?)$", 1), F.lit(""))
    complex_id = F.coalesce(named(stem), named(F.regexp_extract("file", r"([^/]*)/[^/]*$", 1)), stem)
    chain = F.coalesce(F.nullif(part(22, 1), F.lit("")), F.lit("_"))
    rows = ca.select(complex_id.alias("complex_id"), chain.alias("chain"), part(23, 4).alias("num"), part(27, 1).alias("icode"), F.coalesce(F.element_at(table, part(18, 3)), F.lit("X")).alias("residue"), F.struct("file", "line").alias("line"))
    first = rows.groupBy("complex_id", "chain", "num", "icode").agg(F.min_by("residue", "line").alias("residue"), F.min("line").alias("line"))
    kept = first.withColumn("site", F.col("num").try_cast("int")).where("site is not null")
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("complex_id", "chain").orderBy("line")) - 1
    return kept.select("complex_id", "chain", order.alias("ord"), "site", "residue")


def tsv_profile(lines: DataFrame, column: str = "value") -> DataFrame:
    """(file, row_count, columns, header, looks_like_html) of landed tab-separated text; lines: (file, at, value), `#` lines skipped."""
    rows = lines.where(~F.col(column).startswith("#") & (F.trim(column) != ""))
    html = F.bool_or(F.lower(F.trim(column)).rlike("^<(!doctype|html)")).alias("looks_like_html")
    tabbed = F.contains(F.col(column), F.lit("\t")) & ~F.col(column).startswith("<")
    head = F.min_by(F.when(tabbed, F.col(column)), F.when(tabbed, F.col("at")))
    s = rows.groupBy("file").agg(F.count_if(tabbed).alias("n"), head.alias("header"), html)
    return s.select("file", F.greatest(F.col("n") - 1, F.lit(0)).alias("row_count"), F.coalesce(F.size(F.split("header", "\t")), F.lit(0)).alias("columns"), "header", "looks_like_html")


def discover(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """(path, length) of the files below root that have one of the suffixes; contents aren't read."""
    glob = "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")


def keyed_store(sources: Sequence[DataFrame]) -> DataFrame:
    """(accession, sequence) from several sources; a later one overrides an earlier one; empty sequences are dropped."""
    out = None
    for i, s in enumerate(sources):
        one = s.select("accession", "sequence", F.lit(i).alias("at"))
        out = one if out is None else out.unionByName(one)
    return out.where("sequence is not null and sequence <> ''").groupBy("accession").agg(F.max_by("sequence", F.struct("at", "sequence")).alias("sequence"))


def summary_json(row: DataFrame) -> DataFrame:
    """A one-row frame as one JSON text."""
    return row.select(F.to_json(F.struct("*")).alias("summary"))


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row frame as a folder with one JSON object, nested as the row is."""
    summary_json(row).write.mode("overwrite").text(path)


def write_delimited(df: DataFrame, path: str, columns: Sequence[str], sep: str = "\t") -> None:
    """Header, the named columns in that order; others are left out."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
