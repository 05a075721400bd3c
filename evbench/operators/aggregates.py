"""Aggregation operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_distribution(df: DataFrame, label: Column | None, by: Sequence[str] = ()) -> DataFrame:
    """Counts by label; missing labels and tables without a label column have names of their own."""
    name = F.lit("__unlabeled__") if label is None else F.coalesce(F.nullif(F.trim(label.cast("string")), F.lit("")), F.lit("__missing_label__"))
    return df.groupBy(*by, name.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def distinct_profile(df: DataFrame, keys: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row: rows and distinct values of each key; approximate for tables where exact counts aren't audited."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count(F.lit(1)).alias("row_count"), *[f(k).alias(k) for k in keys])


def slices(df: DataFrame, axes: Mapping[str, Column], label: Column, least: int = 20, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """(axis, slice, n, positives, rate, risk): every axis in one pass, each row once per axis."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c.cast("string").alias("slice")) for a, c in axes.items()])).alias("x"), label.cast("int").alias("y"))
    out = rows.groupBy("x.axis", "x.slice").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    rate = F.round(F.col("positives") / F.col("n"), 9)
    risk = F.when(F.col("n") < least, "small_slice").when((rate < low) | (rate > high), "label_skew").otherwise("ok")
    return out.withColumn("rate", rate).withColumn("risk", risk)


def overall_and_by(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """The aggregates over everything (key "all") and for each key, from one pass."""
    g = F.grouping(F.col(key))
    return df.rollup(key).agg(g.alias("__g"), *aggs).withColumn(key, F.when(F.col("__g") == 1, "all").otherwise(F.col(key))).drop("__g")


def as_rows(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """(metric, value) rows of whole-table aggregates; also where the table is empty."""
    one = df.agg(*[c.cast("double").alias(k) for k, c in metrics.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(F.col(k), F.lit(0.0)).alias("value")) for k in metrics])).alias("x")).select("x.*")
