"""Ranks and running sums in two steps, so that no task sorts a whole table: totals per bucket, their running sum, local windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut


def hash_rank(df: DataFrame, by: Sequence[str], digest: Column, tie: Sequence[str], out: str = "rank", digits: int = 3) -> DataFrame:
    """df with its 1-based rank within `by` in the order of the hex digest, then of tie.

    Digests are even, so that their first digits make buckets of like size; at most 16**digits rows per group are summed.
    """
    rows = df.withColumn("__d", digest).withColumn("__p", F.substring("__d", 1, digits))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__d", *tie)))
    match = [ranked[c].eqNullSafe(base[c]) for c in [*by, "__p"]]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    joined = ranked.join(base, cond)
    return joined.select(*[ranked[c] for c in df.columns], (ranked["__r"] + base["__base"]).alias(out))


def running(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], bucket: Column, descending: bool = False) -> DataFrame:
    """df with cum_<x> for each x: its sum over the rows of the group up to and with this one's order value.

    bucket: a monotone function of the order value with a bounded number of values.  df has one row per group and value.
    """
    rows = df.withColumn("__b", bucket)
    key = F.desc if descending else F.asc
    earlier = Window.partitionBy(*by).orderBy(key("__b")).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*by, "__b").agg(*[F.sum(s).alias(s) for s in sums])
    base = base.select(*by, "__b", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"__{s}") for s in sums])
    local = Window.partitionBy(*by, "__b").orderBy(key(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = base.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate([*by, "__b"])], *[f"__{s}" for s in sums])
    j = rows.join(named, [F.col(c).eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate([*by, "__b"])])  # a null is a group too
    return j.select(*df.columns, *[(F.sum(s).over(local) + F.col(f"__{s}")).alias(f"cum_{s}") for s in sums])


def numbered(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """df with its place in the order of the keys, from 0.

    Ranges are sorted by Spark and numbered within their tasks; only their sizes are summed, one row for each range.
    """
    ranged = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id()))
    part, at = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return ranged.withColumn("__p", part).join(base, "__p").select(*df.columns, (at + F.col("__base")).alias(out))
