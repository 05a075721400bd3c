"""Exact quantiles of groups of any size, by selection: no task or buffer holds a group's values.

Values fall into buckets of falling width, and each bucket that holds a wanted rank is looked into: first a sixteenth of a power of two,
then 4096 equal parts of the span of values in it, then the distinct values of one such part.  Each step is one aggregation with a map-side
combine; running counts go over the buckets of a group, at most 70,000, and over the parts of a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 4096


def _bucket(x: Column) -> Column:
    """A bounded number that never falls as x rises."""
    step = lambda y: (F.floor(16 * (F.log2(y) + 1080)) + 1).cast("int")  # noqa: E731  1 at least: the smallest double is 2**-1074
    return F.when(x > 0, step(x)).when(x < 0, -step(-x)).otherwise(0)


def _located(counts: DataFrame, keys: Sequence[str], order: str, wanted: DataFrame, keep: Sequence[str]) -> DataFrame:
    """wanted rows (keys, id, rank) with the cell of counts (keys, order, n, keep) that their rank falls into, and their rank within it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = counts.withColumn("__upto", F.sum("n").over(w)).select(*_named(keys), order, *keep, F.col("n").alias("__n"), "__upto")
    before = F.col("__upto") - F.col("__n")
    j = wanted.join(cells, [*_same(keys), F.col("rank") < F.col("__upto"), F.col("rank") >= before])
    return j.select(*[c for c in wanted.columns if c != "rank"], (F.col("rank") - before).alias("rank"), order, *keep)


def _named(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"__{k}") for k in keys]


def _same(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by, q0, q1, ...): the quantiles of the shares, between two values linearly; nulls and NaN are left out, groups without values are missing."""
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("b", _bucket(F.col("x")))
    by = list(by)
    first = rows.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = lambda q: (F.col("of") - 1) * F.lit(float(q))
    ends = [F.struct(F.lit(k).alias("id"), F.lit(side).alias("side"), f(at(q)).cast("long").alias("rank"), (at(q) - F.floor(at(q))).alias("f")) for k, q in enumerate(shares) for side, f in ((0, F.floor), (1, F.ceil))]
    wanted = first.groupBy(*by).agg(F.sum("n").alias("of")).select(*by, F.explode(F.array(*ends)).alias("e")).select(*by, "e.*")
    one = _located(first, by, "b", wanted, ["lo", "hi"])

    bucket = [*by, "b"]
    chosen = one.select(*_named(bucket), "lo", "hi").distinct()
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("int")
    parted = rows.join(chosen, _same(bucket)).select(*bucket, "x", part.alias("p"))
    two = _located(parted.groupBy(*bucket, "p").agg(F.count(F.lit(1)).alias("n")), bucket, "p", one.drop("lo", "hi"), [])

    cell = [*bucket, "p"]
    values = parted.join(two.select(*_named(cell)).distinct(), _same(cell), "left_semi").groupBy(*cell, "x").agg(F.count(F.lit(1)).alias("n"))
    three = _located(values, cell, "x", two, [])
    end = lambda k, side: F.max(F.when((F.col("id") == k) & (F.col("side") == side), F.col("x")))
    share = lambda k: F.max(F.when(F.col("id") == k, F.col("f")))
    between = lambda k: F.when(share(k) == 0, end(k, 0)).otherwise(end(k, 0) + share(k) * (end(k, 1) - end(k, 0)))
    return three.groupBy(*by).agg(*[between(k).alias(f"q{k}") for k in range(len(shares))])
