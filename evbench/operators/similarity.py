"""Clusters of similar items by shared sketches or tokens: candidate pairs, exact scores on the whole sets, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import jaccard
from .durable import cut
from .graphs import components


#: Sets and blocks of at most so many items travel with their tokens, so that pairs are scored where they meet.
CARRIED = 64


def _candidates(sets: DataFrame, cap: int | None, least: float) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, score) of at least the given similarity, ids that hold a kept token); sets: (id, items, n, block, m), m ids stand behind each row.

    A token is kept if at most cap ids hold it.  Two sets of similarity `least` have a token in common among the
    n - ceil(least n) + 1 rarest of each, if the block is the whole set; so only those meet.  Of the tokens that two sets
    share the rarest one is kept if any is.  A pair counts at the rarest of the tokens by which it meets and is scored there, so that what leaves
    a task is the pairs that are similar; pairs with a set too long to travel are made distinct and look their sets up.
    """
    tokens = cut(sets.select("id", "n", "whole", "m", F.explode("block").alias("token")))
    count = tokens.groupBy("token").agg(F.sum("m").alias("held"))
    known = tokens.join(count, "token")
    rank = F.array_sort(F.collect_list(F.struct("held", "token")))
    take = F.when(F.col("whole"), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1).otherwise(F.col("n"))
    meets = lambda x: (x["held"] > 1) & ((x["held"] <= cap) if cap is not None else F.lit(True))
    prefix = known.groupBy("id", "n", "whole").agg(rank.alias("t")).select("id", F.transform(F.filter(F.slice("t", 1, take), meets), lambda x: x["token"]).alias("p"))
    small = (F.size("items") <= CARRIED) & (F.size("p") <= CARRIED)
    some = prefix.where(F.size("p") > 0).join(sets.select("id", "items"), "id").select("id", F.when(small, F.col("items")).alias("s"), F.when(small, F.col("p")).alias("p"), F.explode("p").alias("token"))
    side = lambda c: some.select("token", F.col("id").alias(c), F.col("s").alias(f"s{c}"), F.col("p").alias(f"p{c}"))
    met = side("a").join(side("b"), "token").where("a < b")
    na, nb, k = F.size("sa"), F.size("sb"), F.col("k")
    carried = F.col("sa").isNotNull() & F.col("sb").isNotNull()
    met = met.where(~carried | (F.least(na, nb) >= least * F.greatest(na, nb) - 1e-9))
    # exploded, so that the filters don't count what is shared anew; -1 stands for sets to look up
    met = met.withColumn("k", F.explode(F.array(F.when(carried, F.size(F.array_intersect("sa", "sb"))).otherwise(-1))))
    score, first = k / (na + nb - k), F.get(F.array_intersect("pa", "pb"), F.lit(0)) == F.col("token")
    met = cut(met.where((k < 0) | ((k > 0) & (score >= least) & first)).select("a", "b", F.when(k > 0, score).alias("score")))
    pairs, long_ = met.where("score is not null"), met.where("score is null")
    if not long_.isEmpty():
        pairs = pairs.unionByName(_scored(long_.select("a", "b").distinct(), sets, least))
    whole = known if cap is None else known.where(F.col("held") <= cap)
    return pairs, whole.select("id").distinct()


def _scored(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs whose sets are similar enough; sizes are compared before the sets are."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("items").alias(f"s{c}"), F.size("items").alias(f"n{c}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
    return j.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("score")).where(F.col("score") >= least)


def _sets(sets: DataFrame, ident: str, items: str, blocking: str | None) -> DataFrame:
    block = F.array_distinct(F.col(blocking or items))
    return sets.select(F.col(ident).alias("id"), F.array_distinct(F.col(items)).alias("items"), block.alias("block"), F.size(block).alias("n"), F.lit(blocking is None).alias("whole"))


def jaccard_edges(sets: DataFrame, ident: str, items: str, cap: int | None, least: float, blocking: str | None = None) -> DataFrame:
    """(a, b, score) of pairs of at least the given similarity; sets: (id, items array).

    Candidates share a token held by at most cap ids (None: by any number); the score uses all tokens.  blocking: a column of
    fewer tokens that candidates must share instead.
    """
    rows = _sets(sets, ident, items, blocking).withColumn("m", F.lit(1))
    return _candidates(rows, cap, least)[0]


def jaccard_clusters(sets: DataFrame, ident: str, items: str, cap: int | None, least: float, blocking: str | None = None) -> DataFrame:
    """(id, cluster): components of the pairs of jaccard_edges(); an id without one is alone.

    Ids of equal sets are one class from the start, so that copies aren't paired with one another; they are linked if one of their
    tokens is kept.
    """
    key = F.md5(F.concat_ws("/", *[F.array_join(F.array_sort(F.col(c)).cast("array<string>"), ",") for c in ("items", "block")]))
    rows = cut(_sets(sets, ident, items, blocking).withColumn("key", key))
    classes = cut(rows.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("items", "block", "n", "whole")]))
    pairs, linked = _candidates(classes, cap, least)
    edges = pairs.select("a", "b")
    copies = rows.select("key", F.col("id").alias("b")).join(classes.join(linked, "id", "left_semi").select("key", F.col("id").alias("a")), "key").select("a", "b")
    alone = rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return components(edges.unionByName(copies).unionByName(alone)).select(F.col("v").alias(ident), F.col("label").alias("cluster"))
