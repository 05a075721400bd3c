"""Sums of packs: those of the whole vectors, for every pack, and no event takes a sequence's entries through a join."""

from __future__ import annotations

from pyspark.sql import functions as F

from evbench.operators import packs as X
from evbench.plans import packs as P

SF = "/root/testdata/sf0.001"


def test_sums_are_those_of_the_vectors(spark):
    packs = {f"pack_{k}": v for k, v in X.FIRST.items()} | {f"state_{k}": v for k, v in X.SECOND.items()}
    ev = P.events(spark, SF).where("l_orderkey % 7 = 0").withColumn("partner_sequence", F.when(F.col("l_linenumber") != 3, F.col("partner_sequence"))).withColumn("l_row", F.concat_ws("/", "modified", "partner"))
    rows, blocks = X.event_blocks(ev, packs)
    key = ["l_orderkey", "l_linenumber", "l_row"]
    whole = X.with_packs(rows, blocks, packs).select(*key, *[X.sums(F.col(p)).alias(p) for p in packs])
    made = X.pack_sums(ev, key, packs)
    flat = lambda df: sorted(tuple(r[:3]) + tuple((round(x["n"]), round(x["s"], 6), round(x["t"], 4)) for x in r[3:]) for r in df.collect())
    got, want = flat(made), flat(whole)
    assert got and len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3]
        for x, y in zip(g[3:], w[3:], strict=True):
            assert x[0] == y[0] and abs(x[1] - y[1]) < 1e-5 and abs(x[2] - y[2]) < 1e-3


def test_entries_stay_with_the_sequences(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = P._pack("x", X.SECOND["counterfactual"])(spark, SF)
        stack, wide = [df._jdf.queryExecution().optimizedPlan()], []
        while stack:
            node = stack.pop()
            if node.nodeName() == "Join":
                wide += [f for f in node.schema().fields() if f.dataType().typeName() == "array"]
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
        assert not wide
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_sequence_moves_with_the_events(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stack, moved = [P._pack("x", X.SECOND["counterfactual_no_chemistry"])(spark, SF)._jdf.queryExecution().optimizedPlan()], set()
        while stack:
            node = stack.pop()
            if node.nodeName() == "Join":
                moved |= {f.name() for f in node.schema().fields()}
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
        assert moved and not moved & {"window", "changed_window", "modified_sequence", "partner_sequence", "s_name", "p_name"}
        # k-mers don't leave their row
        assert "Generate" not in X.hashed_kmers(spark.createDataFrame([("ACD",)], "s string"), "s", F.col("s"), 2, 8, "t")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_categories_of_a_side_are_those_that_occur(spark, monkeypatch):
    side = X.Side(("k", "x"), spark.range(100).selectExpr("id as k", "cast(null as string) as x", "if(id % 5 = 3, null, concat('c', id % 5)) as c"))
    rows = lambda most: spark.range(100).where(f"id % 5 < {most}").selectExpr("id as k", "cast(null as string) as x")
    for looked_up in (X.LOOKED_UP, 3):
        monkeypatch.setattr(X, "LOOKED_UP", looked_up)
        assert X._occurring(rows(5), side, ["c"]) == {"c": ["c0", "c1", "c2", "c4", "missing"]}
        assert X._occurring(rows(3), side, ["c"]) == {"c": ["c0", "c1", "c2"]}
