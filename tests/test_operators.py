"""Small tables with answers worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from evbench.functions import sequences as Q
from evbench.functions import text as T
from evbench.operators import evidence as E
from evbench.operators import graphs as G
from evbench.operators import joins as J
from evbench.operators import metrics as M
from evbench.operators import splits as S
from evbench.sources import readers as R


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_text(spark):
    assert one(spark, T.clean_text(F.lit(" N/A "))) is None
    assert one(spark, T.tokens(F.lit("A1; b2 and C3|NA"))) == ["A1", "B2", "C3"]
    assert one(spark, T.pair_key(F.lit("P2"), F.lit("P1"))) == "P1||P2"
    assert one(spark, T.first_of_many(F.lit("P1-2; P3"), True)) == "P1"
    assert one(spark, T.lenient_int(F.lit("x"))) is None


def test_windows_and_crops(spark):
    s = F.lit("A" * 40)
    assert [len(one(spark, Q.window_around(s, F.lit(p)))) for p in (1, 20, 40)] == [16, 31, 16]
    got = [one(spark, Q.crop_around(F.lit("ACDEFGHIKL"), F.lit(p), 4)) for p in (1, 5, 10)]
    assert [(g.start, g["at"]) for g in got] == [(0, 0), (2, 2), (6, 3)]
    assert one(spark, Q.kmers(F.lit("AC"), 3)) == []


def test_validation(spark):
    rows = [("a", "K", "2"), ("a", "S", "2"), ("a", "K", "9"), ("a", None, "2"), ("a", "KK", "2"), ("a", "K", "x"), ("a", "K", "0")]
    df = spark.createDataFrame(rows, "id string, residue string, position string").coalesce(1)
    checked = E.validate(df, spark.createDataFrame([("a", "MKT")], "accession string, sequence string"), "id", "residue", "position")
    want = {("K", "2"): [], ("S", "2"): ["residue_mismatch"], ("K", "9"): ["position_out_of_range"], (None, "2"): ["missing_residue"], ("KK", "2"): ["invalid_residue", "residue_mismatch"], ("K", "x"): ["invalid_position"], ("K", "0"): []}
    assert {(r.residue, r.position): r.reasons for r in checked.collect()} == want


def test_ranking_metrics(spark):
    df = spark.createDataFrame(list(zip([1, 0, 1, 1, 0], [0.9, 0.8, 0.8, 0.4, 0.1], range(5))), "y int, p double, id int").withColumn("g", F.lit(1))
    assert M.auroc(df, ["g"], "y", "p").first().auroc == 0.75
    assert M.average_precision(df, ["g"], "y", "p").first().auprc == pytest.approx(0.8055556, abs=1e-6)
    assert M.ece(df, ["g"], "y", "p").first().ece == pytest.approx(0.28)


def test_components_and_stars(spark):
    rows = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"]), (2, ["b"]), (3, ["c"]), (4, [])], "row long, e array<string>")
    got = {r.row: r.component for r in G.entity_components(rows, "row", F.col("e")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    m = spark.createDataFrame([("x", "g", i) for i in range(4)], "axis string, key string, row long")
    assert G.axis_edge_counts(m, 3).first().edges == 0
    m = spark.createDataFrame([("x", "g", i) for i in range(3)] + [("x", "h", i) for i in range(2)], "axis string, key string, row long")
    assert G.axis_edge_counts(m, 350).first().edges == 4


def test_topology_self_loop(spark):
    train = spark.createDataFrame([("A", "A"), ("A", "B"), ("A", "B")], "a string, b string")
    r = G.topology_features(train, spark.createDataFrame([("A", "B"), ("A", "Z")], "a string, b string")).collect()
    assert {(x.a, x.b): (x.deg_a, x.deg_b, x.same_component, x.edge_exists) for x in r} == {("A", "B"): (3, 1, True, True), ("A", "Z"): (3, 0, False, False)}


def test_fill_agrees_with_the_greedy():
    rnd = random.Random(3)
    for _ in range(200):
        sizes = [rnd.choice([1, 1, 1, 2, 3, 5, 8, 40]) for _ in range(rnd.randint(1, 60))]
        total = sum(sizes)
        d = [14 * total, 3 * total, 3 * total]
        want = {}
        for s in sorted(sizes, reverse=True):
            k = max(range(3), key=lambda i: (d[i], -i))
            d[k] -= 20 * s
            want.setdefault(s, [0, 0, 0])[k] += 1
        assert S.fill([(s, sizes.count(s)) for s in set(sizes)]) == want


def test_splits_keep_groups_whole(spark):
    df = spark.createDataFrame([(str(i % 37), i % 5 == 0) for i in range(1000)], "k string, label boolean")
    for split in (S.group_split(df, "k", 1), S.stratified_group_split(df, "k", "label", 1)):
        long = S.attach(df, split, "k").select(F.lit("s").alias("split"), F.col("k").alias("key"), "part", "label")
        a = S.audit(long).first()
        assert a.train_valid_overlap == a.train_test_overlap == a.valid_test_overlap == 0
        assert a.train_rows + a.valid_rows + a.test_rows == 1000


def test_shuffled_labels_keep_the_multiset(spark):
    df = spark.createDataFrame([(i, "train" if i < 70 else "test", i % 3) for i in range(100)], "id long, part string, label int")
    r = S.shuffled_labels(df, "id", "label", "part", 5).collect()
    for p in ("train", "test"):
        assert sorted(x.label for x in r if x.part == p) == sorted(x.shuffled for x in r if x.part == p)


def test_nearest(spark):
    p = spark.createDataFrame([("g", 1, 5), ("g", 2, 11), ("h", 3, 4)], "g string, id int, v int")
    s = spark.createDataFrame([("g", 0, 5), ("g", 0, 14)], "g string, id int, v int")
    assert {r.id: r.distance for r in J.nearest(p, s, "g", "id", "v").collect()} == {1: 0, 2: 3, 3: None}


def test_fasta_and_tables(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|A1|X y\nMK\nTT\n>B2 z\nACD\n>sp|A1|X\nGG\n")
    assert {r.accession: r.sequence for r in R.fasta(spark, str(tmp_path / "a.fasta")).collect()} == {"A1": "MKTTGG", "B2": "ACD"}
    (tmp_path / "t.csv").write_text("﻿a,b\n1,x\n", encoding="utf-8")
    assert R.any_table(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    (tmp_path / "t.json").write_text('{"rows": [{"a": 1}, {"a": 2, "b": 3}]}')
    assert R.any_table(spark, str(tmp_path / "t.json")).count() == 2
    with pytest.raises(ValueError, match="missing columns: c"):
        R.delimited(spark, str(tmp_path / "t.csv"), required=["c", "a"])


def test_calibration_recovers_a_logit(spark):
    import math

    from evbench.operators import statistics as St

    rows = []
    for k in range(1, 20):
        p = k / 20
        true = 1 / (1 + math.exp(-(0.5 + 2 * math.log(p / (1 - p)))))
        rows += [("g", int(i < round(true * 1000)), p) for i in range(1000)]
    r = St.calibration(spark.createDataFrame(rows, "g string, y int, p double"), ["g"], "y", "p").first()
    assert r.intercept == pytest.approx(0.5, abs=0.03) and r.slope == pytest.approx(2, abs=0.05)


def test_skipped_split_and_first_key(spark):
    df = spark.createDataFrame([(str(i % 9), i % 2 == 0) for i in range(90)], "k string, label boolean")
    long, status = S.split_or_skip(df, [("a", "k", 1), ("b", "nope", 2)])
    assert {(r.split, r.status) for r in status.collect()} == {("a", "made"), ("b", "skipped")} and long.count() == 90
    src = spark.createDataFrame([("3", "yes"), ("3", "yes")], "k string, y string")
    assert J.join_by_first_key(df, src, [["zzz"], ["k"]], "y").where("y = 'yes'").count() == 10
    with pytest.raises(ValueError):
        J.join_by_first_key(df, src, [["zzz"]], "y")


def test_components_of_chains_and_hubs(spark):
    from evbench.operators import graphs

    e = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 80)] + [(500, 500)]
    got = dict(map(tuple, graphs.components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and got[279] == 200 and got[500] == 500
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_containment_of_long_and_short_needles(spark):
    from evbench.operators import joins

    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000))
    needles = [(1, text[500:700]), (2, text[:90]), (3, text[-90:]), (4, text[100:130]), (5, "z" * 100), (6, text[5:15]), (7, text)]
    n = spark.createDataFrame(needles, "needle_id long, needle string")
    t = spark.createDataFrame([(10, text), (11, text[400:800]), (12, ""), (13, None)], "text_id long, text string")
    got = {(r.needle_id, r.text_id): r.start for r in joins.contained(n, t).collect()}
    want = {(i, j): x.index(s) for i, s in needles for j, x in ((10, text), (11, text[400:800])) if len(s) >= 20 and s in x}
    assert got == want


def test_clusters_of_equal_and_like_sets(spark):
    import itertools
    import random

    from evbench.operators import similarity

    rnd = random.Random(3)
    sets = {i: sorted(rnd.sample(range(25), rnd.randint(1, 6))) for i in range(80)}
    sets |= {100 + i: sets[i] for i in range(20)}
    df = spark.createDataFrame(list(sets.items()), "id long, t array<long>")
    held = {}
    for s in sets.values():
        for x in s:
            held[x] = held.get(x, 0) + 1
    for cap in (None, 20):
        edges = {}
        for a, b in itertools.combinations(sorted(sets), 2):
            x, y = set(sets[a]), set(sets[b])
            if any(cap is None or held[z] <= cap for z in x & y) and len(x & y) / len(x | y) >= 0.5:
                edges[a, b] = len(x & y) / len(x | y)
        assert {(r.a, r.b): r.score for r in similarity.jaccard_edges(df, "id", "t", cap, 0.5).collect()} == edges
        label = {i: i for i in sets}
        for _ in sets:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert {r.id: r.cluster for r in similarity.jaccard_clusters(df, "id", "t", cap, 0.5).collect()} == label


def test_external_scores_refuse_shared_rows(spark):
    import pytest as p

    from evbench.operators import models

    rows = spark.createDataFrame([(i, float(i % 7), i % 2 == 0) for i in range(60)], "id long, x double, label boolean")
    with p.raises(ValueError, match="valid rows"):
        models.external_scores(rows, rows.where("id < 5"), rows, "id", "label", [], ["x"])
    with p.raises(ValueError, match="two classes"):
        models.fit_score(rows.selectExpr("id", "x", "true AS label", "'train' AS part"), "part", "label", [], ["x"], "logistic")
    out = models.external_scores(rows.where("id < 40"), rows.where("id >= 40 and id < 50"), rows.where("id >= 50"), "id", "label", [], ["x"])
    assert {(r.part, r.id) for r in out.collect()} == {("valid", i) for i in range(40, 50)} | {("external", i) for i in range(50, 60)}


def test_nearest_over_ranges(spark):
    """Sites are carried between the ranges of a hot group, whatever the number of ranges; null groups have no site."""
    points = [("hot", i, (i * 37) % 1000) for i in range(400)] + [("none", 1, 5), (None, 2, 5), ("hot", 9000, None)]
    sites = [("hot", v) for v in (3, 400, 401, 990)] + [(None, 5)]
    p = spark.createDataFrame(points, "g string, i int, v int").repartition(7)
    s = spark.createDataFrame(sites, "g string, v int")
    places = [v for _, v in sites[:4]]
    want = {(g, i): min(abs(v - x) for x in places) if g == "hot" and v is not None else None for g, i, v in points}
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            got = {(r.g, r.i): r.distance for r in J.nearest(p, s, "g", "i", "v").collect()}
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert got == want


def test_pair_degrees_blank_and_reversed(spark):
    train = spark.createDataFrame([("a", "B ", True), ("b", "a", True), ("c", "", True), ("c", "d", False)], "a string, b string, y boolean")
    rows = spark.createDataFrame([(1, "A", "b"), (2, "c", "d"), (3, "", None)], "i int, a string, b string")
    got = {r.i: (r.deg_a, r.deg_b, r.deg_product, r.either_seen, r.both_seen, r.pair_seen, r.degree_source) for r in G.pair_degree_features(train, rows, "a", "b", "y").collect()}
    assert got == {1: (2, 2, 4, 1, 1, 1, "train_positive_rows"), 2: (0, 0, 0, 0, 0, 0, "train_positive_rows"), 3: (0, 0, 0, 0, 0, 0, "train_positive_rows")}
    assert {r.degree_source for r in G.pair_degree_features(train.where("not y"), rows, "a", "b", "y").collect()} == {"all_train_rows"}


def test_quantile_candidates_are_percentiles(spark):
    import numpy as np

    for scores in ([0.5], [0.1, 0.1, 0.9], [round((i * i % 97) / 97, 3) for i in range(251)]):
        df = spark.createDataFrame([("g", s) for s in scores], "g string, p double")
        got = sorted(r.s for r in M.quantile_candidates(df, ["g"], "p").collect())
        assert np.allclose(got, np.percentile(scores, range(2, 99)))


def test_summary_sink_nests(spark, tmp_path):
    row = spark.sql("select 3 as n, named_struct('a', 1, 'b', null) as part, map('x', 2) as counts")
    R.write_summary(row, f"file://{tmp_path}/s")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/s").collect()] == ['{"n":3,"part":{"a":1},"counts":{"x":2}}']
