"""Contracts as rows, exact quantiles, matched backgrounds, entity functions, split columns, and the order of FASTA parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evbench.functions import text as T
from evbench.operators import contracts as C
from evbench.operators import evidence as E
from evbench.operators import quantiles as Q
from evbench.operators import reports as R
from evbench.sources import readers


def test_contracts(spark):
    rules = spark.createDataFrame(
        [("id", "yes", "integer", "", ""), ("kind", "True", "", "a | b", ""), ("day", "yes_for_temporal", "date", "", ""), ("score", "no", "float", "", ""), ("code", None, None, None, "[A-Z]+"), ("gone", "yes", "", "", ""), ("other", "yes_for_never", "", "", "")],
        "field string, required string, type string, allowed string, pattern string",
    )
    rows = [(1, "a", "2020-01-31", "1e-3", "AB", True), (2, " b ", None, "x", "A1", True), (3, "c", "", None, None, False), (4, None, "2020-13-01", ".5", " ", False), (5, "a|b", "2020-1-1", "-1.", "Ab", True)]
    df = spark.createDataFrame(rows, "id int, kind string, day string, score string, code string, temporal boolean")
    got = {(r.id, r.field, r.violation) for r in C.violations(df, "id", rules, {"temporal": F.col("temporal")}).collect()}
    want = {(i, "gone", "no column") for i in range(1, 6)}
    want |= {(2, "day", "missing"), (2, "score", "not float"), (2, "code", "pattern"), (3, "kind", "not allowed"), (4, "kind", "missing"), (4, "day", "not date"), (5, "kind", "not allowed"), (5, "day", "not date"), (5, "code", "pattern")}
    assert got == want
    only = C.violations(df, "id", rules.select("field", "required")).where("field <> 'gone'")
    assert {(r.id, r.field, r.violation) for r in only.collect()} == {(4, "kind", "missing")}
    assert C.violations(df.limit(0), "id", rules).count() == 0 and C.violations(df, "id", rules.limit(0)).count() == 0


def test_exact_quantiles(spark):
    rnd = random.Random(1)
    groups = {
        "normal": [rnd.gauss(0, 1) for _ in range(400)], "ties": [rnd.choice([-1.0, 0.0, 0.0, 2.5]) for _ in range(300)], "one": [7.0], "two": [1.0, 2.0], "same": [5.5] * 50,
        "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) for _ in range(200)] + [0.0, 5e-324, -5e-324], None: [float(k) for k in range(11)], "close": [1000 + k * 1e-9 for k in range(500)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("normal", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {r.g: r for r in Q.exact_quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for k, q in enumerate(shares):
            at = (len(vs) - 1) * q
            lo, hi = sorted(vs)[int(np.floor(at))], sorted(vs)[int(np.ceil(at))]
            assert got[g][f"q{k}"] == pytest.approx(lo + (at - np.floor(at)) * (hi - lo) if hi != lo else lo, rel=1e-12), (g, q)
    assert Q.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_matched_background(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.random(), rnd.random() < 0.4, rnd.choice(["x", "x", "y", None]), int(rnd.paretovariate(1))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, score double, hit boolean, kind string, degree int")
    k, bins, per = 60, 4, 8
    got = {(r.kind, r.bin): r for r in R.matched_background(df, "id", "score", "hit", "kind", "degree", k, bins, per, 5).collect()}
    below = {d: sum(r[4] < d for r in rows) for d in {r[4] for r in rows}}
    bin_of = {r[0]: below[r[4]] * bins // len(rows) for r in rows}
    top = {r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}
    for (kind, b), r in got.items():
        own = [x for x in rows if x[3] == kind and bin_of[x[0]] == b]
        best, rest = [x for x in own if x[0] in top], [x for x in own if x[0] not in top]
        assert (r.top_n, r.top_hits, r.wanted) == (len(best), sum(x[2] for x in best), per * len(best))
        assert r.matched == min(len(rest), r.wanted) and r.shortfall == r.wanted - r.matched and r.matched_hits <= sum(x[2] for x in rest)
    assert sum(r.top_n for r in got.values()) == k and any(r.shortfall for r in got.values())


def test_entity_functions(spark):
    rows = [(" a ", "B", "s1; s2 and S1", "p|q"), ("", None, "", None), ("b", "A", "NA", ""), (None, "x", "s3", "nan, P"), ("c", "", "s", "p")]
    df = spark.createDataFrame(rows, "a string, b string, site string, owner string")
    got = [tuple(r) for r in df.select(T.pair_entities(F.col("a"), F.col("b")), T.site_entities(F.col("site"), F.col("owner")), T.site_entities(F.col("site")), T.value_entities(F.col("owner"))).collect()]
    assert got[0] == (["A||B"], ["P:S1", "P:S2", "Q:S1", "Q:S2"], ["S1", "S2", "S1"], ["P", "Q"])
    assert got[1] == ([], [], [], []) and got[2] == (["A||B"], [], [], []) and got[3] == (["||X"], ["P:S3"], ["S3"], ["P"]) and got[4][0] == ["||C"]


def test_split_columns(spark):
    df = spark.createDataFrame([("1", "x", " TRAIN "), ("2", None, None)], "split string, Sub_Set string, Fold string")
    assert T.find_split_column(df) == "Fold"
    assert T.find_split_column(df.withColumn("sub-set", F.lit("dev"))) == "sub-set"
    assert T.find_split_column(df.select("split")) is None and T.find_split_column(df.select(F.col("split").alias("other"))) is None


@pytest.mark.parametrize("size", ["64", "300", "128m"])
def test_fasta_parts_follow_the_files(spark, tmp_path, size):
    # a short file that comes first by name, and a long one that Spark puts first
    (tmp_path / "a.fasta").write_text(">sp|X|one\nAAA\n>sp|Y|y\nCCC\n")
    (tmp_path / "b.fasta").write_text("".join(f">sp|{'X' if k % 3 == 0 else f'Z{k}'}|more\n{'DEFGH'[k % 5] * 7}\n" for k in range(90)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {r.accession: r.sequence for r in readers.fasta(spark, str(tmp_path)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got["X"] == "AAA" + "".join("DEFGH"[k % 5] * 7 for k in range(0, 90, 3)) and got["Y"] == "CCC"


def test_delimited_files_in_splits_and_with_quoted_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿a,b\n1,"x ""y"""\n2,\n')
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "t.csv")).collect()] == [("1", 'x "y"'), ("2", None)]
    (tmp_path / "q.csv").write_text('a,b\n1,"two\nlines"\n')
    assert readers.delimited(spark, str(tmp_path / "q.csv"), quoted_breaks=True).collect()[0].b == "two\nlines"


def test_keyword_rows(spark):
    df = spark.createDataFrame([(i, f"name {'gear' if i % 4 == 0 else 'none'}", None) for i in range(100)], "id int, a string, b string")
    order = [F.desc("id")]
    assert [r.id for r in E.keyword_rows(df, ["a", "b"], "GEAR", order, most=5).collect()] == [96, 92, 88, 84, 80]
    assert sorted(r.id for r in E.keyword_rows(df, ["a", "b"], "gear", order, least=26, fallback=3).collect()) == [97, 98, 99]
    assert E.keyword_rows(df, ["a", "b"], "nothing", order).count() == 60
