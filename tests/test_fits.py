"""Grouped fits against Spark ML, gradients, skipped groups; sparse packs against dense arrays."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from evbench.operators import fits as L
from evbench.operators import models as K
from evbench.operators import packs as X


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    out = []
    for i in range(400):
        x = [rnd.gauss(0, 1), rnd.gauss(5, 20), rnd.random(), 0.0, float(rnd.random() < 0.2)]
        out.append((i, rnd.random() < 1 / (1 + math.exp(-(1.5 * x[0] - 0.05 * x[1] + x[4]))), *x))
    df = spark.createDataFrame(out, "id long, label boolean, a double, b double, c double, zero double, flag double").repartition(3)
    blocks = {"all": X.dense([F.col(x) for x in ("a", "b", "c", "zero", "flag")]), "two": X.dense([F.col("a"), F.col("flag")])}
    return X.with_packs(df, blocks, {"e_all": [X.Part("all")], "e_two": [X.Part("two")]})


@pytest.fixture(scope="module")
def splits(rows):
    part = lambda k: F.when((F.col("id") + k) % 10 < 7, "train").when((F.col("id") + k) % 10 < 8, "valid").otherwise("test")
    long = rows.select("id", F.lit("x").alias("split"), part(0).alias("part")).unionByName(rows.where("id % 3 > 0").select("id", F.lit("y").alias("split"), part(4).alias("part")))
    return long.unionByName(rows.where("label").select("id", F.lit("one class").alias("split"), F.lit("train").alias("part")))


def test_grouped_fits_are_those_of_spark_ml(rows, splits):
    names, families = ["x", "y", "one class"], {"all": L.Family("e_all", 5), "two": L.Family("e_two", 2), "prior": L.Family(None)}
    ready = L.with_parts(rows, "id", splits, names).cache()
    fits, status = L.fit(ready, names, families)
    assert {k for k, v in status.items() if v == "ok"} == {(s, m) for s in ("x", "y") for m in families} and "one class" in {s for s, _ in status}
    for f in fits:
        train = rows.join(splits.where((F.col("split") == f.split) & (F.col("part") == "train")).select("id"), "id")
        if f.family.column is None:
            assert f.weights[0][0] == pytest.approx(train.agg(F.avg(F.col("label").cast("int"))).first()[0])
            continue
        dense = X.vectors(train.withColumn("y", F.col("label").cast("double")), {f.family.column: f.family.size})
        ml = LogisticRegression(featuresCol=f.family.column, labelCol="y", weightCol="weight", regParam=0.01, maxIter=500, tol=1e-12).fit(K.balanced(dense.withColumn("part", F.lit("train")), "part", "label"))
        assert np.allclose(np.concatenate([[ml.intercept], ml.coefficients.toArray()]), f.weights[0], atol=1e-4)
    got = L.scored(ready, "id", names, fits)
    assert got.groupBy("split", "model").count().count() == 6
    one = {r.id: r for r in got.where("split = 'y' and model = 'two'").collect()}
    w = next(f for f in fits if (f.split, f.model) == ("y", "two")).weights[0]
    for r in rows.where("id % 3 > 0").collect():
        assert one[r.id].score == pytest.approx(1 / (1 + math.exp(-(w[0] + w[1] * r.a + w[2] * r.flag)))) and one[r.id].label == r.label
        assert one[r.id].part == ("train" if (r.id + 4) % 10 < 7 else "valid" if (r.id + 4) % 10 < 8 else "test")
        assert one[r.id].confidence == max(one[r.id].score, 1 - one[r.id].score)


def test_networks_learn_and_weigh_classes(rows, splits):
    preds, status = K.harness(rows, "id", splits, ["x", "y"], {"net": L.Family("e_all", 5, "mlp"), "prior": L.Family(None)})
    assert set(status.values()) == {"ok"}
    from evbench.operators import metrics as M

    au = {(r.split, r.model): r.auroc for r in M.auroc(preds.where("part <> 'train'"), ["split", "model"], "label", "score").collect()}
    assert au["x", "net"] > 0.65 and au["y", "net"] > 0.65 and au["x", "prior"] == 0.5


def test_gradient_of_the_network():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float), rng.random(30) + 0.5
    p = rng.normal(size=4 * L.HIDDEN + 1 + L.HIDDEN) * 0.5
    loss, g = L._gradient(p, x, y, w, 0.01)
    for k in range(0, len(p), 7):
        e = np.zeros_like(p)
        e[k] = 1e-6
        assert g[k] == pytest.approx((L._gradient(p + e, x, y, w, 0.01)[0] - L._gradient(p - e, x, y, w, 0.01)[0]) / 2e-6, abs=1e-6)
    assert loss > 0


def test_skips_and_limits(spark, rows, splits):
    with pytest.raises(ValueError, match="at most"):
        L.fit(rows, ["x"], {"wide": L.Family("e_all", 5000)})
    empty = L.with_parts(rows.limit(0), "id", splits, ["x"])
    assert L.fit(empty, ["x"], {"all": L.Family("e_all", 5)})[0] == []


def hashed(s, k, dims, salt):
    out = np.zeros(dims)
    for i in range(len(s) - k + 1):
        d = hashlib.md5((salt + s[i : i + k]).encode()).hexdigest()
        out[int(d[:8], 16) % dims] += 1 - 2 * (int(d[8:10], 16) % 2)
    n = np.linalg.norm(out)
    return out / n if n else out


def test_packs_against_dense_arrays(spark):
    rnd = random.Random(6)
    seqs = ["".join(rnd.choice(X.LETTERS + "BX") for _ in range(rnd.randint(0, 60))) for _ in range(12)] + [None, ""]
    df = spark.createDataFrame([(i, seqs[i % 14], rnd.choice(["u", "v", None]), rnd.choice([0.0, 2.5, None])) for i in range(50)], "id long, s string, kind string, x double")
    made = X.hashed_kmers(df, "s", F.col("s"), 3, 16, "t").toDF("s", "h")
    j = df.join(made, "s", "left").withColumn("h", F.coalesce("h", F.array().cast(X.ENTRIES)))
    blocks = {"hash": X.Block(F.col("h"), 16), "comp": X.composition(F.col("s")), "desc": X.descriptors(F.col("s")), "kind": X.one_hot([(F.col("kind"), ["missing", "u", "v"])]), "x": X.dense([F.col("x")])}
    parts = [X.Part("x"), X.Part("hash"), X.Part("comp", 5), X.Part("kind"), X.Part("desc"), X.Part("hash", 4)]
    size = X.stacked(blocks, parts).size
    assert size == 1 + 16 + 5 + 3 + 8 + 4 and X.manifest(blocks, {"p": parts})[-1] == ("p", 5, "hash", 33, 4)
    got = {r.id: r for r in X.vectors(X.with_packs(j, blocks, {"p": parts}), {"p": size}).collect()}
    for i, s, kind, x in df.collect():
        t = "".join(c for c in (s or "").upper() if c in X.LETTERS)
        share = lambda g: sum(c in g for c in t) / len(t) if t else 0.0  # noqa: B023, E731
        want = np.concatenate([[x or 0], hashed(t, 3, 16, "t"), [share(c) for c in X.LETTERS[:5]], [float((kind or "missing") == c) for c in ("missing", "u", "v")], [math.log1p(len(t)), *map(share, X.DESCRIPTORS)], hashed(t, 3, 16, "t")[:4]])
        v = got[i].p
        assert isinstance(v, SparseVector) and v.size == size and np.allclose(v.toArray(), want) and len(v.indices) == np.count_nonzero(want)
    a, b = F.array(*[F.struct(F.lit(k).alias("i"), F.lit(v).alias("v")) for k, v in ((0, 1.0), (3, 2.0), (7, 1.0))]), F.array(*[F.struct(F.lit(k).alias("i"), F.lit(v).alias("v")) for k, v in ((0, 1.0), (2, 4.0), (7, 3.0))])
    assert [tuple(x) for x in spark.range(1).select(X.difference(a, b).alias("d")).first().d] == [(2, -4.0), (3, 2.0), (7, -2.0)]
