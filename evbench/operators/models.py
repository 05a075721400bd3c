"""Baseline models on Spark ML: fitted on train rows alone, scored on every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import cut
from .fits import Family, fit, scored, with_parts


def prior(rows: DataFrame, part: str, label: str) -> DataFrame:
    """rows with score: the positive rate of train."""
    rate = rows.where(F.col(part) == "train").agg(F.round(F.avg(F.col(label).cast("int")), 9)).first()[0]  # one number
    return rows.withColumn("score", F.lit(rate))


def balanced(rows: DataFrame, part: str, label: str) -> DataFrame:
    """rows with weight: train classes weigh alike."""
    n = {r[label]: r.n for r in rows.where(F.col(part) == "train").groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    total = sum(n.values())
    weight = F.lit(None).cast("double")
    for k, c in n.items():
        weight = F.when(F.col(label) == k, total / (len(n) * c)).otherwise(weight)
    return rows.withColumn("weight", F.coalesce(weight, F.lit(1.0)))


def classifier(kind: str, n_features: int, seed: int = 7):
    y = dict(featuresCol="features", labelCol="y")
    if kind == "logistic":
        return LogisticRegression(weightCol="weight", maxIter=30, regParam=0.01, **y)
    if kind == "forest":
        return RandomForestClassifier(numTrees=300, minInstancesPerNode=2, weightCol="weight", seed=seed, **y)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 16, 2], maxIter=40, seed=seed, **y)
    raise ValueError(f"unknown model {kind!r}")


def fit_score(rows: DataFrame, part: str, label: str, categories: Sequence[str], numbers: Sequence[str], kind: str, least_train: int = 2) -> DataFrame:
    """rows with score and confidence.  Indexers, encoders and scalers see train alone; unseen categories have a place of their own.

    Raises ValueError where train has fewer than least_train rows or one class only, as the split can't be used.
    """
    rows = balanced(rows.withColumn("y", F.col(label).cast("double")), part, label)
    train = rows.where(F.col(part) == "train")
    n, k = train.agg(F.count(F.lit(1)), F.count_distinct("y")).first()
    if n < least_train or k < 2:
        raise ValueError(f"train has {n} rows of {k} classes; {least_train} rows of two classes are needed")
    stages = []
    if categories:
        stages.append(StringIndexer(inputCols=list(categories), outputCols=[f"{c}_i" for c in categories], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories], handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*[f"{c}_v" for c in categories], *numbers], outputCol="raw", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=False))
    prep = Pipeline(stages=stages).fit(train)
    ready = prep.transform(train)
    size = len(ready.select("features").first()[0])
    model = classifier(kind, size).fit(ready)
    scored = model.transform(prep.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*[c for c in rows.columns if c not in ("y", "weight")], "score", F.greatest("score", 1 - F.col("score")).alias("confidence"))


def stacked(preds: DataFrame, ident: str, part: str, label: str, models: Sequence[str]) -> DataFrame:
    """A logistic stack of pivoted scores, fitted on valid; a missing score counts as that model's mean on valid."""
    wide = preds.groupBy(ident, part, label).pivot("model", list(models)).agg(F.avg("score"))
    filled = Imputer(inputCols=list(models), outputCols=[f"{m}_f" for m in models]).fit(wide.where(F.col(part) == "valid")).transform(wide)
    renamed = filled.withColumn(part, F.when(F.col(part) == "valid", "train").otherwise(F.col(part)))
    return fit_score(renamed, part, label, [], [f"{m}_f" for m in models], "logistic").select(ident, part, label, "score")


def aligned(probs: DataFrame, ident: str, classes: Sequence[str]) -> DataFrame:
    """(id, class, p) for every class, 0 where the model doesn't know it."""
    ids = probs.select(ident).distinct().withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    return ids.join(probs, [ident, "class"], "left").fillna(0.0, ["p"])


def harness(rows: DataFrame, ident: str, splits: DataFrame, names: Sequence[str], families: dict[str, Family]) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """(predictions (id, split, model, part, label, score, confidence), status per split and model) of every split and model.

    rows: (id, label, the families' columns of entries); splits: long table (id, split, part).  All groups are fitted together on their own train rows,
    in as many jobs as one of them takes; a split whose train can't be used is skipped with its reason.
    """
    ready = cut(with_parts(rows, ident, splits, names))
    fits, status = fit(ready, names, families)
    return scored(ready, ident, names, fits), status


def external_scores(train: DataFrame, valid: DataFrame, external: DataFrame, ident: str, label: str, categories: Sequence[str], numbers: Sequence[str], kind: str = "logistic") -> DataFrame:
    """(id, part, label, score, confidence) of external and valid rows by a model that is fitted on train and then frozen.

    Raises ValueError if valid rows are train rows too: a threshold must come from rows that the model hasn't seen.
    """
    if not train.select(ident).join(valid.select(ident), ident, "left_semi").isEmpty():
        raise ValueError("valid rows are among the train rows")
    every = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid"))).unionByName(external.withColumn("part", F.lit("external")))
    return fit_score(every, "part", label, categories, numbers, kind).where("part <> 'train'").select(ident, "part", label, "score", "confidence")


def labelled(preds: DataFrame, threshold: Column | float) -> DataFrame:
    """Predictions with the label that the threshold gives."""
    return preds.withColumn("threshold", F.lit(threshold) if isinstance(threshold, float) else threshold).withColumn("predicted", F.col("score") >= F.col("threshold"))
