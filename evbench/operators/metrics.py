"""Ranking, calibration and threshold metrics of many (split, model, ...) groups at once, as aggregates.

Frames have group columns `by`, a boolean or 0/1 label and a score.  Sums that decide are of integers; the last division is
of doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running

#: Lower edges of ten equal bins above the first, as numpy's linspace gives them.
ECE_EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def _histogram(df: DataFrame, by: Sequence[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """(by, s, pos, neg): one row per distinct score, so that ties are one step."""
    y = F.col(label).cast("long")
    w = weight if weight is not None else F.lit(1)
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(y * w).alias("pos"), F.sum((1 - y) * w).alias("neg"))


def _bucket(s: str = "s") -> Column:
    """Scores lie in 0..1: a monotone bucket of bounded number."""
    return F.floor(F.col(s) * 1024).cast("int")


def auroc(df: DataFrame, by: Sequence[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """(by, auroc): ties count half; null where a class is missing."""
    h = running(_histogram(df, by, label, score, weight), by, "s", ["neg"], _bucket())
    wins = F.sum(F.col("pos") * (2 * (F.col("cum_neg") - F.col("neg")) + F.col("neg")))
    out = h.groupBy(*by).agg(wins.alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("wins") / (2 * F.col("p") * F.col("n")), 9)).alias("auroc"))


def average_precision(df: DataFrame, by: Sequence[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """(by, auprc): the step-wise sum of precision over recall gains, without interpolation."""
    h = running(_histogram(df, by, label, score, weight), by, "s", ["pos", "neg"], _bucket(), descending=True)
    part = F.sum(F.col("pos") * F.col("cum_pos") / F.nullif(F.col("cum_pos") + F.col("cum_neg"), F.lit(0)))
    out = h.groupBy(*by).agg(part.alias("a"), F.sum("pos").alias("p"))
    return out.select(*by, F.when(F.col("p") > 0, F.round(F.col("a") / F.col("p"), 9)).alias("auprc"))


def macro_auroc(df: DataFrame, by: Sequence[str], truth: str, scores: dict[str, str]) -> DataFrame:
    """(by, macro_auroc): the mean one-against-rest AUROC; scores: class -> score column."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), (F.col(truth) == c).cast("int").alias("y"), F.col(s).alias("p")) for c, s in scores.items()])).alias("x")).select(*by, "x.*")
    each = auroc(long, [*by, "c"], "y", "p")
    n = F.count(F.lit(1))
    return each.groupBy(*by).agg(F.when(F.count("auroc") == n, F.round(F.avg("auroc"), 8)).alias("macro_auroc"))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    d = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(d > 0, (tp * tn - fp * fn) / F.sqrt(d)).otherwise(0.0)


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def confusion(df: DataFrame, by: Sequence[str], label: str, score: str, threshold: Column | float) -> DataFrame:
    """(by, tp, fp, fn, tn, accuracy, balanced_accuracy, macro_f1, mcc): balanced accuracy averages over classes that occur."""
    y, p = F.col(label).cast("boolean"), F.col(score) >= threshold
    c = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    sens, spec = tp / F.nullif(tp + fn, F.lit(0)), tn / F.nullif(tn + fp, F.lit(0))
    balanced = F.when(sens.isNull(), spec).when(spec.isNull(), sens).otherwise((sens + spec) / 2)
    r = lambda x, name: F.round(x, 9).alias(name)
    return c.select(*by, "tp", "fp", "fn", "tn", r((tp + tn) / (tp + fp + fn + tn), "accuracy"), r(balanced, "balanced_accuracy"), r((_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2, "macro_f1"), r(mcc(tp, fp, fn, tn), "mcc"))


def brier_and_log_loss(df: DataFrame, by: Sequence[str], label: str, score: str, eps: float = 1e-6) -> DataFrame:
    y = F.col(label).cast("int")
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*by).agg(F.round(F.avg((F.col(score) - y) * (F.col(score) - y)), 7).alias("brier"), F.round(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))), 7).alias("log_loss"))


def ece(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """(by, ece): expected calibration error over ten equal bins, the last closed at 1."""
    b = sum((F.when(F.col(score) >= e, 1).otherwise(0) for e in ECE_EDGES), F.lit(0))
    bins = df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("y"), F.sum(score).alias("p"))
    return bins.groupBy(*by).agg(F.round(F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 7).alias("ece"))


def precision_at(df: DataFrame, by: Sequence[str], label: str, score: str, ident: str, k: int = 50) -> DataFrame:
    """(by, precision): of the k rows of highest score, fewer where a group is smaller; ties by id."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), ident)
    top = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return top.groupBy(*by).agg(F.round(F.avg(F.col(label).cast("int")), 9).alias("precision"))


def sweep(df: DataFrame, by: Sequence[str], label: str, score: str, candidates: DataFrame, objective: str = "mcc") -> DataFrame:
    """(by, threshold): the candidate (by, s) of the best objective; the lowest among ties; 0.5 where a class is missing."""
    h = _histogram(df, by, label, score).withColumn("c", F.lit(0))
    zero = F.lit(0).cast("long")
    marks = candidates.select(*by, "s").distinct().select(*by, "s", zero.alias("pos"), zero.alias("neg"), F.lit(1).alias("c"))
    u = h.unionByName(marks).groupBy(*by, "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("c").alias("c"))
    r = running(u, by, "s", ["pos", "neg"], _bucket(), descending=True)
    t = df.groupBy(*by).agg(F.sum(F.col(label).cast("long")).alias("P"), F.sum(1 - F.col(label).cast("long")).alias("N"))
    x = r.where("c = 1").join(t, list(by))
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    value = {"mcc": mcc(tp, fp, fn, tn), "macro_f1": (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2, "mcc_balanced": mcc(tp, fp, fn, tn) + (tp / F.col("P") + tn / F.col("N")) / 2}[objective]
    best = x.groupBy(*by).agg(F.max_by("s", F.struct(F.round(value, 9).alias("v"), (-F.col("s")).alias("t"))).alias("threshold"), F.min("P").alias("P"), F.min("N").alias("N"))
    return best.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("threshold")).otherwise(0.5).alias("threshold"))


def quantile_candidates(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """(by, s): the 2 % to 98 % quantiles of the scores, between two scores linearly; read off running counts, so that no group is held whole."""
    h = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    r = running(h, by, "s", ["n"], _bucket()).join(h.groupBy(*by).agg(F.sum("n").alias("of")), list(by))
    at = lambda k: (F.col("of") - 1) * (k / F.lit(100.0))
    holds = lambda place: (place >= F.col("cum_n") - F.col("n")) & (place < F.col("cum_n"))
    # the quantiles whose place, or the one after it, is one of this score's
    marks = F.filter(F.sequence(F.lit(2), F.lit(98)), lambda k: holds(F.floor(at(k))) | holds(F.ceil(at(k))))
    each = r.select(*by, "s", "n", "cum_n", "of", F.explode(marks).alias("k"))
    p = at(F.col("k"))
    one = lambda place: F.max(F.when(holds(place), F.col("s")))
    g = each.groupBy(*by, "k", p.alias("p")).agg(one(F.floor(p)).alias("lo"), one(F.ceil(p)).alias("hi"))
    between = (F.ceil("p") - F.col("p")) * F.col("lo") + (F.col("p") - F.floor("p")) * F.col("hi")
    return g.select(*by, F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.floor("p") == F.ceil("p"), F.col("lo")).otherwise(between).alias("s"))


def weighted_f1(df: DataFrame, by: Sequence[str], label: str, score: str, threshold: Column | float) -> DataFrame:
    """(by, weighted_f1): the F1 of both classes weighted by their rows."""
    c = confusion(df, by, label, score, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*by, F.round(((tp + fn) * _f1(tp, fp, fn) + (tn + fp) * _f1(tn, fn, fp)) / (tp + fp + fn + tn), 9).alias("weighted_f1"))


def prevalence_threshold(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """(by, threshold): the score quantile above which as large a share of rows lies as is positive, between two scores linearly."""
    h = _histogram(df, by, label, score).withColumn("n", F.col("pos") + F.col("neg"))
    r = running(h, by, "s", ["n"], _bucket())
    t = df.groupBy(*by).agg(F.count(F.lit(1)).alias("of"), F.sum(F.col(label).cast("long")).alias("hits"))
    # place (of - 1) (1 - hits / of) of the ascending scores, counted from 0, as a whole part and a rest
    place = (F.col("of") - 1) * (F.col("of") - F.col("hits"))
    x = r.join(t, list(by)).withColumn("lo", F.expr("((of - 1) * (of - hits)) div of")).withColumn("f", (place - F.col("lo") * F.col("of")) / F.col("of"))
    first = lambda k: F.min(F.when(F.col("cum_n") > F.col("lo") + k, F.col("s")))
    g = x.groupBy(*by).agg(first(0).alias("a"), first(1).alias("b"), F.first("f").alias("f"))
    return g.select(*by, F.round(F.col("a") + F.col("f") * (F.coalesce("b", "a") - F.col("a")), 9).alias("threshold"))


def class_confusion(df: DataFrame, by: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """(by, truth, predicted, n): the cells of the confusion of K classes that hold a row; null labels are no class and are left out."""
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, class, support, predicted, hits, precision, recall, f1) of each class that occurs as truth or prediction; 0 where undefined."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    ends = cells.select(*by, F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), hit.alias("h"))
    ends = ends.unionByName(cells.select(*by, F.col("predicted").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))
    g = ends.groupBy(*by, "class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    share = lambda x, of: F.when(of > 0, x / of).otherwise(0.0)
    t, p, h = F.col("support"), F.col("predicted"), F.col("hits")
    return g.withColumns({"precision": share(h, p), "recall": share(h, t), "f1": share(2 * h, t + p)})


def class_metrics(df: DataFrame, by: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """(by, n, classes, accuracy, balanced_accuracy, macro_f1, weighted_f1, mcc) of K classes.

    Balanced accuracy is the mean recall of the classes that occur; F1 averages over those that occur or are predicted; the correlation comes from the
    margins alone and is 0 where one of them is a single class.  What is aggregated twice has a row for each cell, at most K * K a group.
    """
    c = class_scores(class_confusion(df, by, truth, predicted), by)
    t, p, h = F.col("support"), F.col("predicted"), F.col("hits")
    d = lambda x: x.cast("double")
    g = c.groupBy(*by).agg(
        F.sum(t).alias("n"), F.count(F.lit(1)).alias("classes"), F.sum(h).alias("h"), F.avg(F.when(t > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
        (F.sum(t * F.col("f1")) / F.sum(t)).alias("weighted_f1"), F.sum(d(t) * d(p)).alias("tp"), F.sum(d(t) * d(t)).alias("tt"), F.sum(d(p) * d(p)).alias("pp"),
    )
    n = d(F.col("n"))
    below = (n * n - F.col("pp")) * (n * n - F.col("tt"))
    r = lambda x, name: F.round(x, 9).alias(name)
    correlation = F.when(below > 0, (d(F.col("h")) * n - F.col("tp")) / F.sqrt(below)).otherwise(0.0)
    return g.select(*by, "n", "classes", r(F.col("h") / F.col("n"), "accuracy"), *[r(F.col(x), x) for x in ("balanced_accuracy", "macro_f1", "weighted_f1")], r(correlation, "mcc"))


def class_log_loss(probs: DataFrame, by: Sequence[str], ident: str, truth: str, cls: str, p: str, eps: float = 1e-15) -> DataFrame:
    """(by, log_loss) of long probabilities (by, id, class, p): each id's are brought to a sum of 1, and its true class's is clipped to [eps, 1 - eps]."""
    own = probs.groupBy(*by, ident).agg(F.sum(p).alias("s"), F.sum(F.when(F.col(cls) == F.col(truth), F.col(p)).otherwise(0.0)).alias("p"))
    q = F.least(F.greatest(F.coalesce(F.col("p") / F.nullif(F.col("s"), F.lit(0.0)), F.lit(0.0)), F.lit(eps)), F.lit(1 - eps))
    return own.groupBy(*by).agg(F.round(F.avg(-F.ln(q)), 7).alias("log_loss"))


def metric_rows(preds: DataFrame, by: Sequence[str], label: str, score: str, ident: str, part: str = "part", parts: Sequence[str] = ("valid", "test"), resamples: int = 0, within: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """One row per group: sizes and positive rates of the parts, the threshold of best MCC on valid, and test metrics at it.

    resamples: the bounds of the middle 95 % of the average precision over so many resamples of the test ids, drawn within pools of the columns `within`.
    """
    y = F.col(label).cast("int")
    of = lambda p: F.col(part) == p
    sizes = preds.groupBy(*by).agg(*[F.count_if(of(p)).alias(f"{p}_n") for p in parts], *[F.round(F.avg(F.when(of(p), y)), 9).alias(f"{p}_rate") for p in parts])
    valid, test = preds.where(of("valid")), preds.where(of("test"))
    best = sweep(valid, by, label, score, quantile_candidates(valid, by, score))
    out = sizes.join(best, list(by))
    for one in (
        auroc(test, by, label, score),
        average_precision(test, by, label, score),
        confusion(test.join(best, list(by)), by, label, score, F.col("threshold")).select(*by, "mcc", "macro_f1", "balanced_accuracy"),
        brier_and_log_loss(test, by, label, score).select(*by, "brier"),
        ece(test, by, label, score),
        precision_at(test, by, label, score, ident).withColumnRenamed("precision", "precision_at_50"),
    ):
        out = out.join(one, list(by), "left")
    if resamples:
        from .statistics import bootstrap, interval

        drawn = interval(bootstrap(test, by, ident, label, score, resamples, seed, within), by)
        out = out.join(drawn.select(*by, F.col("lo").alias("auprc_ci_low"), F.col("hi").alias("auprc_ci_high")), list(by), "left")
    return out
