"""Reductions of metric tables: robustness, collapse, gates, ablations, leaderboards and scorecards.

A metric table has a row per (split, model) with auprc, mcc, ece and p_at_k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import overall_and_by
from .joins import nearest
from .ranks import hash_rank, running


def robust_scores(metrics: DataFrame, audit: DataFrame, random_split: str, controls: Sequence[str] = ()) -> DataFrame:
    """(model, robust): rewards mean quality over the shielded splits and takes off for missing splits, leaks and a bad worst case.

    .50 mean AUPRC + .25 (mean MCC + 1) / 2 + .25 mean precision - .20 share of splits missing - .10 for each leaking split
    - .20 max(0, .50 - worst AUPRC).
    """
    shielded = audit.where(F.col("split") != random_split)
    n_splits, leaking = shielded.agg(F.count(F.lit(1)), F.count_if(F.col("leaks"))).first()  # two numbers
    m = metrics.where((F.col("split") != random_split) & ~F.col("model").isin(*controls)).groupBy("model")
    s = m.agg(F.count_distinct("split").alias("splits"), F.avg("auprc").alias("a"), F.avg("mcc").alias("m"), F.avg("p_at_k").alias("p"), F.min("auprc").alias("worst"))
    missing = 1 - F.col("splits") / F.lit(n_splits)
    score = 0.5 * F.col("a") + 0.25 * (F.col("m") + 1) / 2 + 0.25 * F.col("p") - 0.2 * missing - 0.1 * F.lit(leaking) - 0.2 * F.greatest(F.lit(0.0), 0.5 - F.col("worst"))
    return s.select("model", "splits", F.round("worst", 7).alias("worst"), F.round(score, 7).alias("robust"))


def collapse(metrics: DataFrame, random_split: str) -> DataFrame:
    """(model, random_auprc, shielded_mean, shielded_min, drop): models missing on one side stay, with nulls."""
    r = metrics.where(F.col("split") == random_split).select("model", F.col("auprc").alias("random_auprc"))
    s = metrics.where(F.col("split") != random_split).groupBy("model").agg(F.round(F.avg("auprc"), 7).alias("shielded_mean"), F.min("auprc").alias("shielded_min"))
    return r.join(s, "model", "full").withColumn("drop", F.round(F.col("random_auprc") - F.col("shielded_mean"), 7))


def claim_gates(metrics: DataFrame, rules: Sequence[tuple[str, str, str]], margin: float = 0.02, least_mcc: float = 0.05, most_ece: float = 0.25) -> DataFrame:
    """(claim, model, passed): a claim holds on its split where AUPRC beats the baseline's by the margin, with MCC and ECE in bounds.

    rules: (claim, split, baseline model).  A missing baseline fails.
    """
    spark = metrics.sparkSession
    r = spark.createDataFrame(list(rules), "claim string, split string, baseline string")
    base = metrics.select("split", F.col("model").alias("baseline"), F.col("auprc").alias("base_auprc"))
    j = metrics.join(F.broadcast(r), "split").join(base, ["split", "baseline"], "left").where("model <> baseline")
    ok = (F.round(F.col("auprc") - F.col("base_auprc"), 9) >= margin) & (F.col("mcc") > least_mcc) & (F.col("ece") < most_ece)
    return j.select("claim", "model", F.round(F.col("auprc") - F.col("base_auprc"), 9).alias("margin"), F.coalesce(ok, F.lit(False)).alias("passed"))


def ablation_summary(metrics: DataFrame, reference: str, prefix: str) -> DataFrame:
    """(model, mean_auprc, delta): mean over splits; the difference to the reference only for models of the prefix."""
    per = metrics.groupBy("model").agg(F.round(F.avg("auprc"), 7).alias("mean_auprc"))
    ref = per.where(F.col("model") == reference).select("mean_auprc").first()  # one number
    delta = F.round(F.col("mean_auprc") - F.lit(ref[0] if ref else None).cast("double"), 7)
    return per.withColumn("delta", F.when(F.col("model").startswith(prefix), delta))


def leaderboard(frames: dict[str, DataFrame]) -> DataFrame:
    """All metric tables under their family, with each row's rank by AUPRC within its split."""
    from pyspark.sql import Window

    out = None
    for family, f in frames.items():
        g = f.select(F.lit(family).alias("family"), "split", "model", "auprc")
        out = g if out is None else out.unionByName(g)
    return out.withColumn("rank", F.rank().over(Window.partitionBy("split").orderBy(F.desc("auprc"))))


def scorecard(checks: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(criterion, status, evidence): each check is a one-row frame with a boolean `ok` and a text `evidence`."""
    out = None
    for name, frame, _ in checks:
        row = frame.select(F.lit(name).alias("criterion"), F.when(F.coalesce("ok", F.lit(False)), "met").otherwise("open").alias("status"), "evidence")
        out = row if out is None else out.unionByName(row)
    return out


def readiness(metrics: DataFrame, audit: DataFrame, gates: DataFrame, ablations: DataFrame, external: DataFrame, random_split: str, controls: Sequence[str], model: str, least_splits: int = 3) -> DataFrame:
    """(criterion, status, evidence): rules over the tables that an evaluation leaves, each as a one-row aggregate.

    Shielded splits without leaks, controls among the models, claims that pass their gates, a model that gains on its reference,
    a worst shielded split above chance, and an external set large enough and free of overlap.
    """
    one = lambda frame, ok, *text: frame.agg(ok.alias("ok"), F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in text]).alias("evidence"))
    n = lambda c: c.cast("string")
    shielded = audit.where(F.col("split") != random_split)
    splits, leaking = F.count_distinct("split"), F.count_if(F.col("leaks"))
    present = F.count_distinct(F.when(F.col("model").isin(*controls), F.col("model")))
    passed = F.count_if(F.col("passed"))
    gain = F.max(F.when(F.col("model") == model, F.col("delta")))
    worst = F.min(F.when((F.col("split") != random_split) & (F.col("model") == model), F.col("auprc")))
    checks = [
        ("shielded_splits", one(shielded, (splits >= least_splits) & (leaking == 0), n(splits), " splits, ", n(leaking), " leaking"), ""),
        ("controls", one(metrics, present == len(controls), n(present), f" of {len(controls)} controls"), ""),
        ("claims", one(gates, passed > 0, n(passed), " of ", n(F.count(F.lit(1))), " claims pass"), ""),
        ("ablation_gain", one(ablations, gain > 0, "delta ", F.coalesce(F.format_string("%.3f", gain), F.lit("unknown"))), ""),
        ("worst_split", one(metrics, worst >= 0.5, "AUPRC ", F.coalesce(F.format_string("%.3f", worst), F.lit("unknown"))), ""),
        ("external_set", one(external, F.max("status") == "validation", n(F.max("row_count")), " rows, ", n(F.max("overlaps")), " overlaps"), ""),
    ]
    return scorecard(checks)


def matched_distances(sites: DataFrame, interface: DataFrame, events: DataFrame) -> DataFrame:
    """(label, n, actual, expected, ratio, distance, null_distance, distance_ratio): for all events and for each label.

    sites: (chain, site, res); interface: (chain, site); events: (event, label, chain, site, res), a row per mapping.  A mapping is held
    against the sites of its residue in its chain: their share at the interface and their mean distance to it.  An event
    takes the best of its own mappings and the mean of what is expected.
    """
    near = nearest(sites.distinct(), interface, "chain", "res", "site")
    hit = (F.coalesce(F.col("distance"), F.lit(-1)) == 0).cast("int")
    null = near.groupBy("chain", "res").agg(F.avg(hit).alias("rate"), F.avg("distance").alias("away"))
    own = events.join(near, ["chain", "site", "res"], "left").join(null, ["chain", "res"], "left")
    per = own.groupBy("event").agg(F.min("label").alias("label"), F.max(hit).alias("hit"), F.min("distance").alias("distance"), F.avg("rate").alias("rate"), F.avg("away").alias("away"))
    mean = lambda c: F.round(F.avg(c), 6)
    ratio = lambda x, y: F.round(F.avg(x) / F.nullif(F.avg(y), F.lit(0.0)), 6)
    aggs = {"actual": mean("hit"), "expected": mean("rate"), "ratio": ratio("hit", "rate"), "distance": mean("distance"), "null_distance": mean("away"), "distance_ratio": ratio("distance", "away")}
    return overall_and_by(per, "label", F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in aggs.items()])


def seed_gate(deltas: DataFrame, least_positive: float = 0.8) -> DataFrame:
    return deltas.select("metric", "mean", "positive", ((F.col("mean") > 0) & (F.col("positive") >= least_positive)).alias("passed"))


def enrichment(scored: DataFrame, ident: str, score: str, hit: str, stratum: Sequence[str], k: int) -> DataFrame:
    """(k_used, hits, expected, ratio): hits among the k best rows against the rate of their strata among the other rows."""
    top = scored.orderBy(F.desc(score), ident).limit(k).select(ident, F.lit(True).alias("top"))
    rows = scored.join(top, ident, "left")
    back = rows.where("top is null").groupBy(*stratum).agg(F.avg(F.col(hit).cast("int")).alias("rate"))
    best = rows.where("top").join(back, list(stratum), "left")
    s = best.agg(F.count(F.lit(1)).alias("k_used"), F.sum(F.col(hit).cast("int")).alias("hits"), F.round(F.sum(F.coalesce("rate", F.lit(0.0))), 7).alias("expected"))
    return s.withColumn("ratio", F.when(F.col("expected") > 0, F.round(F.col("hits") / F.col("expected"), 6)))


def degree_bins(df: DataFrame, degree: str, bins: int, out: str = "bin") -> DataFrame:
    """df with the bin of its degree: bins hold like numbers of rows, and rows of one degree share a bin.

    A degree's bin follows from the running count of rows below it, over the distinct degrees.
    """
    h = df.groupBy(F.col(degree).alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    total = h.agg(F.sum("__n")).first()[0] or 1  # one number
    bucket = F.floor(16 * F.log2(F.greatest(F.col("__d"), F.lit(0)).cast("double") + 1)).cast("int")
    below = running(h.where(F.col("__d").isNotNull()), [], "__d", ["__n"], bucket)
    at = below.select("__d", F.floor((F.col("cum___n") - F.col("__n")) * bins / F.lit(total)).cast("int").alias(out))
    return df.join(at, F.col(degree) == F.col("__d"), "left").drop("__d")


def matched_background(scored: DataFrame, ident: str, score: str, hit: str, kind: str, degree: str, k: int, bins: int = 5, per_row: int = 1, seed: int = 0) -> DataFrame:
    """(kind, bin, top_n, top_hits, wanted, matched, shortfall, matched_hits): the k best rows against as many others, per_row for each, of
    their kind and degree bin, matched without replacement.

    Within a stratum the others come in the order of a seeded digest of their ids; where there are too few, the shortfall says so and nothing
    from elsewhere fills in.  Ties of the score go by id.
    """
    rows = degree_bins(scored, degree, bins)
    top = scored.orderBy(F.desc(score), ident).limit(k).select(ident, F.lit(True).alias("__top"))  # k is the feature
    rows = rows.join(F.broadcast(top) if k <= 10_000 else top, ident, "left").withColumn("__top", F.coalesce("__top", F.lit(False)))
    y = F.col(hit).cast("int")
    best = rows.where("__top").groupBy(F.col(kind).alias("kind"), "bin").agg(F.count(F.lit(1)).alias("top_n"), F.sum(y).alias("top_hits")).withColumn("wanted", F.col("top_n") * per_row)
    others = rows.where(~F.col("__top")).select(ident, F.col(kind).alias("kind"), "bin", y.alias("y"))
    ranked = hash_rank(others, ["kind", "bin"], F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string"))), [ident], "__r")
    named = lambda c: F.col(c).alias(f"__{c}")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("kind", "bin")]
    taken = ranked.join(best.select(named("kind"), named("bin"), "wanted"), [*same, F.col("__r") <= F.col("wanted")]).groupBy("__kind", "__bin").agg(F.count(F.lit(1)).alias("__m"), F.sum("y").alias("__h"))
    out = best.join(taken, same, "left").select("kind", "bin", "top_n", "top_hits", "wanted", F.coalesce("__m", F.lit(0)).alias("matched"), F.coalesce("__h", F.lit(0)).alias("matched_hits"))
    return out.withColumn("shortfall", F.col("wanted") - F.col("matched"))


def minimum_evidence(rows: DataFrame, publication: str, overlap: str, least_rows: int = 50, least_publications: int = 10) -> DataFrame:
    """One row: whether an external set is large enough and free of overlap, else it is a pilot."""
    s = rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(publication).alias("publications"), F.count_if(F.col(overlap)).alias("overlaps"))
    ok = (F.col("row_count") >= least_rows) & (F.col("publications") >= least_publications) & (F.col("overlaps") == 0)
    return s.withColumn("status", F.when(ok, "validation").otherwise("pilot"))
