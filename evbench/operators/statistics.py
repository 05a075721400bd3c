"""Resampling statistics.

A bootstrap of n units draws n of them with replacement, again and again.  No row is copied for that: a unit's weights in all
repetitions are a function of its number, so that any task finds them for the rows it has, as an array.

Weights.  Independent Poisson weights of rate 1 - MARGIN / sqrt(n) add up to some S < n, and given S they are S draws with
replacement; n - S more draws, of the order of sqrt(n), make n draws, which is exactly multinomial.  (S > n would take a deviation of MARGIN standard
deviations, below 1e-15; such a repetition would have S draws.)  Both come from a 32-bit hash that SQL repeats.  Only the totals S, a number for each repetition, reach the
driver before the draws.

Metrics.  Rows are sorted by (group, falling score) over ranges once, whatever the number of repetitions.  Each range gives its sums of positive and negative weights as
arrays over the repetitions; the driver adds them up in order, and each range then sums its share of the metric from its own
start.  Equal scores are one step, also where they lie in several ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut
from .ranks import hash_rank

#: Standard deviations by which Poisson totals stay below the number of draws.
MARGIN = 8
#: Greatest Poisson weight; a greater one has a probability below 2**-33.
MOST = 12
#: Rows that a range holds, about, and the most ranges; the driver holds six arrays for each range.
RANGE_ROWS, MOST_RANGES = 1_000_000, 512
#: Weights, and draws that fill up, that a task holds at once.
CELLS, FILLING = 1 << 19, 1 << 19

_U = np.uint32


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers that leaves no pattern."""
    x = (x ^ (x >> _U(16))) * _U(0x7FEB352D)
    x = (x ^ (x >> _U(15))) * _U(0x846CA68B)
    return x ^ (x >> _U(16))


def _keys(seed: int, pool: int, reps: np.ndarray, use: int) -> tuple[np.ndarray, np.ndarray]:
    """Two keys for each repetition; use: 0 for Poisson weights, 1 and 2 for the halves of a filling draw."""
    a = _mix((reps + 1_000_003 * seed + 7_368_787 * pool + 15_485_863 * use).astype(_U))
    return a, _mix(a + _U(0x9E3779B9))


def uniform(number: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit numbers for each number (rows) and key (columns)."""
    low, high = (number & 0xFFFFFFFF).astype(_U), (number >> 32).astype(_U)
    return _mix(_mix(low[:, None] ^ a[None, :]) + b[None, :] + high[:, None])


def thresholds(n: int) -> list[int]:
    """The 32-bit numbers from which on a Poisson weight is at least 1, 2, ..."""
    rate = max(0.0, 1 - MARGIN / math.sqrt(n))
    out, p, c = [], math.exp(-rate), 0.0
    for k in range(MOST):
        c += p
        out.append(math.floor(c * 4294967296))
        p = p * rate / (k + 1)
    return out


def poisson(number: np.ndarray, n: int, seed: int, pool: int, reps: np.ndarray) -> np.ndarray:
    """(numbers, repetitions) of the weights before they are filled up."""
    z = uniform(number, *_keys(seed, pool, reps, 0))
    w = np.zeros(z.shape, np.int32)
    for t in thresholds(n):
        if t < 1 << 32:
            w += z >= _U(t)
    return w


class Fillings:
    """The draws that fill up some repetitions of one pool, by unit."""

    def __init__(self, n: int, totals: np.ndarray, seed: int, pool: int, reps: np.ndarray):
        """totals: the Poisson totals of these repetitions."""
        missing = np.maximum(n - totals, 0)
        rep = np.repeat(np.arange(len(reps), dtype=np.int32), missing)
        k = np.arange(len(rep)) - np.repeat(np.cumsum(missing) - missing, missing)
        slot = self._each(k, rep, *_keys(seed, pool, reps, 1)) << np.uint64(32)
        slot |= self._each(k, rep, *_keys(seed, pool, reps, 2))
        slot %= np.uint64(n)
        order = np.argsort(slot, kind="stable")
        self.slot, self.rep = slot[order].astype(np.int64), rep[order]

    @staticmethod
    def _each(k: np.ndarray, rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix(_mix((k & 0xFFFFFFFF).astype(_U) ^ a[rep]) + b[rep] + (k >> 32).astype(_U)).astype(np.uint64)

    def add(self, number: np.ndarray, weights: np.ndarray) -> None:
        lo, hi = np.searchsorted(self.slot, number, "left"), np.searchsorted(self.slot, number, "right")
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        np.add.at(weights, (np.repeat(np.arange(len(number)), size), self.rep[at]), 1)


def _parts(reps: int, n: int) -> Iterator[np.ndarray]:
    """The repetitions, as many at a time as their fillings can be held."""
    step = max(1, min(reps, int(FILLING / (2 * MARGIN * math.sqrt(n) + 1)), CELLS // 64))
    for lo in range(0, reps, step):
        yield np.arange(lo, min(lo + step, reps))


def _sums(number: np.ndarray, label: np.ndarray, edges: np.ndarray, n: int, totals: np.ndarray, seed: int, pool: int, reps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first step, positive sums, negative sums) of a run of steps of equal score; edges: where each step of the rows begins."""
    filling = Fillings(n, totals[reps], seed, pool, reps)
    height = max(1, CELLS // len(reps))
    open_: tuple[int, np.ndarray, np.ndarray] | None = None
    for lo in range(0, len(number), height):
        w = poisson(number[lo : lo + height], n, seed, pool, reps)
        filling.add(number[lo : lo + height], w)
        first = int(np.searchsorted(edges, lo, "right")) - 1
        last = int(np.searchsorted(edges, lo + len(w), "left"))
        starts = np.maximum(edges[first:last] - lo, 0)
        y = label[lo : lo + height, None]
        pos, every = np.add.reduceat(w * y, starts, axis=0, dtype=np.int64), np.add.reduceat(w, starts, axis=0, dtype=np.int64)
        neg = every - pos
        if open_ is not None:
            if open_[0] == first:
                pos[0] += open_[1]
                neg[0] += open_[2]
            else:
                yield open_[0], open_[1][None], open_[2][None]
        if last - first > 1:
            yield first, pos[:-1], neg[:-1]
        open_ = (last - 1, pos[-1], neg[-1])
    if open_ is not None:
        yield open_[0], open_[1][None], open_[2][None]


def _segments(batches):
    """(group, number, label, score) of each group that a range has rows of."""
    t = [x for b in batches if b.num_rows for x in [pa.Table.from_batches([b])]]
    if not t:
        return
    whole = pa.concat_tables(t).combine_chunks()
    gid, number, label, score = (whole.column(c).to_numpy() for c in ("gid", "number", "label", "score"))
    cuts = [0, *(np.flatnonzero(np.diff(gid)) + 1).tolist(), len(gid)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield int(gid[lo]), number[lo:hi], label[lo:hi].astype(np.int32), score[lo:hi]


def _steps(score: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(score)) + 1])


def _gain(pos: np.ndarray, neg: np.ndarray, before_pos: np.ndarray, before_neg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What steps add to (sum of precision over positives, twice the pairs won), given the sums before them."""
    cp, cn = before_pos + np.cumsum(pos, axis=0), before_neg + np.cumsum(neg, axis=0)
    every = cp + cn
    precision = np.where(every > 0, pos * (cp / np.maximum(every, 1)), 0.0).sum(axis=0)
    return precision, (neg * (2 * cp - pos)).sum(axis=0)


def _numbers(df: DataFrame, unit: str, within: Sequence[str]) -> DataFrame:
    """(within, unit, number): the units of each pool, numbered from 0 in the order of their digests."""
    units = df.select(*within, unit).distinct().withColumn("__g", F.lit(0))
    ranked = hash_rank(units, [*within, "__g"], F.md5(F.col(unit).cast("string")), [unit], "__n")
    return ranked.select(*within, unit, (F.col("__n") - 1).cast("long").alias("number"))


def bootstrap(df: DataFrame, by: Sequence[str], unit: str, label: str, score: str, reps: int, seed: int, within: Sequence[str] = ()) -> DataFrame:
    """(by, rep, auprc, auroc) of each resample of the units, and of the rows as they are as rep -1; null where a class is missing.

    within: columns of by that divide the units into pools, each resampled on its own; groups of one pool share their draws, so that
    they can be compared in pairs.  Groups are few: their list, and their values for each repetition, pass through the driver.  Rows without a score are left out.
    """
    spark = df.sparkSession
    rows = df.where(F.col(score).isNotNull())
    groups = sorted((tuple(r) for r in rows.select(*by).distinct().collect()), key=str)
    pools = sorted({tuple(g[by.index(c)] for c in within) for g in groups}, key=str)
    pool_of = [pools.index(tuple(g[by.index(c)] for c in within)) for g in groups]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by)
    result = f"{schema}rep int, auprc double, auroc double"
    if not groups:
        return spark.createDataFrame([], result)

    numbers = cut(_numbers(rows, unit, within))
    numbered = F.broadcast(spark.createDataFrame([(*g, k, pool_of[k]) for k, g in enumerate(groups)], f"{schema}gid int, pool int"))
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    pooled = numbered.select(*within, "pool").distinct()
    units = numbers.join(F.broadcast(pooled), same(numbers, pooled, within)) if within else numbers.withColumn("pool", F.lit(0))
    sizes = [0] * len(pools)
    for r in units.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["pool"]] = r["n"]
    every = np.arange(reps)

    def count(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            pool, number = (b.column(k).to_numpy() for k in range(2))
            for p in np.unique(pool).tolist():
                own, sums = number[pool == p], totals.setdefault(p, np.zeros(reps, np.int64))
                for lo in range(0, reps, 1024):
                    height = max(1, CELLS // 1024)
                    for at in range(0, len(own), height):
                        sums[lo : lo + 1024] += poisson(own[at : at + height], sizes[p], seed, p, every[lo : lo + 1024]).sum(axis=0)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([*totals], pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["pool", "totals"])

    totals = np.zeros((len(pools), reps), np.int64)
    for r in units.select("pool", "number").mapInArrow(count, "pool int, totals binary").collect():  # a row for each task and pool
        totals[r["pool"]] += np.frombuffer(r["totals"], np.int64)

    tagged = rows.join(numbered, [rows[c].eqNullSafe(numbered[c]) for c in by])
    tagged = tagged.select(*[rows[c].alias(f"__{c}") for c in within], F.col(unit).alias("__unit"), "gid", F.col(label).cast("int").alias("label"), F.col(score).cast("double").alias("score"))
    on = [tagged["__unit"].eqNullSafe(numbers[unit]), *(tagged[f"__{c}"].eqNullSafe(numbers[c]) for c in within)]
    tagged = tagged.join(numbers, on).select("gid", "number", "label", "score")
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes) * len(groups) // (RANGE_ROWS * len(pools)))))
    order = ["gid", F.desc("score"), "number"]
    ranged = cut(tagged.repartitionByRange(ranges, *order).sortWithinPartitions(*order))
    held = spark.sparkContext.broadcast((sizes, totals, pool_of))

    def add_up(batches):
        """Sums of a segment's first step, its last one and those between."""
        sizes_, totals_, pool_ = held.value
        part = TaskContext.get().partitionId()
        for gid, number, y, s in _segments(batches):
            edges, pool = _steps(s), pool_[gid]
            out = np.zeros((6, reps), np.int64)
            for own in _parts(reps, sizes_[pool]):
                for at, pos, neg in _sums(number, y, edges, sizes_[pool], totals_[pool], seed, pool, own):
                    for k, (p, n) in enumerate(zip(pos, neg, strict=True), at) if at == 0 or at + len(pos) == len(edges) else [(1, (pos.sum(axis=0), neg.sum(axis=0)))]:
                        row = 0 if k == 0 else 4 if k == len(edges) - 1 else 2
                        out[row, own] += p
                        out[row + 1, own] += n
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([gid]), pa.array([len(edges)]), pa.array([float(s[0])]), pa.array([float(s[-1])]), pa.array([out.tobytes()], pa.binary())], names=["part", "gid", "steps", "first", "last", "sums"])

    found = ranged.mapInArrow(add_up, "part long, gid long, steps long, first double, last double, sums binary").collect()  # at most ranges + groups rows
    precision, wins, ends = (np.zeros((len(groups), reps)), np.zeros((len(groups), reps)), np.zeros((len(groups), 2, reps), np.int64))
    offsets: dict[tuple[int, int], bytes] = {}
    for g in range(len(groups)):
        cum, step, at_score = np.zeros((2, reps), np.int64), None, None

        def close(g: int = g) -> None:
            nonlocal cum, step
            if step is not None:
                a, b = _gain(step[:1], step[1:], cum[0], cum[1])
                precision[g] += a
                wins[g] += b
                cum, step = cum + step, None

        for r in sorted((r for r in found if r["gid"] == g), key=lambda r: r["part"]):
            sums = np.frombuffer(r["sums"], np.int64).reshape(6, reps)
            if step is not None and at_score == r["first"]:
                step = step + sums[:2]
            else:
                close()
                step = sums[:2].copy()
            at_score = r["first"]
            if r["steps"] > 1:
                close()
                offsets[r["part"], g] = cum.tobytes()
                cum = cum + sums[2:4]
                step, at_score = sums[4:].copy(), r["last"]
        close()
        ends[g] = cum
    starts = spark.sparkContext.broadcast(offsets)

    def gain(batches):
        """What the steps between a segment's first and last one add."""
        sizes_, totals_, pool_ = held.value
        part = TaskContext.get().partitionId()
        for gid, number, y, s in _segments(batches):
            edges, pool = _steps(s), pool_[gid]
            if len(edges) < 3:
                continue
            cum, out = np.frombuffer(starts.value[part, gid], np.int64).reshape(2, reps).copy(), np.zeros((2, reps))
            for own in _parts(reps, sizes_[pool]):
                for at, pos, neg in _sums(number, y, edges, sizes_[pool], totals_[pool], seed, pool, own):
                    lo, hi = max(0, 1 - at), min(len(pos), len(edges) - 1 - at)
                    if lo < hi:
                        a, b = _gain(pos[lo:hi], neg[lo:hi], cum[0, own], cum[1, own])
                        out[0, own] += a
                        out[1, own] += b
                        cum[:, own] += np.stack([pos[lo:hi].sum(axis=0), neg[lo:hi].sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([out.tobytes()], pa.binary())], names=["gid", "gains"])

    for r in ranged.mapInArrow(gain, "gid long, gains binary").collect():
        gains = np.frombuffer(r["gains"]).reshape(2, reps)
        precision[r["gid"]] += gains[0]
        wins[r["gid"]] += gains[1]

    values = []
    for g, key in enumerate(groups):
        p, n = ends[g]
        both = (p > 0) & (n > 0)
        ap, au = (np.round(np.where(both, x, 0) / np.where(both, y, 1), 9) for x, y in ((precision[g], p), (wins[g], 2 * p * n)))
        values += [(*key, r, a if ok else None, u if ok else None) for r, a, u, ok in zip(range(reps), ap.tolist(), au.tolist(), both.tolist(), strict=True)]
    return spark.createDataFrame(values, result).unionByName(_observed(rows, by, label, score))


def _observed(rows: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    from . import metrics

    a, b = metrics.average_precision(rows, by, label, score), metrics.auroc(rows, by, label, score)
    j = a.join(b, [a[c].eqNullSafe(b[c]) for c in by])
    known = F.col("auroc").isNotNull()
    return j.select(*[a[c] for c in by], F.lit(-1).alias("rep"), F.when(known, F.col("auprc")).alias("auprc"), "auroc")


def interval(values: DataFrame, by: Sequence[str], value: str = "auprc") -> DataFrame:
    """(by, reps, lo, hi): 2.5 and 97.5 percentiles of the resamples; those without a value are skipped."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))  # of the repetitions, so of a bounded number
    some = values.where((F.col("rep") >= 0) & F.col(value).isNotNull())
    return some.groupBy(*by).agg(F.count(F.lit(1)).alias("reps"), q.alias("q")).select(*by, "reps", F.round(F.get("q", F.lit(0)), 7).alias("lo"), F.round(F.get("q", F.lit(1)), 7).alias("hi"))


def paired(values: DataFrame, by: Sequence[str], model: str, full: str, base: str, value: str = "auprc") -> DataFrame:
    """(by, observed_delta, reps, mean_delta, lo, hi, share_not_positive) of full minus base on the same resamples."""
    f = values.where(F.col(model) == full).select(*by, "rep", F.col(value).alias("f"))
    b = values.where(F.col(model) == base).select(*by, "rep", F.col(value).alias("b"))
    d = f.join(b, [*by, "rep"]).withColumn("d", F.round(F.col("f") - F.col("b"), 9))
    drawn = F.when(F.col("rep") >= 0, F.col("d"))
    q = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    g = d.groupBy(*by).agg(F.max(F.when(F.col("rep") < 0, F.col("d"))).alias("observed_delta"), F.count(drawn).alias("reps"), F.avg(drawn).alias("m"), q.alias("q"), F.avg((drawn <= 0).cast("int")).alias("p"))
    r = lambda c, name: F.round(c, 7).alias(name)
    return g.select(*by, r(F.col("observed_delta"), "observed_delta"), "reps", r(F.col("m"), "mean_delta"), r(F.get("q", F.lit(0)), "lo"), r(F.get("q", F.lit(1)), "hi"), r(F.col("p"), "share_not_positive"))


def seed_deltas(df: DataFrame, seed: str, model: str, full: str, base: str, metrics: Sequence[str]) -> DataFrame:
    """(metric, n, mean, sd, lo, hi, positive): of full minus base over paired seeds."""
    f, b = (df.where(F.col(model) == m).select(seed, *[F.col(x).alias(f"{p}{x}") for x in metrics]) for m, p in ((full, "f_"), (base, "b_")))
    long = f.join(b, seed).select(seed, F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), (F.col(f"f_{x}") - F.col(f"b_{x}")).alias("d")) for x in metrics])).alias("x")).select(seed, "x.*")
    stats = {"mean": F.avg("d"), "sd": F.stddev_samp("d"), "lo": F.min("d"), "hi": F.max("d"), "positive": F.avg((F.col("d") > 0).cast("int"))}
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), *[F.round(c, 7).alias(k) for k, c in stats.items()])


def calibration(df: DataFrame, by: Sequence[str], label: str, score: str, steps: int = 12, eps: float = 1e-6) -> DataFrame:
    """(by, intercept, slope) of the logistic regression of label on logit(score), by Newton steps.

    Each step is one aggregation over all groups at once; what comes back is a row per group.
    """
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    rows = df.select(*by, F.col(label).cast("double").alias("__y"), F.ln(p / (1 - p)).alias("__x"))
    state = rows.select(*by).distinct().withColumn("__a", F.lit(0.0)).withColumn("__b", F.lit(1.0))
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.col("__a") + F.col("__b") * F.col("__x"))))
        j = rows.join(state, list(by)).withColumn("__q", q).withColumn("__w", F.col("__q") * (1 - F.col("__q")))
        r, w, x = F.col("__y") - F.col("__q"), F.col("__w"), F.col("__x")
        s = j.groupBy(*by).agg(F.min("__a").alias("a"), F.min("__b").alias("b"), F.sum(r).alias("g0"), F.sum(r * x).alias("g1"), F.sum(w).alias("h00"), F.sum(w * x).alias("h01"), F.sum(w * x * x).alias("h11"))
        det = F.nullif(F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01"), F.lit(0.0))
        da = (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / det
        db = (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / det
        state = cut(s.select(*by, (F.col("a") + F.coalesce(da, F.lit(0.0))).alias("__a"), (F.col("b") + F.coalesce(db, F.lit(0.0))).alias("__b")))
    return state.select(*by, F.round("__a", 5).alias("intercept"), F.round("__b", 5).alias("slope"))
