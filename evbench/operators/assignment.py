"""Assignment of whole units (groups, components) to parts with target sizes and like label shares.

The score of an assignment is, over its parts with a target,

    |rows - target| / target + 10 * (rows over the target) / target + 0.25 * sum over labels of (share in the part - share in all)**2

so that too large a part costs most, and labels decide among assignments of like sizes.  Units of one size and one label vector are
interchangeable, so only how many units of each such class a part gets is looked for: by a first fill in proportion and a local search
that moves units of a class from part to part, and swaps units of two classes, while that lowers the score.  The search sees a histogram
of classes alone.  Its size has a bound whatever the data: up to EXACT rows a unit's label counts are told apart, beyond it sizes fall into
steps of a sixteenth and label shares into SHARES steps, and a class counts with the mean of its units.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import hash_rank

#: Rows of a unit up to which its label counts are exact, and steps of a label's share beyond.
EXACT, SHARES = 32, 16
#: Classes up to which swaps of two units are tried besides moves.
SWAPS = 300
OVER, LABELS = 10.0, 0.25


def targets(rows: int, shares: Sequence[float]) -> list[int]:
    """Rows of each part; the first part takes the rest, and no other part with a share is left without a row where there are enough."""
    wanted, asked = [], 0
    for share in reversed(shares[1:]):
        asked += share > 0
        wanted.insert(0, max(1 if rows > asked else 0, round(rows * share)) if share > 0 else 0)
    while sum(wanted) >= rows and any(wanted):
        wanted[wanted.index(max(wanted))] -= 1
    return [rows - sum(wanted), *wanted]


def score(counts: np.ndarray, labels: np.ndarray, target: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """counts (..., parts), labels (..., parts, labels): the score over the parts."""
    asked = target > 0
    t = np.maximum(target, 1)
    size = np.abs(counts - target) / t + OVER * np.maximum(counts - target, 0) / t
    share = labels / np.maximum(counts, 1e-9)[..., None]
    label = np.where(counts > 0, ((share - rates) ** 2).sum(axis=-1), 0.0) if len(rates) > 1 else 0.0
    return np.where(asked, size + LABELS * label, OVER * counts).sum(axis=-1)


def _fill(n: np.ndarray, size: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(classes, parts): the units of each class, largest first, dealt in proportion to what the parts still miss; odd ones go where most is missing."""
    given = np.zeros((len(n), len(target)), np.int64)
    missing = target.astype(float)
    for c in np.lexsort((n, -size)):
        need = np.maximum(missing, 0)
        share = need / need.sum() if need.sum() > 0 else (target > 0) / (target > 0).sum()
        given[c] = np.floor(n[c] * share)
        missing = missing - given[c] * size[c]
        for _ in range(int(n[c] - given[c].sum())):  # fewer than parts
            p = int(np.argmax(np.where(target > 0, missing, -np.inf)))
            given[c, p] += 1
            missing[p] -= size[c]
    return given


def assign(n: np.ndarray, size: np.ndarray, labels: np.ndarray, target: np.ndarray, most_steps: int = 10_000) -> np.ndarray:
    """(classes, parts): how many of the n units of each class each part gets, such that no move and, up to SWAPS classes, no swap lowers the score.

    size and labels are those of one unit of the class.  A part with a target keeps at least one unit.
    """
    rates = (labels * n[:, None]).sum(axis=0) / max(1, (size * n).sum())
    given = _fill(n, size, target)
    asked = [p for p in range(len(target)) if target[p] > 0]
    for p in asked:  # each part has a unit, the smallest of the part that has most units
        if not given[:, p].sum():
            q = int(np.argmax(given.sum(axis=0)))
            c = min(np.flatnonzero(given[:, q]), key=lambda c: size[c])
            given[c, q] -= 1
            given[c, p] += 1

    def at(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return size @ g, np.einsum("ck,cp->pk", labels, g)

    counts, held = at(given)
    best = float(score(counts, held, target, rates))
    steps = 1 << np.arange(0, max(1, int(n.max(initial=1)).bit_length()))
    for _ in range(most_steps):
        found = None
        for p in asked:
            units = int(given[:, p].sum())
            for q in asked:
                if p == q:
                    continue
                for m in steps[steps < units]:
                    some = np.flatnonzero(given[:, p] >= m)
                    if not len(some):
                        break
                    c, h = np.repeat(counts[None], len(some), 0), np.repeat(held[None], len(some), 0)
                    c[:, p] -= m * size[some]
                    c[:, q] += m * size[some]
                    h[:, p] -= m * labels[some]
                    h[:, q] += m * labels[some]
                    s = score(c, h, target, rates)
                    k = int(np.argmin(s))
                    if found is None or s[k] < found[0] - 1e-15:
                        found = (float(s[k]), [(some[k], p, q, int(m))])
        if len(n) <= SWAPS and (found is None or found[0] >= best - 1e-12):
            for i, p in enumerate(asked):
                for q in asked[i + 1 :]:
                    a, b = np.flatnonzero(given[:, p]), np.flatnonzero(given[:, q])
                    x, y = (v.ravel() for v in np.meshgrid(a, b, indexing="ij"))
                    c, h = np.repeat(counts[None], len(x), 0), np.repeat(held[None], len(x), 0)
                    c[:, p] += size[y] - size[x]
                    c[:, q] += size[x] - size[y]
                    h[:, p] += labels[y] - labels[x]
                    h[:, q] += labels[x] - labels[y]
                    s = score(c, h, target, rates)
                    if len(s) and (found is None or s.min() < found[0] - 1e-15):
                        k = int(np.argmin(s))
                        found = (float(s[k]), [(x[k], p, q, 1), (y[k], q, p, 1)])
        if found is None or found[0] >= best - 1e-12:
            break
        for c, p, q, m in found[1]:
            given[c, p] -= m
            given[c, q] += m
        counts, held = at(given)
        best = float(score(counts, held, target, rates))
    return given


def scored_group_split(df: DataFrame, key: str, label: str, seed: int, shares: Sequence[float] = (0.70, 0.15, 0.15), parts: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """(key, size, part): every unit whole in one part, by sizes and label shares.  Null keys are no unit; null labels count in sizes alone.

    Raises ValueError for fewer than two units.  A histogram of unit classes reaches the driver; which units of a class go where is
    the order of a seeded digest.
    """
    rows = df.where(F.col(key).isNotNull())
    values = sorted(r[0] for r in rows.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().collect())  # the labels
    names = [f"__l{k}" for k in range(len(values))]
    counts = [F.count_if(F.col(label).cast("string") == v).alias(x) for v, x in zip(values, names, strict=True)]
    units = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), *counts)
    cls = _class(F.col("size"), [F.col(x) for x in names])
    units = units.withColumn("__class", cls)
    total = lambda x: F.sum(x).alias(x)
    seen = units.groupBy("__class").agg(F.count(F.lit(1)).alias("n"), total("size"), *[total(x) for x in names]).orderBy("__class").collect()
    n = np.asarray([r["n"] for r in seen], np.int64)
    if n.sum() < 2:
        raise ValueError("fewer than two units can't be split")
    size = np.asarray([r["size"] for r in seen], float) / n
    labels = np.asarray([[r[x] for x in names] for r in seen], float).reshape(len(seen), len(names)) / n[:, None]
    target = np.asarray(targets(int(round((size * n).sum())), shares))
    given = np.cumsum(assign(n, size, labels, target), axis=1)
    bounds = df.sparkSession.createDataFrame([(r["__class"], *map(int, g)) for r, g in zip(seen, given, strict=True)], "__class string, " + ", ".join(f"`__{p}` long" for p in parts))
    ranked = hash_rank(units, ["__class"], F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), [key], "__rank")
    part = reduce(lambda rest, p: F.when(F.col("__rank") <= F.col(f"__{p}"), p).otherwise(rest), reversed(parts[:-1]), F.lit(parts[-1]))
    return ranked.join(bounds, "__class").select(key, "size", part.alias("part"))


def _class(size: Column, labels: list[Column]) -> Column:
    """The class of a unit as text: exact up to EXACT rows, else steps of size and of label shares."""
    exact = F.concat_ws("|", size, *labels)
    step = F.floor(16 * F.log2(size.cast("double")))
    wide = F.concat_ws("|", F.lit("~"), F.when(size <= 256, size).otherwise(step + 1000), *[F.floor(SHARES * c / size) for c in labels])
    return F.when(size <= EXACT, exact).otherwise(wide)
