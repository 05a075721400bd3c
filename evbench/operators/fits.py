"""Models of many (split, family) groups fitted at once, on sparse entries.

Rows are read once a step for all groups: a task adds up each group's loss, gradient and Gram array over its train rows, Spark adds up
the tasks' arrays by group, and the driver takes one Newton step for every group that isn't done.  So the number of jobs is that of the
steps of the slowest group, whatever the number of splits and families.

A logistic regression minimises

    sum of w * log loss / sum of w  +  reg / 2 * sum of (coefficient * standard deviation of its feature)**2

over the train rows of its split, with class weights w under which both classes weigh alike, and an intercept without penalty; a feature without
variance in train has coefficient 0.  That is Spark ML's objective with standardisation, so that its coefficients are the same.
A group whose train has one class only is skipped with its reason.  What passes through the driver are arrays by group: features squared
for the Gram array, at most MOST_FEATURES of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features up to which a Gram array is made.
MOST_FEATURES = 2048
PARTS = ("train", "valid", "test")
_KEYED = "gid int, sums binary"


class Family(NamedTuple):
    """A model's features: a column of entries and its number of slots; no column: the positive rate of train."""

    column: str | None
    size: int = 0
    kind: str = "logistic"


class Fitted(NamedTuple):
    """One group: a constant, or what predict() asks for."""

    split: str
    model: str
    family: Family
    weights: list[np.ndarray]


def with_parts(rows: DataFrame, ident: str, splits: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows with `parts`, the place of its part in PARTS for each named split, -1 for none; splits: long table (id, split, part)."""
    place = sum((F.when(F.col("part") == p, k + 1).otherwise(0) for k, p in enumerate(PARTS)), F.lit(0)) - 1
    wide = splits.groupBy(ident).agg(*[F.max(F.when(F.col("split") == n, place)).alias(f"__p{k}") for k, n in enumerate(names)])
    parts = F.array(*[F.coalesce(F.col(f"__p{k}"), F.lit(-1)).cast("int") for k in range(len(names))])
    return rows.join(wide, ident, "left").withColumn("parts", parts).drop(*[f"__p{k}" for k in range(len(names))])


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """The dense rows of a batch of entries, with ones in front."""
    x = np.zeros((len(column), size + 1))
    x[:, 0] = 1
    flat = column.flatten()
    lengths = np.diff(np.asarray(column.offsets))
    x[np.repeat(np.arange(len(column)), lengths), np.asarray(flat.field("i"), dtype=np.int64) + 1] = np.asarray(flat.field("v"))
    return x


def _batches(batches, columns: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, pa.ListArray]]]:
    """(label, parts, column -> entries) of the batches that have rows."""
    for b in batches:
        if b.num_rows:
            col = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            parts = np.asarray(col("parts").flatten()).reshape(b.num_rows, -1)
            yield np.asarray(col("label"), dtype=float), parts, {c: col(c) for c in columns}


def _added(rows: DataFrame, sums) -> dict[int, np.ndarray]:
    """gid -> the sum of the arrays that tasks give for it; sums(batches) yields (gid, array)."""

    def each(batches):
        total: dict[int, np.ndarray] = {}
        for gid, x in sums(batches):
            total[gid] = total[gid] + x if gid in total else x
        yield from _rows(total)

    def together(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for gid, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[gid] = total[gid] + np.frombuffer(x) if gid in total else np.frombuffer(x)
        yield from _rows(total)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.mapInArrow(each, _KEYED).repartition(n, "gid").mapInArrow(together, _KEYED).collect()  # a row for each group
    return {r["gid"]: np.frombuffer(r["sums"]) for r in out}


def _rows(total: dict[int, np.ndarray]):
    for gid, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([gid], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["gid", "sums"])


def _moments(rows: DataFrame, splits: Sequence[str], families: dict[str, Family]) -> dict[tuple[int, str], np.ndarray]:
    """(split's place, column) -> (2 classes, 1 + 2 features): train rows and sums of the features and of their squares."""
    sizes = {f.column: f.size for f in families.values() if f.column}
    columns = list(sizes)

    def sums(batches):
        for y, parts, entries in _batches(batches, columns):
            for k, c in enumerate(columns):
                x = _matrix(entries[c], sizes[c])[:, 1:]
                for s in range(len(splits)):
                    out = np.zeros((2, 1 + 2 * sizes[c]))
                    for v in (0, 1):
                        own = x[(parts[:, s] == 0) & (y == v)]
                        out[v] = np.concatenate([[len(own)], own.sum(axis=0), (own**2).sum(axis=0)])
                    yield s * len(columns) + k, out.ravel()

    found = _added(rows.select("label", "parts", *columns), sums)
    return {(gid // len(columns), columns[gid % len(columns)]): x.reshape(2, -1) for gid, x in found.items()}


def fit(rows: DataFrame, splits: Sequence[str], families: dict[str, Family], reg: float = 0.01, least_train: int = 2, most_steps: int = 40, tol: float = 1e-9) -> tuple[list[Fitted], dict[tuple[str, str], str]]:
    """(groups, (split, model) -> status).  rows: label (0, 1 or boolean), parts, and the families' columns of entries; rows without a label are left out.

    Materialise rows first: every step reads them.
    """
    for name, f in families.items():
        if f.size > MOST_FEATURES:
            raise ValueError(f"{name} has {f.size} features; Gram arrays are made for {MOST_FEATURES} at most")
    rows = rows.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("int"))
    if not any(f.column for f in families.values()):
        raise ValueError("no family has features")
    moments = _moments(rows, splits, families)
    some = next(f.column for f in families.values() if f.column)
    status, done, todo = {}, [], []
    for s, split in enumerate(splits):
        n = moments.get((s, some), np.zeros((2, 1)))[:, 0]
        for name, f in families.items():
            if n.sum() < least_train or (n == 0).any():
                status[split, name] = f"train has {int(n.sum())} rows of {int((n > 0).sum())} classes; {least_train} rows of two classes are needed"
                continue
            status[split, name] = "ok"
            if f.column is None:
                done.append(Fitted(split, name, f, [np.asarray([n[1] / n.sum()])]))
                continue
            m, w = moments[s, f.column], n.sum() / (2 * n)
            total, squares = (w * n).sum(), (w**2 * n).sum()
            mean, second = ((w[:, None] * m[:, 1 + k * f.size : 1 + (k + 1) * f.size]).sum(axis=0) for k in (0, 1))
            variance = np.maximum(second - mean**2 / total, 0) / max(total - squares / total, 1e-300)
            scale = np.where(variance > 1e-14 * np.maximum(second / total, 1e-300), np.sqrt(variance), 0.0)
            todo.append((s, name, f, w, total, scale))
    linear = [g for g in todo if g[2].kind == "logistic"]
    done += _newton(rows, splits, linear, reg, most_steps, tol)
    done += _networks(rows, splits, [g for g in todo if g[2].kind == "mlp"])
    return done, status


def _newton(rows: DataFrame, splits: Sequence[str], groups: list, reg: float, most_steps: int, tol: float) -> list[Fitted]:
    columns = sorted({g[2].column for g in groups})
    beta = [np.zeros(1 + g[2].size) for g in groups]
    best = [(np.inf, b) for b in beta]  # the least loss so far, and where
    step: list[np.ndarray | None] = [None] * len(groups)
    live = set(range(len(groups)))
    for _ in range(most_steps if groups else 0):
        at = {k: beta[k] for k in live}

        def sums(batches):
            for y, parts, entries in _batches(batches, columns):
                dense: dict[str, np.ndarray] = {}
                for k, b in at.items():  # noqa: B023
                    s, _, f, w, total, scale = groups[k]
                    own = parts[:, s] == 0
                    if f.column not in dense:
                        dense[f.column] = _matrix(entries[f.column], f.size)
                    x = dense[f.column][own] * np.concatenate([[1], np.divide(1, scale, out=np.zeros_like(scale), where=scale > 0)])
                    t, weight = y[own], w[y[own].astype(int)] / total
                    z = x @ b
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    loss = (weight * (np.logaddexp(0, z) - t * z)).sum()
                    yield k, np.concatenate([[loss], x.T @ (weight * (p - t)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()])

        found = _added(rows.select("label", "parts", *columns), sums)
        for k in list(live):
            d = len(beta[k])
            penalty = np.full(d, reg)
            penalty[0] = 0
            loss = found[k][0] + 0.5 * (penalty * beta[k] ** 2).sum()
            if loss > best[k][0] + 1e-12 and step[k] is not None:  # too far: half the way
                step[k] = step[k] / 2
                if np.abs(step[k]).max() < tol:
                    live.discard(k)
                beta[k] = best[k][1] + step[k]
                continue
            best[k] = (loss, beta[k])
            gradient = found[k][1 : d + 1] + penalty * beta[k]
            hessian = found[k][d + 1 :].reshape(d, d) + np.diag(penalty)
            step[k] = -np.linalg.solve(hessian + 1e-12 * np.eye(d), gradient)
            if np.abs(step[k]).max() < tol:
                live.discard(k)
            beta[k] = beta[k] + step[k]
        if not live:
            break
    out = []
    for (s, name, f, _, _, scale), (_, b) in zip(groups, best, strict=True):
        coefficients = np.divide(b[1:], scale, out=np.zeros_like(scale), where=scale > 0)
        out.append(Fitted(splits[s], name, f, [np.concatenate([b[:1], coefficients])]))
    return out


#: A network: hidden units, rounds of averaging, passes over a task's rows in a round, rows of a step, and rate.
HIDDEN, ROUNDS, PASSES, STEP, RATE = 16, 12, 4, 256, 0.01


def _networks(rows: DataFrame, splits: Sequence[str], groups: list, seed: int = 7) -> list[Fitted]:
    """Networks of one hidden layer with class weights: in each round every batch of rows goes on from the common weights over its own train rows,
    and the results are averaged by the rows' weights.  Jobs are ROUNDS, whatever the number of groups."""
    columns = sorted({g[2].column for g in groups})
    params = []
    for _, _, f, *_ in groups:
        rng = np.random.default_rng(seed)
        params.append(np.concatenate([(rng.normal(size=((1 + f.size), HIDDEN)) / np.sqrt(1 + f.size)).ravel(), rng.normal(size=1 + HIDDEN) / np.sqrt(HIDDEN)]))
    for turn in range(ROUNDS if groups else 0):
        at = list(params)

        def sums(batches):
            for y, parts, entries in _batches(batches, columns):
                for k, start in enumerate(at):  # noqa: B023
                    s, _, f, w, _, scale = groups[k]
                    own = np.flatnonzero(parts[:, s] == 0)
                    if len(own):
                        x = _matrix(entries[f.column], f.size)[own] * np.concatenate([[1], np.divide(1, scale, out=np.zeros_like(scale), where=scale > 0)])
                        weight = w[y[own].astype(int)]
                        # the order of the steps hangs on the rows' number alone
                        new = _descend(start, x, y[own], weight, RATE / (1 + 0.2 * turn), np.random.default_rng(seed + turn))  # noqa: B023
                        yield k, np.concatenate([[weight.sum()], weight.sum() * new])

        found = _added(rows.select("label", "parts", *columns), sums)
        params = [found[k][1:] / found[k][0] if k in found else p for k, p in enumerate(params)]
    out = []
    for (s, name, f, _, _, scale), p in zip(groups, params, strict=True):
        a, b = p[: (1 + f.size) * HIDDEN].reshape(1 + f.size, HIDDEN), p[(1 + f.size) * HIDDEN :]
        inverse = np.concatenate([[1], np.divide(1, scale, out=np.zeros_like(scale), where=scale > 0)])
        out.append(Fitted(splits[s], name, f, [a * inverse[:, None], b]))
    return out


def _gradient(p: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Loss and gradient of a network at some rows."""
    d = x.shape[1]
    a, b = p[: d * HIDDEN].reshape(d, HIDDEN), p[d * HIDDEN :]
    h = np.tanh(x @ a)
    z = b[0] + h @ b[1:]
    q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    total = w.sum()
    e = w * (q - y) / total
    back = (e[:, None] * b[1:]) * (1 - h**2)
    loss = (w * (np.logaddexp(0, z) - y * z)).sum() / total + 0.5 * l2 * (p**2).sum()
    return float(loss), np.concatenate([(x.T @ back).ravel(), [e.sum()], h.T @ e]) + l2 * p


def _descend(p: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Adam over a batch of rows."""
    p, m, v, t = p.copy(), np.zeros_like(p), np.zeros_like(p), 0
    for _ in range(PASSES):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), STEP):
            own = order[lo : lo + STEP]
            _, g = _gradient(p, x[own], y[own], w[own], 1e-4)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p


def predict(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    z = x @ weights[0] if len(weights) == 1 else weights[1][0] + np.tanh(x @ weights[0]) @ weights[1][1:]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def scored(rows: DataFrame, ident: str, splits: Sequence[str], fits: Sequence[Fitted]) -> DataFrame:
    """(id, split, model, part, label, score, confidence) of every row that has a part in a split, for all groups in one pass."""
    spark = rows.sparkSession
    columns = sorted({f.family.column for f in fits if f.family.column})
    held = spark.sparkContext.broadcast([(list(splits).index(f.split), f.split, f.model, f.family, f.weights) for f in fits])
    kind = rows.schema[ident].dataType.simpleString()

    def score(batches):
        for b in batches:
            if not b.num_rows:
                continue
            parts = np.asarray(b.column(2).flatten()).reshape(b.num_rows, -1)
            dense: dict[str, np.ndarray] = {}
            for s, split, model, family, weights in held.value:
                own = np.flatnonzero(parts[:, s] >= 0)
                if not len(own):
                    continue
                if family.column is None:
                    p = np.full(len(own), weights[0][0])
                else:
                    if family.column not in dense:
                        dense[family.column] = _matrix(b.column(3 + columns.index(family.column)), family.size)
                    p = predict(dense[family.column][own], weights)
                take = pa.array(own)
                names = pa.array([PARTS[k] for k in parts[own, s].tolist()])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), pa.repeat(split, len(own)), pa.repeat(model, len(own)), names, b.column(1).take(take), pa.array(p), pa.array(np.maximum(p, 1 - p))],
                    names=[ident, "split", "model", "part", "label", "score", "confidence"],
                )

    label = rows.schema["label"].dataType.simpleString()
    return rows.select(ident, "label", "parts", *columns).mapInArrow(score, f"`{ident}` {kind}, split string, model string, part string, label {label}, score double, confidence double")
