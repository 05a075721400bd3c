"""Connected components by union-find in tasks and contraction between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: Edges that a task unites.
TASK_EDGES = 200_000

_U = np.uint64


def _order(v: np.ndarray, seed: int) -> np.ndarray:
    """Another order of the vertices for each seed."""
    with np.errstate(over="ignore"):
        x = (v.view(_U) ^ _U(seed)) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(32))


def _united(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, root of each); a root is the least vertex, with a seed the least one in the seed's order."""
    seen, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    rank = np.argsort(np.argsort(_order(seen, seed) if seed else seen))
    back = np.empty(len(seen), np.int64)
    back[rank] = np.arange(len(seen))
    parent = list(range(len(seen)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ends = rank[inverse]
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.fromiter(map(root, range(len(seen))), np.int64, len(seen))
    return seen, seen[back[roots[rank]]]


def components(edges: DataFrame, most_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(v, label) of every vertex of the undirected edges (a, b); label is the smallest vertex of its component.

    Each round deals the edges to tasks of about task_edges edges, which unite them and point their vertices at roots.  If one task
    was enough, that is the result.  Else a vertex takes the least of its roots, and its other roots are tied to that by the
    edges of the next round, which are fewer, since only roots are left.  Roots follow another order in each round, so that
    chains shorten by a constant share.  Minima are combined map-side, so a hub costs its edges once.  Rounds are written to
    the shared folder, and a round is deleted when the next one is there.
    """
    left = cut(edges.select("a", "b").where("a <> b"))
    labels = None
    for k in range(most_rounds):
        tasks = -(-left.count() // task_edges)
        seed = k + 1 if tasks > 1 or labels is not None else 0

        def unite(batches, seed=seed):
            rows = [b for b in batches if b.num_rows]
            if rows:
                v, root = _united(*(np.concatenate([np.asarray(b.column(i)) for b in rows]) for i in (0, 1)), seed)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["v", "root"])

        dealt = left.repartition(tasks) if tasks > 1 else left.coalesce(1)
        stars = cut(dealt.mapInArrow(unite, "v long, root long"))
        step = stars.groupBy("v").agg(F.min("root").alias("m")) if tasks > 1 else stars.toDF("v", "m")
        if labels is None:
            labels = cut(step.toDF("v", "label"))
        else:
            before, labels = labels, cut(labels.join(step.toDF("label", "m"), "label", "left").select("v", F.coalesce("m", "label").alias("label")))
            forget(before)
        if tasks > 1:
            after = cut(stars.join(step, "v").where("m <> root").select(F.col("m").alias("a"), F.col("root").alias("b")).distinct())
            forget(left, stars)
            left = after
        if tasks <= 1:
            forget(left, stars)
            if not seed:
                return labels
            named = labels.groupBy("label").agg(F.min("v").alias("least"))
            return cut(labels.join(named, "label").select("v", F.col("least").alias("label")))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
