"""Components by contraction, communities by modularity, and what the rounds leave behind."""

import os
import random

import pytest

from evbench.operators import durable
from evbench.operators import graphs as G


def least(vertices, edges):
    label = {v: v for v in vertices}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def folder(spark):
    root = durable.shared_folder(spark).removeprefix("file://")
    return {f for d, _, names in os.walk(root) for f in names if f.startswith("part-") and "round-" in d}


@pytest.mark.parametrize("task_edges", [0, 3, 1000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, task_edges, kind):
    rnd = random.Random(7)
    name = (lambda i: i) if kind == "long" else (lambda i: f"é{i}")
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(200 + rnd.randrange(60), 200 + rnd.randrange(60)) for _ in range(50)] + [(300, 300), (5, 4)]
    edges = [(name(a), name(b)) for a, b in edges]
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(3)
    before = folder(spark)
    got = {r.v: r.label for r in G.components(df, task_edges=task_edges).collect()}
    assert got == least({v for e in edges for v in e}, edges)
    assert folder(spark) == before
    assert G.components(df.limit(0)).count() == 0


def modularity(edges, label):
    edges = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    degree = {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    m = len(edges)
    tot = {}
    for v, k in degree.items():
        tot[label[v]] = tot.get(label[v], 0) + k
    return sum(label[a] == label[b] for a, b in edges) / m - sum((t / (2 * m)) ** 2 for t in tot.values())


@pytest.mark.parametrize("task_edges", [0, 60, G.TASK_EDGES])
def test_cliques_and_chains_are_found(spark, task_edges):
    cliques = [(10 * c + i, 10 * c + j) for c in range(6) for i in range(8) for j in range(i)] + [(10 * c, 10 * (c + 1) + 1) for c in range(5)]
    before = folder(spark)
    got = {r.v: r.label for r in G.communities(spark.createDataFrame(cliques, "a long, b long").repartition(2), task_edges=task_edges).collect()}
    assert len(set(got.values())) == 6 and all(len({got[10 * c + i] for i in range(8)}) == 1 for c in range(6))
    assert folder(spark) == before
    if task_edges != G.TASK_EDGES:
        return
    chain = [(i, i + 1) for i in range(40)]
    got = {r.v: r.label for r in G.communities(spark.createDataFrame(chain, "a long, b long"), task_edges=task_edges).collect()}
    assert set(got) == set(range(41)) and modularity(chain, got) > 0.6
    votes = {r.v: r.label for r in G.label_propagation(spark.createDataFrame(chain, "a long, b long"), 3).collect()}
    assert modularity(chain, got) > modularity(chain, votes)
    assert folder(spark) == before
    assert G.communities(spark.createDataFrame([], "a long, b long")).count() == 0
