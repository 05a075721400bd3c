"""Scored assignment of whole units to parts."""

import itertools
import random

import numpy as np
import pytest

from evbench.operators import assignment as A


def expanded(n, size, labels, given):
    """(part, size, labels) of every single unit."""
    return [(p, size[c], labels[c]) for c in range(len(n)) for p in range(given.shape[1]) for _ in range(given[c, p])]


def whole_score(units, target, rates):
    counts, held = np.zeros(len(target)), np.zeros((len(target), len(rates)))
    for p, s, v in units:
        counts[p] += s
        held[p] += v
    return float(A.score(counts, held, target, rates))


@pytest.mark.parametrize("seed", range(8))
def test_no_move_and_no_swap_of_twelve_units_is_better(seed):
    rnd = random.Random(seed)
    units = []
    for _ in range(12):
        s = rnd.choice([1, 1, 2, 3, 5, 8])
        k = rnd.randint(0, s)
        units.append((s, k, s - k))
    classes = sorted(set(units))
    n = np.asarray([units.count(c) for c in classes])
    size, labels = np.asarray([c[0] for c in classes], float), np.asarray([c[1:] for c in classes], float)
    target = np.asarray(A.targets(sum(u[0] for u in units), (0.7, 0.15, 0.15)))
    given = A.assign(n, size, labels, target)
    assert (given.sum(axis=1) == n).all() and (given >= 0).all() and (given.sum(axis=0) > 0).all()
    rates = labels.T @ n / (size @ n)
    one = expanded(n, size, labels, given)
    best = whole_score(one, target, rates)
    parts = [p for p, *_ in one]
    for i, q in itertools.product(range(12), range(3)):
        if parts.count(parts[i]) > 1:
            assert whole_score([*one[:i], (q, *one[i][1:]), *one[i + 1 :]], target, rates) >= best - 1e-9
    for i, j in itertools.combinations(range(12), 2):
        other = list(one)
        other[i], other[j] = (one[j][0], *one[i][1:]), (one[i][0], *one[j][1:])
        assert whole_score(other, target, rates) >= best - 1e-9


def test_targets():
    assert A.targets(100, (0.7, 0.15, 0.15)) == [70, 15, 15]
    assert A.targets(3, (0.7, 0.15, 0.15)) == [1, 1, 1] and A.targets(2, (0.8, 0.0, 0.2)) == [1, 0, 1] and sum(A.targets(2, (0.7, 0.15, 0.15))) == 2


@pytest.mark.parametrize("wide", [False, True])
def test_scored_group_split(spark, wide):
    rnd = random.Random(4)
    rows = [(None, "x")] * 5
    for g in range(200):
        for _ in range(rnd.choice([1, 2, 2, 3, 7, 40 if wide else 9])):
            rows.append((f"g{g}", rnd.choice(["a", "a", "b", "c", None])))
    rows += [("hot", "a")] * (len(rows) // 2)  # a third of all rows is one unit
    df = spark.createDataFrame(rows, "k string, y string").repartition(3)
    got = {r.k: (r["size"], r.part) for r in A.scored_group_split(df, "k", "y", 1).collect()}
    assert set(got) == {k for k, _ in rows if k} and all(n == sum(k == x for x, _ in rows) for k, (n, _) in got.items())
    assert got == {r.k: (r["size"], r.part) for r in A.scored_group_split(df.repartition(2), "k", "y", 1).collect()}
    total = sum(n for n, _ in got.values())
    of = lambda p: [y for k, y in rows if k and got[k][1] == p]
    for p, share in (("train", 0.7), ("valid", 0.15), ("test", 0.15)):
        assert abs(len(of(p)) - share * total) <= 3
        for y in "abc":
            assert abs(of(p).count(y) / len(of(p)) - sum(k is not None and x == y for k, x in rows) / total) < (0.35 if y == "a" else 0.2)
    with pytest.raises(ValueError, match="two units"):
        A.scored_group_split(df.where("k = 'hot'"), "k", "y", 1)
