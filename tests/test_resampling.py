"""Resampling without copies of rows: weights, metrics, ranges, pools."""

import random

import numpy as np
import pytest

from evbench.operators import statistics as S


def weights(n, seed, pool, reps):
    """(units, reps) as the library defines them."""
    r, number = np.arange(reps), np.arange(n)
    w = S.poisson(number, n, seed, pool, r)
    S.Fillings(n, w.sum(axis=0), seed, pool, r).add(number, w)
    return w


@pytest.mark.parametrize("n", [1, 7, 63, 400, 5000])
def test_weights_are_draws_with_replacement(n):
    w = weights(n, 5, 0, 300)
    assert (w.sum(axis=0) == n).all() and (w >= 0).all()
    if n >= 400:
        # multinomial: mean 1, variance 1 - 1/n, a share of exp(-1) never drawn, no correlation between units or repetitions
        assert abs(w.mean() - 1) < 1e-12 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
        assert abs(np.corrcoef(w[0::2].ravel(), w[1::2].ravel())[0, 1]) < 0.01
        assert abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.01
    assert (weights(n, 5, 0, 20) == w[:, :20]).all() and (n < 63 or (weights(n, 6, 0, 20) != w[:, :20]).any())


def brute(rows, w, number):
    """(auprc, auroc) of one group's (unit, label, score) rows for each repetition."""
    out = []
    for rep in range(w.shape[1]):
        steps = {}
        for u, y, s in rows:
            if s is not None:
                a = steps.setdefault(s, [0, 0])
                a[0 if y else 1] += int(w[number[u], rep])
        p, n = (sum(x[k] for x in steps.values()) for k in (0, 1))
        cp = cn = 0
        ap, wins = 0.0, 0
        for s in sorted(steps, reverse=True):
            a, b = steps[s]
            cp, cn = cp + a, cn + b
            ap += a * cp / (cp + cn) if cp + cn else 0
            wins += b * (2 * cp - a)
        out.append((round(ap / p, 9), round(wins / (2 * p * n), 9)) if p and n else (None, None))
    return out


@pytest.mark.parametrize(("cells", "filling", "most_ranges"), [(1 << 19, 1 << 22, 512), (700, 900, 512), (300, 60, 1)])
def test_bootstrap(spark, monkeypatch, cells, filling, most_ranges):
    import hashlib

    for name, x in (("CELLS", cells), ("FILLING", filling), ("MOST_RANGES", most_ranges)):
        monkeypatch.setattr(S, name, x)
    rnd = random.Random(cells)
    rows = []
    for split, units in (("a", 60), ("b", 25), (None, 3)):
        for u in range(units):
            for model in ("m", "n"):
                for _ in range(rnd.randint(1, 2)):
                    score = 0.5 if rnd.random() < 0.4 else None if rnd.random() < 0.05 else rnd.randint(0, 9) / 10  # a tie of a third of all rows
                    rows.append((split, model, f"u{u}", rnd.random() < 0.3 and split is not None, score))
    df = spark.createDataFrame(rows, "split string, model string, unit string, label boolean, score double").repartition(3)
    reps = 12
    got = {(r.split, r.model, r.rep): (r.auprc, r.auroc) for r in S.bootstrap(df, ["split", "model"], "unit", "label", "score", reps, 3, within=["split"]).collect()}
    pools = sorted({(s,) for s, *_ in rows}, key=str)
    for split in ("a", "b", None):
        units = sorted({u for s, _, u, _, x in rows if s == split and x is not None}, key=lambda u: (hashlib.md5(u.encode()).hexdigest(), u))
        number = {u: k for k, u in enumerate(units)}
        w = weights(len(units), 3, pools.index((split,)), reps)
        for model in ("m", "n"):
            own = [(u, y, x) for s, m, u, y, x in rows if s == split and m == model and x is not None]
            want = brute(own, w, number)
            for rep in range(reps):
                assert got[split, model, rep] == pytest.approx(want[rep], abs=2e-9) if want[rep][0] is not None else got[split, model, rep] == (None, None)
            one = brute(own, np.ones((len(units), 1), int), number)[0]
            assert got[split, model, -1] == (pytest.approx(one, abs=2e-9) if one[0] is not None else (None, None))
    assert len(got) == 6 * (reps + 1)
    one = S.paired(S.bootstrap(df.where("split = 'a'"), ["model"], "unit", "label", "score", 40, 3), [], "model", "m", "n").first()
    assert one.reps == 40 and one.lo <= one.mean_delta <= one.hi


def test_bootstrap_of_nothing(spark):
    df = spark.createDataFrame([], "model string, unit string, label boolean, score double")
    assert S.bootstrap(df, ["model"], "unit", "label", "score", 5, 1).count() == 0
