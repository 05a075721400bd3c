"""Operator 13 against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evbench.llm import search

SCHEMA = "doc_id long, text string, n string, terms string, score string, rank string"
ITEMS = "item_id long, text string, term string, doc_id string"
LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(rows, items, k):
    tfs = [(i, Counter(terms(t))) for i, t in rows if i is not None]
    tfs = [(i, c) for i, c in tfs if c]
    n_docs, total = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in tfs:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus():
    rnd = random.Random(13)
    words = [f"w{k}" for k in range(80)] + ["Été", "été", "ß", "中文", "A1", "a1", "x"]
    rows = [(i, " ".join(rnd.choice(words[: 5 + i % 80]) for _ in range(rnd.randint(0, 40)))) for i in range(250)]
    rows += [(300 + i, "w1 w2 w3 hot copy") for i in range(120)]  # ties of a third
    rows += [(500, None), (501, ""), (502, " !? \n"), (503, "W1,W2;w3_w4"), (300, "w1 w2 w3 hot copy"), (504, "w5 " * 4000 + "rare"), (505, "q" * 20_000)]
    items = [(k, " ".join(rnd.sample(words, rnd.randint(1, 12)))) for k in range(25)]
    items += [(30, None), (31, ""), (32, "unheard of"), (33, "hot"), (3, "hot rare"), (34, "q" * 20_000), (35, "W1 w1 w1")]
    return rows, items


@pytest.mark.parametrize(("k", "width", "block_terms"), [(50, search.WIDTH, search.BLOCK_TERMS), (5, 3, search.BLOCK_TERMS), (7, 16, 40)])
def test_search(spark, k, width, block_terms):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "n", "t", "s", "r") for i, t in [*rows, (None, "w1 w2")]], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t, "t", "d") for i, t in [*items, (None, "w1")]], ITEMS)
    got = search.search(docs, asked, k, width=width, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, items, k)


def test_empty(spark):
    docs, asked = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "w1", "n", "t", "s", "r")], SCHEMA)
    assert search.search(docs, asked).count() == search.search(some, asked).count() == 0
    assert search.search(docs, spark.createDataFrame([(1, "w1", "t", "d")], ITEMS)).count() == 0


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(5)
    v, n, width = 3000, 2000, 256
    sizes = rng.integers(0, 60, n)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    own_terms = np.concatenate([rng.choice(v, s, replace=False) for s in sizes])
    impacts = (rng.pareto(1.5, len(own_terms)) * 1e6).astype(np.int64)
    coordinate = rng.integers(0, width, v).astype(np.int32)
    batch = search.Batch(np.arange(n), starts, own_terms, impacts, coordinate, -(-int(impacts.max()) // 65_535), width)
    asked, rescored = np.zeros(v, bool), 0
    for _ in range(30):
        own = rng.choice(v, 20, replace=False)
        mask = np.isin(own_terms, own)
        want = np.bincount(np.repeat(np.arange(n), sizes)[mask], weights=impacts[mask], minlength=n).astype(np.int64)
        assert (batch.bounds(coordinate[own]) >= want).all()
        best = search.Best(10)
        rescored += batch.search(own, coordinate[own], asked, best)
        order = np.lexsort((np.arange(n), -want))[:10]
        order = order[want[order] > 0]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == want[order].tolist() and not asked.any()
    assert rescored < 30 * n / 3
