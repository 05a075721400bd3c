"""Graphs with links against SQL, blocks bounded by bytes, the field's optimum, and labels of lines on held-out joins."""

import random
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest

from evbench.llm import licences, neardup, quality, urls


def test_urls_on_a_graph_with_a_hub_is_the_sql(spark):
    rnd = random.Random(21)
    hosts = [f"h{k}.{rnd.choice(['com', 'org', 'net', 'io'])}" for k in range(300)] + ["hub.io", "sub.example.net", "example.com", "x.example.com"]
    rows = []
    for i in range(2500):
        host = "hub.io" if i % 3 == 0 else rnd.choice(hosts)  # a third of all pages are one host's
        links = [f'<a href="https://{"hub.io" if rnd.random() < 0.3 else rnd.choice(hosts)}/p{rnd.randrange(9)}">x</a>' for _ in range(rnd.randint(0, 8))]
        rows.append((i, f"https://{host}{rnd.choice(['/', '/en/x', '/de/y', '/fr/z', ''])}", "<p>" + " ".join(links)))
    rows.append((5000, "http://h1.com/", "<p>" + "long " * 400_000 + '<a href="http://h2.net/">x</a>'))
    rows += [(5001, None, None), (5002, "no scheme", "<a href=//h3.org/>"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    c = duckdb.connect()
    pages = df.toPandas()
    c.register("pages", pages)
    want = c.execute(urls.SQL)
    names = [x[0] for x in want.description]
    cols = ("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    want = Counter(plain(dict(zip(names, r, strict=True))[k] for k in cols) for r in want.fetchall())
    got = urls.judge(df).collect()
    assert Counter(map(plain, got)) == want
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"} and sum(r.trust > 0 for r in got) > 100


def test_near_duplicates_in_blocks_bounded_by_bytes(spark, monkeypatch):
    rnd = random.Random(22)
    words = [f"w{k}" for k in range(400)]
    base = [rnd.choice(words) for _ in range(900)]
    rows = []
    for i in range(40):  # many texts that share bands without being alike
        w = list(base)
        for k in rnd.sample(range(900), 60 + 8 * (i % 7)):
            w[k] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    usual = Counter(map(tuple, neardup.near_duplicates(df, 3, 60).collect()))
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 20_000)  # three texts or so
    assert Counter(map(tuple, neardup.near_duplicates(df, 3, 60).collect())) == usual


def test_the_field_is_at_its_optimum():
    """The brute-force likelihood, over all labellings, has no slope at what fit() gives."""
    rng = np.random.default_rng(3)
    k = len(quality.FEATURES)
    documents = [(rng.random((n, k)), y) for n, y in ((2, 0), (3, 1), (1, 1), (2, 1), (3, 0))]
    l2 = 0.05
    field = quality.fit(documents, rounds=6000, rate=0.02, l2=l2)
    sequences = quality.training(documents)

    def objective(theta):
        trans, total = theta[k:].reshape(2, 2), -0.5 * l2 * (theta**2).sum()
        for x, y, w in sequences:
            s = x @ theta[:k]
            value = lambda ys: sum(s[i] * v for i, v in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:], strict=False))  # noqa: B023, E731
            every = np.logaddexp.reduce([value(ys) for ys in product((0, 1), repeat=len(x))])
            total += w / len(x) / 3 * (value([int(v) for v in y]) - every)
        return total

    theta = np.concatenate([field.unary, np.ravel(field.trans)])
    for at in range(k + 4):
        e = np.zeros(k + 4)
        e[at] = 1e-4
        assert abs(objective(theta + e) - objective(theta - e)) / 2e-4 < 2e-3


def test_lines_of_held_out_joins_are_labelled():
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    good = lambda: "\n".join(" ".join(word() for _ in range(rnd.randint(8, 20))) + "." for _ in range(rnd.randint(3, 8)))
    bad = lambda: "\n".join(rnd.choice(["BUY NOW!!! $$$ 50% #win", "home | about | login", "*** *** ***", "CLICK HERE!!!", "1234 5678 | 99"]) for _ in range(rnd.randint(3, 8)))
    lines = lambda t: t.encode().split(b"\n")
    field = quality.fit([(quality.line_features(lines(good() if y else bad())), y) for y in [0, 1] * 60])
    right = total = 0
    for k in range(80):
        a, b = lines(good()), lines(bad())
        text, want = (a + b + a, [1] * len(a) + [0] * len(b) + [1] * len(a)) if k % 2 else (b + a, [0] * len(b) + [1] * len(a))
        marks = quality.viterbi((quality.line_features(text) @ np.asarray(field.unary)).tolist(), field.trans)
        right += sum(x == y for x, y in zip(marks, want, strict=True))
        total += len(want)
    assert right / total > 0.95


def test_whole_licences_are_found_wherever_they_stand(spark):
    rnd = random.Random(7)
    filler = lambda: " ".join(rnd.choice(["code", "license", "software", "copyright", "notice", "the", "permission", "gnu"]) for _ in range(rnd.randint(0, 25)))
    rows = []
    for i, x in enumerate(licences.TEMPLATES):
        words = x.text.split()
        keys = set(licences.key_places(x))
        some = [w if j in keys or rnd.random() < 0.8 else f"zz{j}" for j, w in enumerate(words)]
        rows += [(3 * i, f"{filler()} {x.text} {filler()}"), (3 * i + 1, f"{filler()} {' '.join(some)} {filler()}"), (3 * i + 2, " ".join(words[: len(words) // 2]))]
    got = sorted(map(tuple, licences.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))
    assert got == sorted(licences.brute_force(rows))
    assert all(x.label in got[3 * i][6].split(",") for i, x in enumerate(licences.TEMPLATES))


def test_templates_without_two_key_places_are_refused():
    with pytest.raises(ValueError, match="two places"):
        licences.key_words([licences.Template("x", "only a word of the", ("word of the",))])
    with pytest.raises(ValueError, match="isn't in"):
        licences.key_words([licences.Template("x", "some words here", ("other words",))])
