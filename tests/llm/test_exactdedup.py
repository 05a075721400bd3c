"""Operator 11 against plain Python: tries, spills, salts and awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from evbench.llm import exactdedup

SCHEMA = "doc_id long, text string, owner string, n string, hot string, sha string, len string"


def brute(rows):
    groups = defaultdict(list)
    norm = [(i, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    for i, s in norm:
        groups[s].append(i)
    return Counter((i, min(groups[s]), len(groups[s]), i == min(groups[s]), hashlib.sha256(s.encode()).hexdigest()) for i, s in norm)


def corpus(seed):
    rnd = random.Random(seed)
    some = ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(0, 9))) for _ in range(40)]
    long = "x" * 50_000
    rows = [(i, rnd.choice(some)) for i in range(300)]
    rows += [(400 + i, "the hot text") for i in range(200)]  # a third of all rows
    rows += [(700, None), (701, ""), (702, " "), (703, "\t\r\n"), (704, "é\x1c  ß"), (705, "é\x1c \tß")]
    rows += [(710, long), (711, long), (712, long + "y"), (713, long[:-1]), (714, "z" + long)]
    rows += [(400, "the hot text"), (5, "another text of the id 5"), (710, long)]  # repeated ids, with and without their text
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("budget", "hot"), [(exactdedup.BUDGET, exactdedup.HOT), (exactdedup.BUDGET, 20), (30_000, 10), (8000, 500)])
def test_owners(spark, budget, hot):
    rows = corpus(budget + hot)
    docs = spark.createDataFrame([(i, t, "o", "n", "h", "s", "l") for i, t in [*rows, (None, "no id")]], SCHEMA).repartition(5)
    got = exactdedup.owners(docs, budget=budget, hot=hot)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_empty_and_deduplicated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exactdedup.owners(empty).count() == 0 and exactdedup.deduplicated(empty).count() == 0
    rows = [(3, "a  b"), (1, "a\tb"), (2, " a b"), (9, None), (8, ""), (None, "a b"), (None, None)]
    docs = spark.createDataFrame([(i, t, "o", "n", "h", "s", "l") for i, t in rows], SCHEMA)
    kept = exactdedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a\tb"), (2, " a b"), (8, ""), (None, "a b"), (None, None)], key=str)


def test_trie_and_spill():
    rnd = random.Random(3)
    for _ in range(60):
        trie, held, gone = exactdedup.Trie(), defaultdict(list), defaultdict(list)
        for i in range(200):
            text = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12)))
            (held if trie.insert(text, i) else gone)[text].append(i)
            if rnd.random() < 0.03 and trie.terminals > 1:
                for t, members in trie.spill(2000):
                    assert [m[0] for m in members] == held[t]
                    gone[t] += held.pop(t)
        assert {t: [m[0] for m in members] for t, members in trie.ends()} == held
        assert trie.terminals == len(held) and not set(held) & set(gone)
        assert trie.root.weight == sum(len(t) + exactdedup.NODE + exactdedup.MEMBER * len(v) for t, v in held.items())


def test_agreement():
    rnd = random.Random(4)
    for _ in range(2000):
        a, b = (bytes(rnd.choice(b"aaaaaaaab") for _ in range(rnd.randint(0, 300))) for _ in range(2))
        hi = min(len(a), len(b))
        lo = rnd.randint(0, hi)
        assert exactdedup.agreement(a, b, lo, hi) == next((k for k in range(lo, hi) if a[k] != b[k]), hi)
