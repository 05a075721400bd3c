"""Operator 12 against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from evbench.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, c string, d string, rank string"


def brute(rows, min_docs, top):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low)))
        held[lang, source] += found
        docs[lang].update(found.keys())
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((held[lang, s] for s in sources), Counter())

        def p(counts):
            below = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // below for t in kept}

        q, ps = p(whole), {s: p(held[lang, s]) for s in sources}
        for s in sources:
            pairs = [(x, sum(abs(ps[s][t] - ps[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, ps[s][t] - q[t]) for t in kept if held[lang, s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def corpus():
    rnd = random.Random(8)
    words = ["the", "The", "a", "of", "Été", "été", "中文", "x1y", "don't", "zebra", "ß", "rare", "é"]
    rows = []
    for i in range(240):
        text = " ".join(rnd.choice(words[: 4 + i % 10]) for _ in range(rnd.randint(0, 25)))
        rows.append((text, ["en", "de", None][i % 7 % 3], "hot" if i % 3 == 0 else rnd.choice([None, "s1", "s2", "é", "s10"])))
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("12 34 \n", "en", "digits"), ("alone word", "xx", "one"), ("few", "yy", "a"), ("few", "yy", "b")]
    rows += [("the of the " * 3000 + "longword" * 2000, "en", "s1")] + [rows[5]] * 3
    return rows


@pytest.mark.parametrize(("min_docs", "top"), [(30, 50), (1, 3), (10_000, 50)])
def test_audit(spark, min_docs, top):
    rows = corpus()
    docs = spark.createDataFrame([(None if i % 9 == 0 else i, *r, "t", "c", "d", "r") for i, r in enumerate(rows)], SCHEMA).repartition(4)
    got = divergence.audit(docs, min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, min_docs, top)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_counts_shared_paths_once():
    rnd = random.Random(2)
    for _ in range(50):
        p0 = [rnd.randint(1, 9) for _ in range(5)]
        rows = Counter(tuple((k, p0[k], rnd.randint(1, 4)) for k in sorted(rnd.sample(range(5), rnd.randint(1, 5)))) for _ in range(60))
        tree, want = divergence.PatternTree(), Counter()
        for row in sorted(rows):
            tree.insert(list(row), rows[row])
            for i, (b, q0, q) in enumerate(row):
                for a, o0, o in row[:i]:
                    want[b, a] += rows[row] * (abs(q - o) - abs(q - o0) - abs(q0 - o) + abs(q0 - o0))
        tree.close()
        assert {k: x for k, x in want.items() if x} == {(b, a): x for b, s in tree.sums.items() for a, x in enumerate(s.tolist()) if x}
