"""The training-data operators against plain Python on small tables, with the awkward rows that their docstrings name."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evbench.llm import bpe, codec, graph, licences, linededup, media, neardup, packing, quality, records, suffixdedup, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", "."]) for _ in range(n))


def corpus():
    """Ordinary texts, nulls, empty and very long ones, exact and near copies, shared lines and passages."""
    rnd = random.Random(5)
    rows = [(i, "\n".join(prose(rnd, rnd.randint(3, 90)) for _ in range(rnd.randint(1, 4)))) for i in range(30)]
    rows += [(100, None), (101, ""), (102, " \n\t \n"), (103, "one"), (104, "Héllo, wörld ß́ \r\n\x1c x  y"), (105, "<|endoftext|> it's  100% 中文")]
    rows += [(110 + i, rows[3][1]) for i in range(4)]  # copies
    base = prose(rnd, 300).split(" ")
    for i in range(6):  # near copies
        w = list(base)
        w[10 * i + 3] = f"changed{i}"
        rows.append((120 + i, " ".join(w)))
    shared = prose(rnd, 120)
    rows += [(130 + i, f"{prose(rnd, 40)}\n  Shared Line of words\t\n{shared}\n{prose(rnd, 30)}") for i in range(3)]
    passage = prose(rnd, 110)
    rows += [(150 + i, f"{prose(rnd, 60)} {passage} {prose(rnd, 50)}") for i in range(3)]
    rows.append((140, " ".join(prose(rnd, 5000) for _ in range(3))))
    rows.append((141, "ab" * 900))
    rows.append((110, rows[3][1]))  # a repeated row
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # a null id, and columns whose names clash with the operators' own
    df = spark.createDataFrame([*rows, (None, "no id here", "en", "s", 10)], SCHEMA).repartition(5)
    return df.withColumn("h", F.lit(1)).withColumn("n", F.lit("x")).withColumn("label", F.lit(2)).withColumn("keys", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --------------------------------------------------------------------------------------------------------- 1, 6, 10: ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_is_the_library(name, rows):
    c = codec.Codec(codec.vocabulary(name))
    rnd = random.Random(1)
    bits = [*"ab éÉß'sS  \n\t.,!$<|>1", "<|endoftext|>", " foo", "'ll", "\r\n", "한", "中文", "\x1c", "\x85", "Σς", "é"]
    texts = [t or "" for _, t, *_ in rows] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert c.ids(t) == c.whole(t), repr(t)


def test_records_round_trip(spark, docs, rows, empty, tmp_path):
    path = f"file://{tmp_path}/r"
    records.write_records(docs, path)
    got = sorted(map(tuple, records.read_records(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    c = codec.Codec(codec.vocabulary("word_bpe_49k.json"))
    start, want = 0, []
    for i, t in sorted((i, t or "") for i, t, *_ in rows):
        ids = c.tok.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert [x[:1] + x[2:] for x in got] == [x[:1] + x[2:] for x in want]
    assert {x for x in got if x[0] != 110} == {x for x in want if x[0] != 110}
    records.write_records(empty, f"file://{tmp_path}/e")
    assert records.read_records(spark, f"file://{tmp_path}/e").count() == 0


def test_records_in_shuffled_order(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/s"
    records.write_records(docs, path)
    c = codec.Codec(codec.vocabulary("word_bpe_49k.json"))
    want = Counter((i, tuple(c.tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in rows)
    one, two = ([(r.place, r.doc_id, tuple(r.ids)) for r in records.read_shuffled(spark, path, seed).collect()] for seed in (1, 2))
    assert Counter(x[1:] for x in one) == Counter(x[1:] for x in two) == want
    assert [x[0] for x in one] == sorted(x[0] for x in one) and [x[1] for x in one] != [x[1] for x in two] != sorted(i for i, *_ in rows)


def test_damaged_records_are_noticed():
    good = records.pack_record(7, np.asarray([1, 70000], "<u4"))
    assert [(i, x.tolist()) for i, x in records.unpack_records(good)] == [(7, [1, 70000])]
    for at in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            list(records.unpack_records(bytes(bad)))
    with pytest.raises(ValueError, match="damaged"):
        list(records.unpack_records(good[:-3]))


def test_bpe_chunks(docs, rows, empty):
    c = codec.Codec(codec.vocabulary("word_bpe_49k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids = c.tok.encode(t or "", add_special_tokens=False).ids
        decoded = c.tok.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digests(docs).collect())) == want
    assert bpe.digests(empty).count() == 0


def test_chunks_concatenate_and_are_shared():
    rnd = random.Random(2)
    shared = prose(rnd, 3000)
    a, b = (prose(rnd, n) + shared for n in (77, 400))
    ca, cb = bpe.chunks(a.encode()), bpe.chunks(b.encode())
    assert b"".join(ca) == a.encode() and b"".join(cb) == b.encode()
    assert len(set(ca) & set(cb)) > 5
    for text in (a, "x" * 70000, "é" * 30000):
        assert b"".join(bpe.chunks(text.encode())).decode() == text
        [x.decode() for x in bpe.chunks(text.encode())]


@pytest.mark.parametrize("most", [2, 64])
def test_packing(docs, rows, empty, most):
    pieces = packing.pack(docs, open_windows=most).collect()
    c = codec.Codec(codec.vocabulary("byte_bpe_50k.json"))
    whole = Counter()
    crcs = {}
    for i, t, *_ in rows:
        ids = np.asarray(c.tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for at in range(0, len(ids), 1024):
            piece = ids[at : at + 1024]
            whole[(i, at, len(piece), len(ids))] += 1
            crcs[i, at] = zlib.crc32(piece.tobytes())
    assert Counter((p.doc_id, p.start, p.length, p.doc_tokens) for p in pieces) == whole
    assert all(crcs[p.doc_id, p.start] == p.ids_crc32 for p in pieces)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for ps in by.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and all(p.seq_length == at for p in ps)
    assert packing.pack(empty).count() == 0
    assert packing.padded_length(512) == 512 and packing.padded_length(700) == 1024


# ------------------------------------------------------------------------------------------------------------- 2: quality


def test_viterbi_is_the_best_path():
    rnd = random.Random(4)
    for _ in range(100):
        s = [rnd.uniform(-2, 2) for _ in range(rnd.randint(1, 7))]
        t = [[rnd.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        value = lambda y: sum(a * b for a, b in zip(s, y)) + sum(t[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(value([k >> i & 1 for i in range(len(s))]) for k in range(1 << len(s)))
        assert value(quality.viterbi(s, t)) == pytest.approx(best)
    assert quality.viterbi([], [[0, 0], [0, 0]]) == []


def test_field_learns_and_verdicts(spark, docs, empty):
    rnd = random.Random(6)
    clean = [(i, "\n".join(prose(rnd, 30) for _ in range(4))) for i in range(60)]
    junk = [(100 + i, "\n".join(" ".join(f"{w}***" for w in prose(rnd, 30).split()) for _ in range(4))) for i in range(60)]
    d = spark.createDataFrame(clean + junk, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 100)) for i, _ in clean[:40] + junk[:40]], "doc_id long, quality int")
    v = {r.doc_id: r for r in quality.verdicts(d, quality.learn(d, lab)).collect()}
    assert all(v[i].kept for i, _ in clean) and not any(v[i].kept for i, _ in junk)
    assert quality.learn(d, lab.where("quality = 1")) == quality.DEFAULT
    assert quality.learn(empty, lab) == quality.DEFAULT
    got = {r.doc_id: r for r in quality.verdicts(docs, quality.DEFAULT).collect()}
    assert (got[100].n_words, got[100].base_failed, got[100].kept) == (0, True, False)
    assert quality.verdicts(empty, quality.DEFAULT).count() == 0
    assert quality.filtered(docs, quality.DEFAULT).columns == docs.columns


def test_mixed_documents_are_judged_by_their_lines():
    """Two thirds of a text are content and one third boilerplate, and the other way round."""
    rnd = random.Random(9)
    clean = [(quality.line_features([prose(rnd, 30).encode() for _ in range(4)]), 1) for _ in range(40)]
    junk = [(quality.line_features([" ".join(f"{w}***" for w in prose(rnd, 30).split()).encode() for _ in range(4)]), 0) for _ in range(40)]
    field = quality.fit(clean + junk)
    good = [prose(rnd, 30) for _ in range(6)]
    bad = [" ".join(f"{w}***" for w in prose(rnd, 30).split()) for _ in range(3)]
    share = lambda lines: quality.judge("\n".join(lines), field)[6]
    chars = lambda lines: sum(len("".join(x.split())) for x in lines)
    assert share(good + bad) == pytest.approx(chars(good) / chars(good + bad))
    assert share(good[:3] + bad + good[3:]) == pytest.approx(chars(good) / chars(good + bad))
    assert quality.judge("\n".join(good + bad), field)[-1] and not quality.judge("\n".join(good[:2] + bad * 2), field)[-1]


def test_verdicts_are_those_of_brute_force(docs, rows):
    import re

    field = quality.DEFAULT
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = t.split("\n")
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        counts = Counter(windows)
        repeat = len({k + d for k, w in enumerate(windows) if counts[w] > 1 for d in range(3)})
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        scores = (quality.line_features([x.encode() for x in lines]) @ np.asarray(field.unary)).tolist()
        if len(lines) > 8:
            continue
        value = lambda y: sum(a * b for a, b in zip(scores, y)) + sum(field.trans[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        marks = max(([k >> n & 1 for n in range(len(lines))] for k in range(1 << len(lines))), key=value)
        sizes = [sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", x))) for x in lines]
        share = sum(n for n, m in zip(sizes, marks) if m) / sum(sizes) if sum(sizes) else 0.0
        want[(i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, repeat, failed, round(share, 9), not failed and share >= 0.5)] += 1
    got = Counter((*r[:7], round(r[7], 9), r[8]) for r in map(tuple, quality.verdicts(docs, field).collect()))
    assert want and not want - got


def test_base_counts():
    r = quality.judge("a b c a b c d\n \na b c a b c d\nx #|* é", quality.DEFAULT)
    assert r[:5] == (17, 19, 3, 1, 14)


# ---------------------------------------------------------------------------------------------------------- 3: near copies


def brute_near(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return Counter((i, len(sets[i]), root(i), root(i) == i) for i, *_ in rows)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, empty, size, percent):
    assert Counter(map(tuple, neardup.near_duplicates(docs, size, percent).collect())) == brute_near(rows, size, percent)
    assert neardup.near_duplicates(empty).count() == 0


def test_borderline_cluster_and_blocks(spark, monkeypatch):
    """Copies that differ from one another about as much as the threshold allows, compared in several blocks."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rnd.sample(range(200), rnd.randint(2, 9)):
            w[k] = f"e{rnd.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows, 3, 85)
    for block in (1024, 16):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert Counter(map(tuple, neardup.near_duplicates(df, 3, 85).collect())) == want


def test_posterior_bounds_keep_true_pairs():
    rnd = np.random.default_rng(1)
    steps = neardup.least_matches(0.85, 100)
    hits = rnd.random((20000, 100)) < 0.85
    assert neardup.plausible(np.ones(100, "u1"), hits.astype("u1"), steps).mean() > 0.999
    assert neardup.plausible(np.ones(100, "u1"), (rnd.random((2000, 100)) < 0.4).astype("u1"), steps).mean() < 0.01


def test_components_of_chains(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)] + [(200, 200 + i) for i in range(1, 30)]
    for most in (graph.TASK_EDGES, 9):  # of nine edges a task, they meet in several rounds
        got = dict(map(tuple, graph.components(spark.createDataFrame(e, "a long, b long"), task_edges=most).collect()))
        assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[229] == 200


# ----------------------------------------------------------------------------------------------------------- 4: licences


def test_licences(docs, rows, empty, spark):
    extra = [
        (1, "Released under the MIT License."), (2, "x y Under the MIT license, under THE mit License!"), (3, "apache license version 2 cc by nc"),
        (4, "license mit the under"), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "permission is hereby granted free of charge to any person obtaining a copy of that software"),
        (7, "é" * 50000), (8, "redistribution in source and binary forms"), (9, None), (10, "Released under the"),
    ]
    df = spark.createDataFrame(extra, "doc_id long, text string")
    got = sorted(map(tuple, licences.scan(df).collect()))
    assert got == sorted(licences.brute_force(extra))
    assert {r[0]: r[6] for r in got}[5] == "gpl-3" and {r[0]: r[6] for r in got}[8] == ""
    plain = [(i, t) for i, t, *_ in rows]
    order = lambda r: (r[0], r[1])
    assert sorted(map(tuple, licences.scan(docs).collect()), key=order) == sorted(licences.brute_force(plain), key=order)
    assert licences.scan(empty).count() == 0


def test_every_licence_of_a_file_is_found(spark):
    by = {x.label: x.text for x in licences.TEMPLATES}
    five = ("cc0", "unlicense", "isc", "bsd", "mit")
    rows = [
        (1, " some words between them ".join(by[x] for x in five)), (2, f"neighboring fee binary person mozilla affero {by['mit']}"), (3, f"neighboring fee binary person mozilla affero {by['gpl-2']}"),
        (4, " and ".join(x.text for x in licences.TEMPLATES)), (5, by["mit"]), (6, by["isc"][20:]), (7, "license " * 300),
    ]
    got = sorted(map(tuple, licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(licences.brute_force(rows))
    labels = {r[0]: r[6] for r in got}
    assert labels[1] == ",".join(sorted(five)) and labels[2] == "mit" and labels[3] == "gpl-2" and labels[4] == ",".join(sorted(by))


# --------------------------------------------------------------------------------------------------------- 5: line dedup


def brute_lines(rows, dropped=()):
    rows = [(i, t) for i, t, *_ in rows if i not in dropped]
    keys = {}
    for i, t in rows:
        for line in (t or "").encode().split(b"\n"):
            if (k := linededup.line_key(line, 10)) is not None:
                keys.setdefault(k, set()).add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if (k := linededup.line_key(x, 10)) is None or len(keys[k]) < 2 or min(keys[k]) == i]
        out[(i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())] += 1
    return out


def digest_lines(df, state=None):
    return Counter(map(tuple, linededup.dedup(df, state=state).where("doc_id is not null").select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))


def test_line_dedup(docs, rows, empty):
    assert digest_lines(docs) == brute_lines(rows)
    out = linededup.dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.where("doc_id is null").first().text == "no id here"
    assert linededup.dedup(empty).count() == 0


def test_line_dedup_is_reversible(spark, rows):
    once = list({r[0]: r for r in rows}.values())
    texts = spark.createDataFrame([(r[0], r[1] or "") for r in once], "doc_id long, text string")
    state = linededup.insert(linededup.build(texts.where("doc_id % 2 = 0")), texts.where("doc_id % 2 = 1"))
    assert digest_lines(texts, state) == brute_lines(once)
    gone = [130, 3, 120]
    state = linededup.delete(state, spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    left = texts.where(~F.col("doc_id").isin(gone))
    assert digest_lines(left, state) == brute_lines(once, gone)
    back = linededup.insert(state, texts.where(F.col("doc_id").isin(gone)))
    assert digest_lines(texts, back) == brute_lines(once)


def test_cuckoo_filter():
    rnd = np.random.default_rng(3)
    keys = rnd.integers(-(1 << 62), 1 << 62, 3000)
    f = linededup.CuckooFilter(keys=500)  # has to grow
    for k in keys:
        f.add(int(k))
    assert f.has(keys).all()
    f = linededup.CuckooFilter(blob=f.blob())
    for k in keys[:1500]:
        assert f.remove(int(k))
    assert f.has(keys[1500:]).all()
    assert f.has(rnd.integers(-(1 << 62), 1 << 62, 20000)).mean() < 0.01


# ---------------------------------------------------------------------------------------------------------- 7: substrings


def digest_cut(df, **kw):
    return Counter(map(tuple, suffixdedup.removed(df, **kw).where("doc_id is not null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))


def test_substrings(docs, rows, empty):
    plain = [(i, t) for i, t, *_ in rows]
    want = Counter(suffixdedup.brute_force(plain))
    assert digest_cut(docs) == want
    assert digest_cut(docs, hot=1) == want  # every bucket counted by Spark
    assert digest_cut(docs, hot=3) == want
    assert suffixdedup.removed(empty).count() == 0
    assert suffixdedup.removed(docs).where("doc_id is null").first().text == "no id here"


def test_substrings_over_small_batches_and_segments(spark, rows, monkeypatch):
    plain = [(i, t) for i, t, *_ in rows]
    data = plain[-3][1].encode()
    whole = suffixdedup.anchors(data)
    monkeypatch.setattr(suffixdedup, "SEGMENT", 1000)
    parts = suffixdedup.anchors(data)
    starts = lambda codes: {(int(c) >> 16, int(c >> 16) - d) for c in codes.tolist() for d in range(c & 255, (c >> 8 & 255) + 1)}
    assert starts(whole[0]) == starts(parts[0])
    texts = [(i, prose(random.Random(i % 7), 200)) for i in range(20)]
    assert digest_cut(spark.createDataFrame(texts, "doc_id long, text string")) == Counter(suffixdedup.brute_force(texts))


@pytest.mark.parametrize("length", [30, 200, 450])
def test_substrings_of_other_lengths(spark, rows, length):
    rnd = random.Random(length)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(length + 5))
    texts = [(i, t) for i, t, *_ in rows if len(t or "") < 3000]
    texts += [(900, f"x{passage}y"), (901, passage[:length]), (902, f"zz{passage[6:]}"), (903, passage[: length - 1])]
    want = Counter(suffixdedup.brute_force(texts, length))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert digest_cut(df, length=length) == want
    assert digest_cut(df, length=length, hot=1) == want
    assert {r[0]: r[2] for r in want}[900] >= length


# ---------------------------------------------------------------------------------------------------------------- 8: urls


PAGES = [
    (1, "https://good.org/fr/1", '<a href="http://friend.com/x">f</a> <a href=//near.com>n</a> <a href="/own">o</a>'),
    (2, "http://friend.com/a", "<a HREF='https://bad.example.com/de/1?q'>b</a>"),
    (3, "HTTP://Bad.Example.com/de/1#x", '<a href="https://good.org/">g</a>'),
    (4, "https://linker.com", '<a href="https://bad.example.com/a">b</a> <a href="https://bad.example.com/b">b</a>'),
    (5, None, None), (6, "no scheme", ""), (7, "https://x.net", None), (8, "https://x.net/", None), (9, "https://a.example.net/en/2", None),
    (10, "https://bad.example.com/fr/2", None), (11, "https://near.com/a", None), (12, "https://fr.org/fr", None), (13, "ftp://://x", None), (13, "ftp://://x", None),
]


def test_urls(spark):
    import duckdb
    import pandas as pd

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("bad.example.com", "/de/1", "example.com/de/", "block")
    assert (got[7].rule, got[8].rule, got[9].rule) == (None, "net/", "example.net/en/")
    assert got[10].verdict == "block" and got[4].verdict == "block"  # the host of a blocked seed, and one that links to it
    assert got[11].verdict == "allow" and got[11].trust > 0
    assert (got[5].host, got[5].path, got[5].verdict) == ("", "", "allow")
    assert urls.judge(df.where("false")).count() == 0
    c = duckdb.connect()
    c.register("p0", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))
    c.execute("CREATE VIEW pages AS SELECT page_id, url, html FROM p0")
    names = [x[0] for x in c.execute(urls.SQL).description]
    want = Counter(tuple(dict(zip(names, r))[k] for k in ("page_id", "host", "path", "rule", "verdict", "trust", "distrust")) for r in c.execute(urls.SQL).fetchall())
    assert Counter(map(tuple, urls.judge(df).collect())) == want


def test_verdicts_do_not_depend_on_the_number_of_hosts(spark):
    copies = 30
    rows = [(1000 * k + i, u.replace("://", f"://c{k}.", 1) if u else u, h.replace("://", f"://c{k}.") if h else h) for k in range(copies) for i, u, h in PAGES if i is not None]
    one = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame([r for r in rows if r[0] < 1000], "page_id long, url string, html string")).collect()}
    many = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(many) >= copies * len(one) and all(r.verdict == one[r.page_id % 1000] for r in many)


# --------------------------------------------------------------------------------------------------------------- 9: media


def bmp(px, bits):
    import struct

    h, w, _ = px.shape
    row = (w * bits // 8 + 3) // 4 * 4
    body = b""
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256)) if bits == 8 else b""
    for y in reversed(range(h)):
        line = px[y, :, 0].tobytes() if bits == 8 else b"".join(px[y, x, ::-1].tobytes() + b"\0" * (bits == 32) for x in range(w))
        body += line.ljust(row, b"\0")
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(body), 0, 0, 0, 0) + palette + body


def test_decoders():
    px = np.random.default_rng(0).integers(0, 256, (5, 7, 3), "u1")
    assert (media.decode(media.encode_ppm(px)) == px).all()
    assert (media.decode(bmp(px, 24)) == px).all() and (media.decode(bmp(px, 32)) == px).all()
    grey = np.repeat(px[:, :, :1], 3, axis=2)
    assert (media.decode(bmp(grey, 8)) == grey).all()
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0").ravel().tolist() == [0, 255, 0, 255, 0, 255]
    assert media.decode(b"P4 3 2\n\xa0\x40").ravel().tolist() == [0, 255, 0, 255, 0, 255]
    assert media.decode(b"P2 2 1 15\n0 15").ravel().tolist() == [0, 255]
    assert media.decode(b"P3 1 1 255\n1 2 3").ravel().tolist() == [1, 2, 3]
    assert media.decode(b"P5 2 1 65535\n\0\0\xff\xff").ravel().tolist() == [0, 255]
    for bad in (b"", b"P6 2 2 255\n123", b"BM", b"P6 x", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize():
    rnd = np.random.default_rng(2)
    px = rnd.integers(0, 256, (12, 10, 1), "u1")
    assert np.allclose(media.resize_area(px, 3, 5)[:, :, 0], px[:, :, 0].reshape(3, 4, 5, 2).mean(axis=(1, 3)))
    fine = np.repeat(np.repeat(px, 7, axis=0), 7, axis=1)  # 84 x 70, into 7 x 7 of 12 x 10 each
    assert np.allclose(media.resize_area(px, 7, 7)[:, :, 0], fine[:, :, 0].reshape(7, 12, 7, 10).mean(axis=(1, 3)))
    assert media.difference_hash(np.tile(np.arange(90, 0, -1, dtype="u1")[None, :, None], (8, 1, 1))) == "ff" * 8


def test_media_columns(spark, docs, rows, empty, tmp_path):
    px = np.zeros((40, 50, 3), "u1")
    df = spark.createDataFrame([(1, bytearray(media.encode_ppm(px))), (2, bytearray(b"P6 9 9 255\n")), (3, None)], "id long, media binary")
    t = media.tiles(df)
    got = {r.id: r for r in t.collect()}
    assert got[1].height == 40 and got[2].tile is None and got[2].error and got[3].error == "no media"
    files = {r.id: r.file for r in media.write_npy_tiles(t, f"file://{tmp_path}/tiles").collect()}
    assert np.load(tmp_path / "tiles" / files[1]).shape == (32, 32, 3) and files[3] is None
    media.pack_texts(docs, f"file://{tmp_path}/m")
    media.write_tile_archives(spark.read.parquet(f"file://{tmp_path}/m"), f"file://{tmp_path}/a")
    out = media.read_tiles(spark, f"file://{tmp_path}/a").collect()
    for r in out:
        px = media.decode(media.encode_ppm(np.frombuffer(media.payload_of(dict((i, t or "") for i, t, *_ in rows)[r.doc_id])[1], "u1").reshape(-1, 64, 3)))
        assert (np.load(io.BytesIO(bytes(r.tile))) == media.tile(px, media.TEXT_TILE)).all() and r.feature == media.difference_hash(px)
    want = Counter()
    for i, text, *_ in rows:
        d = (text or "").encode()
        p = d + b" " * (max(1, -(-len(d) // 192)) * 192 - len(d))
        want[(i, len(d), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    media.pack_texts(empty, f"file://{tmp_path}/e")
    media.write_tile_archives(spark.read.parquet(f"file://{tmp_path}/e"), f"file://{tmp_path}/ea")
    assert media.read_tiles(spark, f"file://{tmp_path}/ea").count() == 0


# --------------------------------------------------------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline as cp

    once = list({r[0]: r for r in rows}.values())
    given = spark.createDataFrame(once, SCHEMA).repartition(3)
    given.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, *_ in once], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path)).collect()

    field = quality.learn(given, labels)
    assert field != quality.DEFAULT
    keep = [(i, t) for i, t, *_ in once if quality.judge(t or "", field)[-1]]
    keys = {}
    for i, t in keep:
        for line in t.encode().split(b"\n"):
            if (k := linededup.line_key(line, 10)) is not None:
                keys.setdefault(k, set()).add(i)
    lines = [(i, b"\n".join(x for x in t.encode().split(b"\n") if (k := linededup.line_key(x, 10)) is None or min(keys[k]) == i).decode()) for i, t in keep]
    kept = {i for (i, _, _, k), n in brute_near(lines, 5, 80).items() if k}
    few = [(i, t) for i, t in lines if i in kept]
    left = suffixdedup.brute_force_words(few, cp.PASSAGE)
    assert {p.doc_id for p in got} == set(left) and len(left) > 10
    tok = codec.Codec(codec.vocabulary("byte_bpe_50k.json"))
    for i, text in left.items():
        assert {p.doc_tokens for p in got if p.doc_id == i} == {len(tok.ids(text.decode())) // 4 + 1}
        assert sum(p.length for p in got if p.doc_id == i) == len(tok.ids(text.decode())) // 4 + 1
    assert any(len(left[i]) < len(t.encode()) for i, t in few)


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 3])
def test_repeated_passages_counted_in_words(spark, hot):
    rnd = random.Random(19)
    word = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(k))
    words = lambda n, k=9: [word(rnd.randint(1, k)) for _ in range(n)]
    shared = [words(51, 1), words(51), words(50), words(80, 3), ["a"] * 60, ["long" * 3000, *words(55)]]
    rows = [(i, "\t ".join([*words(rnd.randint(0, 90)), *shared[i % 6], *words(rnd.randint(0, 60))]) + "\n") for i in range(40)]
    rows += [(50, None), (51, ""), (52, "  \n"), (53, " ".join(shared[0])), (54, " ".join(words(20_000, 4))), (55, " ".join(["x"] * 51)), (56, " ".join(["y"] * 52))]
    rows += [(57, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in suffixdedup.removed(df, hot=hot, words=51).collect()}
    for i, kept in suffixdedup.brute_force_words(rows, 51).items():
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest() and got[i].n_bytes - got[i].n_removed == len(kept), i


def test_word_units():
    assert suffixdedup.word_units(b"")[0] == suffixdedup.word_units(b" \n\t")[0] == b""
    text = "  a bb\x0ba  \n ccc bb\rbb a" + " " + "z" * 200_000 + " z"
    units, starts, ends = suffixdedup.word_units(text.encode())
    each = [units[8 * k : 8 * k + 8] for k in range(len(starts))]
    seen = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    assert seen == text.split() and len({*each}) == len({*seen})
    assert all((x == y) == (u == v) for x, u in zip(seen, each, strict=True) for y, v in zip(seen, each, strict=True))
    rnd = random.Random(4)
    many = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 18))) for _ in range(20_000)}
    whole = " ".join(sorted(many)).encode()
    units = suffixdedup.word_units(whole)[0]
    assert len({units[k : k + 8] for k in range(0, len(units), 8)}) == len(many)
    assert units[:80] == suffixdedup.word_units(whole[: whole.index(b" ", 120)])[0][:80]


def test_pipeline_removes_a_shared_passage_of_51_words(spark):
    import corpus_pipeline as cp

    rnd = random.Random(9)
    word = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    words = lambda n: " ".join(word(rnd.randint(2, 9)) for _ in range(n))
    short, usual = " ".join(word(1) for _ in range(51)), words(51)
    phrase = words(50)  # one word less than a passage, and more than 200 bytes
    assert len(short) == 101 and 200 < len(phrase) < 400
    texts = [(1, f"{words(60)} {short} {words(40)}"), (2, f"{words(30)} {short} {words(80)}"), (3, f"{usual} {words(70)}"), (4, f"{words(70)} {usual}")]
    clean = [(5, words(150)), (6, f"{words(50)} {phrase} {words(50)}"), (7, f"{words(20)} {phrase} {words(90)}")]
    df = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in texts + clean], SCHEMA)
    got = {r.doc_id: r.text for r in cp.substring_dedup(spark, df, "").collect()}
    for i, t in texts:
        assert got[i] == t.replace(short if i < 3 else usual, "")
    assert [got[i] for i, _ in clean] == [t for _, t in clean]


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 3])
def test_short_passages_are_counted_beside_the_bytes(spark, tmp_path, hot):
    rnd = random.Random(21)
    word = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    words = lambda n: [word(rnd.randint(2, 8)) for _ in range(n)]
    join = lambda *x: " ".join(w for y in x for w in y)
    passage, phrase, touching = words(51), words(50), (words(51), words(51))
    assert len(join(passage)) < 400
    rows = [(1, join(words(60), passage, words(40))), (2, join(words(30), passage, words(9)) + "\n" + join(passage)), (3, "\t".join(passage)), (4, join(phrase, words(80)))]
    rows += [(5, join(words(9), phrase)), (6, None), (7, ""), (8, join(words(150))), (9, join(*touching, words(3))), (10, join(touching[0])), (11, join(touching[1]))]
    copy = join(words(400))
    rows += [(12, copy), (13, copy), (14, copy + " end"), (15, copy), (15, copy)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffixdedup.query(spark, str(tmp_path)) if hot > 3 else suffixdedup.removed(spark.read.parquet(f"{tmp_path}/documents.parquet"), hot=hot, passages=51)
    got = got.collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(suffixdedup.brute_force(rows))
    want = {1: (1, 51), 2: (2, 102), 3: (1, 51), 9: (1, 102), 10: (1, 51), 11: (1, 51), **dict.fromkeys((12, 13, 14, 15), (1, 400))}
    assert all((r.n_passages, r.n_passage_words) == want.get(r.doc_id, (0, 0)) for r in got) and len(got) == len(rows)
    assert all(r.n_removed == 0 for r in got if r.doc_id < 12)


@pytest.mark.parametrize("words, length", [(False, 400), (True, 51)])
def test_anchors_of_many_texts(words, length, monkeypatch):
    rnd = random.Random(22)
    texts = [prose(rnd, rnd.choice([0, 3, 60, 200, 900])).encode() for _ in range(60)] + [b"", b" ", b"x" * 399, b"x" * 400, b"y " * 50, b"y " * 51]
    monkeypatch.setattr(suffixdedup, "TOGETHER", 9000)
    sizes, codes, hashes = suffixdedup.anchors_of(texts, length, words)
    each = [suffixdedup.anchors(suffixdedup.word_units(t)[0] if words else t, length, "<u8" if words else "u1") for t in texts]
    assert sizes.tolist() == [len(c) for c, _ in each] and sum(sizes) > 100
    assert (codes == np.concatenate([c for c, _ in each])).all() and (hashes == np.concatenate([h for _, h in each])).all()
    assert [len(x) for x in suffixdedup.anchors_of([], length, words)] == [0, 0, 0]


def test_pipeline_stages_keep_columns_and_pass_empty_tables(spark, tmp_path, empty):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).columns == empty.columns
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
