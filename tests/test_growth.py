"""What findings on larger tables asked for: less is moved and held, with the same results."""

import random
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evbench.operators import contracts as C
from evbench.operators import graphs as G
from evbench.operators import joins as J
from evbench.operators import similarity as M
from evbench.operators import splits as S
from evbench.operators import statistics as T


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_trial_of_communities_passes_over_the_edges_once(spark, monkeypatch):
    cliques = [(10 * c + i, 10 * c + j) for c in range(6) for i in range(8) for j in range(i)] + [(10 * c, 10 * (c + 1) + 1) for c in range(5)]
    e = spark.createDataFrame(cliques, "a long, b long")
    seen, join = Counter(), type(e).join

    def counted(d, *args, **kw):
        seen[tuple(d.columns)] += 1
        return join(d, *args, **kw)

    monkeypatch.setattr(type(e), "join", counted)
    G.communities(e, task_edges=0).count()
    # the edges (a, b, w) are joined to the labels of one end alone: what is around a trial is judged without another pass
    assert seen["a", "b", "w"] > 0 and seen["a", "b", "w", "ca"] == 0


def test_a_trial_of_communities_keeps_one_row_a_vertex(spark, monkeypatch):
    cliques = [(10 * c + i, 10 * c + j) for c in range(6) for i in range(8) for j in range(i)] + [(10 * c, 10 * (c + 1) + 1) for c in range(5)]
    kept, put = [], G.Stored.put

    def counted(stored, df):
        out = put(stored, df)
        kept.append((tuple(out.columns), out.count()))
        return out

    monkeypatch.setattr(G.Stored, "put", counted)
    labels = {r.v: r.label for r in G.communities(spark.createDataFrame(cliques, "a long, b long"), task_edges=0).collect()}
    assert {labels[10 * c + i] for c in range(6) for i in range(8)} == {labels[10 * c] for c in range(6)} and len({*labels.values()}) == 6
    edges = 2 * len(cliques)
    # of the edges' number are the edges themselves alone
    assert [columns for columns, n in kept if n > len(labels)] == [("a", "b", "w")] and kept[0] == (("a", "b", "w"), edges)


def test_only_similar_pairs_leave_the_join(spark, monkeypatch):
    rnd = random.Random(3)
    sets = {i: sorted(rnd.sample(range(40), rnd.randrange(1, 9))) for i in range(120)}
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.5}
    rows = M._sets(spark.createDataFrame([*sets.items()], "id long, t array<long>"), "id", "t", None).selectExpr("*", "1 as m")
    for carried in (M.CARRIED, 5, 0):  # longer sets look themselves up
        monkeypatch.setattr(M, "CARRIED", carried)
        pairs = M._candidates(rows, None, 0.5)[0].collect()
        assert len(pairs) == len(want) and {(r.a, r.b) for r in pairs} == want


def test_groups_are_audited_as_their_rows(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, *range(9)]), rnd.randrange(200), rnd.random() < 0.4) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x int, y int, label boolean")
    specs = [("X", "x", 1), ("Y", "y", 2)]
    long = S.named_splits(df, "id", specs).join(df.select("id", "label"), "id")
    audited = lambda d: sorted(map(tuple, d.collect()))
    assert audited(S.audit(S.named_split_groups(df, "label", specs), size="size")) == audited(S.audit(long))


def test_pieces_are_audited_as_their_rows_and_no_group_is_stored(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, *range(40)]), rnd.choice([None, *"abcdefghij", "12:0"]), rnd.choice([None, True, False])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, x int, y string, label boolean")
    specs = [("X", "x", 1), ("Y", "y", 2), ("I", "id", 3), ("XY", "xy", 4)]
    wide = df.withColumn("xy", F.concat("x", F.lit(":"), "y"))
    families = [S.Family([("X", F.col("x"), 1), ("XY", F.concat("x", F.lit(":"), "y"), 4)], ["x", "y"], "x"), S.Family([("Y", F.col("y"), 2), ("I", F.col("id"), 3)], ["y", "id"])]
    kept, cut = [], S.cut

    def counted(d):
        out = cut(d)
        kept.append(out.count())
        return out

    monkeypatch.setattr(S, "cut", counted)
    pieces = S.split_pieces(df, "label", families, digits=1)
    assert max(kept) < 1000
    audited = lambda d: sorted(map(tuple, d.collect()))
    got = audited(S.audit(pieces, key="piece", size="size"))
    monkeypatch.undo()
    assert got == audited(S.audit(S.named_splits(wide, "id", specs).join(wide.select("id", "label"), "id"))) and len(got) == 4
    assert S.split_pieces(df.where("x is null"), "label", families[:1]).collect() == [("X", None, "train", sum(r[1] is None for r in rows), sum(r[1] is None and bool(r[3]) for r in rows)), ("XY", None, "train", sum(r[1] is None for r in rows), sum(r[1] is None and bool(r[3]) for r in rows))]


def test_rows_of_groups_over_the_cap_go_before_the_join(spark):
    rows = [(i, "day", str(i // 5)) for i in range(60)] + [(i, "status", "F") for i in range(60)] + [(60, "day", None)]
    stars = G.stars(spark.createDataFrame(rows, "row int, axis string, key string"), "row", ["axis", "key"], 5)
    assert {(r.a, r.b) for r in stars.collect()} == {(i // 5 * 5, i) for i in range(60)} | {(i, i) for i in range(61)}
    assert "BroadcastHashJoin [axis" in plan(stars) and "LeftAnti" in plan(stars)


def test_common_neighbours_of_hubs_in_several_lists(spark, monkeypatch):
    monkeypatch.setattr(G, "LISTED", 3)
    rnd = random.Random(8)
    edges = {tuple(sorted((f"v{rnd.randrange(4)}", f"v{rnd.randrange(30)}"))) for _ in range(150)}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    pairs = {(f"v{rnd.randrange(30)}", f"v{rnd.randrange(32)}") for _ in range(120)}
    got = G.topology_features(spark.createDataFrame([*edges], "a string, b string"), spark.createDataFrame([*pairs], "a string, b string")).collect()
    assert {(r.a, r.b): r.common for r in got} == {(a, b): len((near.get(a, set()) & near.get(b, set())) - {a, b}) for a, b in pairs}


def test_nearest_reads_no_frame_to_the_end_of_a_group(spark):
    p = spark.createDataFrame([("g", i, 7 * i) for i in range(30)], "g string, i int, v int")
    s = spark.createDataFrame([("g", 20), ("g", 100)], "g string, v int")
    d = J.nearest(p, s, "g", "i", "v")
    assert {r.i: r.distance for r in d.collect()} == {i: min(abs(7 * i - 20), abs(7 * i - 100)) for i in range(30)}
    assert "currentrow$(), unboundedfollowing$()" not in plan(d)


def test_rules_are_compiled_as_constants(spark):
    rules = spark.createDataFrame([("a", "yes", "integer", "", ""), ("b", "no", "", "x| y", "[xy]")], "field string, required string, type string, allowed string, pattern string")
    found = C.violations(spark.createDataFrame([(1, "2", "y"), (2, " ", "z"), (3, "q", None)], "id int, a string, b string"), "id", rules)
    assert {tuple(r) for r in found.collect()} == {(2, "a", "missing"), (2, "b", "not allowed"), (3, "a", "not integer")}
    assert "lambda" not in plan(found)


def test_contained_by_bytes_in_pieces(spark, monkeypatch):
    rnd = random.Random(15)
    word = lambda n: "".join(rnd.choice("abé😀 ") for _ in range(n))
    texts = {i: word(rnd.randrange(400)) for i in range(40)} | {40: "", 41: None, 42: "a" * 300}
    needles = {i: (lambda t, n: t[(k := rnd.randrange(max(1, len(t) - n + 1))) : k + n])(texts[rnd.randrange(40)], rnd.choice([19, 20, 25, 60, 120])) for i in range(60)} | {60: "a" * 90, 61: "a" * 20, 62: None, 63: word(50)}
    want = {(n, t): b.find(a) for n, a in needles.items() for t, b in texts.items() if a and b and len(a) >= 20 and a in b}
    n, t = spark.createDataFrame([*needles.items()], "needle_id long, needle string"), spark.createDataFrame([*texts.items()], "text_id long, text string")
    for piece in (J.PIECE, 50):
        monkeypatch.setattr(J, "PIECE", piece)
        assert {(r.needle_id, r.text_id): r.start for r in J.contained(n, t).collect()} == want


def test_fillings_of_a_large_pool_are_held_in_parts():
    n, reps = 12_600_000, 150
    part = next(T._parts(reps, n))
    totals = np.full(len(part), n - int(T.MARGIN * n**0.5))
    tracemalloc.start()
    T.Fillings(n, totals, 4, 0, part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20, peak


def test_modularity_joins_the_edges_once(spark):
    edges = [(i, j) for i in range(6) for j in range(i)] + [(10 + i, 10 + j) for i in range(6) for j in range(i)] + [(0, 10)]
    e, labels = spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(v, v // 10) for v in [*range(6), *range(10, 16)]], "v int, label int")
    got = G.modularity(e, labels)
    r = got.first()
    assert (r.communities, r.modularity) == (2, round(30 / 31 - 2 * (31 / 62) ** 2, 9))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_either_direction_without_doubling_the_contacts(spark):
    asked = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (5, 6)], "a int, b int")
    contacts = spark.createDataFrame([(1, 2, 7), (1, 2, 8), (4, 3, 9)], "x int, y int, v int")
    d = J.either_direction(asked, contacts, "v")
    assert sorted(map(tuple, d.collect())) == [(1, 2, 7, False), (1, 2, 8, False), (2, 1, 7, True), (2, 1, 8, True), (3, 4, 9, True)]
    assert "Aggregate" not in plan(d)
