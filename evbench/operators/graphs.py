"""Components, communities and train-only graph features on edge tables.  Cliques are never built: a group is a star."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import Stored, cut


#: Edges up to which what is left of a graph is united in one task.
TASK_EDGES = 200_000


def _united(edges: DataFrame) -> DataFrame:
    """(v, label) of a bounded number of edges: label is the least vertex that a union-find reaches."""
    kind = edges.schema["a"].dataType.simpleString()

    def unite(batches):
        t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        names = pc.unique(pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]))
        names = names.take(pc.sort_indices(names))  # so that the least number is the least vertex
        a, b = (pc.index_in(t.column(c), names).to_pylist() for c in ("a", "b"))
        parent = list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(a, b, strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = pa.array([root(x) for x in range(len(names))])
        yield pa.RecordBatch.from_arrays([names, names.take(roots)], names=["v", "label"])

    return edges.select("a", "b").repartition(1).mapInArrow(unite, f"v {kind}, label {kind}")


def components(edges: DataFrame, most_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(v, label) of every vertex of the undirected edges (a, b); label is the smallest vertex of its component.

    Each round orders the vertices by a fresh hash, points every vertex at the least of itself and its neighbours, and puts those
    in place of the ends of the edges; edges within one vertex and repeated ones go.  A constant share of the vertices goes in each
    round, of a chain as of a star, until what is left fits one task, which unites it.  A round keeps the map of its own vertices alone, and the maps are
    applied to one another at the end, from the smallest on, so that no round writes the labels of all vertices.
    Minima are combined map-side, and a hub's edges are gone after the first rounds; joins by a hub
    or by a large component's label are split by Spark's skew join.  Self-loops keep a vertex without other edges.  What the rounds wrote is deleted.
    """
    rounds = Stored(edges.sparkSession)
    every = rounds.put(edges.select("a", "b").distinct())
    left, moves = rounds.put(every.where("a <> b")), []
    for k in range(most_rounds):
        if left.count() <= task_edges:
            break
        key = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        least = F.least(key("a"), key("b")).alias("m")
        ends = left.select(F.col("a").alias("v"), least).unionByName(left.select(F.col("b").alias("v"), least))
        step = rounds.put(ends.groupBy("v").agg(F.min("m").alias("m")).select("v", F.col("m.v").alias("m")))
        moves.append(step)
        moved = left.join(step.toDF("a", "am"), "a").join(step.toDF("b", "bm"), "b")
        before, left = left, rounds.put(moved.select(F.least("am", "bm").alias("a"), F.greatest("am", "bm").alias("b")).where("a <> b").distinct())
        rounds.drop(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    names = _united(left)
    for step in reversed(moves):
        names = step.join(names.toDF("m", "label"), "m", "left").select("v", F.coalesce("label", "m").alias("label"))
    if moves:
        names = rounds.put(names)
        names = names.join(names.groupBy("label").agg(F.min("v").alias("least")), "label").select("v", F.col("least").alias("label"))
    vertices = every.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    out = cut(vertices.join(names, "v", "left").select("v", F.coalesce("label", "v").alias("label")))
    rounds.close()
    return out


#: Groups too common to connect whose rows are dropped before a shuffle, at most.
MOST_HEAVY = 10_000


def stars(memberships: DataFrame, row: str, keys: Sequence[str], cap: int | None = None) -> DataFrame:
    """(a, b) edges from the smallest row of each group to its others, so that a group costs its size; a row meets itself too.

    memberships: (row, *keys).  cap, part of the meaning: larger groups are too common to connect.  Null keys connect nothing.
    """
    known = memberships.dropna(subset=list(keys))
    w = known.groupBy(*keys).agg(F.min(row).alias("a"), F.count(F.lit(1)).alias("n"))
    if cap is not None:
        # the rows of the largest groups go before they would meet in one task; fewer than MOST_HEAVY groups are so large
        heavy = w.where(F.col("n") > max(cap, known.count() // MOST_HEAVY)).select(*keys)
        known = known.join(F.broadcast(heavy), list(keys), "left_anti")
        w = w.where(F.col("n") <= cap)
    return known.join(w, list(keys)).select("a", F.col(row).alias("b")).unionByName(memberships.select(F.col(row).alias("a"), F.col(row).alias("b"))).distinct()


def entity_components(rows: DataFrame, row: str, entities: Column) -> DataFrame:
    """(row, component): rows are connected if they share an entity; rows without entities are alone."""
    m = rows.select(F.col(row).alias("row"), F.explode_outer(entities).alias("e"))
    return components(stars(m, "row", ["e"])).select(F.col("v").alias(row), F.col("label").alias("component"))


def axis_memberships(rows: DataFrame, row: str, axes: dict[str, Column]) -> DataFrame:
    """(row, axis, key) in long form, one row per axis."""
    return rows.select(F.col(row).alias("row"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c.cast("string").alias("key")) for a, c in axes.items()])).alias("x")).select("row", "x.axis", "x.key")


def axis_edge_counts(members: DataFrame, cap: int) -> DataFrame:
    """(axis, edges, skipped): pairs that the groups of each axis connect, by formula, and groups over the cap."""
    g = members.where("key is not null").groupBy("axis", "key").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("axis").agg(F.sum(F.when(F.col("n") <= cap, F.expr("n * (n - 1) div 2")).otherwise(0)).alias("edges"), F.count_if(F.col("n") > cap).alias("skipped"))


def label_propagation(edges: DataFrame, rounds_: int, simple: bool = False) -> DataFrame:
    """(v, label) after synchronous rounds: each vertex takes its neighbours' commonest label, the smallest among ties; simple: as for communities()."""
    rounds = Stored(edges.sparkSession)
    one = edges.select("a", "b") if simple else _simple(edges)
    both = rounds.put(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    # in the first round all labels are vertices, each with one vote
    first = F.min("b") if rounds_ > 0 else F.first("a")
    labels = rounds.put(both.groupBy(F.col("a").alias("v")).agg(first.alias("label")))
    for _ in range(1, rounds_):
        votes = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        # the greatest count, then the smallest label
        best = votes.groupBy("a").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"))
        before, labels = labels, rounds.put(best.select(F.col("a").alias("v"), "label"))
        rounds.drop(before)
    out = cut(labels)
    rounds.close()
    return out


def _settled(near: list[dict[int, float]], own: list[float], least_gain: float) -> list[int]:
    """The community of each vertex: vertices move one by one to where the modularity gains most, until a pass gains little; communities become vertices, and so on.

    near: for each vertex its neighbours with their weights; own: the weight within each vertex, both ways.
    """
    k = [sum(x.values()) + o for x, o in zip(near, own, strict=True)]
    total = sum(k)
    label = list(range(len(near)))
    while True:
        at, held, moved = list(range(len(near))), list(k), 0.0
        while True:
            gained = 0.0
            for v, x in enumerate(near):
                to: dict[int, float] = {at[v]: 0.0}
                for u, w in x.items():
                    to[at[u]] = to.get(at[u], 0.0) + w
                now = at[v]
                held[now] -= k[v]
                best, stay = now, to[now] - k[v] * held[now] / total
                top = stay
                for c, w in to.items():
                    gain = w - k[v] * held[c] / total
                    if gain > top + 1e-12 or (best != now and abs(gain - top) <= 1e-12 and c < best):
                        best, top = c, max(top, gain)
                held[best] += k[v]
                at[v] = best
                gained += 2 * (top - stay) / total
            moved += gained
            if gained < least_gain / 10:
                break
        names = {c: i for i, c in enumerate(sorted(set(at)))}
        label = [names[at[c]] for c in label]
        if moved < least_gain or len(names) == len(near):
            return label
        nearer: list[dict[int, float]] = [{} for _ in names]
        inner, degree = [0.0] * len(names), [0.0] * len(names)
        for v, x in enumerate(near):
            c = names[at[v]]
            inner[c] += own[v]
            degree[c] += k[v]
            for u, w in x.items():
                d = names[at[u]]
                if c == d:
                    inner[c] += w
                else:
                    nearer[c][d] = nearer[c].get(d, 0.0) + w
        near, own, k = nearer, inner, degree


def _settled_in_task(both: DataFrame, vertices: DataFrame, least_gain: float) -> DataFrame:
    """(v, label) of a graph of a bounded number of edges; label is the least vertex of the community."""
    kind = vertices.schema["v"].dataType.simpleString()
    rows = both.select("a", "b", "w").unionByName(vertices.select(F.col("v").alias("a"), F.col("v").alias("b"), F.col("own").alias("w")))

    def settle(batches):
        t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        names = pc.unique(t.column("a"))
        names = names.take(pc.sort_indices(names))
        near: list[dict[int, float]] = [{} for _ in range(len(names))]
        own = [0.0] * len(names)
        for a, b, w in zip(*(pc.index_in(t.column(c), names).to_pylist() for c in ("a", "b")), t.column("w").to_pylist(), strict=True):
            if a == b:
                own[a] = w
            else:
                near[a][b] = w
        label = _settled([dict(sorted(x.items())) for x in near], own, least_gain)
        first: dict[int, int] = {}
        for v, c in enumerate(label):
            first.setdefault(c, v)
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array([first[c] for c in label]))], names=["v", "label"])

    return rows.repartition(1).mapInArrow(settle, f"v {kind}, label {kind}")


#: Shares of the vertices that move at once: the largest one that raises the modularity.
SHARES = (2, 4, 16, 64)


def _simple(edges: DataFrame) -> DataFrame:
    """The edges (a, b) between two vertices, each once, with a < b."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def communities(edges: DataFrame, least_gain: float = 1e-3, most_levels: int = 6, most_rounds: int = 10, task_edges: int = TASK_EDGES, simple: bool = False) -> DataFrame:
    """(v, label) of communities found by their modularity; labels are vertices.

    Levels of local moving and contraction.  In a round every vertex looks at the communities of its neighbours, one row for each
    (vertex, community), and picks that of the greatest gain

        (edges to it) - (own degree) * (degrees in it, without its own) / (all degrees)

    if that beats staying; the smaller label wins ties.  Gains hold for a vertex that moves alone, so a share of the vertices moves, by a fresh hash: a half, or if the
    modularity falls a quarter, and so on; so it never falls.  A level ends when a round gains less than least_gain, and the search when a level
    does.  Then the communities are the vertices of the next level, with the edges between them added up.  A level whose edges fit one task ends there,
    vertex by vertex.  A trial takes one pass over the edges, of which it keeps one row for each vertex: the weight of its edges within its community,
    and where it wishes to go next.  The edges lie in the order of their ends, so that a pass adds them up before they move.  simple: each edge
    is there once, with a < b.  What the rounds wrote is deleted.
    """
    rounds = Stored(edges.sparkSession)
    one = edges.select("a", "b") if simple else _simple(edges)
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("w", F.lit(1.0))
    both = rounds.put(both.repartitionByRange("a", "b").sortWithinPartitions("a", "b"))
    # own: the weight within a vertex of this level, both ways
    vertices = rounds.put(both.groupBy("a").agg(F.sum("w").alias("k")).select(F.col("a").alias("v"), "k", F.lit(0.0).alias("own")))
    total = vertices.agg(F.coalesce(F.sum("k"), F.lit(0.0))).first()[0]
    names = None

    def looked(labels: DataFrame, near: DataFrame) -> DataFrame:
        """labels (v, c, k, own) with the weight of each vertex's edges within its community, and where it gains most, from the rows (a, c, w) of what is around it."""
        held = labels.groupBy("c").agg(F.sum("k").alias("t"))
        gain = lambda w, others: F.round(w - F.col("k") * others / F.lit(total), 9)
        j = near.join(labels.select(F.col("v").alias("a"), F.col("c").alias("now"), "k"), "a").join(held, "c")
        there = F.when(F.col("c") != F.col("now"), F.struct((-gain(F.col("w"), F.col("t"))).alias("g"), F.col("c").alias("c")))  # the smaller label wins ties
        best = j.groupBy("a").agg(F.sum(F.when(F.col("c") == F.col("now"), F.col("w"))).alias("inside"), F.min(there).alias("best"))
        own = labels.join(best.withColumnRenamed("a", "v"), "v", "left").join(held, "c").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
        leaves = -F.col("best.g") > gain(F.col("inside"), F.col("t") - F.col("k"))  # staying wins ties
        return rounds.put(own.select("v", "c", "k", "own", "inside", F.when(leaves, F.col("best.c")).otherwise(F.col("c")).alias("to")))

    def around(labels: DataFrame) -> DataFrame:
        """(a, c, w): the weight of the edges of each vertex to each community."""
        return both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))

    def quality(state: DataFrame) -> float:
        """Modularity of the labels (v, c, k, own, inside) of this level."""
        held = state.groupBy("c").agg(F.sum(F.col("inside") + F.col("own")).alias("inside"), F.sum("k").alias("k"))
        x = held.agg(F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
        return x["inside"] / total - x["squares"] / (total * total)

    for level in range(most_levels if total else 0):
        if both.count() <= 2 * task_edges:
            step = rounds.put(_settled_in_task(both, vertices, least_gain))
            names = step if names is None else rounds.put(names.join(step.toDF("label", "next"), "label").select("v", F.col("next").alias("label")))
            break
        state = looked(vertices.withColumn("c", F.col("v")), both.select("a", F.col("b").alias("c"), "w"))  # every vertex is a community
        start = reached = quality(state)
        for k in range(most_rounds):
            gained = 0.0
            for share in SHARES:
                turn = F.pmod(F.xxhash64("v", F.lit(1000 * level + k)), F.lit(share)) == 0
                tried = state.select("v", F.when(turn, F.col("to")).otherwise(F.col("c")).alias("c"), "k", "own")
                trial = looked(tried, around(tried))
                q = quality(trial)
                if q > reached:
                    gained, reached = q - reached, q
                    rounds.drop(state)
                    state = trial
                    break
                rounds.drop(trial)
            if gained < least_gain:
                break
        step = state.select("v", F.col("c").alias("label"))
        names = step if names is None else rounds.put(names.join(step.toDF("label", "next"), "label").select("v", F.col("next").alias("label")))
        if reached - start < least_gain:
            break
        summed = around(state).withColumnRenamed("c", "cb").join(state.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").groupBy("ca", "cb").agg(F.sum("w").alias("w"))
        summed = rounds.put(summed.repartitionByRange("ca", "cb").sortWithinPartitions("ca", "cb"))
        inner = summed.where("ca = cb").select(F.col("ca").alias("c"), "w")
        grown = state.groupBy("c").agg(F.sum("k").alias("k"), F.sum("own").alias("own"))
        vertices = rounds.put(grown.join(inner, "c", "left").select(F.col("c").alias("v"), "k", (F.col("own") + F.coalesce("w", F.lit(0.0))).alias("own")))
        both = summed.where("ca <> cb").toDF("a", "b", "w")
    out = cut(names if names is not None else vertices.select("v", F.col("v").alias("label")))
    rounds.close()
    return out


def modularity(edges: DataFrame, labels: DataFrame, simple: bool = False) -> DataFrame:
    """One row: communities and modularity of the labels on the undirected edges; simple: as for communities()."""
    e = edges.select("a", "b") if simple else _simple(edges)
    m = e.join(labels.select(F.col("v").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b")
    # the edges are joined once: their numbers by labels give the ends of a label and the edges within it
    n = m.groupBy("la", "lb").agg(F.count(F.lit(1)).alias("n"))
    within = F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)
    ends = n.select(F.explode(F.array(F.struct(F.col("la").alias("c"), F.col("n").alias("d"), within.alias("l")), F.struct(F.col("lb").alias("c"), F.col("n").alias("d"), F.lit(0).cast("long").alias("l")))).alias("x"))
    j = ends.groupBy("x.c").agg(F.sum("x.d").alias("d"), F.sum("x.l").alias("l"))
    s = j.agg(F.count(F.lit(1)).alias("communities"), F.sum("l").alias("l"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum("d").alias("t"))
    return s.select("communities", F.round(2 * F.col("l") / F.col("t") - F.col("dd") / (F.col("t") * F.col("t")), 9).alias("modularity"))


def degree_features(train: DataFrame, rows: DataFrame, a: str, b: str, site: str) -> DataFrame:
    """rows with six counts from train alone: of a as a, of b as b, of either as any, of the site and of the pair."""
    n = F.count(F.lit(1))
    da, db = train.groupBy(a).agg(n.alias("n_a")), train.groupBy(b).agg(n.alias("n_b"))
    every = train.select(F.col(a).alias("p")).unionByName(train.select(F.col(b).alias("p"))).groupBy("p").agg(n.alias("n"))
    ds, dp = train.groupBy(site).agg(n.alias("n_site")), train.groupBy(a, b).agg(n.alias("n_pair"))
    out = rows.join(da, a, "left").join(db, b, "left").join(ds, site, "left").join(dp, [a, b], "left")
    out = out.join(every.select(F.col("p").alias(a), F.col("n").alias("n_any_a")), a, "left").join(every.select(F.col("p").alias(b), F.col("n").alias("n_any_b")), b, "left")
    return out.fillna(0, ["n_a", "n_b", "n_site", "n_pair", "n_any_a", "n_any_b"])


def pair_degree_features(train: DataFrame, rows: DataFrame, a: str, b: str, label: str | None) -> DataFrame:
    """rows with the train degrees of a and b, their sum, difference, least, greatest and product, whether either and both were seen,
    whether the pair was, in any order, and the source of the counts.

    A degree counts train rows that have the entity at either end; rows with a blank end count nothing.  Positive train rows are
    counted where there are any, else all.  Entities are compared trimmed and in upper case.
    """
    source = "all_train_rows"
    if label is not None and not train.where(F.col(label)).isEmpty():
        train, source = train.where(F.col(label)), "train_positive_rows"
    named = lambda c: F.nullif(F.upper(F.trim(F.col(c).cast("string"))), F.lit(""))
    known = train.select(named(a).alias("x"), named(b).alias("y")).dropna()
    degrees = known.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    pairs = known.select(F.least("x", "y").alias("__lo"), F.greatest("x", "y").alias("__hi")).distinct().withColumn("pair_seen", F.lit(1))
    j = rows.withColumn("__x", named(a)).withColumn("__y", named(b))
    j = j.withColumn("__lo", F.when(F.col("__y").isNotNull(), F.least("__x", "__y"))).withColumn("__hi", F.when(F.col("__x").isNotNull(), F.greatest("__x", "__y")))
    for end, name in (("__x", "deg_a"), ("__y", "deg_b")):
        j = j.join(degrees.select(F.col("v").alias(end), F.col("n").alias(name)), end, "left")
    j = j.join(pairs, ["__lo", "__hi"], "left").fillna(0, ["deg_a", "deg_b", "pair_seen"]).drop("__x", "__y", "__lo", "__hi")
    x, y = F.col("deg_a"), F.col("deg_b")
    made = {
        "deg_sum": x + y,
        "deg_diff": F.abs(x - y),
        "deg_min": F.least(x, y),
        "deg_max": F.greatest(x, y),
        "deg_product": x * y,
        "either_seen": ((x > 0) | (y > 0)).cast("int"),
        "both_seen": ((x > 0) & (y > 0)).cast("int"),
        "degree_source": F.lit(source),
    }
    return j.withColumns(made)


#: Neighbours that a list holds, about.
LISTED = 4096


def topology_features(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with deg_a, deg_b, common, same_component and edge_exists in the simple graph of the train edges (a, b).

    A self-loop adds 2 to a degree; common neighbours leave out a and b themselves; nodes that train doesn't have score 0.
    """
    e = cut(train.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = e.where("a <> b").unionByName(e.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both.select("a").unionByName(e.where("a = b").select(F.explode(F.array("a", "b")).alias("a")))
    deg = ends.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    asked = pairs.select("a", "b").distinct()
    # a pair brings the neighbours of its end of smaller degree to those of the other end, as lists; a hub's are dealt over lists by the neighbour's hash
    size = both.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    sized = asked.join(size.toDF("a", "ka"), "a").join(size.toDF("b", "kb"), "b")
    few, many = F.when(F.col("ka") <= F.col("kb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("ka") <= F.col("kb"), F.col("b")).otherwise(F.col("a"))
    lists = lambda k: (1 + F.floor(F.col(k) / LISTED)).cast("int")
    turned = sized.withColumn("k", F.greatest("ka", "kb")).select("a", "b", few.alias("few"), many.alias("many"), lists("k").alias("lists"))
    hubs = size.where(F.col("k") >= LISTED).select("a", lists("k").alias("lists"))
    dealt = both.join(hubs, "a", "left").select(F.col("a").alias("v"), F.coalesce(F.pmod(F.xxhash64("b"), F.col("lists")), F.lit(0)).cast("int").alias("l"), F.col("b").alias("w"))
    near = dealt.groupBy("v", "l").agg(F.collect_list("w").alias("ws"))
    brought = turned.join(near.select(F.col("v").alias("few"), "ws"), "few").withColumn("l", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)))
    own = F.when(F.col("lists") == 1, F.col("ws")).otherwise(F.filter("ws", lambda w: F.pmod(F.xxhash64(w), F.col("lists")) == F.col("l")))
    brought = brought.select("a", "b", "many", "l", F.array_except(own, F.array("a", "b")).alias("mine"))
    paths = brought.join(near.toDF("many", "l", "ws"), ["many", "l"]).select("a", "b", F.size(F.array_intersect("ws", "mine")).alias("n"))
    common = paths.groupBy("a", "b").agg(F.sum("n").alias("common"))
    comp = components(e)
    known = e.select("a", "b", F.lit(True).alias("edge"))
    out = asked.join(deg.select("a", F.col("deg").alias("deg_a")), "a", "left").join(deg.select(F.col("a").alias("b"), F.col("deg").alias("deg_b")), "b", "left").join(common, ["a", "b"], "left")
    out = out.join(comp.select(F.col("v").alias("a"), F.col("label").alias("ca")), "a", "left").join(comp.select(F.col("v").alias("b"), F.col("label").alias("cb")), "b", "left")
    out = out.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(known.withColumnsRenamed({"a": "lo", "b": "hi"}), ["lo", "hi"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("a", "b", zero("deg_a"), zero("deg_b"), zero("common"), F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("same_component"), F.coalesce("edge", F.lit(False)).alias("edge_exists"))


def subgraph_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, degree) of the nodes (v) in the simple graph of the edges (a, b) that both ends are nodes of; 0 for those without."""
    keep = lambda c: nodes.select(F.col("v").alias(c)).distinct()
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().join(keep("a"), "a", "left_semi").join(keep("b"), "b", "left_semi")
    d = e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("v").distinct().join(d, "v", "left").fillna(0, ["degree"])


def community_key(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b) with community_pair: the communities of both ends as texts in text order, -1 for an end without one."""
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").cast("string").alias(f"__{c}"))
    j = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    x, y = F.coalesce("__a", F.lit("-1")), F.coalesce("__b", F.lit("-1"))
    return j.withColumn("community_pair", F.concat(F.least(x, y), F.lit("|"), F.greatest(x, y))).drop("__a", "__b")
