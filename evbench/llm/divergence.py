"""Source divergence audit with a frequent-pattern tree of term rows (operator 12).

Per language the terms of at least `min_docs` of its documents are kept; a source's smoothed share of a term is
p = 1 + floor(10**9 * (count + 5) / (N + 5 V)) over V kept terms with N occurrences in the source.  The divergence of two sources is
the sum of |p - q| over all kept terms.  Most terms are missing from most sources, so it is not summed pair by pair:

    V |p0 - q0|                                  as if both sources had no term at all,
    + sum over a source's own counts             as if the other one lacked the term,
    + a pair correction where both hold it.

The first two need the histogram of a source's counts alone.  For the third, every kept term is a row of its nonzero counts, written
as (source, p) items in one order of sources.  Equal rows are counted first, which gives them a multiplicity; tasks then take ranges of the sorted
rows and insert them into a frequent-pattern tree, so that rows with the same beginning share a path.  A node's multiplicity is
that of all rows through it, and its correction with each ancestor is computed once, whatever the number of rows.  Corrections add up over trees.

A tree holds the path of one row at a time: rows come sorted, and a node is closed, and its corrections are added, as soon as a row leaves it.

All arithmetic is exact: decimals of 38 digits give p, and what comes after fits 64 bits (p <= 10**9 + 1, times V).

Null text, lang or source counts as the empty one.  A group without terms has p of count 0 everywhere and still meets the other sources
of its language; a language with no kept term gives pairs of value 0.  A language of one source gives no pairs.  Ties rank by item in
UTF-8 order.  Very long texts are read whole; very long terms are terms.  Repeated rows count again.  Rows with a null id count as any other, since no id is asked for.
Columns other than text, lang and source are never read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, forget, table

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Distinct (lang, source, term) triples that a task counts before it passes them on.
HELD = 400_000
#: Cells of a block when a source's counts meet the other sources of its language.
CELLS = 1 << 20

#: ASCII letters and every byte of a character beyond ASCII are parts of terms; A-Z become a-z.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TERM).split()


def counted(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents of a term in a group, summed within a task's run of documents; a row with the term '' stands for the group itself."""

    def scan(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (occurrences, holders) in groups.items():
                terms, n = [*holders], len(holders)
                columns = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (lang, source)]
                columns += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array([occurrences[t] for t in terms], pa.int64()), pa.array([holders[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "c", "d"])
            groups.clear()

        size = 0
        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                found = words(text)
                group = groups.get((lang, source))
                if group is None:
                    group = groups[lang, source] = (Counter(), Counter({b"": 1}))
                    size += 1
                before = len(group[1])
                group[0].update(found)
                group[1].update(set(found))
                size += len(group[1]) - before
                if size >= held:
                    yield from flush()
                    size = 0
        yield from flush()

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return plain.mapInArrow(scan, "lang string, source string, term string, c long, d long")


def kept_terms(parts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, own): of the terms of at least min_docs documents their occurrences in each source, and of the term '' every source.

    The counts meet by language and term once: they are summed by source there, and rare terms end there.
    """
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_source = parts.repartition(n, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    rows = by_source.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "c")).alias("own"))
    return rows.where((F.col("term") == "") | (F.col("d") >= min_docs)).select("lang", "term", "own")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), exactly; 0 where there are no kept terms."""
    top = (count + SMOOTH).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (n + SMOOTH * v).cast("decimal(38,0)")
    return F.when(v > 0, 1 + F.call_function("div", top, below).cast("long")).otherwise(F.lit(0).cast("long"))


def _single(groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): of a source's own counts, as if the other source lacked the terms; with it the pair's base once.

    A row of groups is one source: its p of count 0, its histogram of p and the p of count 0 of its language's sources.
    """

    def correct(batches):
        for b in batches:
            for lang, source, v, p0, hist, others in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                names = [x["source"] for x in others]
                q0 = np.asarray([x["p0"] for x in others], np.int64)
                base = np.abs(p0 - q0)
                p = np.asarray([x["p"] for x in hist or []], np.int64)
                m = np.asarray([x["m"] for x in hist or []], np.int64)
                own = np.zeros(len(q0), np.int64)
                step = max(1, CELLS // max(1, len(q0)))
                for at in range(0, len(p), step):
                    own += ((np.abs(p[at : at + step, None] - q0) - base) * m[at : at + step, None]).sum(axis=0)
                rows = [(source, x, y) for x, y in zip(names, (own + v * base).tolist(), strict=True) if x != source]
                rows += [(x, source, y) for x, y in zip(names, own.tolist(), strict=True) if x != source]
                for at in range(0, len(rows), 50_000):
                    left, right, value = zip(*rows[at : at + 50_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(left)), pa.array(left), pa.array(right), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    return groups.select("lang", "source", "v", "p0", "hist", "others").mapInArrow(correct, "lang string, source string, item string, value long")


class PatternTree:
    """The open path of a frequent-pattern tree over sorted rows of (place of the source, its p of count 0, p) items.

    closed() rows add, for the node and each of its ancestors, the correction of the two sources times the node's multiplicity.
    """

    def __init__(self):
        self.path: list[tuple[int, int, int]] = []
        self.times: list[int] = []
        self.sums: dict[int, np.ndarray] = {}

    def insert(self, items: list[tuple[int, int, int]], times: int) -> None:
        same = 0
        while same < min(len(items), len(self.path)) and items[same] == self.path[same]:
            same += 1
        self.close(same)
        self.path += items[same:]
        self.times += [0] * (len(items) - same)
        if items:
            self.times[-1] += times

    def close(self, depth: int = 0) -> None:
        """Close the nodes below a depth; their rows count for the node above too."""
        if len(self.path) > max(1, depth):
            at, p0, p = np.asarray(self.path, np.int64).T
            for k in range(len(self.path) - 1, depth - 1, -1):
                own, q0, q = self.path[k]
                value = (np.abs(q - p[:k]) - np.abs(q - p0[:k]) - np.abs(q0 - p[:k]) + np.abs(q0 - p0[:k])) * self.times[k]
                if own not in self.sums:
                    self.sums[own] = np.zeros(own, np.int64)  # ancestors have lower places
                self.sums[own][at[:k]] += value
                if k:
                    self.times[k - 1] += self.times[k]
        del self.path[depth:], self.times[depth:]


def _tree(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value): pair corrections of sources a and b, by their places, of (lang, items, times) rows, for each task's tree."""

    def walk(batches):
        lang, tree = None, PatternTree()

        def result():
            tree.close()
            found = [(a, int(b), int(row[b])) for a, row in tree.sums.items() for b in np.flatnonzero(row)]
            for at in range(0, len(found), 50_000):
                a, b, value = zip(*found[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])

        for batch in batches:
            for own, items, times in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if own != lang:
                    yield from result()
                    lang, tree = own, PatternTree()
                tree.insert([(x["at"], x["p0"], x["p"]) for x in items], times)
        yield from result()

    return rows.select("lang", "items", "times").mapInArrow(walk, "lang string, a long, b long, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for each other source of the language, and at most `top` `term` rows."""
    rows = cut(kept_terms(counted(docs), min_docs))
    every = rows.select("lang", "term", F.explode("own").alias("x")).select("lang", "term", F.col("x.source").alias("source"), F.col("x.c").alias("c"))
    occurring = every.where("term = ''").select("lang", "source")
    terms = rows.where("term <> ''").select("lang", "term", F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["c"]).alias("all"), "own")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("n_all"))
    kept = terms.select("lang", "term", "all", F.explode("own").alias("x")).select("lang", F.col("x.source").alias("source"), "term", F.col("x.c").alias("c"), "all")
    sizes = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = occurring.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "n_all"])
    # small sources first: their low counts repeat, so that more rows begin alike
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("n", "source")).cast("long"))
    groups = cut(groups.withColumn("p0", share(F.lit(0), F.col("n"), F.col("v"))))
    valued = cut(
        kept.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "at", "p0", share(F.col("c"), F.col("n"), F.col("v")).alias("p"), share(F.col("all"), F.col("n_all"), F.col("v")).alias("q")
        )
    )

    forget(rows)
    hist = valued.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("hist"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("others"))
    single = _single(groups.join(hist, ["lang", "source"], "left").join(others, "lang"))

    rows = valued.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("at", "p0", "p"))).alias("items"))
    rows = rows.where(F.size("items") > 1).groupBy("lang", "items").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items")
    place = groups.select("lang", "at", "source")
    both = _tree(rows).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = both.join(place.withColumnsRenamed({"at": "a"}), ["lang", "a"]).join(place.withColumnsRenamed({"at": "b", "source": "item"}), ["lang", "b"])
    both = both.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")

    pairs = single.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: Rows of query() in DuckDB.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), held AS (
  SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), n AS (
  SELECT lang, source, sum(c) AS n FROM held GROUP BY ALL
), l AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(n.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN n USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c,
         (1 + (1000000000::HUGEINT * (coalesce(h.c, 0) + 5)) // (g.n + 5 * l.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.c + 5)) // (l.n + 5 * l.v))::BIGINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
) WHERE part = 'pair' OR rank <= 50
"""
