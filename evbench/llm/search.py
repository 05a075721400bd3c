"""Ranked lexical search with hashed max-sketches (operator 13).

A document's impact of a term is w * ((10**9 tf) div (1000 tf + 20 m)), with w = floor(1000 ln((2N + 2) / (2 df + 1))) and
m = 50 + (50 n N) div L; its score for an item is the sum over the item's distinct terms.

1. The items are taken in blocks of about BLOCK_TERMS terms, so that a block's vocabulary is small enough for every task.
2. A scan writes for each document its length and its frequencies of the vocabulary's terms, as Parquet in the shared folder.  N, L and df are
   counts over all of these rows.
3. Tasks take documents in batches.  A document's impacts fold into a sketch of WIDTH places: term t goes to place h(t), and a place keeps
   the maximum, rounded up to 16 bits.  The sum of a sketch's places over an item's terms is at least the score.  All items look
   up a batch of sketches; an item's documents are then rescored exactly in the order of falling bounds, until the next bound is
   below the k-th best score that the task has seen in all of its batches.
4. Each task passes on at most k documents an item; they meet over salts first, then per item.

Bounds only decide what is rescored: every document above the threshold, and every tie with it, is.  Nothing is capped or sampled.

Null or empty text has no terms, never a score, and doesn't count in N.  Terms that no document holds add nothing.  Equal scores rank by
ascending doc_id.  Rows with one doc_id are documents of their own; rows with one item_id are one item with the terms of all of them.
Rows with a null id are left out.  Very long texts are read whole.  Columns other than id and text are never read.  An empty table on either side
gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, shared_path, table, texts

K = 50
#: Places of a sketch.
WIDTH = 4096
#: Terms of the items of one block, about; blocks are told apart by a hash of the item's id.
BLOCK_TERMS = 200_000
#: Documents and postings of a batch of sketches.
BATCH_DOCS, BATCH_POSTINGS = 2048, 1 << 20
#: Documents that are rescored at once.
STEP = 64
#: Parts in which the tasks' best documents of an item meet first.
SALTS = 16

#: ASCII letters and digits and every byte of a character beyond ASCII are parts of terms; A-Z become a-z.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TERM).split()


def _asked(items: DataFrame) -> DataFrame:
    """(doc_id, term): the distinct terms of each item."""

    def scan(batches):
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sorted(set(words(text)))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "term"])

    return items.select("doc_id", "text").mapInArrow(scan, "doc_id long, term binary").distinct()


def _postings(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that have a term."""
    held = docs.sparkSession.sparkContext.broadcast(place)

    def scan(batches):
        known = held.value
        for b in batches:
            ids, lengths, terms, tfs, ends = [], [], [], [], [0]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words(text)
                if not found:
                    continue
                for term, tf in Counter(found).items():
                    if (at := known.get(term)) is not None:
                        terms.append(at)
                        tfs.append(tf)
                ids.append(i)
                lengths.append(len(found))
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The k best (score, id) of one item so far; least is the score that a further document must reach."""

    __slots__ = ("k", "scores", "ids", "least")

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.empty(0, np.int64), np.empty(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


class Batch:
    """Documents with their impacts, postings side by side, and their sketches."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, coordinate: np.ndarray, unit: int, width: int):
        """starts has one more entry than ids; coordinate: the sketch place of each term; unit: what one step of a sketch stands for."""
        self.ids, self.starts, self.terms, self.impacts, self.unit = ids, starts, terms, impacts, unit
        flat = np.zeros(width * len(ids), np.uint16)
        owner = np.repeat(np.arange(len(ids)), np.diff(starts))
        np.maximum.at(flat, coordinate[terms].astype(np.int64) * len(ids) + owner, (-(-impacts // unit)).astype(np.uint16))
        self.sketch = flat.reshape(width, len(ids))

    def bounds(self, coordinates: np.ndarray) -> np.ndarray:
        """Upper bounds of all documents' scores for an item of which each term has one coordinate here."""
        total = np.zeros(len(self.ids), np.int64)
        for at in range(0, len(coordinates), 256):
            total += self.sketch[coordinates[at : at + 256]].sum(axis=0, dtype=np.int64)
        return total * self.unit

    def exact(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Scores of some documents; asked says of each term whether the item has it."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        values = np.append(np.where(asked[self.terms[at]], self.impacts[at], 0), 0)
        return np.where(sizes > 0, np.add.reduceat(values, ends - sizes), 0)

    def search(self, own: np.ndarray, coordinates: np.ndarray, asked: np.ndarray, best: Best) -> int:
        """Put the batch's documents into best; how many were rescored.  own: the item's terms; asked: all False, before and after."""
        bounds = self.bounds(coordinates)
        rows = np.flatnonzero(bounds >= best.least)
        rows = rows[np.argsort(-bounds[rows], kind="stable")]
        asked[own] = True
        at = 0
        while at < len(rows) and bounds[rows[at]] >= best.least:
            some = rows[at : at + STEP]
            best.add(self.exact(some, asked), self.ids[some])
            at += STEP
        asked[own] = False
        return min(at, len(rows))


def _ranked(postings: DataFrame, queries: list[tuple[int, list[int]]], weights: list[int], coordinates: list[int], n_docs: int, n_terms: int, k: int, width: int) -> DataFrame:
    """(item_id, doc_id, score): of each task and item the k best documents."""
    held = postings.sparkSession.sparkContext.broadcast((queries, np.asarray(weights, np.int64), np.asarray(coordinates, np.int32)))

    def rank(batches):
        asked_items, w, coordinate = held.value
        unit = max(1, -(-int(w.max(initial=0)) * 1_000_000 // 65_535))  # no impact is above w * 10**6
        items = [(i, np.asarray(own, np.int64), coordinate[own], Best(k)) for i, own in asked_items]
        asked = np.zeros(len(w), bool)
        for b in batches:
            ids, lists = np.asarray(b.column(0)), b.column(2)
            terms, tfs = (np.asarray(b.column(c).flatten(), dtype=np.int64) for c in (2, 3))
            starts = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
            m = np.asarray([50 + 50 * n * n_docs // n_terms for n in b.column(1).to_pylist()], np.int64)
            impacts = w[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * np.repeat(m, np.diff(starts))))
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, min(lo + BATCH_DOCS, int(np.searchsorted(starts, starts[lo] + BATCH_POSTINGS, "right")) - 1))
                s, e = starts[lo], starts[hi]
                batch = Batch(ids[lo:hi], starts[lo : hi + 1] - s, terms[s:e], impacts[s:e], coordinate, unit, width)
                for _, own, places, best in items:
                    batch.search(own, places, asked, best)
                lo = hi
        for i, *_, best in items:
            if len(best.ids):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(best.ids), pa.int64()), pa.array(best.ids, pa.int64()), pa.array(best.scores, pa.int64())], names=["item_id", "doc_id", "score"])

    return postings.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(rank, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents of highest score above 0."""
    spark = docs.sparkSession
    docs = texts(docs, id_col, text_col)
    asked = cut(_asked(texts(items, item_col, item_text_col)))
    blocks = max(1, -(-asked.count() // block_terms))
    found = None
    for block in range(blocks):
        terms_of: dict[int, list[bytes]] = {}
        for i, term in asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block).collect():  # about block_terms rows
            terms_of.setdefault(i, []).append(bytes(term))
        vocabulary = sorted({t for own in terms_of.values() for t in own})
        place = {t: k for k, t in enumerate(vocabulary)}
        path = shared_path(spark, "postings")
        _postings(docs, place).write.parquet(path)
        postings = spark.read.parquet(path)
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each term of the block at most
        weights = [weight(n_docs, df.get(k, 0)) for k in range(len(vocabulary))]
        queries = [(i, [place[t] for t in own]) for i, own in sorted(terms_of.items())]
        some = _ranked(postings, queries, weights, [zlib.crc32(t) % width for t in vocabulary], n_docs, n_terms, k, width)
        order = (F.desc("score"), F.col("doc_id"))
        salted = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
        some = some.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
        some = cut(some.select("item_id", "rank", "doc_id", "score"))
        discard(spark, path)
        found = some if found is None else found.unionByName(some)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Rows of query() in DuckDB.
SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents WHERE doc_id IS NOT NULL
), words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low
), tf AS (
  SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), n AS (
  SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row
), whole AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM n
), m AS (
  SELECT row, 100 - 50 + ((50 * n * n_docs) // l) AS m FROM n, whole
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), weights AS (
  SELECT item_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term), whole
), scores AS (
  SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM weights JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 50
"""
