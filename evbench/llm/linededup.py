"""Reversible line deduplication (operator 5): sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased, if it has at least `min_chars` code
points; 128 bits of BLAKE2b stand for it.  The state of a corpus is three tables:

    postings  (shard, k0, k1, doc_id)                     one row per document and key
    counts    (shard, k0, k1, refs, min_doc, max_doc)     the exact reference counts
    filters   (shard, blob)                               a cuckoo filter per shard of the keys held by two documents or more

Inserting documents adds postings, adds to the counts and puts keys that became shared into their shard's filter; deleting
documents takes all of that back, so that a line comes back when its other holders go.  To decide on a document's lines,
its postings first probe the filters, which let all but shared keys and a few false positives go, and what is left is
looked up in the exact counts.  Shards grow in number with the keys, so that one filter stays small: insertions that outgrow
the layout deal all keys anew and rebuild the filters from the exact counts.  Probes of a shard are
dealt over several salts, so that a line in a third of all documents doesn't meet in one task.

Null or empty text: one empty line, which has no key and stays.  Repeated ids count as one holder and are treated alike.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lines_into, texts

SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: Moves of one insertion before a filter counts as full.
MOST_KICKS = 200
#: Keys for which one shard's filter is laid out at first.
SHARD_KEYS = 50_000
#: Shared keys of a shard that don't yet ask for another layout.
FEWEST = 64
#: Tasks over which the probes of one shard are dealt.
SALTS = 16

POSTINGS = "k0 long, k1 long, doc_id long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """A chain of tables of 16-bit fingerprints; a full one gets a successor of the same size.

    All tables have the same number of buckets.  So two keys that share a fingerprint and a bucket share both buckets in every
    table: whichever of their copies a removal takes, the other key is still found.
    """

    def __init__(self, keys: int = 0, blob: bytes | None = None):
        self.tables: list[np.ndarray] = []
        at = 0
        while blob is not None and at < len(blob):
            n = int(np.frombuffer(blob, "<u4", 1, at)[0])
            self.tables.append(np.frombuffer(blob, "<u2", n * SLOTS, at + 4).reshape(n, SLOTS).copy())
            at += 4 + 2 * n * SLOTS
        if not self.tables:
            n = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.85))))
            self.tables.append(np.zeros((n, SLOTS), "<u2"))

    def blob(self) -> bytes:
        return b"".join(np.asarray([len(t)], "<u4").tobytes() + t.tobytes() for t in self.tables)

    @staticmethod
    def prints(k0: np.ndarray) -> np.ndarray:
        p = (k0.astype("<i8").view("<u8") >> np.uint64(48)).astype(np.int64)
        return np.where(p == 0, 1, p)

    @staticmethod
    def _other(bucket, fp, n: int):
        return (bucket ^ (fp * 0x5BD1E995)) & (n - 1)

    def add(self, k0: int) -> None:
        fp = int(self.prints(np.asarray([k0], dtype="<i8"))[0])
        n = len(self.tables[0])
        i = k0 & (n - 1)
        for table in reversed(self.tables):  # the last one has room most often
            for bucket in (i, self._other(i, fp, n)):
                free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = fp
                    return
        table = self.tables[-1]
        before = table.copy()
        moved, bucket = fp, i
        for kick in range(MOST_KICKS):
            slot = (kick + moved) % SLOTS
            moved, table[bucket, slot] = int(table[bucket, slot]), moved
            bucket = self._other(bucket, moved, n)
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = moved
                return
        table[:] = before
        self.tables.append(np.zeros_like(table))
        self.add(k0)

    def remove(self, k0: int) -> bool:
        fp = int(self.prints(np.asarray([k0], dtype="<i8"))[0])
        for table in self.tables:
            n = len(table)
            i = k0 & (n - 1)
            for bucket in (i, self._other(i, fp, n)):
                at = np.flatnonzero(table[bucket] == fp)
                if len(at):
                    table[bucket, at[0]] = 0
                    return True
        return False

    def has(self, k0: np.ndarray) -> np.ndarray:
        fp = self.prints(k0)
        found = np.zeros(len(k0), bool)
        for table in self.tables:
            n = len(table)
            i = k0.astype(np.int64) & (n - 1)
            found |= (table[i] == fp[:, None]).any(axis=1) | (table[self._other(i, fp, n)] == fp[:, None]).any(axis=1)
        return found


@dataclass
class State:
    """laid_out: the shared keys for which the filters were laid out."""

    shards: int
    laid_out: int
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame


def _postings(docs: DataFrame, min_chars: int) -> DataFrame:
    def scan(batches):
        for b in batches:
            ids, keys = [], []
            for doc_id, text in zip(lines_into(b, "doc_id"), lines_into(b, "text"), strict=True):
                own = {digest(k) for line in text.encode().split(b"\n") if (k := line_key(line, min_chars)) is not None}
                keys += own
                ids += [doc_id] * len(own)
            both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], names=["k0", "k1", "doc_id"])

    return docs.mapInArrow(scan, POSTINGS)


def _shard(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int").alias("shard")


def _counts(postings: DataFrame) -> DataFrame:
    """Map-side combined, so that a hot line is one row per task."""
    return postings.groupBy("shard", "k0", "k1").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))


def _shared(counts: DataFrame) -> DataFrame:
    return counts.where("min_doc <> max_doc")


def _changed_filters(filters: DataFrame | None, changes: DataFrame) -> DataFrame:
    """changes: (shard, k0, sign).  A group holds one shard's filter and its changes, which the number of shards bounds."""
    rows = changes.select("shard", "k0", "sign", F.lit(None).cast("binary").alias("blob"))
    if filters is not None:
        rows = rows.unionByName(filters.select("shard", F.lit(0).cast("long").alias("k0"), F.lit(0).alias("sign"), "blob"))

    def change(pdf: pd.DataFrame) -> pd.DataFrame:
        old = pdf[pdf.sign == 0]
        f = CuckooFilter(blob=old.blob.iloc[0]) if len(old) else CuckooFilter(keys=len(pdf))
        for k0 in np.sort(pdf.k0[pdf.sign < 0].to_numpy()):
            f.remove(int(k0))
        for k0 in np.sort(pdf.k0[pdf.sign > 0].to_numpy()):
            f.add(int(k0))
        return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "blob": [f.blob()]})

    return rows.groupBy("shard").applyInPandas(change, "shard int, blob binary")


def _laid_out(postings: DataFrame, counts: DataFrame, shards: int, shared: int) -> State:
    """A state whose filters are built from the exact counts alone, over as many shards."""
    again = lambda df: df.withColumn("shard", _shard(shards))
    postings, counts = again(postings), again(counts)
    filters = cut(_changed_filters(None, _shared(counts).select("shard", "k0", F.lit(1).alias("sign"))))
    return State(shards, shared, postings, counts, filters)


def build(docs: DataFrame, min_chars: int = 10) -> State:
    """The state of a corpus: of (doc_id, text) rows as texts() gives them."""
    raw = cut(_postings(docs, min_chars))
    shards = max(8, -(-raw.count() // SHARD_KEYS))
    postings = raw.select(_shard(shards), "k0", "k1", "doc_id")
    counts = cut(_counts(postings))
    return _laid_out(postings, counts, shards, _shared(counts).count())


def insert(state: State, docs: DataFrame, min_chars: int = 10) -> State:
    """docs: documents that the state doesn't hold yet."""
    new = cut(_postings(docs, min_chars).select(_shard(state.shards), "k0", "k1", "doc_id"))
    counts = cut(
        state.counts.unionByName(_counts(new)).groupBy("shard", "k0", "k1").agg(F.sum("refs").alias("refs"), F.min("min_doc").alias("min_doc"), F.max("max_doc").alias("max_doc"))
    )
    postings = cut(state.postings.unionByName(new))
    keys, shared = counts.agg(F.count(F.lit(1)), F.count_if(F.col("min_doc") != F.col("max_doc"))).first()
    if keys > 2 * SHARD_KEYS * state.shards or shared > 4 * max(state.laid_out, FEWEST * state.shards):
        return _laid_out(postings, counts, max(state.shards, -(-keys // SHARD_KEYS)), shared)
    gained = _shared(counts).join(_shared(state.counts), ["shard", "k0", "k1"], "left_anti").select("shard", "k0", F.lit(1).alias("sign"))
    return State(state.shards, state.laid_out, postings, counts, cut(_changed_filters(state.filters, gained)))


def delete(state: State, ids: DataFrame) -> State:
    """ids: (doc_id) of documents to take back.  Only the keys they held are counted anew."""
    gone = ids.select("doc_id").distinct()
    touched = state.postings.join(gone, "doc_id", "left_semi").select("shard", "k0", "k1").distinct()
    postings = cut(state.postings.join(gone, "doc_id", "left_anti").select("shard", "k0", "k1", "doc_id"))
    again = _counts(postings.join(touched, ["shard", "k0", "k1"], "left_semi"))
    counts = cut(state.counts.join(touched, ["shard", "k0", "k1"], "left_anti").unionByName(again))
    lost = _shared(state.counts).join(_shared(counts), ["shard", "k0", "k1"], "left_anti").select("shard", "k0", F.lit(-1).alias("sign"))
    return State(state.shards, state.laid_out, postings, counts, cut(_changed_filters(state.filters, lost)))


def _candidates(state: State, postings: DataFrame) -> DataFrame:
    """Postings that their shard's filter lets through.  A task streams: first a shard's filter, then the shard's probes."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    probes = postings.select("shard", salt.alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "k0", "k1", "doc_id")
    zero = F.lit(0).cast("long")
    filters = state.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), "blob", zero.alias("k0"), zero.alias("k1"), zero.alias("doc_id"))

    def probe(batches):
        shard, held = None, None
        for b in batches:
            shards, kinds = (np.asarray(b.column(i)) for i in (0, 2))
            keep = np.zeros(b.num_rows, bool)
            k0 = np.asarray(b.column(4))
            edges = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])]) if b.num_rows else []
            for lo, hi in zip(edges, [*edges[1:], b.num_rows], strict=True):
                if kinds[lo] == 0:
                    if shards[lo] != shard:
                        shard, held = shards[lo], CuckooFilter(blob=b.column(3)[int(lo)].as_py())
                elif shards[lo] == shard:
                    keep[lo:hi] = held.has(k0[lo:hi])
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep)) for i in (0, 4, 5, 6)], names=["shard", "k0", "k1", "doc_id"])

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = probes.unionByName(filters).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return rows.mapInArrow(probe, "shard int, k0 long, k1 long, doc_id long")


def drops(state: State) -> DataFrame:
    """(doc_id, keys): per document the keys of which an earlier document holds a line too."""
    exact = _shared(state.counts).select("shard", "k0", "k1", "min_doc")
    lost = _candidates(state, state.postings).join(exact, ["shard", "k0", "k1"]).where("doc_id <> min_doc")
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("k0", "k1")).alias("keys"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, state: State | None = None) -> DataFrame:
    """docs with every column, text_col without dropped lines, plus n_lines, n_dropped and kept_sha256.

    state: that of a corpus which holds docs; by default that of docs alone.  Rows with a null id keep their text.
    """
    state = state or build(texts(docs, id_col, text_col), min_chars)
    lost = drops(state).select(F.col("doc_id").alias("__id"), F.col("keys").alias("__keys"))
    joined = docs.join(lost.hint("shuffle_hash"), docs[id_col].cast("long") == lost["__id"], "left").drop("__id")
    at, keys_at = docs.columns.index(text_col), len(docs.columns)

    def strip(batches):
        for b in batches:
            out, n_lines, n_dropped, sha = [], [], [], []
            for text, keys in zip(b.column(at).to_pylist(), b.column(keys_at).to_pylist(), strict=True):
                data = (text or "").encode()
                lines = data.split(b"\n")
                n_lines.append(len(lines))
                if keys:
                    lost = {np.asarray([k["k0"], k["k1"]], "<i8").tobytes() for k in keys}
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or digest(k) not in lost]
                    n_dropped.append(len(lines) - len(kept))
                    data = b"\n".join(kept)
                    text = data.decode()
                else:
                    n_dropped.append(0)
                out.append(text)
                sha.append(hashlib.sha256(data).hexdigest())
            columns = [pa.array(out, b.schema.field(i).type) if i == at else b.column(i) for i in range(keys_at)]
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*[b.schema.field(i) for i in range(keys_at)], ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())]))

    schema = docs.select(*docs.columns).schema
    for name, kind in (("n_lines", "long"), ("n_dropped", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(strip, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


#: Rows of query() in DuckDB.
SQL = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL) d,
       LATERAL (SELECT unnest(range(len(ls))) AS i, unnest(ls) AS line) u
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, i, line, (keeper IS NOT NULL AND doc_id <> keeper) AS dropped FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
