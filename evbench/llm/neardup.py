"""MinHash near-duplicates with sequential Bayesian verification (operator 3).

1. A scan turns each text into its set of word shingles, a MinHash signature and band hashes.  Texts with equal sets become
   one class, whose id is its smallest document id; from here on only classes are compared.
2. Classes that share a band's hash form a bucket.  First each class meets one class: of its buckets' smallest members the
   one that it shares most buckets with.  Then, in buckets that hold several components, members outside the largest one
   meet a member of it, drawn anew for each band.
3. Buckets that still hold several components go through an exhaustive round: members outside a bucket's largest component
   meet one another and its members, in blocks, in the first band they share, until their components are linked.  Members of
   one component are not compared again, so that a group of thousands of copies costs its size and not its square; only
   links leave a task, and no cap is set on buckets or partners.
4. Every pair is verified sequentially: after each batch of signature places it is dropped if the posterior probability
   that its similarity reaches the threshold, under a uniform prior, is below `miss`; survivors are compared exactly on
   their full sets.  Links that hold give the components.

Bands are as many as keep the probability to miss a pair at the threshold below `band_miss`.

Null or empty text, or no words: the empty set, linked with nothing.  Texts with fewer words than a shingle have their whole
sequence as one shingle.  Rows with one id count as one document.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, lines_into, texts
from .graph import components

ROWS = 5
BAND_MISS, MISS = 1e-5, 1e-6
#: Signature places that a verification step looks at.
BATCH = 20
#: Members of a bucket, and bytes of their sets and signatures, that the exhaustive round compares as one block, about.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
#: Tasks over which the members that are compared with one leader are dealt.
SALTS = 8

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64"""
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U)


_tables = {"n": 0}


def _power_tables(n: int):
    if _tables["n"] < n:
        m = max(4096, 1 << (n - 1).bit_length())
        _tables.update(n=m, up=_powers(_BASE, m), down=_powers(pow(_BASE, -1, 1 << 64), m))
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes that separate words.
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words, A-Z lower-cased; of the whole sequence if it is shorter."""
    raw = np.frombuffer(text.encode().lower(), "u1")
    if not len(raw):
        return np.zeros(0, _U)
    gap = _GAP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[_U(0)], np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)])])
        words = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))
        n = min(size, len(words))
        out = np.full(len(words) - n + 1, n, dtype=_U)
        for k in range(n):
            out = mix(out * _U(_BASE) + words[k : len(words) - n + 1 + k])
    return np.unique(out)


def seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        a = mix(np.arange(1, k + 1, dtype=_U) * _U(_BASE)) | _U(1)
        return a, mix(a)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, in blocks of bounded size."""
    best = np.full(len(a), np.iinfo(np.uint64).max, dtype=_U)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            h = np.multiply.outer(a, shingles[at : at + 512])
            h += b[:, None]
            np.minimum(best, h.min(axis=1), out=best)
    return best


def bands_for(threshold: float, rows: int = ROWS, miss: float = BAND_MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_matches(threshold: float, places: int, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(places looked at, fewest matches not to be dropped): fewer make the posterior of similarity >= threshold less than miss.

    Places hold 8 bits, so that two sets of similarity s match in one with probability s + (1 - s) / 256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(batch, places + 1, batch):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(like - like.max())
            if w[s >= threshold].sum() >= miss * w.sum():
                out.append((n, m))
                break
    return out


def plausible(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of y (signatures) may reach the threshold with x (one signature, or a row for each), by batches."""
    alive = np.arange(len(y))
    found = np.zeros(len(y), np.int32)
    done = 0
    for n, least in steps:
        xs = x[done:n] if x.ndim == 1 else x[alive, done:n]
        found[alive] += (y[alive, done:n] == xs).sum(axis=1, dtype=np.int32)
        alive = alive[found[alive] >= least]
        done = n
        if not len(alive):
            break
    out = np.zeros(len(y), bool)
    out[alive] = True
    return out


def _scan(rows: DataFrame, size: int, bands: int) -> DataFrame:
    k = bands * ROWS

    def scan(batches):
        a, b = seeds(k)
        for batch in batches:
            ids, c0, c1, ns, sigs, hashes = [], [], [], [], [], []
            for doc_id, text in zip(lines_into(batch, "doc_id"), lines_into(batch, "text"), strict=True):
                s = shingle_set(text, size)
                ids.append(doc_id)
                ns.append(len(s))
                with np.errstate(over="ignore"):
                    # two independent sums over the set stand for it
                    c0.append(int(mix(s).sum(dtype=_U).view(np.int64)))
                    c1.append(int(mix(s ^ _U(_BASE)).sum(dtype=_U).view(np.int64)))
                    m = mix(minhash(s, a, b))
                    sigs.append((m >> _U(56)).astype("u1").tobytes() if len(s) else None)
                    folded = np.zeros(bands, dtype=_U)
                    for r in range(ROWS):
                        folded = mix(folded * _U(_BASE) + m[r::ROWS])
                    hashes.append(folded.view(np.int64) if len(s) else None)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, c0, c1, ns, sigs, hashes), kinds, strict=True)], names=["doc_id", "c0", "c1", "n", "sig", "bands"])

    return rows.mapInArrow(scan, "doc_id long, c0 long, c1 long, n long, sig binary, bands array<long>")


def _shared_grams(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted sets have in common."""
    if len(x) < len(y):
        x, y = y, x
    if not len(y):
        return 0
    at = np.searchsorted(x, y)
    return int((x[np.minimum(at, len(x) - 1)] == y).sum())


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, steps: list) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, of those that the sequential test lets through.

    A task streams a's signature and set, then those of its partners; partners of one class are dealt over SALTS tasks.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    members = salted.join(sets.select(F.col("id").alias("b"), "sig", "grams"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "sig", "grams")
    leaders = salted.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), "sig", "grams"), "a").select("a", "salt", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("b"), "sig", "grams")

    def check(batches):
        leader, own, own_sig = None, None, None
        for batch in batches:
            out = []
            for a, kind, b, sig, grams in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), batch.column(5), strict=True):
                s, x = np.frombuffer(grams.as_buffer(), "<u8"), np.frombuffer(sig, "u1")
                if kind == 0:
                    leader, own, own_sig = a, s, x
                elif leader == a and 100 * min(len(s), len(own)) >= percent * max(len(s), len(own)) and plausible(own_sig, x[None, :], steps)[0]:
                    inter = _shared_grams(own, s)
                    if 100 * inter >= percent * (len(own) + len(s) - inter):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.unionByName(leaders).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "kind")
    return rows.mapInArrow(check, "a long, b long")


def _block_links(rows: list[tuple], percent: int, steps: list) -> list[tuple[int, int]]:
    """Links between different components of a unit, one for each two components that have any.

    rows: (band, h, u, v, own block, id, label, n, sig, bands, grams).  Blocks below 0 hold members of the bucket's largest
    component.  A pair that already met in an earlier band is left to it.
    """
    band, across = rows[0][0], rows[0][2] != rows[0][3]
    own, ids, labels, n = (np.asarray([r[i] for r in rows]) for i in range(4, 8))
    sig = np.frombuffer(b"".join(r[8] for r in rows), "u1").reshape(len(rows), -1)
    before = np.asarray([r[9][:band] for r in rows], dtype=np.int64).reshape(len(rows), band)
    grams = [np.frombuffer(r[10], "<u8") for r in rows]
    parent = {x: x for x in labels.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(own == own.max()).tolist():
        # across two blocks the others are those of the other block, else those that come later in the same one
        ok = (own != own[i]) if across else (np.arange(len(rows)) > i)
        ok &= (labels != labels[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        if band:
            ok &= ~(before == before[i]).any(axis=1)
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        for j in at[plausible(sig[i], sig[at], steps)].tolist():
            a, b = root(int(labels[i])), root(int(labels[j]))
            if a != b:
                both = _shared_grams(grams[i], grams[j])
                if 100 * both >= percent * (len(grams[i]) + len(grams[j]) - both):
                    parent[max(a, b)] = min(a, b)
                    out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return out


def _exhaustive(open_: DataFrame, sets: DataFrame, percent: int, steps: list) -> DataFrame:
    """Links between different components of buckets; open_: (band, h, id, label, top, c, o, cb, ob), see _open().

    The o members outside a bucket's largest component are dealt to blocks 0, 1, ..., its c members to blocks -1, -2, ...  Units
    are pairs of the former, and pairs of one of each, so that a task holds two blocks at most.  Only links leave a task.
    """
    blocks = lambda c: F.ceil(F.greatest(F.col(c) / BLOCK, F.col(f"{c}b") / BLOCK_BYTES)).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    outside = F.col("label") != F.col("top")
    own = open_.withColumn("own", F.when(outside, deal(blocks("o"))).otherwise(-1 - deal(blocks("c"))))
    others = F.when(outside, F.sequence(-blocks("c"), blocks("o") - 1)).otherwise(F.sequence(F.lit(0), blocks("o") - 1))
    dealt = own.select("band", "h", "id", "label", "own", F.explode(others).alias("other"))
    units = dealt.select("band", "h", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "own", "id", "label")
    rows = units.join(sets, "id").select("band", "h", "u", "v", "own", "id", "label", "n", "sig", "bands", "grams")

    def compare(batches):
        held: list = []

        def links() -> list[pa.RecordBatch]:
            found = _block_links(held, percent, steps)
            held.clear()
            return [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])] if found else []

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(11)), strict=True):
                if held and held[0][:4] != row[:4]:
                    yield from links()
                held.append(row)
        if held:
            yield from links()

    n = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "band", "h", "u", "v").sortWithinPartitions("band", "h", "u", "v").mapInArrow(compare, "a long, b long").distinct()


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: (band, h, id, label, top, leader, c, cb, o, ob).

    top is the label of the bucket's largest component, which has c members of cb bytes, of which leader is one; o members of ob bytes are outside it.
    """
    now = shared.select("band", "h", "id", "bytes").join(labels, "id")
    each = now.groupBy("band", "h", "label").agg(F.count(F.lit(1)).alias("c"), F.min_by("id", F.xxhash64("id", "band")).alias("leader"), F.sum("bytes").alias("cb"))
    top = each.groupBy("band", "h").agg(F.max(F.struct("c", "label", "leader", "cb")).alias("t"), F.sum("c").alias("m"), F.sum("cb").alias("mb"), F.count(F.lit(1)).alias("k")).where("k > 1")
    outside = ((F.col("m") - F.col("t.c")).alias("o"), (F.col("mb") - F.col("t.cb")).alias("ob"))
    return now.join(top, ["band", "h"]).select("band", "h", "id", "label", F.col("t.label").alias("top"), F.col("t.leader").alias("leader"), F.col("t.c").alias("c"), F.col("t.cb").alias("cb"), *outside)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) once links (a, b) are added: only the labels that the links join go through components()."""
    of = lambda c: labels.toDF(c, f"{c}l")
    found = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("al").alias("a"), F.col("bl").alias("b")))
    return cut(labels.join(found.toDF("label", "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs with an id.  percent: of the union that must be shared."""
    threshold = percent / 100
    bands = bands_for(threshold)
    steps = least_matches(threshold, bands * ROWS)
    rows = texts(docs, id_col, text_col)
    raw = cut(_scan(rows, size, bands))
    members = raw.where("n > 0")
    classes = cut(members.groupBy("c0", "c1", "n").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("sig", "bands"), "doc_id").alias("x")).select("c0", "c1", "id", "n", "x.sig", "x.bands"))
    # a member's set, bands and signature, as a block holds them
    banded = classes.select("id", (8 * F.col("n") + 40 * F.size("bands") + F.octet_length("sig")).cast("long").alias("bytes"), F.posexplode("bands").alias("band", "h"))
    full = banded.groupBy("band", "h").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("least")).where("m > 1")
    shared = cut(banded.join(full, ["band", "h"]).select("band", "h", "id", "least", "bytes"))
    wanted = classes.join(shared.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("doc_id"), "n", "sig", "bands")

    def grams(batches):
        for batch in batches:
            sets = [shingle_set(t, size).astype("<u8").tobytes() for t in lines_into(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sets, pa.binary())], names=["id", "n", "sig", "bands", "grams"])

    sets = cut(rows.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "n", "sig", "bands", "text").mapInArrow(grams, "id long, n long, sig binary, bands array<long>, grams binary"))
    met = shared.where("id <> least").groupBy("id", "least").agg(F.count(F.lit(1)).alias("k"))
    first = met.groupBy("id").agg(F.max(F.struct("k", (-F.col("least")).alias("least"))).alias("x")).select((-F.col("x.least")).alias("a"), F.col("id").alias("b"))
    found = components(_confirm(first, sets, percent, steps)).toDF("id", "label")
    labels = cut(sets.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    open_ = cut(_open(shared, labels))
    if not open_.isEmpty():
        second = open_.where("label <> top").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        links = cut(_confirm(second, sets, percent, steps))
        if not links.isEmpty():
            labels = _merged(labels, links)
            forget(open_)
            open_ = cut(_open(shared, labels))
        links = cut(_exhaustive(open_, sets, percent, steps))
        if not links.isEmpty():
            labels = _merged(labels, links)
    forget(shared, sets, open_)
    named = classes.select("c0", "c1", "n", "id").join(labels, "id", "left").select("c0", "c1", "n", F.coalesce("label", "id").alias("component_id"))
    out = raw.select("doc_id", "c0", "c1", "n").join(named, ["c0", "c1", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)


#: Rows of query() in DuckDB: exact similarities of all documents that share a shingle, then reachability.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shr AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM shr JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), u AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), walk(v, l) AS (
  SELECT a, a FROM u UNION SELECT u.b, w.l FROM walk w JOIN u ON u.a = w.v WHERE u.b > w.l
), c AS (
  SELECT v, min(l) AS l FROM walk GROUP BY v
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.l, doc_id) AS component_id, doc_id = coalesce(c.l, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = doc_id
"""
