"""Repeated-substring removal by bucket-pointer refinement (operator 7).

Every byte that a string of `length` bytes covers which also starts anywhere else is removed; texts are UTF-8 bytes.  The
query takes LENGTH; figures below are for it, and measures() derives all sizes from the length.

1. A scan names each text's q-grams, by doubling from bytes, and keeps for every window of `length` bytes the q-gram of the
   least name in it, the first among equals.  Equal strings keep the same q-gram at the same offset, so only q-grams that
   are kept twice or more in the corpus matter: these are the initial buckets, about one for every 128 bytes of repeated text.
2. The strings of `length` bytes that keep a q-gram fall into blocks of 64 starts; all strings of a block share a core of
   `length` - 63 bytes.  A block's bucket is refined by the identifiers of the q-grams at later offsets in its core, one
   q-gram further on each, up to the core's end; Spark sorts the blocks by these identifiers.  Identifiers are 128 bits of names and not
   ranks, so that all tasks agree on them without a sort of every place of the corpus.
3. In a bucket, pointers are refined byte by byte: a suffix that starts one byte earlier is sorted by that byte and the
   bucket pointer of the later offset, which the step before has just updated; on the right side a prefix one byte longer
   likewise.  A string is repeated if the pair of its left and right pointers occurs twice.  All buckets of a batch are
   refined together by one sort a step.
4. q-grams kept more than `hot` times don't meet in one task: there, each string of a text is a row with 128 bits of hash
   and all its places in the text, and Spark counts them, over SALTS salts a string.
5. A q-gram that is kept at one place of one text only, of which there are copies, needs no bucket: the strings that keep it are
   repeated in the copies.

With `words` the passages are counted in words (runs without ASCII white space): each word is one unit, eight bytes of its hash, in
place of a byte (SHORT of them beside cores); the strings are `words` of these, and a repeated run takes the text from its first word's first byte to its last
word's last.  `passages` counts such runs beside the bytes that go, and takes nothing.

Strings are judged on the input: nothing depends on what is removed.  Null or empty text, or fewer than `length` bytes:
nothing is removed.  Repeated rows are copies of one another.  Very long texts are scanned in segments, and their rows are
dealt like those of many texts.  An empty table gives an empty result.  Removing bytes may cut a
character; `removed` then drops its broken rest from the text, while the digests are of the exact bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, texts

LENGTH = 400
#: Words of the passages that the query counts beside the bytes it removes.
PASSAGE = 51
#: Occurrences of a q-gram beyond which its strings are counted by Spark.
HOT = 100_000
#: One q-gram in so many is common; no more than so many q-grams can be.
COMMON = 10_000
#: Rows that are refined at once, bytes of a text that are scanned at once, and of short texts.
BATCH, SEGMENT, TOGETHER = 20_000, 1 << 20, 1 << 16
#: Bytes of a word's hash that stand for it beside a core.
SHORT = 6
#: Tasks over which the texts that hold one hot string are dealt.
SALTS = 64
#: What is done with a q-gram's strings: refined in buckets, counted by Spark, or known to be repeated.
COLD, SPREAD, SURE = range(3)

_U = np.uint64
_MUL = 0x9E3779B97F4A7C15


with np.errstate(over="ignore"):
    #: Powers that tell apart the places of a word's bytes, and their inverses.
    _POWERS, _INVERSE = (np.cumprod(np.full(1 << 20, x, _U)) for x in (0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)))
_INSIDE = np.array([x != 32 and not 9 <= x <= 13 for x in range(256)])


class Measures(NamedTuple):
    """Bytes of a q-gram, q-grams in a window, starts that share a core, bytes of a core and most bytes beside it."""

    gram: int
    span: int
    block: int
    core: int
    edge: int


def measures(length: int, words: bool = False) -> Measures:
    # a window holds 256 q-grams at most, since anchors() keeps distances in 8 bits
    gram = max(length * 145 // 400, length - 255, 1)
    # a q-gram of words is the core of all strings that keep it: one row instead of two
    block = length - gram + 1 if words else max(min(64, length // 2), 1)
    return Measures(gram, length - gram + 1, block, length - block + 1, block - 1)


def _grams(raw: np.ndarray, gram: int, base: int = _MUL) -> np.ndarray:
    """A name of the gram bytes from each place, by doubling; odd, so never 0."""
    with np.errstate(over="ignore"):
        h = raw.astype(_U) + _U(1)
        step, power = 1, _U(base)
        while 2 * step <= gram:
            h = h[:-step] * power + h[step:]
            step, power = 2 * step, power * power
        rest = gram - step
        h = h[: len(h) - rest] * _U(0xBF58476D1CE4E5B9) + h[rest:] if rest else h
        h = (h ^ (h >> _U(31))) * _U(0x94D049BB133111EB)
        return (h ^ (h >> _U(29))) | _U(1)


def core_names(raw: np.ndarray, starts: np.ndarray, m: Measures) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of the cores that start at the given places: two sequences of q-gram names folded from front to end."""
    steps = [*range(0, m.core - m.gram, m.gram), m.core - m.gram] if m.core > m.gram else [0]
    gram = min(m.gram, m.core)
    out = []
    for base in (_MUL, 0xD1342543DE82EF95):
        g = _grams(raw, gram, base)
        with np.errstate(over="ignore"):
            k = np.full(len(starts), m.core, _U)
            for step in steps:
                k = (k ^ (k >> _U(30))) * _U(0xBF58476D1CE4E5B9) + g[starts + step]
            out.append(((k ^ (k >> _U(27))) * _U(0x94D049BB133111EB)).view(np.int64))
    return out[0], out[1]


def _least_places(g: np.ndarray, span: int) -> np.ndarray:
    """For each window of span values the place of the least one by its first 43 bits, the first among equals; by doubling the window."""
    low = _U((1 << 21) - 1)
    key = (g & ~low) | np.arange(len(g), dtype=_U)
    step = 1
    while step < span:
        move = min(step, span - step)
        key = np.minimum(key[move:], key[: len(key) - move])
        step += move
    return (key & low).astype(np.int64)


def word_units(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(eight bytes of hash for each word, first byte of each word, byte after its last)."""
    raw = np.frombuffer(data, "u1")
    inside = _INSIDE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return b"", starts, ends
    h = np.empty(len(starts), _U)
    lo = 0
    while lo < len(starts):  # about SEGMENT bytes at a time, or one word
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SEGMENT, "right")))
        a, b, base = starts[lo:hi], ends[lo:hi], int(starts[lo])
        part = raw[base : b[-1]].astype(_U) + _U(1)
        with np.errstate(over="ignore"):
            if len(part) <= len(_POWERS):
                sums = np.concatenate([np.zeros(1, _U), np.cumsum(part * _POWERS[: len(part)])])
                h[lo:hi] = (sums[b - base] - sums[a - base]) * _INVERSE[a - base] + (b - a).astype(_U)
            else:  # one word
                at = np.arange(len(part))
                h[lo] = np.sum(part * _POWERS[at % len(_POWERS)] * (2 * (at // len(_POWERS)) + 1).astype(_U)) + _U(len(part))
        lo = hi
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(31))) * _U(0x94D049BB133111EB)
        h ^= h >> _U(29)
    return h.astype("<u8").tobytes(), starts, ends


def anchors(data: bytes, length: int = LENGTH, unit: str = "u1") -> tuple[np.ndarray, np.ndarray]:
    """(codes, hashes) of the q-grams of least hash in some window of length bytes, or units.

    A code holds a q-gram's place p and the run of window starts for which it is the first least one: p << 16, the distance
    from the first start to p << 8, and that from the last.  Every start belongs to one q-gram.
    """
    raw = np.frombuffer(data, unit)
    m = measures(length)
    codes, hashes = [], []
    for at in range(0, len(raw) - length + 1, SEGMENT):
        g = _grams(raw[at : at + SEGMENT + length - 1], m.gram)
        least = _least_places(g, m.span)
        edge = np.flatnonzero(np.diff(least)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(least)]]) - 1
        p = least[first]
        codes.append(((p + at) << 16) | ((p - first) << 8) | (p - last))
        hashes.append(g[p])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(hashes).view(np.int64)


def anchors_of(texts: list[bytes], length: int = LENGTH, words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of codes of each text, codes, hashes) as of anchors(), of many texts at once; no window crosses texts."""
    sizes, codes, hashes = [], [], []

    def some(part: list[bytes]) -> None:
        if words:
            data, starts, _ = word_units(b" ".join(part))
            bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in part)]))
            raw = np.frombuffer(data, "<u8")
        else:
            raw, bounds = np.frombuffer(b"".join(part), "u1"), np.cumsum([0, *map(len, part)])
        if len(part) == 1 or len(raw) < length:
            c, h = anchors(raw.tobytes(), length, raw.dtype.str)
            sizes.append([len(c)] if len(part) == 1 else [0] * len(part))
        else:
            m = measures(length)
            g = _grams(raw, m.gram)
            least = _least_places(g, m.span)
            of = np.repeat(np.arange(len(part)), np.diff(bounds))[: len(least)]
            inside = np.flatnonzero(np.arange(length, len(raw) + 1) <= bounds[of + 1])
            least = least[inside]
            edge = np.flatnonzero(np.diff(least)) + 1
            first = inside[np.concatenate([[0], edge])[: len(inside)]]
            last = inside[np.concatenate([edge, [len(inside)]])[: len(inside)] - 1]
            p = least[np.concatenate([[0], edge])[: len(inside)]]
            c, h = ((p - bounds[of[first]]) << 16) | ((p - first) << 8) | (p - last), g[p].view(np.int64)
            sizes.append(np.bincount(of[first], minlength=len(part)))
        codes.append(c)
        hashes.append(h)

    part: list[bytes] = []
    held = 0
    for data in texts:
        if part and held + len(data) > TOGETHER:
            some(part)
            part, held = [], 0
        part.append(data)
        held += len(data)
    if part:
        some(part)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (sizes, codes, hashes))


def blocks(codes, block: int):
    """(core start, least e, greatest e) of the blocks that a q-gram's starts fall into; a start is e bytes before the core."""
    for code in codes:
        p, far, near = code >> 16, code >> 8 & 255, code & 255
        for j in range(near // block, far // block + 1):
            yield p - j * block, max(near - j * block, 0), min(far - j * block, block - 1)


def refine(group: np.ndarray, left: list[bytes], right: list[bytes], block: int, size: int = 1) -> np.ndarray:
    """(rows, block) bool: whether the string that starts e units before a row's core is repeated in its group.

    group: small integers; left and right: the units beside the core, at most block - 1 of them, of `size` bytes each.
    """
    edge = block - 1
    n = len(group)
    la, lb = (np.fromiter(map(len, x), np.int32, n) // size for x in (left, right))
    side = edge * size
    whole = np.frombuffer(b"".join(x.rjust(side, b"\0") + y.ljust(side, b"\0") for x, y in zip(left, right, strict=True)), "u1").reshape(n, 2 * side)
    # rows alike in everything are one row that counts twice
    alike = np.concatenate([group.astype("<i4").view("u1").reshape(n, 4), la.astype("u1")[:, None], lb.astype("u1")[:, None], whole], axis=1)
    _, first, inverse, counts = np.unique(np.ascontiguousarray(alike).view(f"V{alike.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    group, la, lb, whole = group[first].astype(np.int64), la[first], lb[first], whole[first]
    m = len(first)
    sizes = np.bincount(group)
    live = sizes[group] > 1
    repeated = np.zeros((m, block), bool)
    e = np.arange(block)
    valid = (e[None, :] <= la[:, None]) & (edge - e[None, :] <= lb[:, None])
    at = np.flatnonzero(live)
    if len(at):
        k = len(at)
        names, va, radix = whole[at], valid[at], 256
        if size > 1:  # small integers in place of hashes
            padded = np.zeros((k, 2 * edge, 8), "u1")
            padded[:, :, :size] = names.reshape(k, 2 * edge, size)
            distinct, names = np.unique(padded.view("<u8").ravel(), return_inverse=True)
            names, radix = names.reshape(k, 2 * edge), len(distinct)
        names = names.astype(np.int64)
        lefts, rights = np.zeros((block, k), np.int64), np.zeros((block, k), np.int64)
        lefts[0] = rights[0] = group[at]
        for i in range(1, block):
            lefts[i] = np.unique(lefts[i - 1] * radix + names[:, edge - i], return_inverse=True)[1]
            rights[i] = np.unique(rights[i - 1] * radix + names[:, edge + i - 1], return_inverse=True)[1]
        for i in range(block):
            ok = np.flatnonzero(va[:, i])
            if len(ok):
                _, inv, cnt = np.unique(lefts[i, ok] * k + rights[edge - i, ok], return_inverse=True, return_counts=True)
                repeated[at[ok], i] = cnt[inv] > 1
    repeated |= valid & (counts > 1)[:, None]
    return repeated[inverse]


def _runs(marks: np.ndarray, core: int, length: int) -> list[tuple[int, int]]:
    """Ranges of units that the marked strings of a block cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [(core - int(hi) + 1, core - int(lo) + length) for lo, hi in zip(edge[::2], edge[1::2], strict=True)]


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


SPANS = "doc_id long, h long, lo int, hi int"


def _arrow(rows: list[tuple], kinds: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names.split())


def spans(rows: DataFrame, text_col: str, hot: int = HOT, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """(doc_id, h, lo, hi): byte ranges covered by repeated strings, overlapping; with words, ranges of words.

    rows: _keyed(docs).  They are joined here just as in _cut_out(), so that Spark shuffles the texts once for both.
    """
    spark = rows.sparkSession
    least = length
    if words:
        length, least = words, 2 * words - 1
    wide = SHORT if words else 1
    m = measures(length, bool(words))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long_, int_ = pa.int64(), pa.int32()

    def find(batches):
        for b in batches:
            sizes, *found = anchors_of([(text or "").encode() for text in b.column(2).to_pylist()], length, bool(words))
            bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in found)], names=["doc_id", "h", "codes", "grams"])

    some = rows.where(F.col("__id").isNotNull() & (F.octet_length(text_col) >= least))
    found = cut(some.select("__id", "__h", text_col).mapInArrow(find, "doc_id long, h long, codes array<long>, grams array<long>"))
    counted = found.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    total = found.agg(F.sum(F.size("grams"))).first()[0] or 0  # one number
    each = found.select("doc_id", "h", F.explode(F.arrays_zip("codes", "grams")).alias("x")).select("doc_id", "h", F.col("x.codes").alias("c"), F.col("x.grams").alias("g"))
    # at most COMMON q-grams are that common, or total / hot: they are sent to every task, and only the others' rows meet by q-gram
    common = cut(counted.where(F.col("m") > min(hot, max(2, total // COMMON))))
    split = each.join(F.broadcast(common), "g", "left")
    same = Window.partitionBy("g")
    place = F.xxhash64("h", "c")
    rare = (
        split.where("m is null")
        .select("doc_id", "h", "c", F.count(F.lit(1)).over(same).alias("n"), F.min(place).over(same).alias("p0"), F.max(place).over(same).alias("p1"))
        .where("n > 1")
        .select("doc_id", "h", "c", F.when(F.col("p0") == F.col("p1"), SURE).otherwise(COLD).alias("kind"))
    )
    marks = (
        split.where("m is not null")
        .select("doc_id", "h", "c", F.when(F.col("m") > hot, SPREAD).otherwise(COLD).alias("kind"))
        .unionByName(rare)
        .repartition("doc_id", "h")  # plain rows take less room in a shuffle than arrays of one
        .groupBy("doc_id", "h")
        .agg(F.collect_set(F.col("c") * 4 + F.col("kind")).alias("__found"))
    )
    taken = marks.where(F.exists("__found", lambda x: x % 4 != SURE)).select("__found", F.col("doc_id").alias("__i"), F.col("h").alias("__g"))
    c = F.shiftright("x", 2)
    ends = F.shiftright(c, 16) - F.shiftright(c, 8).bitwiseAND(255), F.shiftright(c, 16) - c.bitwiseAND(255) + length
    sure = marks.select("doc_id", "h", F.explode(F.filter("__found", lambda x: x % 4 == SURE)).alias("x")).select("doc_id", "h", *(x.cast("int").alias(k) for x, k in zip(ends, ("lo", "hi"), strict=True)))
    width, at = len(rows.columns), rows.columns.index(text_col)

    def deal(batches):
        kinds = [long_, long_, long_, long_, int_, pa.binary(), pa.binary(), pa.bool_()]
        names = "k0 k1 doc_id h core left right hot"
        for b in batches:
            out: list[tuple] = []
            for doc_id, h, text, got in zip(b.column(width - 2).to_pylist(), b.column(width - 1).to_pylist(), b.column(at).to_pylist(), b.column(width).to_pylist(), strict=True):
                if not got:
                    continue
                data = text.encode()
                raw = np.frombuffer(data, "u1")
                if words:
                    raw = np.frombuffer(word_units(data)[0], "<u8")
                    data = raw.view("u1").reshape(-1, 8)[:, :wide].tobytes()
                own = [(*x, kind == SPREAD) for kind in (COLD, SPREAD) for x in blocks([c >> 2 for c in got if c & 3 == kind], m.block)]
                k0, k1 = core_names(raw, np.asarray([x[0] for x in own]), m)
                for (c, lo, hi, is_hot), x, y in zip(own, k0.tolist(), k1.tolist(), strict=True):
                    end = c + m.core
                    out.append((x, y, doc_id, h, c, data[(c - hi) * wide : c * wide], data[end * wide : (end + m.edge - lo) * wide], is_hot))
                if len(out) >= 4096:
                    yield _arrow(out, kinds, names)
                    out = []
            if out:
                yield _arrow(out, kinds, names)

    dealt = _joined(rows, taken).mapInArrow(deal, "k0 long, k1 long, doc_id long, h long, core int, left binary, right binary, hot boolean")

    def sort_buckets(batches):
        def out(t: list) -> Iterator[pa.RecordBatch]:
            group = np.cumsum(np.concatenate([[0], _edges(t)]))
            keep = np.flatnonzero(np.bincount(group)[group] > 1)
            if not len(keep):
                return
            pick = [x.take(pa.array(keep)) for x in t]
            marked = refine(np.unique(group[keep], return_inverse=True)[1], pick[5].to_pylist(), pick[6].to_pylist(), m.block, wide)
            found_ = [(d, h, lo, hi) for d, h, c, x in zip(pick[2].to_pylist(), pick[3].to_pylist(), pick[4].to_pylist(), marked, strict=True) if x.any() for lo, hi in _runs(x, c, length)]
            if found_:
                yield _arrow(found_, [long_, long_, int_, int_], "doc_id h lo hi")

        held: list = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= BATCH:
                t = pa.Table.from_batches(held).combine_chunks()
                # the last bucket may go on in the next batch
                starts = np.flatnonzero(np.concatenate([[True], _edges([t.column(i) for i in range(2)])]))
                last = int(starts[-1])
                if last:
                    yield from out([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in t.slice(0, last).columns])
                held = t.slice(last).to_batches() if last else t.to_batches()
                size = sum(x.num_rows for x in held) if last else 0
        if held:
            yield from out([x.combine_chunks() for x in pa.Table.from_batches(held).combine_chunks().columns])

    key = ["k0", "k1"]
    cold = dealt.where("not hot").drop("hot").repartition(n, *key).sortWithinPartitions(*key).mapInArrow(sort_buckets, SPANS)
    cold = cold.unionByName(sure)
    if common.where(F.col("m") > hot).isEmpty():
        return cold

    def strings(batches):
        """A row for each string of a text's hot blocks, with its places."""
        for b in batches:
            by: dict[tuple, list[int]] = {}
            for k0, k1, doc_id, h, core, left, right in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                name, edge = np.asarray([k0, k1], "<i8").tobytes(), m.edge
                for e in range(max(0, edge - len(right) // wide), len(left) // wide + 1):
                    # the lengths of both sides are fixed by e, so that the concatenation is unambiguous
                    d = hashlib.blake2b(name + bytes([e]) + left[len(left) - e * wide :] + right[: (edge - e) * wide], digest_size=16).digest()
                    by.setdefault((d, doc_id, h), []).append(core - e)
            if by:
                yield _arrow([(*np.frombuffer(d, "<i8").tolist(), doc_id, h, lo) for (d, doc_id, h), lo in by.items()], [long_, long_, long_, long_, pa.list_(int_)], "s0 s1 doc_id h lo")

    made = dealt.where("hot").drop("hot").mapInArrow(strings, "s0 long, s1 long, doc_id long, h long, lo array<int>")
    each = cut(made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int")))
    name = ["s0", "s1"]
    salted = each.groupBy(*name, "salt").agg(F.sum(F.size("lo")).alias("n"))
    twice = salted.groupBy(*name).agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1").select(*name, F.explode("salts").alias("salt"))
    several = each.join(twice, [*name, "salt"]).select("doc_id", "h", F.explode("lo").alias("lo"))
    return cold.unionByName(several.withColumn("hi", (F.col("lo") + length).cast("int")))


def _edges(t: list) -> np.ndarray:
    """Whether a row's first two columns differ from those of the row before, from the second row on."""
    cols = [x.to_numpy() if isinstance(x, pa.ChunkedArray) else np.asarray(x) for x in t[:2]]
    return np.any([c[1:] != c[:-1] for c in cols], axis=0)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __id and __h, which name a row's text."""
    return docs.withColumn("__id", docs[id_col].cast("long")).withColumn("__h", F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))


def _joined(rows: DataFrame, side: DataFrame) -> DataFrame:
    """rows with one more column, from side (one column, __i, __g)."""
    return rows.join(side.hint("shuffle_hash"), (rows["__id"] == side["__i"]) & (rows["__h"] == side["__g"]), "left").drop("__i", "__g")


def _ranges(found: DataFrame, name: str) -> DataFrame:
    """A text's ranges in one row, for _joined()."""
    return found.repartition("doc_id", "h").groupBy("doc_id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias(name)).select(name, F.col("doc_id").alias("__i"), F.col("h").alias("__g"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, length: int = LENGTH, words: int | None = None, passages: int | None = None) -> DataFrame:
    """docs with every column, text_col without bytes of repeated strings of `length` bytes, plus n_bytes, n_removed, n_spans and kept_sha256.

    words: passages of as many words instead, whatever their bytes.
    passages: two more columns of the text as given, n_passages (maximal runs of passages of as many words that start anywhere else too) and n_passage_words (words in them).

    Rows with a null id keep their text and neither give nor take repeats.
    """
    rows = _keyed(docs, id_col, text_col)
    joined = _joined(rows, _ranges(spans(rows, text_col, hot, length, words), "__spans"))
    if passages:
        joined = _joined(joined, _ranges(spans(rows, text_col, hot, words=passages), "__passages"))
    end, at = len(docs.columns), docs.columns.index(text_col)
    counts = ["n_bytes", "n_removed", "n_spans"]
    more = ["n_passages", "n_passage_words"] if passages else []

    def cut_out(batches):
        for b in batches:
            out, numbers, sha = [], [], []
            for text, found in zip(b.column(at).to_pylist(), b.column(end + 2).to_pylist(), strict=True):
                data = (text or "").encode()
                spans_ = [(r["lo"], r["hi"]) for r in found or ()]
                if words and spans_:
                    _, starts, ends = word_units(data)
                    spans_ = [(int(starts[lo]), int(ends[hi - 1])) for lo, hi in spans_]
                merged = united(spans_)
                numbers.append((len(data), sum(hi - lo for lo, hi in merged), len(merged)))
                if merged:
                    bounds = [0, *(x for r in merged for x in r), len(data)]
                    data = b"".join(data[lo:hi] for lo, hi in zip(bounds[::2], bounds[1::2], strict=True))
                    text = data.decode(errors="ignore")
                out.append(text)
                sha.append(hashlib.sha256(data).hexdigest())
            fields = [b.schema.field(i) for i in range(end)]
            columns = [pa.array(out, fields[i].type) if i == at else b.column(i) for i in range(end)]
            columns += [pa.array([x[i] for x in numbers], pa.int64()) for i in range(len(counts))]
            columns.append(pa.array(sha, pa.string()))
            if more:
                runs = [united([(r["lo"], r["hi"]) for r in found or ()]) for found in b.column(end + 3).to_pylist()]
                columns += [pa.array([len(x) for x in runs], pa.int64()), pa.array([sum(hi - lo for lo, hi in x) for x in runs], pa.int64())]
            fields += [pa.field(k, pa.string() if k == "kept_sha256" else pa.int64()) for k in (*counts, "kept_sha256", *more)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    schema = docs.select(*docs.columns).schema
    for name in (*counts, "kept_sha256", *more):
        schema = schema.add(name, "string" if name == "kept_sha256" else "long")
    return joined.mapInArrow(cut_out, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return removed(docs, passages=PASSAGE).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words")


def brute_force_words(rows: list[tuple[int, str | None]], words: int) -> dict[int, bytes]:
    """The bytes that removed() keeps of each text when it counts in words, by a table of all passages."""
    cut_up = [(i, d, [x.span() for x in re.finditer(rb"[^\x20\x09-\x0D]+", d)]) for i, d in ((i, (t or "").encode()) for i, t in rows)]
    seen: Counter = Counter()
    passages = [[tuple(d[a:b] for a, b in at[k : k + words]) for k in range(len(at) - words + 1)] for _, d, at in cut_up]
    for own in passages:
        seen.update(own)
    out = {}
    for (i, d, at), own in zip(cut_up, passages, strict=True):
        gone = np.zeros(len(d), bool)
        for k, p in enumerate(own):
            if seen[p] > 1:
                gone[at[k][0] : at[k + words - 1][1]] = True
        out[i] = bytes(np.frombuffer(d, "u1")[~gone])
    return out


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same by a table of all strings, for tests on small tables."""
    seen: dict[bytes, int] = {}
    coded = [(i, (t or "").encode()) for i, t in rows]
    for _, d in coded:
        for s in range(len(d) - length + 1):
            key = d[s : s + length]
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, d in coded:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(d, "u1")[~gone])
        out.append((i, len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
