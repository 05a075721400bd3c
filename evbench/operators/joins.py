"""Join operators: lookups, membership, nearest values, intervals, candidate pairs from shared tokens, containment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut
from .ranks import numbered


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a side with one row per key; Spark broadcasts it if its statistics say that it is small."""
    return df.join(dim, list(on), "left")


def membership(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: for each key column, how many rows of df have a value that known has too.  One distinct side for each key."""
    out = df
    for k in keys:
        seen = known.select(F.col(k)).distinct().withColumn(f"__{k}", F.lit(True))
        out = out.join(seen, k, "left")
    return out.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(f"__{k}").alias(f"{k}_shared") for k in keys])


def batches(keys: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch): consecutive runs of `size` distinct keys in order; see ranks.numbered()."""
    rows = keys.select(F.col(key).cast("string").alias(key)).distinct()
    return numbered(rows, [key], "__at").select(key, F.floor(F.col("__at") / size).cast("long").alias("batch"))


def nearest(points: DataFrame, sites: DataFrame, group: str, ident: str, value: str) -> DataFrame:
    """(group, id, value, distance) to the nearest site of the group, null where it has none; null groups and values have none.

    Distinct places of points and sites are sorted together by Spark's ranges of (group, value), so that a group of any size
    spreads over tasks.  The last site before and the first one after are the only candidates: they are found within a range,
    or carried from the nearest other range of the group that holds one.  Distance 0 counts.
    """
    asked = points.select(group, value, F.lit(True).alias("__p"), F.lit(False).alias("__k"))
    places = asked.unionByName(sites.select(group, value, F.lit(False).alias("__p"), F.lit(True).alias("__k"))).dropna(subset=[group, value])
    each = places.groupBy(group, value).agg(F.bool_or("__p").alias("__p"), F.bool_or("__k").alias("__k"))
    site = F.when(F.col("__k"), F.col(value))
    ranged = cut(each.withColumn("__s", site).repartitionByRange(group, value).withColumn("__r", F.spark_partition_id()))
    # a row for each range of a group
    ends = ranged.groupBy(group, "__r").agg(F.min("__s").alias("lo"), F.max("__s").alias("hi"))
    by = Window.partitionBy(group).orderBy("__r")
    earlier = F.last("hi", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("__e")
    later = F.first("lo", True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("__l")
    # both windows end at the row itself: a frame from a row to the end of its group is read anew for each row
    local, back = (Window.partitionBy(group, "__r").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc(value), F.desc(value)))
    before = F.coalesce(F.last("__s", True).over(local), "__e")
    after = F.coalesce(F.last("__s", True).over(back), "__l")
    found = ranged.join(ends.select(group, "__r", earlier, later), [group, "__r"]).withColumns({"__b": before, "__a": after}).where("__p")
    distance = F.least(F.col(value) - F.col("__b"), F.col("__a") - F.col(value)).alias("distance")
    return points.select(group, ident, value).join(found.select(group, value, distance), [group, value], "left").select(group, ident, value, "distance")


def inside(crops: DataFrame, ranges: DataFrame, on: str) -> DataFrame:
    """Crops (start, end) with the reason why they don't lie in their key's range (lo, hi): no_range, before, after, or ok."""
    j = crops.join(ranges, on, "left")
    why = F.when(F.col("lo").isNull(), "no_range").when(F.col("start") < F.col("lo"), "before").when(F.col("end") > F.col("hi"), "after").otherwise("ok")
    return j.withColumn("status", why)


#: Bytes of texts whose places a task hashes at once, and bits of a place's hash that are looked up before it leaves the task.
PIECE, FILTER_BITS = 1 << 20, 24

_U = np.uint64


def _place_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes that stand together: of 1, 2, 4, ... bytes by doubling, joined to k, and mixed."""
    base, out, done = 0x9E3779B97F4A7C15, None, 0
    power, one, size = base, data.astype(_U) + _U(1), 1
    while True:
        if k & size:  # the next `size` bytes come behind those that out holds
            n = len(data) - done - size + 1
            out = one[:n] if out is None else out[:n] * _U(power) + one[done : done + n]
            done += size
        if done == k:
            break
        one = one[: len(one) - size] * _U(power) + one[size:]
        power, size = power * power % (1 << 64), 2 * size
    out = (out ^ (out >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return out ^ (out >> _U(29))


def _window_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least value of each `size` that stand together."""
    if len(values) < size:
        return values[:0]
    step = 1
    while step < size:
        move = min(step, size - step)
        values = np.minimum(values[: len(values) - move], values[move:])
        step += move
    return values


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text begins and the last one ends); null is empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit for each beginning of a hash (g), set if some key has it: at most 2**FILTER_BITS bits, whatever the number of keys."""
    at = F.shiftrightunsigned("g", 64 - FILTER_BITS) + 1
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in keys.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect():
        lo = (r["n"] - 1) * 4096
        out[lo : lo + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def contained(needles: DataFrame, texts: DataFrame, k: int = 20, window: int = 64) -> DataFrame:
    """(needle_id, text_id, start): needles (needle_id, needle) that stand in texts (text_id, text); start counts from 0.

    A needle is looked up by the least hash among those of its first `window` places, of k bytes each.  A text that holds it has that hash as the minimum
    of the window there.  Needles of fewer places are looked up by their first k bytes at all places; needles of fewer than k characters match nothing.
    Places are hashed in Arrow batches.  Only hashes whose first bits some needle has leave a task, which drops nothing that matches; they are joined to the needles' hashes, and
    texts that share one are searched.
    """
    kind = {f: d.schema[f].dataType.simpleString() for d, f in ((needles, "needle_id"), (texts, "text_id"))}
    span = k + window - 1

    def look(batches):
        for b in batches:
            data, at = _bytes_of(b.column(1))
            keys = [int(_place_hashes(data[lo : lo + (span if hi - lo >= span else k)], k).min()) for lo, hi in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(keys, _U).view(np.int64)), pa.array(np.diff(at) >= span)], names=["needle_id", "g", "long"])

    asked = cut(needles.where(F.length("needle") >= k).select("needle_id", "needle").mapInArrow(look, f"needle_id {kind['needle_id']}, g long, long boolean"))
    sides = {r[0] for r in asked.select("long").distinct().collect()}
    held = texts.sparkSession.sparkContext.broadcast({side: _bits(asked.where(F.col("long") == side)) for side in sorted(sides)})

    def places(batches):
        known = {side: np.unpackbits(bits, bitorder="little").view(bool) for side, bits in held.value.items()}
        for b in batches:
            data, at = _bytes_of(b.column(1))
            for lo in range(0, len(data), PIECE):
                piece = data[lo : lo + PIECE + span - 1]
                if len(piece) < k:
                    continue
                every = _place_hashes(piece, k)
                for side, bits in known.items():
                    g, size = (_window_least(every, window), span) if side else (every, k)
                    p = np.flatnonzero(bits[(g[:PIECE] >> _U(64 - FILTER_BITS)).astype(np.int64)])
                    text = np.searchsorted(at, lo + p, "right") - 1
                    inside = lo + p + size <= at[text + 1]
                    found = np.unique(np.stack([text[inside], g[p[inside]].view(np.int64)]), axis=1)
                    if found.shape[1]:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(found[0])), pa.array(found[1]), pa.array(np.full(found.shape[1], side))], names=["text_id", "g", "long"])

    hits = texts.select("text_id", "text").mapInArrow(places, f"text_id {kind['text_id']}, g long, long boolean").join(asked, ["g", "long"]).select("needle_id", "text_id")
    found = hits.distinct().join(needles, "needle_id").join(texts, "text_id")
    return found.select("needle_id", "text_id", (F.instr(F.col("text"), F.col("needle")) - 1).alias("start")).where("start >= 0")


def match_or_keep(needles: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per match, or one without for needles that have none; is_unique if there is exactly one."""
    counts = matches.groupBy("needle_id").agg(F.count(F.lit(1)).alias("n"))
    j = needles.select("needle_id").join(matches, "needle_id", "left").join(counts, "needle_id", "left")
    return j.select("needle_id", "text_id", "start", F.col("text_id").isNotNull().alias("mapped"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("is_unique"))


def covered(crops: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """(crop_id, n_missing, ids): tokens (key, pos, token) at every place of a crop (crop_id, key, start, size), in order."""
    places = crops.where("size > 0").select("crop_id", key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos"))
    j = places.join(tokens, [key, "pos"], "left")
    return j.groupBy("crop_id").agg(F.count_if(F.col("token").isNull()).alias("n_missing"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x.token).alias("ids"))


def either_direction(asked: DataFrame, contacts: DataFrame, value: str) -> DataFrame:
    """Join (a, b) to contacts (x, y) as they stand, or reversed where that fails; `reversed` tells which."""
    stand = contacts.select(F.col("x").alias("a"), F.col("y").alias("b"), value)
    turned = contacts.select(F.col("y").alias("a"), F.col("x").alias("b"), value)
    rest = asked.join(stand.select("a", "b"), ["a", "b"], "left_anti")
    return asked.join(stand, ["a", "b"]).withColumn("reversed", F.lit(False)).unionByName(rest.join(turned, ["a", "b"]).withColumn("reversed", F.lit(True)))


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, with the union of columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def overlap_counts(df: DataFrame, key: Column, part: Column, parts: Sequence[str]) -> DataFrame:
    """One row: keys in each part and keys in each pair of parts, from one aggregation by key."""
    per = df.select(key.alias("k"), part.alias("p")).groupBy("k").agg(*[F.bool_or(F.col("p") == x).alias(x) for x in parts])
    pairs = [(x, y) for i, x in enumerate(parts) for y in parts[i + 1 :]]
    return per.agg(*[F.count_if(F.col(x)).alias(f"{x}_keys") for x in parts], *[F.count_if(F.col(x) & F.col(y)).alias(f"{x}_{y}_overlap") for x, y in pairs])


def join_by_first_key(df: DataFrame, source: DataFrame, keys: Sequence[Sequence[str]], label: str) -> DataFrame:
    """df with source's label by the first key set that both have and that finds a label for some row.

    One existence test per key set; raises ValueError where none works.  Each key of source counts once.
    """
    for key in keys:
        if not set(key) <= set(df.columns) & set(source.columns):
            continue
        side = source.groupBy(*key).agg(F.min(label).alias(label))
        j = df.join(side, list(key), "left")
        if not j.where(F.col(label).isNotNull()).isEmpty():
            return j
    raise ValueError("no key set joins the tables")


def once_per_value(df: DataFrame, column: str, compute) -> DataFrame:
    """df joined to compute(distinct values of the column), so that costly work runs once per value."""
    return df.join(compute(df.select(column).where(F.col(column).isNotNull()).distinct()), column, "left")
