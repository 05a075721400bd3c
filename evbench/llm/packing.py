"""Bounded-space online packing (operator 6).

Each partition keeps a fixed number of open windows.  A document's ids are cut into full windows and one remainder; the
remainder goes into the open window that it fills best; where none fits and all windows are in use, the fullest is
emitted.  Windows that a partition leaves open are merged across partitions by the same rule in a second pass.  Only piece
metadata leaves a task, never ids, so that the second pass is small.  A sequence shorter than its capacity is padded to
it, except where its length is a power of two (`padded_length`).

A null or empty text is the end id alone.  Repeated ids are packed separately.  An empty table gives no pieces.  All
pieces of a window stand in it gaplessly from 0 in the order of placement.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import codec, vocabulary
from .common import crc, cut, lines_into, texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seq_length long, is_open boolean"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def padded_length(n: int, capacity: int = 1024) -> int:
    return n if n & (n - 1) == 0 else capacity


class OpenWindows:
    """At most `most` open windows; put() returns a window to emit, if one had to go to make room."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_room: list[tuple[int, int]] = []  # (room, window), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def put(self, length: int, item) -> list | None:
        out = None
        at = bisect_left(self.by_room, (length, -1))  # the smallest room that is enough
        if at < len(self.by_room):
            room, w = self.by_room.pop(at)
        else:
            if len(self.by_room) >= self.most:
                _, full = self.by_room.pop(0)
                out = self.held.pop(full)
            room, w = self.capacity, self.next
            self.next += 1
            self.held[w] = []
        self.held[w].append((self.capacity - room, item))
        if room > length:
            insort(self.by_room, (room - length, w))
        else:
            out_full = self.held.pop(w)
            if out is not None:
                raise AssertionError("a fresh window cannot be full")
            return out_full
        return out

    def rest(self) -> list[list]:
        left, self.held, self.by_room = list(self.held.values()), {}, []
        return left


def pack(docs: DataFrame, vocab: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 1024, open_windows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, seq_length."""

    def first(batches):
        codec_ = codec(vocabulary(vocab))
        end = np.asarray([end_id], dtype="<u4")
        windows = OpenWindows(capacity, open_windows)
        part, seq = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def emit(window: list, is_open: bool) -> None:
            nonlocal seq
            total = sum(piece[2] for _, piece in window)
            for offset, piece in window:
                rows.append((*piece, (part << 32) + seq, offset, total, is_open))
            seq += 1

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=NAMES)
            rows.clear()
            return out

        for b in batches:
            for doc_id, own in zip(lines_into(b, "doc_id"), codec_.each(lines_into(b, "text")), strict=True):
                ids = np.concatenate([own, end])
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    item = (doc_id, at, len(piece), crc(piece), len(ids))
                    if len(piece) == capacity:
                        emit([(0, item)], False)
                    elif (gone := windows.put(len(piece), item)) is not None:
                        emit(gone, False)
            if len(rows) > 10_000:
                yield batch()
        for window in windows.rest():
            emit(window, True)
        if rows:
            yield batch()

    def merge(batches):
        """Open windows, each a row with its pieces, put together as if each were one remainder."""
        windows = OpenWindows(capacity, 4 * open_windows)
        part, seq = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal seq
            total = sum(x["seq_length"] for _, x in window)
            for shift, x in window:
                for p in x["pieces"]:
                    rows.append((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"], (1 << 62) + (part << 32) + seq, shift + p["offset"], total, False))
            seq += 1

        for b in batches:
            for x in b.to_pylist():
                if (gone := windows.put(x["seq_length"], x)) is not None:
                    emit(gone)
        for window in windows.rest():
            emit(window)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=NAMES)

    spark = docs.sparkSession
    placed = cut(texts(docs, id_col, text_col).mapInArrow(first, PIECES))
    # at most open_windows windows a task of the first pass; about 4096 of them meet in a merging task
    tasks = max(1, -(-placed.rdd.getNumPartitions() * open_windows // 4096))
    piece = F.struct("offset", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    open_ = placed.where("is_open").groupBy("sequence_id", "seq_length").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    merged = open_.repartition(tasks, "sequence_id").sortWithinPartitions(F.desc("seq_length"), "sequence_id").mapInArrow(merge, PIECES)
    return placed.where("not is_open").unionByName(merged).drop("is_open")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
