"""Token-id output as length-delimited binary records (operator 1).

One data file per partition of the id order.  A record is

    payload length  unsigned 64-bit
    masked crc32 of those 8 bytes  unsigned 32-bit
    payload: document id (signed 64-bit), bytes per id (one byte: 2 or 4), the ids
    masked crc32 of the payload  unsigned 32-bit

all little-endian.  A mask is a rotation by 15 bits plus a constant, so that checksums of data that hold checksums stay
independent.  Beside the data files stands an index (Parquet) with file, document id, byte offset, byte length, number of
ids and the number of ids before it in the file: a reader can take records in any order.  The index is written by Spark's
committer and names only the files of successful task attempts; files of failed attempts are never read.

Null or empty texts give a record with the end id alone; an empty table gives an empty index.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codec import codec, vocabulary
from .common import crc, lines_into, shared_path, texts

#: Fixed constant of the checksum mask.
MASK_DELTA = 0xA282EAD8
#: Bytes of records that a read task takes at once.
READ_BYTES = 8 << 20

INDEX = "file string, doc_id long, offset long, n_bytes long, n_tokens long, before long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def pack_record(doc_id: int, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = struct.pack("<qB", doc_id, width) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unpack_records(data: bytes):
    """(doc_id, ids) of records that stand one after the other; raises ValueError where a checksum or a length is wrong."""
    at = 0
    while at < len(data):
        if at + 12 > len(data) or masked(data[at : at + 8]) != struct.unpack_from("<I", data, at + 8)[0]:
            raise ValueError(f"damaged record length at byte {at}")
        (n,) = struct.unpack_from("<Q", data, at)
        payload = data[at + 12 : at + 12 + n]
        if len(payload) < n or at + 16 + n > len(data) or masked(payload) != struct.unpack_from("<I", data, at + 12 + n)[0]:
            raise ValueError(f"damaged record at byte {at}")
        doc_id, width = struct.unpack_from("<qB", payload)
        yield doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")
        at += 16 + n


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, path: str, vocab: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id, and write data files and index below path, in ascending id order over the files."""

    def write(batches):
        codec_ = codec(vocabulary(vocab))
        end = np.asarray([end_id], dtype="<u4")
        out, file = None, f"{uuid.uuid4().hex}.rec"
        offset = before = 0
        for b in batches:
            if out is None and b.num_rows:
                store, folder = _files(f"{path}/data")
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{file}")
            rows = []
            for doc_id, own in zip(lines_into(b, "doc_id"), codec_.each(lines_into(b, "text")), strict=True):
                ids = np.concatenate([own, end])
                rec = pack_record(doc_id, ids)
                out.write(rec)
                rows.append((file, doc_id, offset, len(rec), len(ids), before))
                offset += len(rec)
                before += len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["file", "doc_id", "offset", "n_bytes", "n_tokens", "before"])
        if out is not None:
            out.close()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(write, INDEX).write.parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, offset), read back from the data files; start counts the ids of all documents before."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    # one row per file: the number of files is the number of write tasks, not of documents
    order = Window.orderBy("lo", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("file").agg(F.min("doc_id").alias("lo"), F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    spans = (
        index.groupBy("file", F.floor(F.col("offset") / READ_BYTES).alias("block"))
        .agg(F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("n_bytes")).alias("hi"), F.min("before").alias("before"))
        .join(files, "file")
        .select("file", "lo", "hi", (F.col("base") + F.col("before")).alias("start"))
    )

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                store, folder = _files(f"{path}/data")
                with store.open_input_file(f"{folder}/{r['file']}") as f:
                    f.seek(r["lo"])
                    data = f.read(r["hi"] - r["lo"])
                rows, start, offset = [], r["start"], r["lo"]
                for doc_id, ids in unpack_records(data):
                    rows.append((doc_id, start, len(ids), crc(ids), r["file"], offset))
                    start += len(ids)
                    offset += 16 + 9 + len(ids) * (2 if not len(ids) or int(ids.max()) < 1 << 16 else 4)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "offset"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartition(n, "file", "lo").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, offset long")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(place, doc_id, ids): every record once in an order drawn from the seed, read one by one by its offset.

    place is the 64-bit hash by which tasks and their rows are ordered, so that an epoch can be repeated or resumed from a place.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select(F.xxhash64(F.lit(seed), "file", "offset").alias("place"), "file", "offset", "n_bytes")

    def read(batches):
        for b in batches:
            rows = []
            store, folder = _files(f"{path}/data")
            for place, file, offset, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                with store.open_input_file(f"{folder}/{file}") as f:
                    f.seek(offset)
                    doc_id, ids = next(unpack_records(f.read(size)))
                rows.append((place, doc_id, ids))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["place", "doc_id", "ids"])

    return placed.repartitionByRange(n, "place").sortWithinPartitions("place").mapInArrow(read, "place long, doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_records(spark, path)
