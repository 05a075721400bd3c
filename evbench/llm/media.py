"""Media columns (operator 9): Netpbm and BMP decoding, area resizing by integral images, NPY tiles and difference hashes.

`decode` reads P1-P6 Netpbm and uncompressed 8-, 24- and 32-bit BMP into numpy arrays of (height, width, channels).
`resize_area` averages the exact area that each target pixel covers, by interpolating a summed-area table, in memory
proportional to the picture.  `tiles` gives each picture's tile in NPY format and its difference hash.

Null or damaged media: null tile and hash, and the reason in `error`.  For texts as media, see `pack_texts`: null is the
empty text.  Their tiles go into archives, one for each task, with an index.  Very long texts are high pictures.  Repeated ids
are separate rows.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lines_into, shared_path, texts

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("damaged Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    most = head[2] if len(head) == 3 else 1
    if not 0 < most < 65536 or not w or not h:
        raise ValueError("damaged Netpbm header")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * channels
    if kind == b"P1":
        digits = np.frombuffer(re.sub(rb"#[^\n\r]*", b"", data[at:]), "u1")
        flat = (digits[(digits == 48) | (digits == 49)] - 48)[:n]
    elif kind in (b"P2", b"P3"):
        flat = np.asarray(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == b"P4":
        row = -(-w // 8)
        raw = np.frombuffer(data, "u1", offset=at + 1)[: row * h]
        if len(raw) < row * h:
            raise ValueError("short Netpbm raster")
        flat = np.unpackbits(raw.reshape(h, row), axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, "u1" if most < 256 else ">u2", offset=at + 1, count=-1 if most < 256 else (len(data) - at - 1) // 2)[:n]
    if len(flat) < n:
        raise ValueError("short Netpbm raster")
    if kind in (b"P1", b"P4"):
        flat = 1 - flat  # 1 is black
    if most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    return flat.astype("u1").reshape(h, w, channels)


def encode_ppm(samples: np.ndarray) -> bytes:
    h, w, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (w, h) + samples.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    (start,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    (used,) = struct.unpack_from("<I", data, 46)
    if packed not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or not h:
        raise ValueError("unsupported BMP")
    row = (w * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, "u1", offset=start)[: row * abs(h)]
    if len(raw) < row * abs(h):
        raise ValueError("short BMP raster")
    px = raw.reshape(abs(h), row)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    if h > 0:  # rows stand from the bottom up
        px = px[::-1]
    if bits == 8:
        palette = np.frombuffer(data, "u1", offset=14 + size, count=4 * (used or 256)).reshape(-1, 4)
        return palette[:, 2::-1][px[:, :, 0]]
    return px[:, :, 2::-1].copy()  # blue, green, red (and a spare byte)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _overlaps(n: int, to: int):
    """Where the edges of `to` equal parts of 0..n fall: whole index and fraction."""
    edge = np.arange(to + 1) * (n / to)
    whole = np.minimum(np.floor(edge).astype(np.int64), n - 1)
    return whole, edge - whole


def resize_area(px: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the area that each target pixel covers, from an integral image read at fractional corners."""
    h, w, c = px.shape
    table = np.zeros((h + 1, w + 1, c))
    table[1:, 1:] = px.astype(np.float64).cumsum(axis=0).cumsum(axis=1)
    yi, yf = _overlaps(h, height)
    xi, xf = _overlaps(w, width)
    rows = table[yi] * (1 - yf)[:, None, None] + table[yi + 1] * yf[:, None, None]
    at = rows[:, xi] * (1 - xf)[None, :, None] + rows[:, xi + 1] * xf[None, :, None]
    area = (h / height) * (w / width)
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / area


def difference_hash(px: np.ndarray, side: int = 8) -> str:
    """Bits of whether each of side x side cells is brighter than its right neighbour, as hex."""
    grey = resize_area(px, side, side + 1).mean(axis=2)
    bits = np.round(grey[:, 1:], 6) < np.round(grey[:, :-1], 6)
    return np.packbits(bits.ravel()).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tile(px: np.ndarray, side: int = 32) -> np.ndarray:
    return np.clip(np.rint(resize_area(px, side, side)), 0, 255).astype("u1")


def tiles(media: DataFrame, id_col: str = "id", data_col: str = "media", side: int = 32) -> DataFrame:
    """(id, height, width, channels, tile (NPY bytes), dhash, error) of each picture, by a scan without a shuffle."""
    names = ["id", "height", "width", "channels", "tile", "dhash", "error"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def make(batches):
        for b in batches:
            rows = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    if not data.is_valid:
                        raise ValueError("no media")
                    px = decode(data.as_py())
                    rows.append((i, *px.shape, npy(tile(px, side)), difference_hash(px), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((i, None, None, None, None, None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    pick = media.select(media[id_col].cast("long").alias("id"), media[data_col].alias("media"))
    return pick.mapInArrow(make, "id long, height int, width int, channels int, tile binary, dhash string, error string")


def write_npy_tiles(made: DataFrame, path: str) -> DataFrame:
    """Write each tile as <id>-<number>.npy below path (any URI that Arrow's file systems know); (id, file) of each."""

    def write(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for b in batches:
            ids, data = lines_into(b, "id"), lines_into(b, "tile")
            files = [None if d is None else f"{i}-{hashlib.sha256(d).hexdigest()[:16]}.npy" for i, d in zip(ids, data, strict=True)]
            for f, d in zip(files, data, strict=True):
                if f:
                    with store.open_output_stream(f"{folder}/{f}") as out:
                        out.write(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.string())], names=["id", "file"])

    return made.select("id", "tile").mapInArrow(write, "id long, file string")


# ------------------------------------------------------------------------------------------- texts stored as pictures

#: Samples of a row of pixels: 64 pixels of three channels.
ROW = 192


def payload_of(text: str) -> tuple[int, bytes]:
    data = text.encode()
    return len(data), data + b" " * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def pack_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store each text's bytes as a PPM picture 64 pixels wide, in a table of (doc_id, n_bytes, media) at path."""

    def pack(batches):
        for b in batches:
            ids, sizes, media = lines_into(b, "doc_id"), [], []
            for text in lines_into(b, "text"):
                n, payload = payload_of(text)
                sizes.append(n)
                media.append(encode_ppm(np.frombuffer(payload, "u1").reshape(-1, ROW // 3, 3)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    texts(docs, id_col, text_col).mapInArrow(pack, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PLACE = "file string, offset long, size long"
#: Side of the tiles of stored texts.
TEXT_TILE = 8


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def write_tile_archives(stored: DataFrame, path: str, side: int = TEXT_TILE) -> None:
    """Decode stored pictures; write their NPY tiles one after the other into a file for each task, and an index with their digests.

    The index (Parquet, by Spark's committer) names only files of successful attempts, with each tile's offset and size.
    """

    def write(batches):
        from pyarrow import fs

        out, file, offset = None, f"{uuid.uuid4().hex}.tiles", 0
        for b in batches:
            if out is None and b.num_rows:
                store, folder = fs.FileSystem.from_uri(f"{path}/tiles")
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{file}")
            rows = []
            for doc_id, n, media in zip(*(lines_into(b, c) for c in ("doc_id", "n_bytes", "media")), strict=True):
                px = decode(media)
                payload = px.tobytes()
                data = npy(tile(px, side))
                out.write(data)
                sha = hashlib.sha256
                rows.append((doc_id, n, len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha(media).hexdigest(), difference_hash(px), file, offset, len(data)))
                offset += len(data)
            if rows:
                yield _columns(rows, f"{DIGEST}, {PLACE}")
        if out is not None:
            out.close()

    stored.select("doc_id", "n_bytes", "media").mapInArrow(write, f"{DIGEST}, {PLACE}").write.parquet(f"{path}/index")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The index with `tile`, the NPY bytes that stand in the archives; tiles of a file that an Arrow batch asks for are one read."""
    index = spark.read.schema(f"{DIGEST}, {PLACE}").parquet(f"{path}/index")
    at = [index.columns.index(c) for c in ("file", "offset", "size")]

    def read(batches):
        from pyarrow import fs

        for b in batches:
            if not b.num_rows:
                continue
            store, folder = fs.FileSystem.from_uri(f"{path}/tiles")
            files, offsets, sizes = (b.column(i).to_pylist() for i in at)
            found: list = [None] * b.num_rows
            for file in set(files):
                mine = [i for i, f in enumerate(files) if f == file]
                lo, hi = min(offsets[i] for i in mine), max(offsets[i] + sizes[i] for i in mine)
                with store.open_input_file(f"{folder}/{file}") as f:
                    f.seek(lo)
                    data = f.read(hi - lo)
                for i in mine:
                    found[i] = data[offsets[i] - lo : offsets[i] - lo + sizes[i]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, "tile"])

    return index.mapInArrow(read, f"{DIGEST}, {PLACE}, tile binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "media")
    pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{path}/pictures")
    write_tile_archives(spark.read.parquet(f"{path}/pictures"), path)
    return read_tiles(spark, path).withColumn("tile_sha256", F.sha2("tile", 256)).drop("file", "offset", "size", "tile")
