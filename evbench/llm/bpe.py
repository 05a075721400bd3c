"""BPE encoding and decoding with content-defined chunk reuse (operator 10).

A rolling hash over the UTF-8 bytes cuts each text where the hash of the last 32 bytes has its low bits zero, so that texts
with a passage in common have its chunks in common, wherever it stands.  Chunks that occur twice or more are encoded once,
by the document that holds the first occurrence; the others take those ids through a join.  The rest is encoded in place.

A chunk's ids are those of its whole words; the broken words at its two ends are kept as text.  Joining two chunks
re-encodes the stretch from the last white space before the join to the first one after it, and where a chunk has no
white space the stretch grows over it into the next one, until both ends are word breaks, where the tokenizer's splitter
makes the ids on either side independent: from there on they agree exactly with those of the whole text.

Null or empty texts have no ids and decode to the empty text.  Repeated ids are encoded alike.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import codec, vocabulary
from .common import cut, lines_into, texts

#: Low bits of the rolling hash that must be zero at a cut: chunks of 2**CUT_BITS bytes on average.
CUT_BITS = 10
MIN_CHUNK, MAX_CHUNK = 256, 16_384
#: Uses of a shared chunk that one salt takes.
SALT_USES = 1000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes up to each byte (fewer at the start), by doubling the window."""
    h = data.astype(np.uint64) + np.uint64(1)
    step, power = 1, MULTIPLIER
    for _ in range(5):
        nxt = h.copy()
        nxt[step:] += h[:-step] * power
        h, step, power = nxt, 2 * step, power * power
    return h ^ (h >> np.uint64(29))


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks that concatenate to data and end on UTF-8 character bounds."""
    if not data:
        return []
    raw = np.frombuffer(data, "u1")
    with np.errstate(over="ignore"):
        hits = np.flatnonzero((rolling(raw) * MULTIPLIER) >> np.uint64(64 - CUT_BITS) == 0) + 1
    out, at, n = [], 0, len(data)
    k = 0
    while at < n:
        while k < len(hits) and hits[k] < at + MIN_CHUNK:
            k += 1
        end = int(hits[k]) if k < len(hits) else n
        end = min(end, at + MAX_CHUNK, n)
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def chunk_hash(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def splitting(vocab: str):
    """The codec of a vocabulary; chunks join exactly only where white space is dropped, so others are refused."""
    codec_ = codec(vocabulary(vocab))
    if not codec_.lower:
        raise ValueError(f"{vocab} keeps white space in its tokens: chunks can't be encoded apart")
    return codec_


def open_chunk(chunk: bytes) -> tuple[str, str | None, str]:
    """(broken word at the start, the whole words, broken word at the end); no words where there's no white space."""
    text = chunk.decode().replace("\n", " ")
    first, last = text.find(" "), text.rfind(" ")
    if first < 0:
        return text, None, ""
    return text[:first], text[first + 1 : last] if last > first else "", text[last + 1 :]


def join_plan(parts: list[tuple[str, str | np.ndarray | None, str]]) -> list[str | np.ndarray]:
    """What a document consists of in order: known ids, and texts that are still to be encoded."""
    out: list[str | np.ndarray] = []
    open_ = ""
    for head, body, tail in parts:
        open_ += head
        if body is None:  # no word break yet
            continue
        if open_:
            out.append(open_)
        out.append(body)
        open_ = tail
    if open_:
        out.append(open_)
    return out


def encode_plans(codec_, plans: list[list[str | np.ndarray]]) -> Iterator[np.ndarray]:
    """The ids of each plan; the texts of all plans are encoded together."""
    made = codec_.each(x for plan in plans for x in plan if isinstance(x, str))
    for plan in plans:
        parts = [next(made) if isinstance(x, str) else x for x in plan]
        yield np.concatenate(parts) if parts else np.zeros(0, "<u4")


def id_type(codec_) -> str:
    """Two bytes an id on the way, where the vocabulary allows it."""
    return "<u2" if codec_.tok.get_vocab_size() <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, vocab: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary of unsigned 32-bit little-endian ids) without special tokens; for vocabularies that drop white space.

    `ids` are built per document in its task; see `digests` for results that don't carry them.
    """
    return _assembled(docs, vocab, id_col, text_col, digest=False)


def digests(docs: DataFrame, vocab: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return _assembled(docs, vocab, id_col, text_col, digest=True)


def _assembled(docs: DataFrame, vocab: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    base = texts(docs, id_col, text_col)

    def hashed(batches):
        for b in batches:
            ids, k0, k1 = lines_into(b, "doc_id"), [], []
            for text in lines_into(b, "text"):
                own = np.frombuffer(b"".join({chunk_hash(c) for c in chunks(text.encode())}), "<i8").reshape(-1, 2)
                k0.append(own[:, 0])
                k1.append(own[:, 1])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k0, kind), pa.array(k1, kind)], names=["doc_id", "k0", "k1"])

    # a row per document holds its distinct chunks
    found = cut(base.mapInArrow(hashed, "doc_id long, k0 array<long>, k1 array<long>")).select("doc_id", F.explode(F.arrays_zip("k0", "k1")).alias("k")).select("doc_id", "k.k0", "k.k1")
    shared = found.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner")).where("n > 1")
    # uses of one chunk are dealt over salts, as many as its count asks for
    uses = cut(found.join(shared, ["k0", "k1"]).withColumn("salts", F.ceil(F.col("n") / SALT_USES).cast("int")).drop("n"))
    owned = uses.where("doc_id = owner").groupBy("doc_id").agg(F.collect_list(F.struct("k0", "k1", "salts")).alias("own"))
    names = ["k0", "k1", "head", "ids", "tail"]

    def encode_owned(batches):
        codec_ = splitting(vocab)
        kind = id_type(codec_)
        for b in batches:
            rows, bodies = [], []
            for text, own in zip(lines_into(b, "text"), lines_into(b, "own"), strict=True):
                wanted = {np.asarray([k["k0"], k["k1"]], "<i8").tobytes(): k["salts"] for k in own}
                for c in chunks(text.encode()):
                    if salts := wanted.pop(h := chunk_hash(c), None):
                        head, body, tail = open_chunk(c)
                        rows.append([*np.frombuffer(h, "<i8").tolist(), head, None, tail, salts])
                        bodies.append(body)
            made = codec_.each(x for x in bodies if x is not None)
            for row, body in zip(rows, bodies, strict=True):
                if body is not None:
                    row[3] = next(made).astype(kind).tobytes()
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=[*names, "salts"])

    made = base.join(owned.hint("shuffle_hash"), "doc_id").mapInArrow(encode_owned, "k0 long, k1 long, head string, ids binary, tail string, salts int")
    # an owner with repeated rows encodes its chunks once for each; they are equal
    once = made.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    asked = uses.select("k0", "k1", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))
    given = asked.join(once, ["k0", "k1", "salt"]).groupBy("doc_id").agg(F.collect_set(F.struct(*names)).alias("given"))

    def assemble(batches):
        codec_ = splitting(vocab)
        kind = id_type(codec_)
        for b in batches:
            plans = []
            for text, got in zip(lines_into(b, "text"), lines_into(b, "given"), strict=True):
                known = {}
                for g in got or ():
                    ids = None if g["ids"] is None else np.frombuffer(g["ids"], kind).astype("<u4")
                    known[np.asarray([g["k0"], g["k1"]], "<i8").tobytes()] = (g["head"], ids, g["tail"])
                plans.append(join_plan([known.get(chunk_hash(c)) or open_chunk(c) for c in chunks(text.encode())]) if known else [text])
            rows = []
            for doc_id, ids in zip(lines_into(b, "doc_id"), encode_plans(codec_, plans), strict=True):
                if digest:
                    decoded = codec_.decode(ids)
                    rows.append((doc_id, len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    rows.append((doc_id, ids.tobytes()))
            if rows:
                out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids binary"
    return base.join(given.hint("shuffle_hash"), "doc_id", "left").mapInArrow(assemble, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
