"""Token-id output as a content-addressed store: rolling hashes cut id streams into chunks, each distinct chunk is stored once,
recipes list the chunks of each document, and a Merkle manifest verifies what is read back.

A store is a folder of three tables that Spark writes, so lost executors and commits are Spark's matter:
  chunks    hash (SHA-256 of the ids), n, payload (zstandard frame of little-endian unsigned 16- or 32-bit ids)
  recipes   doc_id, row, idx, hash, n, after (ids of the document behind this chunk), in ascending doc_id order
  manifest  doc_id, row, n_tokens, n_chunks, root (Merkle root over the document's chunk hashes), start, in the same order
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.llm.common import discard, keep, pick, read, table_path, with_start
from lakesieve.llm.tokens import encoder, vocabulary

END = 2
#: Ids in a chunk: at least, on average about (a power of two), at most; ids that the rolling hash sees.
LEAST, MEAN, MOST, SEEN = 128, 1024, 8192, 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document. A cut depends on the SEEN ids before it alone, but for the least and most sizes."""
    if len(ids) <= LEAST:
        return [len(ids)]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
    mixed ^= mixed >> np.uint64(29)
    rolled, factor, seen = mixed, np.uint64(0x100000001B3), 1
    while seen < SEEN:  # the hash of twice as many ids from those of two neighbours
        rolled = rolled[:-seen] * factor + rolled[seen:]
        factor, seen = np.uint64(int(factor) ** 2 % 2**64), 2 * seen
    ends = np.nonzero((rolled >> np.uint64(40)) % np.uint64(MEAN) == 0)[0] + SEEN
    out, last = [], 0
    for e in [*ends.tolist(), len(ids)]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST or (e == len(ids) and e > last):
            last = e
            out.append(last)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root over the leaves; an odd one out goes up as it is."""
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"".join(leaves[i : i + 2])).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def _crc_steps() -> list[np.ndarray]:
    """For each power of two, what that many zero bytes make of each bit of a CRC-32."""
    bit = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # one zero bit

    def twice(m: np.ndarray) -> np.ndarray:
        return _applied(m, m)

    m = bit
    for _ in range(3):
        m = twice(m)
    out = []
    for _ in range(44):
        out.append(m)
        m = twice(m)
    return out


def _applied(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for i in range(32):
        out ^= np.where((values >> np.uint32(i)) & np.uint32(1), matrix[i], np.uint32(0))
    return out


_STEPS = _crc_steps()


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 values as parts of a longer one with so many bytes behind; the exclusive or of all parts is the whole's."""
    crc = crc.astype(np.uint32)
    for k, m in enumerate(_STEPS):
        has = (zeros >> k) & 1 == 1
        if has.any():
            crc[has] = _applied(m, crc[has])
    return crc


def write_store(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encodes every whole text (null counts as empty), adds the end id and writes the store. Rows alike are documents of
    their own each and share their chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, press = encoder(tokenizer), zstandard.ZstdCompressor(level=3, write_content_size=True)
        types = {"doc_id": pa.int64(), "row": pa.int64(), "idx": pa.int32(), "hash": pa.binary(), "n": pa.int32(), "after": pa.int64(), "n_tokens": pa.int64(), "n_chunks": pa.int32(), "root": pa.binary(), "payload": pa.binary()}
        for b in batches:
            rows, size = [], 0
            for doc_id, row, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), coder.encode(x.as_py() for x in b.column(2)), strict=True):
                ids = np.append(found, coder.type.type(end))
                ends = cuts(ids)
                parts = [ids[a:e].tobytes() for a, e in zip([0, *ends[:-1]], ends, strict=True)]
                hashes = [hashlib.sha256(p).digest() for p in parts]
                for i, (p, h) in enumerate(zip(parts, hashes, strict=True)):
                    first = i == 0
                    rows.append((doc_id, row, i, h, len(p) // coder.width, len(ids) - ends[i], len(ids) if first else None, len(ends) if first else None, merkle(hashes) if first else None, press.compress(p)))
                    size += len(p)
                if size > 8 << 20:
                    yield pa.record_batch({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(types.items())})
                    rows, size = [], 0
            yield pa.record_batch({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(types.items())})

    schema = "doc_id long, row long, idx int, hash binary, n int, after long, n_tokens long, n_chunks int, root binary, payload binary"
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    cut = keep(source.mapInArrow(run, schema), "cut")
    heads = cut.where("idx = 0").select("doc_id", "row", "n_tokens", "n_chunks", "root")
    with_start(heads, ["doc_id", "row"], "n_tokens", "start").repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").write.parquet(f"{path}/manifest")
    cut.select("doc_id", "row", "idx", "hash", "n", "after").repartitionByRange("doc_id", "row", "idx").sortWithinPartitions("doc_id", "row", "idx").write.parquet(f"{path}/recipes")
    cut.groupBy("hash").agg(F.first("n").alias("n"), F.first("payload").alias("payload")).write.parquet(f"{path}/chunks")
    discard(cut)


def _chunk_ids(payload: bytes, n: int, hash_: bytes, press: zstandard.ZstdDecompressor | None = None) -> np.ndarray:
    raw = (press or zstandard.ZstdDecompressor()).decompress(payload)
    if hashlib.sha256(raw).digest() != hash_:
        raise ValueError(f"chunk {hash_.hex()} does not hold what its name says")
    return np.frombuffer(raw, f"<u{len(raw) // n}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the store's files: doc_id, row, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    n_chunks, and verified: that the chunks found make the manifest's counts and Merkle root.

    Every chunk is read, checked against its name and summed once; documents then combine the sums of their chunks, so the
    ids themselves are not shuffled.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            got = [zlib.crc32(_chunk_ids(p, n, h, press).astype("<u4").tobytes()) for h, n, p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.record_batch({"hash": b.column(0), "crc": pa.array(got, pa.int64())})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = shifted(b.column("crc").to_numpy(), 4 * b.column("after").to_numpy())
            yield pa.record_batch({c: b.column(c) for c in ("row", "idx", "hash", "n")} | {"part": pa.array(whole.astype(np.int64))})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [bool(whole.as_py()) and merkle(found.as_py()) == root.as_py() for whole, found, root in zip(b.column("whole"), b.column("found"), b.column("root"), strict=True)]
            yield pa.record_batch({c: b.column(c) for c in ("doc_id", "row", "start", "n_tokens", "ids_crc32", "n_chunks")} | {"verified": pa.array(ok) if ok else pa.array([], pa.bool_())})

    chunk = keep(spark.read.parquet(f"{path}/chunks").select("hash", "n", "payload").mapInArrow(sums, "hash binary, crc long"), "sums")
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    made = recipes.join(chunk, "hash").select("row", "idx", "hash", "n", "after", "crc").mapInArrow(parts, "row long, idx int, hash binary, n int, part long")
    found = made.groupBy("row").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("n").alias("_n"), F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("found")).withColumn("found", F.col("found.hash"))
    joined = manifest.join(found, "row", "left").withColumn("whole", (F.col("_n") == F.col("n_tokens")) & (F.size("found") == F.col("n_chunks")))
    checked = joined.select("doc_id", "row", "start", "n_tokens", "ids_crc32", "n_chunks", "whole", "found", "root")
    return checked.mapInArrow(verify, "doc_id long, row long, start long, n_tokens long, ids_crc32 long, n_chunks int, verified boolean")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row and ids: every document's ids, put together again from the store. Chunks that fail their check raise."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_chunk_ids(p.as_py(), n.as_py(), h.as_py()).tolist() for h, n, p in zip(b.column("hash"), b.column("n"), b.column("payload"), strict=True)]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "row": b.column("row"), "idx": b.column("idx"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    joined = spark.read.parquet(f"{path}/recipes").join(spark.read.parquet(f"{path}/chunks").select("hash", "payload"), "hash")
    parts = joined.select("doc_id", "row", "idx", "hash", "n", "payload").mapInArrow(opened, "doc_id long, row long, idx int, ids array<int>")
    whole = parts.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("idx", "ids"))).alias("_parts"))
    return whole.select("doc_id", "row", F.flatten(F.col("_parts.ids")).alias("ids"))


def op7_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "store")
    write_store(read(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified")
