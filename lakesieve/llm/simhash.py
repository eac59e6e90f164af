"""SimHash near-dedup: fingerprints become vectors of bit counts over 32 segments of two bits; the Manhattan distance of two
vectors never exceeds the Hamming distance of the fingerprints, so a grid range-join under it finds all candidates, and
those are then verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.llm.common import discard, frugal, keep, pick, read
from lakesieve.llm.components import components

SEED = 42
#: Set bits by byte value, most significant bit first: row b holds the bits of b.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = (np.arange(8, dtype=np.int64) * 256)[None, :]
_ODD = 0x5555555555555555
#: Rows of a cell that are compared with each other in one group; larger cells are compared in pairs of blocks of this size.
CELL = 1024


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the most significant bit first."""
    by_value = np.bincount((hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    return (by_value @ _BITS).ravel()


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of hashes: bits that are set in over half of them; 0 for none. They are counted in bounded blocks."""
    ones = sum((_ones(hashes[at : at + (1 << 16)]) for at in range(0, len(hashes), 1 << 16)), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a whole text; 0 for a text without words. Windows are counted in bounded blocks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six white-space characters only
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view, digest, ones = memoryview(line), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        s, e = starts[at : min(n, at + (1 << 16))].tolist(), ends[at + shingle - 1 : min(n, at + (1 << 16)) + shingle - 1].tolist()
        ones += _ones(np.array([digest(view[a:b], SEED) for a, b in zip(s, e, strict=True)], dtype=">u8"))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and _fp, the fingerprint's 64 bits as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch({"doc_id": b.column(0), "_fp": pa.array(got.view(np.int64))})

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(frugal(run), "doc_id long, _fp long")


def _counts(fp: Column) -> Column:
    """32 fields of two bits, each the number of set bits of its segment."""
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(high).bitwiseAND(F.lit(_ODD)).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(_ODD)), 1))


def blocks(rows: int, bits: int) -> int:
    """How many blocks of segments make the work least: with b blocks each row stands in comb(b, bits) cells, and a cell that b - bits
    blocks choose holds any other row with a chance of 0.375 ** (32 x (b - bits) / b), since two segments have the same count with
    one of 0.375. So the work for a row grows by about the fourth root of the rows, not with their number."""
    return min(range(bits + 2, 17), key=lambda b: math.comb(b, bits) * (1 + rows * 0.375 ** (32 * (b - bits) / b)))


def _masks(bits: int, blocks: int) -> list[int]:
    """The dimensions of the grids: of so many blocks of segments, two vectors at most `bits` apart agree in all but `bits`, so they
    share a cell of one of the grids, each of which has that many blocks as its dimensions."""
    edge = [2 * (32 * i // blocks) for i in range(blocks + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(some) for some in combinations(block, blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(fp: np.ndarray, cell: np.ndarray, bits: int, direct: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links within cells connect, at most one for each row. cell: numbers, in order. direct: a link of
    each row with the first that it has one with, which need not connect all."""
    us, vs = [], []
    x = fp.view(np.uint64)
    odd = np.uint64(_ODD)
    one = np.uint64(1)
    c = x - ((x >> one) & odd)
    alive, lag = np.arange(len(x)), 0
    while len(alive):
        lag += 1
        alive = alive[alive + lag < len(x)]
        alive = alive[cell[alive] == cell[alive + lag]]
        other = alive + lag
        d = c[alive] ^ c[other]
        # Of two counts 0 to 2, the difference is 1 if they differ in the low bit, else 2 if they differ at all.
        least = np.bitwise_count(d & odd).astype(np.int64) + 2 * np.bitwise_count((d >> one) & ~d & odd)
        near = least <= bits
        a, b = alive[near], other[near]
        exact = np.bitwise_count(x[a] ^ x[b]) <= bits
        us.append(a[exact])
        vs.append(b[exact])
    u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
    label = np.arange(len(x))
    if direct:
        np.minimum.at(label, v, u)
    while not direct:
        m = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.nonzero(label != np.arange(len(x)))[0]
    return fp[linked], fp[label[linked]]


def links(prints: DataFrame, bits: int = 4, direct: bool = False) -> DataFrame:
    """u, v: edges between distinct fingerprints (_fp) that connect all that links of at most `bits` differing bits connect. direct:
    only links themselves, in each cell one for each row that has any with a row before it.

    A cell with more than CELL rows is cut into blocks and all pairs of blocks are compared, so none is left out and no group
    outgrows a task's memory.
    """
    counted = prints.select("_fp", _counts(F.col("_fp")).alias("_c"))
    masks = F.array(*(F.lit(_signed(m)) for m in _masks(bits, blocks(prints.count(), bits))))
    grids = F.transform(masks, lambda m, i: F.struct(i.alias("grid"), F.col("_c").bitwiseAND(m).alias("cell")))
    cells = counted.select("_fp", F.explode(grids).alias("_g")).select("_fp", "_g.grid", "_g.cell")
    full = keep(cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CELL), "full")
    parts = F.coalesce(F.ceil(F.col("_n") / CELL), F.lit(1)).cast("int")
    dealt = cells.join(full, ["grid", "cell"], "left").withColumn("_blocks", parts)
    own = F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int")
    dealt = dealt.select("_fp", "grid", "cell", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_with"))
    dealt = dealt.select("_fp", F.xxhash64("grid", "cell", F.least("_own", "_with"), F.greatest("_own", "_with")).alias("_cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            fp = np.concatenate((held[0], b.column(0).to_numpy()))
            cell = np.concatenate((held[1], b.column(1).to_numpy()))
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on in the next batch
            u, v = _stars(fp[:cut], cell[:cut], bits, direct)
            held = fp[cut:], cell[cut:]
            yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})
        u, v = _stars(*held, bits, direct)
        yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})

    # Two cells that share a hash are compared with each other too, which does no harm: every link is verified.
    ordered = dealt.repartition("_cell").sortWithinPartitions("_cell", "_fp")
    return ordered.mapInArrow(frugal(run), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that is
    reached over links between fingerprints with at most `bits` differing bits, its own included.

    Null and empty texts have fingerprint zero and are linked like any other. Rows without id take part in links; their
    component is named by the ids it holds, null if there are none.
    """
    rows = keep(fingerprints(docs, shingle), "fingerprints")
    prints = keep(rows.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "prints")
    edges = keep(links(prints, bits), "links")
    roots = keep(components(edges).select(F.col("node").alias("_fp"), F.col("root").alias("_root")), "roots")
    named = keep(prints.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp")), "named")
    least = keep(named.groupBy("_root").agg(F.min("_least").alias("component_id")), "least")
    classes = keep(named.join(least, "_root").select("_fp", "component_id"), "classes")
    discard(edges, roots, named, least, prints)
    out = rows.join(classes, "_fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
