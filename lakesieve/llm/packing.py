"""Best-fit packing by exact-complement hashing: single lengths and sums of two and three lengths that fill a gap exactly are
looked up and consumed under their availability; what has no exact complement is packed best-fit.

The plan is made over the counts of lengths, at most one for each length up to the capacity, so the driver's work and what it
sends out do not grow with the documents. Pieces then find their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesieve.llm.common import frugal, keep, pick, read
from lakesieve.llm.tokens import encoder, vocabulary

CAPACITY, END = 4096, 1
#: Rows of one length that are ranked together.
CELL = 128


class _Stock:
    """Available counts by length, and an index of the sums that two available lengths can have."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts
        self._sums = np.zeros(0, bool)
        self._age = 0

    def _index(self) -> np.ndarray:
        """Sums of two lengths. Lengths only run out, so an old index holds all sums that there are; hits are verified."""
        if not len(self._sums) or self._age >= 64:
            have = np.nonzero(self.left > 0)[0]
            self._sums, self._age = np.zeros(len(self.left), bool), 0
            for a in have:
                s = have[have <= len(self.left) - 1 - a] + a
                self._sums[s] = True
        self._age += 1
        return self._sums

    def _pair(self, gap: int, left: np.ndarray) -> tuple[int, ...] | None:
        have = left[1:gap] > 0
        both = np.nonzero(have & have[::-1])[0] + 1
        both = both[2 * both >= gap]
        for a in both[::-1]:  # the longest first: short ones are easier to place later
            if 2 * a != gap or left[a] >= 2:
                return int(a), int(gap - a)
        return None

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        left = self.left[: gap + 1].copy()
        for n, k in used.items():
            if n <= gap:
                left[n] -= k
        if left[gap] > 0:
            return (gap,)
        if found := self._pair(gap, left):
            return found
        third = np.nonzero(left[1:gap] > 0)[0] + 1
        third = third[self._index()[gap - third]]
        third = third[3 * third >= gap]
        for c in third[::-1]:
            left[c] -= 1
            found = self._pair(int(gap - c), left[: gap - c + 1])
            left[c] += 1
            if found:
                return (int(c), *found)
        return None

    def fitting(self, gap: int, used: Counter) -> int:
        """The longest available length that fits, 0 for none."""
        have = np.nonzero(self.left[1 : gap + 1] > 0)[0] + 1
        for n in have[::-1]:
            if self.left[n] > used[int(n)]:
                return int(n)
        return 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Patterns (how often each length) with the number of sequences of that pattern. Each round makes as many sequences of
    one pattern as the stock allows, so at least one length falls below what the pattern needs; the rounds are bounded by
    the number of lengths, not of pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    stock, out, longest = _Stock(left), [], capacity
    while longest:
        if not left[longest]:
            longest -= 1
            continue
        used, gap = Counter({longest: 1}), capacity - longest
        while gap:
            if found := stock.exact(gap, used):
                used.update(found)
                break
            if not (n := stock.fitting(gap, used)):
                break
            used[n] += 1
            gap -= n
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        out.append((used, times))
    return out


def places(patterns: list[tuple[Counter, int]]) -> np.ndarray:
    """Rows length, first rank, sequences of the pattern, first sequence, first offset; sorted by length and rank. A length's
    ranks from the first on stand in those sequences in turn, copy after copy."""
    rows, ranks, sequence = [], Counter(), 0
    for used, times in patterns:
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n, ranks[n], times, sequence, offset))
            ranks[n] += k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and the ids (little-endian) if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in batches:
            rows = []
            for doc_id, found in zip(b.column(0).to_pylist(), coder.encode(x.as_py() for x in b.column(1)), strict=True):
                ids = np.append(found.astype("<u4"), np.uint32(end))
                for i in range(0, len(ids), capacity):
                    part = ids[i : i + capacity]
                    rows.append((doc_id, i // capacity, i, len(part), zlib.crc32(part.tobytes()), *([part.tobytes()] if with_ids else [])))
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
            yield pa.record_batch({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(types.items())})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(frugal(run), schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (a written table) with sequence_id and offset. Any columns stay."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity))
    names = cut.columns
    # Ranks within a length: pieces are dealt to cells of bounded size, and cells, not pieces, are put in order.
    cells = cut.sparkSession.createDataFrame([(n, -(-k // CELL)) for n, k in sorted(counts.items())], "length long, _cells long")
    dealt = cut.join(F.broadcast(cells), "length").withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_cells"))).drop("_cells")
    order = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_in", F.row_number().over(inside)).join(keep(base, "bases"), ["length", "_cell"]).withColumn("_rank", F.col("_base") + F.col("_in") - 1)
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            found = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            nth = rank - found[:, 1]
            columns = {c: b.column(c) for c in names}
            yield pa.record_batch(columns | {"sequence_id": pa.array(found[:, 3] + nth % found[:, 2]), "offset": pa.array(found[:, 4] + nth // found[:, 2] * length)})

    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(frugal(run), schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    Documents of more than `capacity` ids, the end id included, are cut into pieces of `capacity`, the last one shorter; no
    other is cut. Null and empty texts are the end id alone. Rows alike are pieces of their own each.
    """
    return place(keep(pieces(docs, path or vocabulary("word_bpe_49k.json"), capacity, end, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids (little-endian unsigned 32-bit) of each sequence; at most `capacity` ids meet for one."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("_parts"))
    return joined.select("sequence_id", F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
