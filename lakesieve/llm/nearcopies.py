"""Near copies by resemblance: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

SimHash finds the first candidates: fingerprints of the sets, bit counts of their segments, the grid join under the Manhattan
bound (llm/simhash.py); those are verified on the whole sets and joined to components. At similarity 0.8 about ten of 64 bits
differ, with a wide spread, and a radius that holds them all makes the grid compare all pairs. So what is farther apart than BITS is
found from there on by bands of MinHash values, verified the same way, between what is not connected yet; a parity sketch drops
pairs that cannot be links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesieve.llm.common import discard, frugal, keep, pick
from lakesieve.llm.components import components
from lakesieve.llm.simhash import links, majority

SEED = 42
SHINGLE = 5
#: Differing bits of fingerprints up to which the grid join finds candidates.
BITS = 4
#: Bands and rows of each: a pair at similarity 0.8 shares no band with a chance of (1 - 0.8 ** 4) ** 24, about 3 in a million.
BANDS, ROWS = 24, 4
_A, _X = np.random.default_rng(SEED).integers(0, 2**32, (2, BANDS * ROWS, 1), np.uint32)
_A |= np.uint32(1)
#: Odd factors of the words in a shingle, and of the last mixing step.
_PLACE = np.random.default_rng(SEED + 1).integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters of the texts whose words are looked up together.
BLOCK = 2 << 20
#: Sets that a worker holds at once.
TOGETHER = 1024
#: Rows of a cell that are compared with all others of it in the first round, and by how much their number grows.
CENTRES, MORE = 8, 64
#: Numbers of 64 bits in a sketch: bit i is the parity of the hashes that are i modulo 64 times this.
SKETCH = 4


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _block(texts: list[str]) -> Iterator[np.ndarray]:
    raw = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()).cast(pa.string(), safe=False)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(raw))  # A-Z and the six white-space characters only
    words = parts.flatten().dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
    real = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)
    at = words.indices.to_numpy()
    upto = parts.offsets.to_numpy()
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        own = at[a:b]
        h = known[own[real[own]]]  # white space at either end leaves an empty word
        n = len(h) - SHINGLE + 1
        if n > 1:
            yield np.unique(_mixed(sum((h[i : i + n] * _PLACE[i] for i in range(1, SHINGLE)), h[:n] * _PLACE[0])))
        else:  # one shingle, which a shorter one of the same words is not
            yield _mixed((h * _PLACE[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(SHINGLE - len(h))) if len(h) else h


def shingles(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the distinct hashes of its shingles, in order; a shorter text is one shingle, a text without words has none.
    Each distinct word of a block of texts is hashed once, and shingles are sums of their words' hashes by place."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size > BLOCK:
            yield from _block(held)
            held, size = [], 0
    if held:
        yield from _block(held)


def _cells(hashes: np.ndarray) -> list[int]:
    """A number for each band of the set's MinHash values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        x = short[None, at : at + 2048] ^ _X
        x *= _A
        np.minimum(least, x.min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(bands[i].tobytes(), i) for i in range(BANDS)]


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes by residue. Two sketches differ in no more bits than the sets have hashes of their own."""
    odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, _text (a hash), _key (a hash of the set of shingles), _n (its size), _fp (its fingerprint), _sketch and _cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, prints, sketches, cells = [], [], [], [], []
            for hashes in shingles(x.as_py() for x in b.column(2)):
                keys.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                prints.append(majority(hashes))
                sketches.append(_sketch(hashes))
                cells.append(np.array(_cells(hashes) if len(hashes) else [], np.uint64).view(np.int64))
            yield pa.record_batch({"doc_id": b.column(0), "_text": b.column(1), "_key": pa.array(np.array(keys, np.uint64).view(np.int64)), "_n": pa.array(sizes, pa.int64()), "_fp": pa.array(np.array(prints, np.uint64).view(np.int64)), "_sketch": pa.array(sketches, pa.list_(pa.int64())), "_cells": pa.array(cells, pa.list_(pa.int64()))})

    return docs.mapInArrow(frugal(run), "doc_id long, _text long, _key long, _n long, _fp long, _sketch array<long>, _cells array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """_key and _set, the hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, TOGETHER) for at in range(0, whole.num_rows, TOGETHER)):
                sets = [x.view(np.int64) for x in shingles(x.as_py() for x in b.column(1))]
                yield pa.record_batch({"_key": b.column(0), "_set": pa.array(sets, pa.list_(pa.int64()))})

    return texts.mapInArrow(frugal(run), "_key long, _set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose sets have a similarity of 0.8 or more, in whole numbers; their roots, as an edge."""
    both = pairs.join(sets.select(F.col("_key").alias("v"), F.col("_set").alias("_b")), "v").join(sets.select(F.col("_key").alias("u"), F.col("_set").alias("_a")), "u")
    linked = both.where(9 * F.size(F.array_intersect("_a", "_b")) >= 4 * (F.size("_a") + F.size("_b")))
    return linked.select(F.col("_ru").alias("u"), F.col("_rv").alias("v")).distinct()


def _moved(rows: DataFrame, to: DataFrame) -> DataFrame:
    """The rows with their _root replaced by what `to` (node, root) leads it to."""
    renamed = to.select(F.col("node").alias("_root"), F.col("root").alias("_to"))
    return rows.join(renamed, "_root", "left").withColumn("_root", F.coalesce("_to", "_root")).drop("_to").select(*rows.columns)


def _candidates(nodes: DataFrame) -> DataFrame:
    """u, v: pairs of sets (_key) by their fingerprints: those with one fingerprint, each with the first of them, and these with each
    other where at most BITS bits differ."""
    firsts = keep(nodes.groupBy("_fp").agg(F.min("_key").alias("_first")), "firsts")
    same = nodes.join(firsts, "_fp").where("_key <> _first").select(F.col("_first").alias("u"), F.col("_key").alias("v"))
    found = links(firsts.select("_fp"), BITS, direct=True)
    at = lambda end: firsts.select(F.col("_fp").alias(end), F.col("_first").alias(f"_{end}"))
    near = found.join(at("u"), "u").join(at("v"), "v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
    out = keep(same.unionByName(near).distinct(), "candidates")
    discard(firsts)
    return out


def _roots(nodes: DataFrame, cells: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes (_key, _least, _root) with their _root over all links within cells (_cell, _key, _n, _sketch, _root). In each round a few
    rows of each cell are compared with all its others that are not yet known to be connected, and leave the cell; cells that are
    one component are done. Rows of a cell's smallest components come first, so that a few strays among many copies end in one
    round. A round joins components, not rows: its links are edges between the roots so far."""
    old = cells
    # For two sets, the hashes of one alone are at most a ninth of all if the similarity is 0.8 or more.
    apart = sum((F.bit_count(F.col("_sketch")[i].bitwiseXOR(F.col("_sa")[i])) for i in range(1, SKETCH)), F.bit_count(F.col("_sketch")[0].bitwiseXOR(F.col("_sa")[0])))
    near = (5 * F.least("_n", "_na") >= 4 * F.greatest("_n", "_na")) & (9 * apart <= F.col("_n") + F.col("_na"))
    whole, own = Window.partitionBy("_cell"), Window.partitionBy("_cell", "_root")
    centres = CENTRES
    while True:
        open_ = cells.withColumns({"_low": F.min("_root").over(whole), "_high": F.max("_root").over(whole)}).where("_low <> _high").drop("_low", "_high")
        ranked = keep(open_.withColumn("_many", F.count(F.lit(1)).over(own)).withColumn("_rank", F.row_number().over(whole.orderBy("_many", "_key"))).drop("_many"), "ranked")
        discard(old, cells)
        if ranked.isEmpty():
            discard(ranked)
            return nodes
        first = ranked.where(F.col("_rank") <= centres).select("_cell", F.col("_key").alias("a"), F.col("_n").alias("_na"), F.col("_sketch").alias("_sa"), F.col("_root").alias("_ra"), F.col("_rank").alias("_ka"))
        met = ranked.join(first, "_cell").where("_ka < _rank AND _ra <> _root").where(near)
        ends = [F.struct("a", "_ra"), F.struct(F.col("_key").alias("a"), F.col("_root").alias("_ra"))]
        met = met.select(F.least(*ends).alias("_u"), F.greatest(*ends).alias("_v"))
        pairs = keep(met.select(F.col("_u.a").alias("u"), F.col("_v.a").alias("v"), F.col("_u._ra").alias("_ru"), F.col("_v._ra").alias("_rv")).distinct(), "pairs")
        links = keep(_verified(pairs, sets), "links")
        rest = ranked.where(F.col("_rank") > centres).drop("_rank")
        if links.isEmpty():
            cells = keep(rest, "cells")
        else:
            roots, before = keep(components(links), "roots"), nodes
            nodes, cells = keep(_moved(nodes, roots), "nodes"), keep(_moved(rest, roots), "cells")
            discard(roots, before)
        discard(pairs, links, ranked)
        centres *= MORE


def near_copies(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id and component_id, the smallest doc_id that is reached over links, its own included.
    Texts without words are copies of each other. Rows without id take part; a component without ids has none for a name."""
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), "text")
    rows = keep(_signatures(texts), "signatures")
    # Equal sets are one node from here on.
    nodes = keep(rows.groupBy("_key").agg(F.min("doc_id").alias("_least"), F.min("_text").alias("_text"), F.min("_n").alias("_n"), F.min("_fp").alias("_fp"), F.min("_sketch").alias("_sketch"), F.min("_cells").alias("_cells")), "nodes")
    cells = nodes.select("_key", "_n", "_sketch", F.explode("_cells").alias("_cell"))
    shared = nodes.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1").select("_cell")
    cells = cells.join(shared, "_cell").select("_cell", "_key", "_n", "_sketch", F.col("_key").alias("_root"))
    candidates = _candidates(nodes)
    ends = candidates.select(F.explode(F.array("u", "v")).alias("_key"))
    cells = keep(cells, "cells")
    wanted = nodes.join(cells.select("_key").unionByName(ends).distinct(), "_key", "left_semi").select("_key", "_text")
    single = texts.groupBy("_text").agg(F.first("text").alias("text"))
    sets = keep(_sets(single.join(wanted, "_text").select("_key", "text")), "sets")
    near = keep(_verified(candidates.withColumns({"_ru": F.col("u"), "_rv": F.col("v")}), sets), "near")
    roots = keep(components(near), "roots")
    joined = keep(_moved(nodes.select("_key", "_least", F.col("_key").alias("_root")), roots), "joined")
    moved = keep(_moved(cells, roots), "cells")
    discard(cells, candidates, near, roots)
    named = _roots(joined, moved, sets)
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = keep(named.join(least, "_root").select("_key", "component_id"), "classes")
    discard(nodes, sets, named)
    return rows.select("doc_id", "_key").join(classes, "_key").select("doc_id", "component_id")
