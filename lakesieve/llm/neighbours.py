"""Approximate nearest neighbours by multiprobe p-stable hashing: vectors of unit length fall into buckets of Gaussian
projections; a query visits perturbed buckets in the order of their estimated success, and the candidates of all tables are
merged and ranked by exact distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesieve.llm.common import discard, keep, pick, read

#: Tables, projections of a table, width of a bucket in standard deviations of a projection, and buckets that a query visits
#: in each table. Measured: see the README.
TABLES, HASHES, WIDTH, PROBES = 3, 6, 1.7, 224
#: Components of the vectors that meet in one group. Buckets are dealt to as many regions as the vectors need, a query is sent to
#: a region once with all buckets that it visits there, and regions with more vectors are cut into parts, which it visits all.
PART = 1 << 20
#: Queries that are ranked at once.
ASKED = 256


def _projections(dims: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The same random projections and offsets everywhere: a seeded generator makes them from the sizes alone. A unit vector
    has projections of variance 1."""
    draw = np.random.default_rng([dims, tables, hashes])
    return draw.standard_normal((tables, dims, hashes)), draw.uniform(0, width, (tables, 1, hashes))


def _codes(cells: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of bucket coordinates."""
    code = np.full(cells.shape[:-1], 1469598103934665603, np.uint64)
    for j in range(cells.shape[-1]):
        code = (code ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(1099511628211)
        code ^= code >> np.uint64(31)
    return code.view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def buckets(vectors: np.ndarray, tables: int, hashes: int, width: float) -> np.ndarray:
    """tables x rows: each vector's bucket."""
    a, b = _projections(vectors.shape[1], tables, hashes, width)
    return _codes(np.floor((_unit(vectors) @ a + b) / width))


def probes(vectors: np.ndarray, tables: int, hashes: int, width: float, visits: int) -> np.ndarray:
    """tables x rows x visits: the buckets that a query visits. A perturbation takes some coordinates one step down or up; the
    squared distances to the borders that it crosses add up to its score, and low scores come first."""
    a, b = _projections(vectors.shape[1], tables, hashes, width)
    at = (_unit(vectors) @ a + b) / width
    cell = np.floor(at)
    inside = at - cell
    steps = np.array(list(product((-1, 0, 1), repeat=hashes)), np.int64)
    visits = min(visits, len(steps))
    out = np.empty((tables, len(vectors), visits), np.int64)
    for t in range(tables):
        for i in range(0, len(vectors), 256):
            x = inside[t, i : i + 256]
            score = (x**2) @ (steps == -1).T + ((1 - x) ** 2) @ (steps == 1).T
            first = np.argsort(score, axis=1, kind="stable")[:, :visits]
            out[t, i : i + 256] = _codes(cell[t, i : i + 256, None, :] + steps[first])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows have equal results wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0))


def _by_length(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of the batches (cls, embedding) of at most so many rows, the vectors of one length each, with that length."""
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            b = whole.slice(i, rows)
            lengths = pc.list_value_length(b.column(1))
            for d in pc.unique(lengths).to_pylist():
                yield d, b.filter(pc.equal(lengths, d))


def _nearest_of(k: int):  # noqa: ANN202
    """For one part of a region, the k + 1 best classes among the visited buckets for each query."""

    def rank(have: pa.Table, ask: pa.Table) -> pa.Table:
        if not have.num_rows or not ask.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        v, ids = _matrix(have.column("embedding")), have.column("cls").to_numpy()
        kinds, kind = np.unique(have.column("bucket").to_numpy(), return_inverse=True)
        unit, asks, out = _unit(v).T, [], []
        for i in range(0, ask.num_rows, ASKED):
            some = ask.slice(i, ASKED).combine_chunks()
            q, lists = _matrix(some.column("embedding")), some.column("buckets").combine_chunks()
            codes, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy())
            at = np.minimum(np.searchsorted(kinds, codes), len(kinds) - 1)
            visited = np.zeros((len(q), len(kinds)), bool)
            visited[of[kinds[at] == codes], at[kinds[at] == codes]] = True
            rough = np.where(visited[:, kind], _unit(q) @ unit, -np.inf)
            n = min(k + 1, rough.shape[1])
            limit = np.partition(rough, -n, axis=1)[:, -n] - 1e-9  # what rounding could bring in stays
            a, c = np.nonzero((rough >= limit[:, None]) & (rough > -np.inf))
            asks.append(some.column("cls").to_numpy()[a])
            out.append((ids[c], cosine(q[a], v[c])))
        found, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"q": np.concatenate(asks), "cls": found, "score": score})

    return rank


def nearest(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, visits: int = PROBES) -> DataFrame:
    """vectors: vec_id, embedding. For each query row its k nearest found by largest cosine: query_id, rank (from 1), vec_id,
    score; ties go to the smaller vec_id, and a query is no neighbour of itself.

    Vectors that are null, zero or hold null or non-finite components take no part. Vectors of different lengths have no cosine,
    so each length is searched apart. A query that finds fewer than k in the buckets is ranked against all vectors of its
    length, so it has fewer answers only where there are fewer candidates. Equal vectors are one class in the search, of which
    only the k + 1 smallest ids can be among the answers; so a vector with very many copies is searched, and found, once. Rows
    with an id of their own each are expected; repeated ids are repeated rows. No rows give no rows, and other columns, of
    whatever name, are left aside.
    """
    rows = keep(_usable(pick(vectors, "vec_id", "embedding")), "vectors")
    order = Window.partitionBy("embedding").orderBy("vec_id")
    # The limit on the rank is pushed below the shuffle: a task sends on at most k + 1 rows of a class.
    few = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    classes = keep(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids", "embedding"), "classes")
    asked = rows.where(is_query)
    asking = keep(asked.select("embedding").distinct().join(classes, "embedding").select("cls", "embedding"), "asking")
    regions = max(1, -(-(classes.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0) // PART))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b in _by_length(batches, 4096):
            code = buckets(_matrix(b.column(1)), tables, hashes, width)
            for t in range(tables):
                yield pa.record_batch({"dims": pa.array(np.full(b.num_rows, d, np.int32)), "tab": pa.array(np.full(b.num_rows, t, np.int32)), "region": pa.array(code[t] % regions), "bucket": pa.array(code[t]), "cls": b.column(0), "embedding": b.column(1)})

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b in _by_length(batches, 512):
            code = probes(_matrix(b.column(1)), tables, hashes, width, visits)
            for t in range(tables):
                region = code[t] % regions
                order = np.argsort(region, axis=1, kind="stable")
                region, sent = np.take_along_axis(region, order, 1).ravel(), np.take_along_axis(code[t], order, 1).ravel()
                first = np.ones(region.size, bool)
                first[1:] = (region[1:] != region[:-1]) | (np.arange(1, region.size) % code.shape[2] == 0)
                starts = np.nonzero(first)[0]
                own = pa.array(starts // code.shape[2])
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, region.size).astype(np.int32)), pa.array(sent))
                yield pa.record_batch({"dims": pa.array(np.full(len(starts), d, np.int32)), "tab": pa.array(np.full(len(starts), t, np.int32)), "region": pa.array(region[starts]), "buckets": lists, "cls": b.column(0).take(own), "embedding": b.column(1).take(own)})

    def search(indexed: DataFrame, visited: DataFrame) -> DataFrame:
        """q and the score and ids of what it found, the k + 1 best classes' ids in order."""
        where = ["dims", "tab", "region"]
        sizes = keep(indexed.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) * F.col("dims") / PART).cast("int").alias("parts")), "sizes")
        left = indexed.join(sizes, where).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).select(*where, "part", "bucket", "cls", "embedding")
        right = visited.join(sizes, where).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*where, "part", "buckets", "cls", "embedding")
        found = left.groupBy(*where, "part").cogroup(right.groupBy(*where, "part")).applyInArrow(_nearest_of(k), "q long, cls long, score double")
        best = found.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))).where(F.col("_r") <= k + 1)
        named = best.join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
        return keep(named.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))).alias("found")), "answers")

    kind = dict(classes.dtypes)["embedding"]
    place = "dims int, tab int, region long"
    indexed = keep(classes.select("cls", "embedding").mapInArrow(index, f"{place}, bucket long, cls long, embedding {kind}"), "index")
    answers = search(indexed, asking.mapInArrow(visit, f"{place}, buckets array<long>, cls long, embedding {kind}"))
    lacking = keep(asking.join(answers.where(F.size("found") > k).select(F.col("q").alias("cls")), "cls", "left_anti"), "lacking")
    if not lacking.isEmpty():
        # All vectors as one bucket, dealt to parts: each query meets each vector of its length once.
        one = {"dims": F.size("embedding"), "tab": F.lit(0), "region": F.lit(0).cast("long")}
        exact = search(classes.select("cls", "embedding").withColumns(one | {"bucket": F.lit(0).cast("long")}), lacking.withColumns(one | {"buckets": F.array(F.lit(0).cast("long"))}))
        answers = answers.join(lacking.select(F.col("cls").alias("q")), "q", "left_anti").unionByName(exact)
    who = keep(asked.join(classes.select(F.col("cls").alias("q"), "embedding"), "embedding").select("q", F.col("vec_id").alias("query_id")), "who")
    discard(rows, classes, asking, indexed)
    each = who.join(answers, "q").select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("_at", "_x"))
    return each.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_x.vec_id").alias("vec_id"), (-F.col("_x.low")).alias("score"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
