"""Mixing sources to target weights: thresholds on a hash of each document, found from histograms of words by source and
hash bucket; only the bucket that holds the threshold is refined, and documents are then filtered without a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesieve.llm.common import keep, pick, read, words_in

#: Bits of the document hash, and of each level of the histogram.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 12, 3
#: A source with more than 1 / HOT of all documents is hot; so there are at most HOT, and their list is safe to broadcast.
HOT = 1000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target words of each source: sources by code point, null last, take the weights in turn and share `share` times all
    words; no target is above `most` times its source's words, and what is over is shared again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    while open_ := [s for s in names if s not in out]:
        rate = (share * sum(sizes.values()) - sum(out.values())) / sum(weight[s] for s in open_)
        if over := [s for s in open_ if rate * weight[s] > most * sizes[s]]:
            out |= {s: most * float(sizes[s]) for s in over}
        else:
            out |= {s: rate * weight[s] for s in open_}
    return out


def _hash(doc_id: Column, text: Column) -> Column:
    """60 bits that depend on id and text alone: reruns agree, and rows alike are taken alike."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(6), doc_id, text), 64 - HASH_BITS)


def _with_source(rows: DataFrame, table: DataFrame, hot: list[str | None]) -> DataFrame:
    """rows joined with a table of sources (_s): hot sources go to every task, so their rows stay where they are; the rows of
    others, none of which is large, are joined by source."""
    here = lambda c: F.lit(False) if not hot else F.coalesce(F.col(c).isin([s for s in hot if s is not None]), F.lit(None in hot))
    same = F.col("source").eqNullSafe(F.col("_s"))
    near = rows.where(here("source")).join(F.broadcast(table.where(here("_s"))), same)
    return near.unionByName(rows.where(~here("source")).join(table.where(~here("_s")), same))


def thresholds(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame, list[str | None]]:
    """One row for each source: source, source_size, target, _base (times that all its documents are taken) and _cut
    (documents whose hash is below it are taken once more); the table of sizes, read from the texts once; and the hot sources.

    What comes to the driver is one row for each source and level, not of documents.
    """
    spark = docs.sparkSession
    sized = keep(pick(docs, "doc_id", "text", "source").select("doc_id", "source", words_in(F.col("text")).alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("_u")), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["source"]: r["size"] or 0 for r in found}
    hot = [r["source"] for r in found if r["n"] * HOT > sum(x["n"] for x in found)]
    target = targets(sizes, weights, share, most)
    base = {s: int(target[s] // sizes[s]) if sizes[s] else 0 for s in sizes}
    left = {s: target[s] - base[s] * sizes[s] for s in sizes}
    full = {s for s in sizes if base[s] >= most}  # no document is taken once more, also none without words
    whole: set[str | None] = set()
    known = {s: 0 for s in sizes}  # the leading bits of each source's threshold
    for level in range(LEVELS):
        low = HASH_BITS - LEVEL_BITS * (level + 1)
        rows = sized
        if level:
            at = spark.createDataFrame([(s, known[s]) for s in sizes], "_s string, _known long")
            rows = _with_source(sized, at, hot).where(F.shiftright("_u", low + LEVEL_BITS) == F.col("_known"))
        found = rows.groupBy("source", (F.shiftright("_u", low) % (1 << LEVEL_BITS)).alias("_digit")).agg(F.sum("size").alias("_words"))
        upto = Window.partitionBy("source").orderBy("_digit")
        limit = spark.createDataFrame([(s, left[s]) for s in sizes], "_s string, _left double")
        below = _with_source(found.withColumn("_upto", F.sum("_words").over(upto)), limit, hot)
        # The bucket of the threshold is the first that goes over.
        ends = below.groupBy("source").agg(F.min(F.when(F.col("_upto") > F.col("_left"), F.struct("_digit", "_upto", "_words"))).alias("_over"))
        over = {r["source"]: r["_over"] for r in ends.collect()}
        for s in sizes:
            o = over.get(s)
            if s in whole or o is None:
                whole.add(s)  # only at the first level: nothing goes over, every document is below the threshold
                known[s] = 1 << (LEVEL_BITS * (level + 1))
                continue
            left[s] -= o["_upto"] - o["_words"]
            known[s] = (known[s] << LEVEL_BITS) + o["_digit"]
            if level == LEVELS - 1 and o["_words"] - left[s] < left[s]:
                known[s] += 1  # the last bucket goes to the nearer side
    shift = HASH_BITS - LEVEL_BITS * LEVELS
    found = spark.createDataFrame([(s, sizes[s], target[s], base[s], 0 if s in full else known[s] << shift) for s in sizes], "_s string, source_size long, target double, _base int, _cut long")
    return found, sized, hot


def _taken(rows: DataFrame, found: DataFrame, hot: list[str | None]) -> DataFrame:
    return _with_source(rows, found, hot).withColumn("copies", F.col("_base") + (F.col("_u") < F.col("_cut")).cast("int")).drop("_s", "_u", "_base", "_cut")


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken (copies times size).

    Null texts and texts without words have size 0 and change no source's words. Rows alike in id and text are taken alike. No
    rows give no rows, and other columns, of whatever name, are left aside.
    """
    found, sized, hot = thresholds(docs, **how)
    return _taken(sized, found, hot).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it (at most twice), with the columns of docs. No rows give
    no rows; repeated rows are rows of their own each; null texts, ids and sources are values like any other."""
    names = docs.columns
    found, _, hot = thresholds(docs, **how)
    held = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    doc_id, text, source = (F.col(f"_c{names.index(c)}") for c in ("doc_id", "text", "source"))
    rows = _taken(held.select("*", source.alias("source"), _hash(doc_id, text).alias("_u")), found, hot).where("copies > 0")
    copied = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select(*(f"_c{i}" for i in range(len(names)))).toDF(*names)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
