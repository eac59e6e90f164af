"""Line dedup [native]: all occurrences of lines, dealt by ranges of their hash and sorted by hash, document and position, are streamed;
the first occurrence of a key names the one document that keeps it, and each document gets a compressed bitmap of the lines that
it keeps, not a new text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesieve.llm.common import LOWER, UPPER, WHITE, keep, lower_ascii, pick, read

#: A document without an id counts as one smaller than all.
_NO_ID = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), F.xxhash64("text").alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))


def line_table(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row for each line whose key is long enough: document, row hash, position, two 64-bit hashes of the key."""
    lines = _keyed(docs).select("_id", "_row", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    keyed = lines.withColumn("_key", lower_ascii(F.btrim("_line", F.lit(WHITE)))).where(F.char_length("_key") >= min_chars)
    return keyed.select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """For each row that loses lines: _id, _row and its bitmap, an array of (word, bits) in order. A set bit is a line that stays;
    words of 64 lines that all stay are absent.

    A line's key is the line stripped of white space with A-Z lower-cased. A key of `min_chars` code points or more found in
    `min_docs` documents or more stays only in the largest doc_id that holds it. Null and empty texts are one empty line.
    Rows of one doc_id are one document; rows alike in id and text share a bitmap. No rows give no bitmaps.

    The ranges are cut by hash, document and position, so a key in a third of all documents is spread over many of them.
    """
    lines = keep(line_table(docs, min_chars), "lines")
    order = ["_h1", "_h2", F.desc("_id"), "_row", "_pos"]
    ranged = keep(lines.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    key = ["_h1", "_h2"]
    run = Window.partitionBy("_range", *key)
    stream = run.orderBy(F.desc("_id"), "_row", "_pos")
    new = F.coalesce(F.lag("_id").over(stream) != F.col("_id"), F.lit(True)).cast("long")
    met = ranged.withColumns({"_keeper": F.first("_id").over(stream), "_new": new}).withColumn("_docs", F.sum("_new").over(run))
    # Only the first and the last key of a range can go on in others: two rows for each range, whatever the input.
    ends = ranged.groupBy("_range").agg(F.min(F.struct(*key)).alias("_low"), F.max(F.struct(*key)).alias("_high"))
    cut = keep(ends.select(F.explode(F.array("_low", "_high")).alias("_k")).select("_k.*").distinct(), "cut")
    parts = ranged.join(F.broadcast(cut), key, "left_semi").select(*key, "_id").distinct()
    whole = keep(parts.groupBy(*key).agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_all")), "whole")
    told = met.join(F.broadcast(whole), key, "left").withColumns({"_keeper": F.coalesce("_first", "_keeper"), "_docs": F.coalesce("_all", "_docs")})
    lost = told.where((F.col("_docs") >= min_docs) & (F.col("_id") != F.col("_keeper")))
    words = lost.groupBy("_id", "_row", F.expr("_pos div 64").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, _pos % 64)"))).alias("bits"))
    return words.groupBy("_id", "_row").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("_words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All rows of docs with text replaced by the kept lines, and n_lines (before) and n_dropped; no other column changes."""
    names = docs.columns
    held = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    doc_id, text = (f"_c{names.index(c)}" for c in ("doc_id", "text"))
    held = held.withColumns({"_id": F.coalesce(doc_id, F.lit(_NO_ID)), "_row": F.xxhash64(text)})
    joined = held.join(bitmaps, ["_id", "_row"], "left").withColumn("_bits", F.map_from_entries("_words"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: F.coalesce(F.try_element_at("_bits", F.floor(i / 64).cast("int")), F.lit(-1)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) != 0), "\n")
    dropped = F.aggregate("_words", F.lit(0).cast("long"), lambda s, w: s + 64 - F.bit_count(w["bits"]))
    lines = F.coalesce(F.size(F.split(text, "\n")).cast("long"), F.lit(1).cast("long"))
    out = joined.select(*(F.col(f"_c{i}").alias(f"_c{i}") if c != "text" else F.when(F.col("_words").isNull(), F.col(text)).otherwise(kept).alias(text) for i, c in enumerate(names)), F.when(F.col(text).isNull(), F.lit(1)).otherwise(lines).cast("long").alias("_n_lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("_n_dropped"))
    return out.toDF(*names, "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs without the repeated lines, with n_lines and n_dropped."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(pick(read(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id <> g.keeper AS lost FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
