"""Tables of text, JSON lines and resource lists as sources; audits and mappings as sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_ROWS = "record_id string, part string, start int, end int, type string, text string, stratum string"
AUDIT_ROWS = "media_path string, reasons array<string>, source_sha256 string, occurrences int, category string, sensitive boolean"


def text_records(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Records of any text table: one for each line, with the columns that the operators know."""
    lines = df.select(F.col(key).cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_n", "text"))
    none = lambda kind: F.lit(None).cast(kind)
    return lines.select(
        "doc_id", F.format_string("%s:p%06d", "doc_id", "_n").alias("record_id"), F.lit("text").alias("part_name"), F.col("_n").cast("long").alias("ord"), "text", none("string").alias("cell_key"),
        none("array<string>").alias("table_headers"), none("string").alias("column_header"), F.array().cast("array<struct<start:int,end:int>>").alias("boundaries"),
    )


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Gold or predicted spans from JSON lines, with seq, their order in the file as far as the reader keeps it."""
    return spark.read.schema(SPAN_ROWS).json(path).withColumnRenamed("type", "pii_type").withColumn("seq", F.monotonically_increasing_id())


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A picture gold standard or audit: one JSON array."""
    return spark.read.schema(AUDIT_ROWS).option("multiLine", True).json(path)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """term: the lines of a list; empty lines and those that begin with # are none."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> '' AND NOT startswith(term, '#')")


def detections(resolved: DataFrame) -> DataFrame:
    """The audit rows of a run, in the shape of its JSON lines."""
    return resolved.select(
        "record_id", F.col("part_name").alias("part"), "start", "end", F.col("pii_type").alias("type"), "text", "detector", F.round("confidence", 4).alias("confidence"), "priority", "metadata", "replacement",
    )


def mapping(resolved: DataFrame) -> DataFrame:
    """type, original, replacement, canonical: each pair once."""
    return resolved.select(F.col("pii_type").alias("type"), F.col("text").alias("original"), "replacement", "canonical").distinct()


def write_detections(resolved: DataFrame, path: str) -> None:
    detections(resolved).write.json(path)


def write_mapping(resolved: DataFrame, path: str) -> None:
    """Sorted by type and original; the sort is a range exchange, the files follow each other."""
    mapping(resolved).orderBy("type", F.lower("original"), "original").write.json(path)


def write_images(audit: DataFrame, path: str) -> None:
    audit.select("media_path", "reasons", "source_sha256", "occurrences").write.json(path)
