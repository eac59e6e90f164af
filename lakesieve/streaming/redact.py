"""Records as a stream: detection is stateless; the substitutes are the one state, kept as a table that each batch adds to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.config import Config
from lakesieve.functions.spans import rebuild
from lakesieve.operators import surrogates
from lakesieve.plans.redactor import arbitrate, candidates, spans_of

MEMO = "pii_type string, canonical string, base string"


def detect_stream(spark: SparkSession, path: str, schema: str, config: Config = Config()) -> DataFrame:
    """A stream of records (doc_id, record_id, part_name, ord, text) under a path, with their resolved spans. Records that come
    twice within a day are taken once."""
    records = spark.readStream.schema(schema).parquet(path).withColumn("_seen", F.current_timestamp())
    once = records.withWatermark("_seen", "1 day").dropDuplicatesWithinWatermark(["doc_id", "record_id"]).drop("_seen")
    return arbitrate(candidates(once, config), config)


def redact_stream(spark: SparkSession, source: str, schema: str, output: str, memo: str, checkpoint: str, config: Config = Config()):  # noqa: ANN201
    """Writes redacted records under `output`. Values that the memo table knows keep their substitutes; new ones get theirs from
    a hash of their own, with the batch's number in it, and join the memo. A batch that runs again overwrites its own rows."""

    def batch(rows: DataFrame, n: int) -> None:
        session = rows.sparkSession
        rows = rows.persist()
        try:
            named = spans_of(rows).withColumn("canonical", surrogates.canonical(F.col("pii_type"), F.col("text"), F.try_element_at("metadata", F.lit("canonical"))))
            try:
                known = session.read.schema(MEMO + ", batch long").parquet(memo).where(F.col("batch") != n).drop("batch")
            except Exception as e:  # the first batch has no table to read
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                known = session.createDataFrame([], MEMO)
            values = named.groupBy("pii_type", "canonical").agg(F.min("text").alias("_sample")).join(known.select("pii_type", "canonical"), ["pii_type", "canonical"], "left_anti")
            taken = known.groupBy("pii_type").agg(F.count(F.lit(1)).alias("_taken"))
            new = surrogates.numbered(values, config.seed).join(taken, "pii_type", "left").withColumn("_nth", F.col("_nth") + F.coalesce("_taken", F.lit(0)))
            new = new.withColumn("base", surrogates.base_value(F.col("pii_type"), F.col("canonical"), F.col("_nth"), F.col("_hash"), F.col("_sample"), config.seed)).select("pii_type", "canonical", "base")
            new.write.mode("overwrite").parquet(f"{memo}/batch={n}")
            bases = known.unionByName(session.read.schema(MEMO).parquet(f"{memo}/batch={n}"))
            found = named.join(bases, ["pii_type", "canonical"]).withColumn("replacement", surrogates.surface(F.col("pii_type"), F.col("text"), F.col("canonical"), F.col("base"), F.col("metadata")))
            per = found.groupBy("doc_id", "record_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("_r"))
            done = rows.select("doc_id", "record_id", "ord", "text").join(per, ["doc_id", "record_id"], "left")
            done.select("doc_id", "record_id", "ord", F.when(F.col("_r").isNull(), F.col("text")).otherwise(rebuild(F.col("text"), F.col("_r"))).alias("text")).write.mode("overwrite").parquet(f"{output}/batch={n}")
        finally:
            rows.unpersist()

    return detect_stream(spark, source, schema, config).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
