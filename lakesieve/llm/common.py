"""What the operators of this subpackage share: column picking, shared tables, prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that part words, as Java and Python regular expressions write them.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, to strip with btrim.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name and position, so that extra columns of clashing names do no harm."""
    places = {}
    for i, c in enumerate(df.columns):
        places.setdefault(c, i)
    if missing := [n for n in names if n not in places]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns)))).select(*(F.col(f"_c{places[n]}").alias(n) for n in names))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where it is unset and all runs on one machine (tests) a folder of
    our own; on a cluster that names none this raises."""
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lakesieve-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as a table in the shared folder and read back: this cuts the lineage, survives lost executors
    and gives the planner real sizes."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that keep() wrote and nothing needs any more."""
    for df in frames:
        if path := getattr(df, "_kept_path", None):
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch the worker gives free memory back to the system. Workers outlive their stages, and what their
    allocators hold on to would add up with the memory of the stages to come."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
            trim(0)

    return whole


def words_in(text: Column) -> Column:
    """The number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def with_start(df: DataFrame, order: list[str], value: str, start: str) -> DataFrame:
    """Adds the sum of `value` over all rows before each row in the given order, without one task seeing all rows:
    rows are dealt by ranges, each range is summed, and only the sums of the ranges meet."""
    from pyspark.sql import Window

    dealt = keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # One row for each partition: as many as the job has range partitions, whatever the input.
    base = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn(start, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(base), "_range").withColumn(start, (F.col(start) + F.col("_base")).cast("long")).drop("_range", "_base")
