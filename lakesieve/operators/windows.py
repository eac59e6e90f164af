"""Operators that look across neighbouring records: contexts, cell blocks, sliding windows, protected neighbours, and the
projection of what is found in a block back onto its records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesieve import fixed
from lakesieve.functions.spans import SPANS, matches, none
from lakesieve.operators.addresses import found_addresses

_SEGMENT = "array<struct<record_id:string,ord:bigint,start:int,end:int>>"


def with_context(records: DataFrame, chars: int = 200) -> DataFrame:
    """Adds before and after: the end of the previous and the beginning of the next record of the document."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    return records.withColumns({"before": F.coalesce(F.right(F.lag("text").over(order), F.lit(chars)), F.lit("")), "after": F.coalesce(F.left(F.lead("text").over(order), F.lit(chars)), F.lit(""))})


def _joined(parts: str) -> dict:
    """text and segments of an array of (ord, record_id, text)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SEGMENT).alias("s"))
    step = lambda a, r: F.struct((a["at"] + F.length(r["text"]) + 1).alias("at"), F.concat(a["s"], F.array(F.struct(r["record_id"].alias("record_id"), r["ord"].alias("ord"), a["at"].alias("start"), (a["at"] + F.length(r["text"])).alias("end")))).alias("s"))
    return {"text": F.array_join(F.transform(parts, lambda r: r["text"]), "\n"), "segments": F.aggregate(parts, start, step, lambda a: a["s"])}


def cell_blocks(records: DataFrame) -> DataFrame:
    """doc_id, block_id, text, segments, column_header: the records of each table cell, joined by line feeds."""
    rows = records.where("cell_key IS NOT NULL").groupBy("doc_id", F.col("cell_key").alias("block_id")).agg(F.sort_array(F.collect_list(F.struct("ord", "record_id", "text"))).alias("r"), F.min_by("column_header", "ord").alias("column_header"))
    return rows.withColumns(_joined("r")).select("doc_id", "block_id", "text", "segments", "column_header")


def body_windows(records: DataFrame, size: int = 6, part: str = "word/document.xml") -> DataFrame:
    """The same for every run of `size` records of the main part outside of tables, the last ones shorter, two at least."""
    body = records.where((F.col("part_name") == part) & F.col("cell_key").isNull())
    order = Window.partitionBy("doc_id").orderBy("ord")
    rows = body.select("doc_id", (F.row_number().over(order) - 1).alias("n"), F.collect_list(F.struct("ord", "record_id", "text")).over(order.rowsBetween(0, size - 1)).alias("r")).where(F.size("r") >= 2)
    return rows.withColumns(_joined("r")).select("doc_id", F.format_string("body:%06d", "n").alias("block_id"), "text", "segments", F.lit(None).cast("string").alias("column_header"))


def project(blocks: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """A span of a block as one row for each record that it touches, in that record's offsets, with segment index and count."""
    touched = F.filter("segments", lambda s: (s["start"] < F.col(end)) & (F.col(start) < s["end"]))
    local = F.transform(touched, lambda s, i: F.struct(s["record_id"].alias("record_id"), s["ord"].alias("ord"), (F.greatest(s["start"], F.col(start)) - s["start"]).alias("start"), (F.least(s["end"], F.col(end)) - s["start"]).alias("end"), i.alias("index"), F.size(touched).alias("count")))
    rest = [c for c in blocks.columns if c not in (start, end, "segments")]
    return blocks.select(*rest, F.explode(local).alias("_p")).select(*rest, "_p.*")


def protected(records: DataFrame, follow: int = 3, from_paragraph: int = 0) -> DataFrame:
    """doc_id, record_id of records that name a regulator or registrar, and of the next ones in the same part: their addresses
    are public."""
    paragraph = F.coalesce(F.regexp_extract("record_id", r":p(\d+)$", 1).try_cast("int"), F.lit(-1))
    flag = (matches(F.col("text"), fixed.PROTECTED_BODY) & (paragraph >= from_paragraph)).cast("int")
    near = F.max(flag).over(Window.partitionBy("doc_id", "part_name").orderBy("ord").rowsBetween(-follow, 0))
    return records.withColumn("_near", near).where("_near = 1").select("doc_id", "record_id")


def block_addresses(records: DataFrame, protected_from: int = 0) -> DataFrame:
    """Addresses that go over several records, as spans of those records: doc_id, record_id, found.

    Three passes, cells, windows of six, windows of three (these for ZIP codes alone); where a later find meets an earlier one
    in a record, the later one stays. Finds that touch a protected record, or one record alone, are left out.
    """
    passes = []
    for n, (blocks, only) in enumerate(((cell_blocks(records), None), (body_windows(records, 6), None), (body_windows(records, 3), "us_address"))):
        found = blocks.withColumn("a", F.explode(found_addresses(F.col("text"), F.col("column_header"))))
        if only:
            found = found.where(F.col("a.method") == only)
        passes.append(found.select("doc_id", F.lit(n).alias("pass"), "block_id", F.col("text").alias("block_text"), "segments", F.col("a.start").alias("start"), F.col("a.end").alias("end"), F.col("a.confidence").alias("confidence"), F.col("a.method").alias("method")))
    spans = passes[0].unionByName(passes[1]).unionByName(passes[2]).withColumn("canonical", F.substring("block_text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("block_text")
    spans = spans.withColumn("_span", F.struct("pass", "block_id", "start", "end", "method"))
    local = project(spans).where("count > 1")
    barred = local.join(protected(records, from_paragraph=protected_from), ["doc_id", "record_id"], "left_semi").select("doc_id", "_span").distinct()
    local = local.join(barred, ["doc_id", "_span"], "left_anti").join(records.select("doc_id", "record_id", F.col("text").alias("record_text")), ["doc_id", "record_id"])
    span = F.struct(
        "start", "end", F.lit("POSTAL_ADDRESS").alias("pii_type"), F.substring("record_text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), F.lit("address_block").alias("detector"), "confidence",
        F.lit(fixed.PRIORITIES["POSTAL_ADDRESS"]).alias("priority"),
        F.create_map(F.lit("method"), "method", F.lit("canonical"), "canonical", F.lit("block_id"), "block_id", F.lit("block_segment_index"), F.col("index").cast("string"), F.lit("block_segment_count"), F.col("count").cast("string")).alias("metadata"),
    )
    last_first = F.reverse(F.array_sort(F.collect_list(F.struct("pass", "block_id", F.col("_span.start").alias("at"), F.struct(F.col("_span.end"), "confidence").alias("z"), span.alias("s"))), lambda x, y: F.when(x["pass"] < y["pass"], -1).when(x["pass"] > y["pass"], 1).when(x["block_id"] < y["block_id"], -1).when(x["block_id"] > y["block_id"], 1).when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0)))
    grouped = local.groupBy("doc_id", "record_id").agg(last_first.alias("_finds"))
    free = lambda acc, s: ~F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    kept = F.aggregate(F.transform("_finds", lambda x: x["s"]).cast(SPANS), none(), lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    return grouped.select("doc_id", "record_id", kept.alias("found"))


def with_block_addresses(records: DataFrame, protected_from: int = 0, to: str = "candidates") -> DataFrame:
    """records whose address candidates give way to those of blocks where they overlap."""
    found = block_addresses(records, protected_from)
    joined = records.join(found, ["doc_id", "record_id"], "left")
    stay = F.filter(to, lambda s: (s["pii_type"] != "POSTAL_ADDRESS") | ~F.exists(F.coalesce("found", none()), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return joined.withColumn(to, F.concat(stay, F.coalesce("found", none()))).drop("found")
