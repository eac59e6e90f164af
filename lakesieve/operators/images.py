"""Pictures: which are sensitive, by their own text, by the text near them, or by likeness to another; and what replaces them.

Character recognition and code reading are plugged in: a table of pictures brings ocr_text and has_qr if it has them.
"""

from __future__ import annotations

import io
import zlib
from struct import pack

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve import fixed
from lakesieve.functions.spans import matches


def is_identity(ocr_text: Column) -> Column:
    """The text of an identity document: its usual words, or a number in the shape of one."""
    plain = F.regexp_replace(F.coalesce(ocr_text, F.lit("")), r"(?U)\s+", " ")
    return matches(plain, fixed.IDENTITY_MARKERS) | matches(plain, fixed.IDENTITY_PAN) | matches(plain, fixed.IDENTITY_AADHAAR, False)


def words(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def plain(value: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def text_reasons(images: DataFrame, companies: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, media_path, reason: party-context (a company in the text near), party-image (a distinctive word of one in the
    picture), detected-pii-in-image (another found value of five characters or more in it). Pictures and names meet on the
    document and a word that both have."""
    near = images.withColumns({"_near": plain(F.concat_ws("\n", "nearby_text", "description")), "_ocr": plain(F.col("ocr_text"))})
    names = companies.select("doc_id", F.col("canonical").alias("company"), plain(F.col("canonical")).alias("_name"), F.filter(words(F.col("canonical")), lambda w: (F.length(w) >= 4) & ~w.isin(*fixed.GENERIC_COMPANY_TOKENS)).alias("_rare")).where("_name <> ''").distinct()
    in_context = near.select("doc_id", "media_path", "_near", F.explode(F.array_distinct(F.split("_near", " "))).alias("_w")).join(names.withColumn("_w", F.split("_name", " ")[0]), ["doc_id", "_w"]).where(F.col("_near").contains(F.col("_name")))
    context = in_context.select("doc_id", "media_path", "company").distinct()
    in_image = near.select("doc_id", "media_path", F.explode(F.array_distinct(F.split("_ocr", " "))).alias("_w")).join(names.select("doc_id", "company", F.explode("_rare").alias("_w")), ["doc_id", "_w"]).select("doc_id", "media_path", "company").distinct()
    found = values.where(F.length("text") >= 5).select("doc_id", plain(F.col("text")).alias("_v")).where("_v <> ''").distinct().withColumn("_w", F.split("_v", " ")[0])
    other = near.select("doc_id", "media_path", "_ocr", F.explode(F.array_distinct(F.split("_ocr", " "))).alias("_w")).join(found, ["doc_id", "_w"]).where(F.col("_ocr").contains(F.col("_v"))).select("doc_id", "media_path").distinct()
    keys = ["doc_id", "media_path", "company"]
    return (
        context.select("doc_id", "media_path", F.concat(F.lit("party-context:"), "company").alias("reason"))
        .unionByName(in_image.join(context, keys, "left_anti").select("doc_id", "media_path", F.concat(F.lit("party-image:"), "company").alias("reason")))
        .unionByName(other.withColumn("reason", F.lit("detected-pii-in-image")))
    )


def hamming_pairs(hashes: DataFrame, limit: int = 8, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs (a, b with a < b) of pictures of one scope whose 64-bit hashes differ in at most `limit` bits, with distance.

    With limit + 1 blocks of bits, two such hashes agree in one block at least: pictures meet on the block, not all with all.
    """
    blocks = limit + 1
    edge = [64 * i // blocks for i in range(blocks + 1)]
    parts = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("hash", edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)).alias("v")) for i in range(blocks)))
    rows = hashes.where("hash IS NOT NULL").select(*scope, "media_path", "hash", F.explode(parts).alias("k"))
    left = rows.select(*scope, "k", F.col("media_path").alias("a"), F.col("hash").alias("_x"))
    right = rows.select(*scope, "k", F.col("media_path").alias("b"), F.col("hash").alias("_y"))
    distance = F.bit_count(F.col("_x").bitwiseXOR(F.col("_y")))
    return left.join(right, [*scope, "k"]).where("a < b").withColumn("distance", distance).where(F.col("distance") <= limit).select(*scope, "a", "b", "distance").distinct()


def propagate(reasons: DataFrame, hashes: DataFrame, limit: int = 8) -> DataFrame:
    """Reasons, and one for pictures without any that look like one that a party's reason marks (one step, not on and on)."""
    party = reasons.where(F.col("reason").startswith("party-")).select("doc_id", "media_path").distinct()
    pairs = hamming_pairs(hashes, limit)
    both = pairs.select("doc_id", F.col("a").alias("media_path"), F.col("b").alias("_to")).unionByName(pairs.select("doc_id", F.col("b").alias("media_path"), F.col("a").alias("_to")))
    like = both.join(party, ["doc_id", "media_path"], "left_semi").select("doc_id", F.col("_to").alias("media_path")).distinct().join(reasons, ["doc_id", "media_path"], "left_anti")
    return reasons.unionByName(like.withColumn("reason", F.lit("similar-to-redacted-party-logo")))


def audit(images: DataFrame, companies: DataFrame, values: DataFrame, policy: str = "sensitive") -> DataFrame:
    """doc_id, media_path, reasons, source_sha256, occurrences of the pictures to replace.

    images: a row for each reference: doc_id, media_path, nearby_text, description, content, ocr_text, has_qr, hash. Policy all
    replaces every picture, none no one; sensitive raises where pictures come without recognised text: it fails closed.
    """
    if policy not in ("all", "none", "sensitive"):
        raise ValueError(f"unknown image policy: {policy}")
    each = images.groupBy("doc_id", "media_path").agg(F.count(F.lit(1)).alias("occurrences"), F.first("content").alias("_content"), F.first("hash").alias("hash"), F.first("ocr_text").alias("ocr_text"), F.max("has_qr").alias("has_qr"))
    if policy == "none":
        each, reasons = each.limit(0), each.limit(0).select("doc_id", "media_path", F.lit("").alias("reason"))
    elif policy == "all":
        reasons = each.select("doc_id", "media_path", F.lit("policy-all").alias("reason"))
    else:
        if each.where("ocr_text IS NULL OR has_qr IS NULL").limit(1).count():
            raise RuntimeError("the sensitive image policy needs recognised text and code reading for every picture")
        own = each.select("doc_id", "media_path", F.explode(F.array_compact(F.array(F.when(F.col("has_qr"), F.lit("qr-code")), F.when(is_identity(F.col("ocr_text")), F.lit("identity-document"))))).alias("reason"))
        reasons = propagate(own.unionByName(text_reasons(images, companies, values)).distinct(), each.select("doc_id", "media_path", "hash"))
    marked = reasons.groupBy("doc_id", "media_path").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return each.join(marked, ["doc_id", "media_path"]).select("doc_id", "media_path", "reasons", F.sha2("_content", 256).alias("source_sha256"), "occurrences")


def difference_hash(pixels: list[list[int]]) -> int:
    """64 bits of a grey picture of 8 rows and 9 columns: whether each pixel is brighter than the next of its row."""
    value = 0
    for i, (a, b) in enumerate((row[j], row[j + 1]) for row in pixels for j in range(8)):
        value |= (a > b) << i
    return value


def placeholder(width: int, height: int) -> bytes:
    """A grey picture of a given size in PNG."""
    rows = b"".join(b"\0" + b"\xc0" * width for _ in range(height))
    out = io.BytesIO(b"\x89PNG\r\n\x1a\n")
    out.seek(0, io.SEEK_END)
    for kind, data in ((b"IHDR", pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows)), (b"IEND", b"")):
        out.write(pack(">I", len(data)) + kind + data + pack(">I", zlib.crc32(kind + data)))
    return out.getvalue()
