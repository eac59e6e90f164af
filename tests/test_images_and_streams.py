"""Pictures, blocks of records, streams and the command line."""

import pytest
from pyspark.sql import functions as F

from lakesieve import cli
from lakesieve.operators import images, windows
from lakesieve.plans.queries import QUERIES

SCHEMA = "doc_id string, media_path string, nearby_text string, description string, content binary, ocr_text string, has_qr boolean, hash long"


def pictures(spark):
    rows = [
        ("d", "logo.png", "Orchid Systems Private Limited is ours", "", b"1", "", False, 0x1234), ("d", "same.png", "", "", b"2", "", False, 0x1235), ("d", "pan.png", "", "", b"3", "INCOME TAX DEPARTMENT", False, None),
        ("d", "qr.png", "", "", b"4", "", True, None), ("d", "plain.png", "a chart", "", b"5", "sales", False, -1), ("d", "mail.png", "", "", b"6", "write to priya.sharma@x.org", False, None),
    ]
    return spark.createDataFrame([(*r[:4], bytearray(r[4]), *r[5:]) for r in rows], SCHEMA)


def test_pictures_are_judged_by_text_context_and_likeness(spark):
    companies = spark.createDataFrame([("d", "Orchid Systems Private Limited")], "doc_id string, canonical string")
    values = spark.createDataFrame([("d", "priya.sharma@x.org")], "doc_id string, text string")
    found = {r.media_path: r.reasons for r in images.audit(pictures(spark), companies, values).collect()}
    assert found == {
        "logo.png": ["party-context:Orchid Systems Private Limited"], "same.png": ["similar-to-redacted-party-logo"], "pan.png": ["identity-document"], "qr.png": ["qr-code"], "mail.png": ["detected-pii-in-image"],
    }
    assert images.audit(pictures(spark), companies, values, "all").count() == 6
    assert images.audit(pictures(spark), companies, values, "none").count() == 0
    with pytest.raises(RuntimeError, match="recognised text"):
        images.audit(pictures(spark).withColumn("ocr_text", F.lit(None).cast("string")), companies, values)


def test_hash_and_placeholder():
    assert images.difference_hash([[9 - j for j in range(9)]] * 8) == 2**64 - 1
    assert images.placeholder(3, 2).startswith(b"\x89PNG")


def records(spark, lines, cell=None):
    rows = [("d", f"word/document.xml:p{i:06d}", "word/document.xml", i, t, cell, None) for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id string, record_id string, part_name string, ord long, text string, cell_key string, column_header string")


def test_an_address_over_several_records_goes_back_to_them(spark):
    lines = ["Orchid works", "Plot 12, Ring Road", "Nashik 422 009, Maharashtra, India", "thanks"]
    found = {r.record_id[-1]: [(s.text, s.metadata["block_segment_index"]) for s in r.found] for r in windows.block_addresses(records(spark, lines)).collect()}
    assert found["1"][0][0] == "Plot 12, Ring Road"
    assert found["2"][0][0] == "Nashik 422 009, Maharashtra, India"
    guarded = ["Registrar of Companies", *lines[1:]]
    assert windows.block_addresses(records(spark, guarded)).count() == 0


def test_stream(spark):
    data = "/root/testdata/sf0.001"
    found = QUERIES["stream_redact"](spark, data)
    lines = QUERIES["records_split"](spark, data)
    assert found.count() == lines.count()
    assert found.where("text RLIKE '[a-z]@mail[0-9]'").count() == 0


def test_package_round_trip(spark):
    texts = [r.text for r in QUERIES["docx_roundtrip_inline"](spark, "").orderBy("record_id").collect()]
    assert len(texts) == 13
    assert "priya.sharma" not in " ".join(texts)
    assert texts[11].startswith("Order 6350960932")


def test_command_line(capsys):
    assert cli.main(["--input", "/nowhere", "--types", "NAME"]) == 2
    assert "unknown types" in capsys.readouterr().err
