"""Queries without SQL over whole tables, against plain Python, and spans and substitutes at the edge of their shapes."""

import re
import time
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakesieve import fixed
from lakesieve.functions.spans import SPANS, resolve
from lakesieve.operators import evaluate, structured, surrogates
from lakesieve.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
NUMBERS = "call +91 98765 43210 or (022) 2345 6789, mobile: 9876543210, 9876543210, (415) 555-0123, 415.555.0123, toll free 4155550123, 4155550123, 022 2345 6789, +91 12"


def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def phones(text):
    digits = lambda m: sum(c.isdigit() for c in m)
    national = lambda m: digits(m) - 2 * re.sub(r"\D", "", m).startswith("91")
    found = [m for m in re.finditer(fixed.PHONE_COUNTRY, text, re.I) if 8 <= national(m.group()) <= 11]
    found += [m for m in re.finditer(fixed.PHONE_LANDLINE, text, re.I) if 9 <= digits(m.group()) <= 12]
    found += [m for m in re.finditer(fixed.PHONE_MOBILE, text, re.I) if re.search(fixed.BEFORE_MOBILE, text[max(0, m.start() - 48) : m.start()], re.I)]
    found += [m for m in re.finditer(fixed.PHONE_NANP, text, re.I) if re.match(r"\(.{0,3}\)", m.group()) or re.search("[-.]", m.group()) or re.search(fixed.BEFORE_NANP, text[max(0, m.start() - 40) : m.start()], re.I)]
    return Counter(m.group().strip() for m in found)


def test_all_phones_of_all_documents(spark):
    got = defaultdict(Counter)
    for r in QUERIES["det_phone"](spark, DATA).collect():
        got[r.doc_id][r.value.strip()] += 1
    want = {i: c for i, t in texts().items() if (c := phones(t))}
    assert dict(got) == want
    one = structured.detect(spark.createDataFrame([(NUMBERS,)], "text string"), frozenset({"PHONE"})).select(F.explode("candidates.text").alias("v")).collect()
    assert Counter(r.v.strip() for r in one) == phones(NUMBERS)
    assert sum(phones(NUMBERS).values()) >= 6


def test_words_of_all_documents(spark):
    got = {r.doc_id: r.n_words for r in QUERIES["vocab_lower"](spark, DATA).collect()}
    want = {i: len(w) for i, t in texts().items() if (w := set(re.findall(r"(?<![@.\w])[a-z][a-z'\u2019-]*(?![@.\w])", t)))}
    assert got == want


def test_many_spans_in_one_text(spark):
    spans = [{"start": 20 * i + d, "end": 20 * i + 12 + d, "pii_type": k, "text": "", "detector": "t", "confidence": 0.9, "priority": p, "metadata": {}} for i in range(8000) for d, k, p in ((0, "EMAIL", 100), (0, "EMAIL", 100), (4, "URL", 92))]
    df = spark.createDataFrame([(spans,)], f"c {SPANS}").cache()
    df.count()
    began = time.time()
    assert df.select(F.size(resolve(F.col("c"))).alias("n")).first().n == 8000
    assert time.time() - began < 20  # comparing all pairs takes minutes


@pytest.mark.parametrize(("kind", "sample", "edges"), [("EMAIL", "a@b.co", (0, 728_999, 729_000, 1_458_000, 90**6 - 1)), ("CREDIT_CARD", "4111111111111111", (0, 999_999, 1_000_000, 2_000_000)), ("AADHAAR", "236368043103", (0, 10**6, 2 * 10**6)), ("PAN", "ABCDE1234F", (0, 9_999, 10_000, 20_000, 260_000)), ("BANK_ACCOUNT", "123456789012", (0, 10**6))])
def test_substitutes_beyond_the_edges(spark, kind, sample, edges):
    df = spark.createDataFrame([(n,) for n in edges], "n long")
    same = F.lit(surrogates_hash := "0123456789abcdef" * 4)
    made = [r.v for r in df.select(surrogates.base_value(F.lit(kind), F.lit(sample), F.col("n"), same, F.lit(sample), 42).alias("v")).collect()]
    assert len(set(made)) == len(edges)
    assert len(surrogates_hash) == 64


def test_a_full_shape_raises(spark):
    df = spark.createDataFrame([(10**6,)], "n long")
    with pytest.raises(Exception, match="room"):
        df.select(surrogates.base_value(F.lit("IFSC"), F.lit("x"), F.col("n"), F.lit("0" * 64), F.lit("HDFC0ABC123"), 42).alias("v")).collect()


def test_surnames_that_stay_are_found(spark):
    mapping = spark.createDataFrame([("d", "PERSON", "priya sharma"), ("d", "PERSON", "amit long"), ("d", "PERSON", "single")], "doc_id string, pii_type string, canonical string")
    output = spark.createDataFrame([("d", "r1", "Ms Sharma went a long way"), ("d", "r2", "nothing")], "doc_id string, record_id string, text string")
    words = spark.createDataFrame([("d", "long"), ("d", "went")], "doc_id string, word string")
    assert [tuple(r) for r in evaluate.surname_leaks(mapping, output, words).collect()] == [("d", "r1", "sharma")]
