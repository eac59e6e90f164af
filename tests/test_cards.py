"""Card numbers beside other digits: the detector, and the queries that count them against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lakesieve.operators import structured
from lakesieve.plans.queries import ORACLES, QUERIES

RUNS = ["4366089147969128 42", "42 4366089147969128", "paid 4495589438270767 42, 7", "7 4366089147969128-19 x", "4366089147969128-", "4366089147969128 4111111111111111", "4366089147969129 42", "43660891479691280000 4", "no 12 34", None]


@pytest.mark.parametrize("text,values", [
    ("42 4366089147969128 17", ["4366089147969128"]),
    ("4111 1111 1111 1111 42", ["4111 1111 1111 1111"]),
    ("12 4111-1111-1111-1111 123", ["4111-1111-1111-1111"]),
    ("1234 4111 1111 1111 1111 and 3782 822463 10005 5", ["4111 1111 1111 1111", "3782 822463 10005"]),
    ("41 1111 1111 1111 11", ["41 1111 1111 1111 11"]),
    ("card: 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("4111 1111 1111 1112", []),
    (" ".join(["77"] * 20000), []),
])
def test_cards_beside_digits(spark, text, values):
    found = structured.detect(spark.createDataFrame([(text,)], "text string"), frozenset({"CREDIT_CARD"})).first().candidates
    assert [s.text for s in found] == values
    assert all(text[s.start : s.end] == s.text and s.end == s.start + len(s.text) for s in found)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cards"))
    spark.createDataFrame([(i, t, "de" if i % 2 else "en") for i, t in enumerate(RUNS)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    sql = con.sql(ORACLES[name])
    df = QUERIES[name](spark, folder).select(*(F.col(c) for c in sql.columns))
    assert sorted(map(tuple, df.collect())) == sorted(sql.fetchall())
    return df


def test_det_card_luhn_equals_its_sql_beside_digits(spark, folder):
    assert equals_its_sql(spark, folder, "det_card_luhn").count() == 7


def test_counts_by_type_equals_its_sql_beside_digits(spark, folder):
    assert dict(equals_its_sql(spark, folder, "counts_by_type").collect()) == {"CREDIT_CARD": 7}


def test_counts_rollup_equals_its_sql_beside_digits(spark, folder):
    assert ("ALL", "ALL", 7) in {tuple(r) for r in equals_its_sql(spark, folder, "counts_rollup").select("pii_type", "lang", "n").collect()}
