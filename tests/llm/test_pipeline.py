"""The pipeline's stages on the smallest tables, and the queries with SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_nearcopies import brute

import corpus_pipeline
from lakesieve.llm import mixing, quality
from lakesieve.llm.common import keep
from lakesieve.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        last, docs = docs, keep(stage(spark, docs, DATA), "test")
        counts.append(docs.count())
        if name != "best-fit packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality rules":
            forest = quality.fit(last, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality.judge(last, forest).where("kept").collect()}
        if name == "line dedup":
            assert counts[-1] == counts[-2]
        if name == "SimHash near-dedup":
            # The stage's contract: five words and a similarity of 0.8 or more, here over all pairs.
            assert {r.doc_id for r in docs.collect()} == brute([(r.doc_id, r.text) for r in last.select("doc_id", "text").collect()])
        if name == "mixing sources":
            copies = {r.doc_id: r.copies for r in mixing.mix(last).collect()}
            assert Counter(r.doc_id for r in docs.collect()) == Counter({i: n for i, n in copies.items() if n})
            texts = {r.doc_id: r.text for r in last.collect()}
            assert all(r.text == texts[r.doc_id] for r in docs.collect())
        if name == "best-fit packing":
            told = Counter(r.doc_id for r in docs.where("piece = 0").collect())
            assert told == Counter(r.doc_id for r in last.collect())
            ends = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
            assert all(r.n == r.end <= 4096 for r in ends)
    assert counts[1] < counts[0]
    assert docs.agg({"length": "max"}).first()[0] <= 4096


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, sql = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(list(sql.columns), sql.fetchall())


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
