"""The leak and difference queries look at every kind that prose holds."""

import re

from lakesieve.operators import evaluate
from lakesieve.plans.queries import QUERIES


def test_leak_check_and_redact_diff_cover_all_kinds(spark, tmp_path, monkeypatch):
    text = "mail a.b@example.org call +91 98765 43210 card 4111 1111 1111 1111 host 192.168.10.24 US SSN: 123-45-6789"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    leaks, differences, seen = evaluate.leaks, evaluate.differences, []
    kinds = lambda df: seen.append({r.pii_type for r in df.collect()})
    monkeypatch.setattr(evaluate, "leaks", lambda m, o: kinds(m) or leaks(m, o))
    monkeypatch.setattr(evaluate, "differences", lambda s, o, d: kinds(d) or differences(s, o, d))
    for name in ("leak_check", "redact_diff"):
        assert QUERIES[name](spark, str(tmp_path)).first()[0] == 0
    assert seen == [{"EMAIL", "PHONE", "CREDIT_CARD", "IP_ADDRESS", "SSN"}] * 2


def test_values_that_begin_alike_do_not_meet_all_records(spark, monkeypatch):
    phones = [f"+91 9{i:04} 4{i:04}" for i in range(300)]
    values = [("PHONE", p) for p in phones] + [("IP_ADDRESS", "10.1.2.3"), ("SSN", "123-45-6789"), ("CREDIT_CARD", "4111111111111111"), ("EMAIL", "a.b@x.org"), ("EMAIL", "Jo@x.org"), ("EMAIL", "in@fake.org")]
    mapping = spark.createDataFrame([(k, v, "see in@fake.org" if i == 0 else f"fake{i}") for i, (k, v) in enumerate(values)], "pii_type string, text string, replacement string")
    texts = [f"+91 {i} 91 call" for i in range(300)] + [f"x {phones[7]}, y", "xa.b@x.org", "a xa.b@x.org", "mail jo@x.org", "mail Jo@x.organ", "110.1.2.3", "10.1.2.34 10", "n 123-45-67890", "4111111111111111", "41111111111111110", "in@fake.org", None]
    output = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "record_id string, text string")
    sizes, held = [], evaluate.held
    monkeypatch.setattr(evaluate, "held", lambda df: sizes.append((out := held(df)).count()) or out)

    def plain(extra):
        words = lambda t: {w.lower() for w in re.findall(r"\w+", t)}
        return {(str(i), v) for i, t in enumerate(texts) if t for _, v in values + extra if v in t and re.search(r"\w+", v)[0].lower() in words(t) and v != "in@fake.org"}

    assert {(r.record_id, r.original) for r in evaluate.leaks(mapping, output).collect()} == plain([])
    assert sizes[1] < 50  # 90,000 meet by their first word
    name = spark.createDataFrame([("PERSON", "mail Jo", "other")], mapping.schema)  # neither digit nor at sign: all words of all records
    assert {(r.record_id, r.original) for r in evaluate.leaks(mapping.union(name), output).collect()} == plain([("PERSON", "mail Jo")])
