"""The counts of spans against their SQL, on texts where Unicode, colons, gaps and repeated digits matter."""

import pytest
from test_cards import equals_its_sql

from lakesieve.operators import structured

TEXTS = {
    "邮箱john@x.com吧 éanna@x.com paul@x.comé": {"EMAIL": 3},
    "::1 fe80::1 2001:db8::8a2e:370:7334 ab::cd 1:2:3:4:5:6:7:8": {},
    "10:22:33:192.168.0.1 ::ffff:192.168.1.1 and 12::7.2.3.4": {"IP_ADDRESS": 3},
    "٣1.2.3.4 1.2.3.4٣ 01.2.3.4 1.2.3.4.5 1.2.3.4:80": {"IP_ADDRESS": 3},
    "4111 1111 1111 1111, 4111-1111-1111-1111, 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1": {},
    f"4111-1111-1111-1111 4366089147969128-42 {'8' * 16} {'4' * 17} {'2' * 17} {'4' * 16}": {"CREDIT_CARD": 4},
}


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("text", TEXTS)
def test_counts_by_type_equals_its_sql(spark, tmp_path, text):
    folder = table(spark, tmp_path, [(1, text, "en"), (2, None, "de"), (2, "nothing", None)])
    assert dict(equals_its_sql(spark, folder, "counts_by_type").collect()) == TEXTS[text]


def test_colons_hide_no_ipv4_address(spark):
    text = "10:22:33:192.168.0.1 ::ffff:192.168.1.1"
    found = structured.detect(spark.createDataFrame([(text,)], "text string"), frozenset({"IP_ADDRESS"})).first().candidates
    assert {"192.168.0.1", "192.168.1.1"} <= {s.text for s in found}
    assert all(text[s.start : s.end] == s.text for s in found)


SPANS = "a@b.com 1.2.3.4 4111111111111111 ::1"


@pytest.mark.parametrize("rows", [
    [],
    [(1, "nothing", "en"), (2, None, None)],
    [(1, SPANS, "en"), (1, f"{SPANS} c@d.org", "de"), (1, SPANS, "en"), (2, SPANS, "en"), (2, "nothing", None)],
    [(None, SPANS, "en"), (None, SPANS, "de"), (3, SPANS, None), (4, SPANS, "ALL")],
    *([(1, text, "en"), (2, text, "de")] for text in TEXTS),
])
def test_counts_rollup_equals_its_sql(spark, tmp_path, rows):
    assert equals_its_sql(spark, table(spark, tmp_path, rows), "counts_rollup").columns == ["pii_type", "lang", "n"]
