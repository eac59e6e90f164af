"""Dictionaries, entity rules and substitutes."""

import re

from pyspark.sql import functions as F

from lakesieve import fixed
from lakesieve.config import Config
from lakesieve.operators import gazetteer, ner, structured, surrogates
from lakesieve.plans import redactor
from lakesieve.sources import tables


def records(spark, *lines, doc="d"):
    return tables.text_records(spark.createDataFrame([(doc, "\n".join(lines))], "id string, text string"), "id")


def names(spark, *lines, scope="all"):
    rows = records(spark, *lines)
    return {(r.pii_type, r.canonical): set(r.variants) for r in gazetteer.build(rows, None, gazetteer.vocabulary(rows), scope).collect()}


def test_labels_transactions_and_suffixes(spark):
    found = names(spark, "Contact Person: Asha Rao / Vikram Shetty", "transfer of shares to Kushal Hegde from Jayaram Hegde.", "Alpha Works Limited and Beta Works LLP agreed.", "SEBI and Companies Act, 2013")
    assert {k for k in found if k[0] == "PERSON"} == {("PERSON", n) for n in ("Asha Rao", "Vikram Shetty", "Kushal Hegde", "Jayaram Hegde")}
    assert {k for k in found if k[0] == "COMPANY"} == {("COMPANY", "Alpha Works Limited"), ("COMPANY", "Beta Works LLP")}
    # A surname of two people is no variant of either; one person's alone is.
    assert "Hegde" not in found["PERSON", "Kushal Hegde"]
    assert "Shetty" in found["PERSON", "Vikram Shetty"]
    assert "Alpha Works" in found["COMPANY", "Alpha Works Limited"]


def test_equal_companies_merge(spark):
    found = names(spark, "Orchid  Systems Private Limited and OrchidSystems Private Limited.")
    assert [k[1] for k in found] == ["Orchid Systems Private Limited"]


def test_tables_of_people_and_aliases(spark):
    cells = [("d", "t0", r, c, v) for r, row in enumerate([("Name", "DIN", "Address"), ("Mr. Asha Rao", "01234567", "x")]) for c, v in enumerate(row)]
    cells += [("d", "t1", r, c, v) for r, row in enumerate([("Term", "Description"), ("Orchid", "Orchid Systems Private Limited, our promoter"), ("Offer", "the offer means a sale of shares")]) for c, v in enumerate(row)]
    cells = spark.createDataFrame(cells, "doc_id string, table_id string, row int, col int, cell string")
    rows = records(spark, "Orchid Systems Private Limited")
    found = {r.canonical: r.variants for r in gazetteer.build(rows, cells, gazetteer.vocabulary(rows)).collect()}
    assert "Asha Rao" in found
    assert "Orchid" in found["Orchid Systems Private Limited"]
    assert [r.term for r in gazetteer.glossary(cells).collect()] == ["Offer"]


def test_entity_rules_have_names():
    def rules(text, *found, words=()):
        return [(r[5], r[6]) for r in ner.judge(text, list(found), set(words), set())]

    assert rules("Asha Rao came", (0, 8, "PERSON")) == [("accepted", "person_candidate")]
    assert rules("Rao came", (0, 3, "PERSON")) == [("rejected", "single_token_person")]
    assert rules("Main Office", (0, 11, "PERSON")) == [("rejected", "person_veto_token")]
    assert rules("Net Sales", (0, 9, "PERSON"), words=("net", "sales")) == [("rejected", "all_tokens_in_lowercase_vocabulary")]
    assert rules("Acme Inc.", (0, 9, "ORG")) == [("accepted", "organization_candidate")]
    assert rules("Acme", (0, 4, "ORG")) == [("rejected", "missing_organization_evidence")]
    assert rules("see Outlook.com now") == [("accepted", "bare_name_tld_organization")]


def test_a_plugged_in_model_feeds_the_dictionary(spark):
    def load():
        return lambda texts: [[(m.start(), m.end(), "PERSON") for m in re.finditer("Asha Meera Rao|Asha Rao", t)] for t in texts]

    rows = records(spark, "Asha Meera Rao spoke.", "Then Asha Rao left.")
    result = redactor.run(rows, config=Config(types=frozenset({"PERSON"})), model=load)
    found = {r.text: (r.canonical, r.replacement) for r in result.detections.collect()}
    assert {c for c, _ in found.values()} == {"asha meera rao"}
    assert found["Asha Rao"][1] == found["Asha Meera Rao"][1]


def test_substitutes_keep_shapes_and_never_meet(spark):
    texts = [f"card 4111 1111 1111 {i:04d} ssn 123-45-{6000 + i} ip 10.0.{i % 250}.{i} mail a{i}.b@x.org call ({200 + i}) 555-0{100 + i} Tel: 022 2345 {1000 + i} DIN {10000000 + i}" for i in range(120)]
    rows = spark.createDataFrame([(str(i), str(i), t) for i, t in enumerate(texts)], "doc_id string, record_id string, text string")
    spans = redactor.spans_of(redactor.arbitrate(structured.detect(rows)))
    found = surrogates.assign(spans).collect()
    assert surrogates.collisions(surrogates.assign(spans)).count() == 0
    assert sorted((r.text, r.replacement) for r in found) == sorted((r.text, r.replacement) for r in surrogates.assign(spans).collect())
    for r in found:
        if r.pii_type in ("CREDIT_CARD", "PHONE"):
            assert re.sub(r"\d", "0", r.replacement) == re.sub(r"\d", "0", r.text)
    again = spark.createDataFrame([(r.replacement,) for r in found if r.pii_type == "CREDIT_CARD"], "text string")
    assert again.where(F.size(structured.structured_spans(F.col("text"), types=frozenset({"CREDIT_CARD"}))) == 1).count() == again.count()
    assert {r.pii_type for r in found} >= {"CREDIT_CARD", "SSN", "IP_ADDRESS", "EMAIL", "PHONE", "DIN"}


def test_types_and_scope_are_checked():
    import pytest

    with pytest.raises(ValueError, match="unknown types"):
        Config(types=frozenset({"NAME"}))
    assert "COMPANY" not in Config(company_scope="none").types
    assert set(fixed.PRIORITIES) == Config().types
