"""Span columns against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from lakesieve import fixed
from lakesieve.functions import checks
from lakesieve.functions.spans import SPANS, find_all, rebuild, resolve, split_names
from lakesieve.operators import evaluate


def span(start, end, kind, priority, confidence=0.9, text=""):
    return {"start": start, "end": end, "pii_type": kind, "text": text, "detector": "t", "confidence": confidence, "priority": priority, "metadata": {}}


def winners(spark, spans):
    df = spark.createDataFrame([(spans,)], f"c {SPANS}")
    return [(s.start, s.end, s.pii_type) for s in df.select(resolve(F.col("c")).alias("s")).first().s]


def test_priority_beats_length_and_length_beats_nothing_else(spark):
    assert winners(spark, [span(0, 12, "PERSON", 80), span(5, 20, "EMAIL", 100)]) == [(5, 20, "EMAIL")]
    assert winners(spark, [span(2, 5, "URL", 92), span(2, 9, "URL", 92)]) == [(2, 9, "URL")]
    assert winners(spark, [span(9, 12, "URL", 92), span(0, 3, "URL", 92)]) == [(0, 3, "URL"), (9, 12, "URL")]


def test_a_loser_blocks_nobody(spark):
    assert winners(spark, [span(0, 10, "EMAIL", 100), span(8, 14, "PHONE", 98), span(12, 20, "URL", 92)]) == [(0, 10, "EMAIL"), (12, 20, "URL")]


def test_resolve_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    kinds = list(fixed.PRIORITIES.items())
    cases = []
    for _ in range(40):
        spans = []
        for _ in range(rng.randint(0, 9)):
            a = rng.randint(0, 20)
            kind, priority = rng.choice(kinds)
            spans.append(span(a, a + rng.randint(1, 8), kind, priority, rng.choice([0.9, 0.95])))
        cases.append(spans)

    def plain(spans):
        best = {}
        for s in spans:
            k = (s["start"], s["end"], s["pii_type"])
            if k not in best or (s["priority"], s["confidence"]) > (best[k]["priority"], best[k]["confidence"]):
                best[k] = s
        kept = []
        for s in sorted(best.values(), key=lambda s: (-s["priority"], -s["confidence"], s["start"] - s["end"], s["start"], s["pii_type"])):
            if all(s["end"] <= k["start"] or k["end"] <= s["start"] for k in kept):
                kept.append(s)
        return sorted((s["start"], s["end"], s["pii_type"]) for s in kept)

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {SPANS}")
    got = {r.i: sorted((s.start, s.end, s.pii_type) for s in r.s) for r in df.select("i", resolve(F.col("c")).alias("s")).collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases)}


TEXTS = ["a@b.co é😀 x.y@z.example.org, no@", "", "ip 1.2.3.4 and 999.1.1.1 ::1 fe80::1", "Straße 12345678 ÉCOLE DIN 1", "\x01a@b.co\x02"]


@pytest.mark.parametrize(("core", "fold"), [(fixed.EMAIL, True), (fixed.IP_TOKEN, True), (fixed.DIN, False), (r"\w+", False), (r"\s", False), (r"école", True)])
def test_offsets_equal_pythons(spark, core, fold):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: [(m.start, m.end) for m in r.m] for r in df.select("i", find_all(F.col("t"), core, fold).alias("m")).collect()}
    clean = [t.replace("\x01", " ").replace("\x02", " ") for t in TEXTS]
    assert got == {i: [m.span() for m in re.finditer(core, t, re.I if fold else 0)] for i, t in enumerate(clean)}


def test_null_text_has_no_matches(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(find_all(F.col("t"), r"\w").alias("m")).first().m == []


def test_rebuild_does_not_drift(spark):
    df = spark.createDataFrame([("é😀 one two", [(3, 6, "LONGER"), (7, 10, "")])], "t string, r array<struct<start:int,end:int,replacement:string>>")
    assert df.select(rebuild(F.col("t"), F.col("r")).alias("x")).first().x == "é😀 LONGER "


def test_names_are_split_at_breaks(spark):
    text = "Automatic Data\nProcessing, Inc."
    df = spark.createDataFrame([(text, [span(0, len(text), "COMPANY", 78, text=text)], [(14, 15)])], f"t string, c {SPANS}, b array<struct<start:int,end:int>>")
    got = df.select(split_names(F.col("t"), F.col("c"), F.col("b")).alias("s")).first().s
    assert [(s.text, s.metadata["block_segment_index"], s.metadata["block_segment_count"]) for s in got] == [("Automatic Data", "0", "2"), ("Processing, Inc.", "1", "2")]


def test_check_digits_round_trip(spark):
    numbers = [str(41111111111 + 7919 * i) for i in range(50)]
    df = spark.createDataFrame([(checks.verhoeff_digit(n), checks.luhn_digit("4" + n + "000"), n) for n in numbers], "v string, l string, n string")
    ok = df.select(checks.verhoeff(F.concat("n", "v")).alias("a"), checks.luhn(F.concat(F.lit("4"), "n", F.lit("000"), "l")).alias("b")).collect()
    assert all(r.a and r.b for r in ok)


def test_relaxed_modes_differ_on_exact_and_partial(spark):
    gold = spark.createDataFrame([("r", "URL", 0, 10, "s", 0)], "record_id string, pii_type string, start int, end int, stratum string, seq long")
    guess = spark.createDataFrame([("r", "URL", 0, 10, 0), ("r", "URL", 2, 12, 1)], "record_id string, pii_type string, start int, end int, seq long")
    left = lambda mode: evaluate.relaxed_matches(gold, guess, mode).where("outcome = 'fp'").first().start
    assert left("exact_first") == 2
    assert left("reference") == 0
