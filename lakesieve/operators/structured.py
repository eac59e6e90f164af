"""Detectors of structured identifiers: a cheap test of the text, a pattern with offsets, and a check of each match."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve import fixed
from lakesieve.config import ALL_TYPES
from lakesieve.functions import checks
from lakesieve.functions.spans import MATCH, SPANS, after, as_spans, before, find_all, in_order, matches, none, once, rebuild

Check = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Detector:
    """A detector is an expression over a text. quick: a test that every text with a match passes, so that most texts skip
    the pattern. check: of a match (start, end, text), the text and the table headers."""

    pii_type: str
    core: str
    confidence: float
    quick: str
    ignore_case: bool = False
    check: Check | None = None
    detector: str = "structured"

    def column(self, text: Column, headers: Column, plain: bool = False) -> Column:
        found = find_all(text, self.core, self.ignore_case, plain)
        if self.check:
            found = F.filter(found, lambda m: F.coalesce(self.check(m, text, headers), F.lit(False)))
        spans = as_spans(found, self.pii_type, self.detector, self.confidence)
        return F.when(F.coalesce(text.rlike(self.quick), F.lit(False)), spans).otherwise(none())


def _count(m: Column) -> Column:
    return F.length(checks.digits(m["text"]))


def _national(m: Column) -> Column:
    n = checks.digits(m["text"])
    return F.length(n) - F.when(n.startswith("91"), 2).otherwise(0)


def _nanp(m: Column, text: Column, headers: Column) -> Column:
    bracketed = m["text"].startswith("(") & F.substring(m["text"], 1, 5).contains(")")
    return bracketed | m["text"].rlike("[-.]") | matches(before(text, m["start"], 40), fixed.BEFORE_NANP)


def _din(m: Column, text: Column, headers: Column) -> Column:
    return matches(before(text, m["start"], 36), r"\bDIN\b") | matches(F.array_join(F.coalesce(headers, F.array().cast("array<string>")), " "), r"\bDIN\b")


DETECTORS = (
    Detector("EMAIL", fixed.EMAIL, 0.99, "@", True),
    Detector("PAN", fixed.PAN, 0.99, "[A-Z]{5}\\p{Nd}"),
    Detector("CIN", fixed.CIN, 0.99, "(?i)P[LT]C", True),
    Detector("SEBI_REG_NO", fixed.SEBI, 0.99, "(?i)IN[A-Z]{1,3}\\p{Nd}", True),
    Detector("IFSC", fixed.IFSC, 0.99, "[A-Z]{4}0"),
    Detector("GSTIN", fixed.GSTIN, 0.99, "Z[0-9A-Z]"),
    Detector("SSN", fixed.SSN, 0.99, "\\p{Nd}-\\p{Nd}\\p{Nd}-\\p{Nd}", check=lambda m, t, h: checks.ssn(m["text"])),
    # Each version by itself, so that groups with colons before an IPv4 address never swallow its first number.
    Detector("IP_ADDRESS", fixed.IPV6, 0.99, ":[0-9A-Fa-f]{0,4}:", True, lambda m, t, h: checks.ip(m["text"])),
    Detector("IP_ADDRESS", fixed.IPV4, 0.99, "\\p{Nd}\\.\\p{Nd}", check=lambda m, t, h: checks.ip(m["text"])),
    Detector("AADHAAR", fixed.AADHAAR, 0.99, "[2-9]\\p{Nd}{3}[ -]?\\p{Nd}{4}", check=lambda m, t, h: checks.verhoeff(m["text"])),
    Detector("PHONE", fixed.PHONE_COUNTRY, 0.99, "\\+", True, lambda m, t, h: _national(m).between(8, 11)),
    Detector("PHONE", fixed.PHONE_LANDLINE, 0.985, "0\\p{Nd}{2}", check=lambda m, t, h: _count(m).between(9, 12)),
    Detector("PHONE", fixed.PHONE_MOBILE, 0.98, "[6-9]\\p{Nd}{9}", check=lambda m, t, h: matches(before(t, m["start"], 48), fixed.BEFORE_MOBILE)),
    Detector("PHONE", fixed.PHONE_NANP, 0.99, "\\p{Nd}{3}[-.\\s]?\\p{Nd}{4}", check=_nanp),
    Detector("DIN", fixed.DIN, 0.98, "\\p{Nd}{8}", check=_din),
    Detector("PASSPORT", fixed.PASSPORT, 0.98, "(?i)passport", check=lambda m, t, h: matches(before(t, m["start"], 48), fixed.BEFORE_PASSPORT)),
    Detector("BANK_ACCOUNT", fixed.BANK, 0.97, "(?i)a/?c|account", True, lambda m, t, h: matches(before(t, m["start"], 64), fixed.BEFORE_BANK) & _count(m).between(9, 18)),
)


def cards(text: Column, plain: bool = False) -> Column:
    """Card numbers. Usual groups of digits are looked for from each group on; in the text without them the pattern reads the rest."""
    good = lambda m: checks.luhn(m["text"], plain) & checks.known_issuer(m["text"])
    shapes = "|".join("[ -]".join(f"[0-9]{{{n}}}" for n in sizes) for sizes in fixed.CARD_GROUPS)
    lengths = F.array(*(F.lit(sum(sizes) + len(sizes) - 1) for sizes in fixed.CARD_GROUPS))

    def readings(m: Column) -> Column:
        return F.transform(lengths, lambda n: F.struct(m["start"].alias("start"), (m["start"] + n).alias("end"), F.substring(text, m["start"] + 1, n).alias("text")))

    def keep(acc: Column, m: Column) -> Column:
        return F.when(m["start"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)), acc).otherwise(F.concat(acc, F.array(m)))

    def with_rest(usual: Column) -> Column:
        left = rebuild(text, F.transform(usual, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.repeat(F.lit("x"), m["end"] - m["start"]).alias("replacement"))))
        return in_order(as_spans(F.concat(usual, F.filter(find_all(left, fixed.CARD), good)), "CREDIT_CARD", "structured", 0.995))

    # This pattern matches nothing but the place, so that groups which overlap are all found.
    places = find_all(text, f"(?<![0-9])(?=(?:{shapes})(?![0-9]))")
    whole = lambda m: (F.length(m["text"]) == m["end"] - m["start"]) & m["text"].rlike(f"^(?:{shapes})$") & ~F.substring(text, m["end"] + 1, F.lit(1)).rlike("[0-9]")
    usual = F.aggregate(F.filter(F.flatten(F.transform(places, readings)), lambda m: whole(m) & good(m)), F.array().cast(MATCH), keep)
    return F.when(F.coalesce(text.rlike("[0-9](?:[ -]?[0-9]){12}"), F.lit(False)), once(usual, with_rest)).otherwise(none())


def url_host(value: Column) -> Column:
    """The host of a URL that may have gaps in it and no scheme, without www."""
    compact = F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", ""), r"^[.,;:)]+|[.,;:)]+$", "")
    return F.regexp_replace(F.lower(F.regexp_extract(compact, r"^(?:(?i:[a-z]+)://)?([^/?#:]*)", 1)), r"^www\.", "")


def urls(text: Column) -> Column:
    """URLs, also those with a gap before the last label; not those of public hosts."""
    found = F.concat(find_all(text, fixed.URL, True), find_all(text, fixed.SPLIT_URL, True))

    def strip(m: Column) -> Column:
        core = F.regexp_replace(m["text"], r"[.,;:)]+$", "")
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(core)).alias("end"), core.alias("text"))

    kept = F.filter(F.array_distinct(F.transform(found, strip)), lambda m: (m["end"] > m["start"]) & ~_public(url_host(m["text"])))
    spans = F.transform(kept, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.lit("URL").alias("pii_type"), m["text"].alias("text"), F.lit("structured").alias("detector"), F.lit(0.99).alias("confidence"),
        F.lit(fixed.PRIORITIES["URL"]).alias("priority"), F.create_map(F.lit("host"), url_host(m["text"])).alias("metadata"),
    )).cast(SPANS)
    return F.when(F.coalesce(text.rlike(r"(?i)://|www\.|\.[a-z]{2,4}/"), F.lit(False)), in_order(spans)).otherwise(none())


def _public(host: Column) -> Column:
    test = F.lit(False)
    for h in fixed.PUBLIC_HOSTS:
        test = test | (host == h) | host.endswith(f".{h}")
    return test


def dates_of_birth(text: Column, headers: Column, column_header: Column) -> Column:
    """Dates with a label just before them, or in a table column that names them."""
    titles = F.concat_ws(" ", F.array_join(F.coalesce(headers, F.array().cast("array<string>")), " "), F.coalesce(column_header, F.lit("")))
    listed = matches(titles, fixed.DOB_HEADER)
    found = F.filter(find_all(text, fixed.DATE, True), lambda m: listed | matches(before(text, m["start"], 48), fixed.BEFORE_DOB))
    return F.when(F.coalesce(text.rlike(r"(?:19|20)\p{Nd}{2}"), F.lit(False)), as_spans(found, "DATE_OF_BIRTH", "date_context", 0.98)).otherwise(none())


def structured_spans(text: Column, headers: Column | None = None, column_header: Column | None = None, types: frozenset[str] = ALL_TYPES, plain: bool = False) -> Column:
    """All structured candidates of a text, of the wanted types alone: the expressions of others are never built. plain: as SQL's
    patterns read them, with classes of ASCII alone and cards of one repeated digit."""
    headers = F.lit(None).cast("array<string>") if headers is None else headers
    # Most texts hold no digit at all: one test of that guards all detectors of numbers.
    apart = ("EMAIL", "IP_ADDRESS")
    numbers = [d.column(text, headers, plain) for d in DETECTORS if d.pii_type in types and d.pii_type not in apart]
    if "CREDIT_CARD" in types:
        numbers.append(cards(text, plain))
    if "DATE_OF_BIRTH" in types:
        numbers.append(dates_of_birth(text, headers, F.lit(None).cast("string") if column_header is None else column_header))
    parts = [d.column(text, headers, plain) for d in DETECTORS if d.pii_type in types and d.pii_type in apart]
    if numbers:
        parts.append(F.when(F.coalesce(text.rlike(r"\p{Nd}"), F.lit(False)), F.concat(*numbers)).otherwise(none()))
    if "URL" in types:
        parts.append(urls(text))
    return F.coalesce(F.concat(*parts), none()) if parts else none()


def detect(records: DataFrame, types: frozenset[str] = ALL_TYPES, to: str = "candidates", plain: bool = False) -> DataFrame:
    """records with an array of candidate spans; one narrow projection."""
    has = set(records.columns)
    return records.withColumn(to, structured_spans(F.col("text"), F.col("table_headers") if "table_headers" in has else None, F.col("column_header") if "column_header" in has else None, types, plain))


__all__ = ["DETECTORS", "MATCH", "Detector", "after", "cards", "dates_of_birth", "detect", "structured_spans", "url_host", "urls"]
