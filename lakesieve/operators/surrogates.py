"""Substitutes: seeded, format-preserving and injective values for what was found.

The distinct values of a type are put in the order of a salted hash and numbered; the number is read in a mixed radix over word
lists or number ranges. So no two values of a type share a substitute, whatever the order of the rows, and nothing has to be
tried again. Numbers come from a hash range first and a rank inside it, so no task ranks all values of a type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesieve import fixed
from lakesieve.config import ALL_TYPES
from lakesieve.functions import checks
from lakesieve.sources.stage import held

#: Hash ranges in which values are ranked; their counts, not the values, are put in order.
RANGES = 1024
_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnprstvwy"
_LETTERS = tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: How many values the shape of a type has substitutes for; beyond, the run fails rather than give two values one substitute.
_ROOM = {"EMAIL": 90**6, "IP_ADDRESS": 762 + 2 * 2**16 + 2**24, "PAN": 26 * 26 * 10**4, "DIN": 10**8, "SSN": 9999 * 99, "CIN": 10**6, "SEBI_REG_NO": 10**6, "IFSC": 10**6, "GSTIN": 10**6, "PASSPORT": 10**6, "PERSON": 90**4}


def digest(seed: int, pii_type: Column, canonical: Column, attempt: int = 0) -> Column:
    """64 hexadecimal digits that depend on seed, type and canonical value alone."""
    return F.sha2(F.concat_ws("\x01", F.lit(str(seed)), pii_type, canonical, F.lit(str(attempt))), 256)


def number(hash_: Column, first: int = 1) -> Column:
    """60 bits of a digest, from its hexadecimal digit `first` on."""
    return F.conv(F.substring(hash_, first, 15), 16, 10).cast("long")


def canonical(pii_type: Column, text: Column, name: Column | None = None) -> Column:
    """The value that decides on the substitute: digits of phones, the registrable domain of URLs, the canonical name of people
    and companies, otherwise the text with single spaces and in lower case."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(name, text) if name is not None else text, r"(?U)\s+", " ")))
    return F.when(pii_type == "PHONE", checks.digits(text)).when(pii_type == "URL", domain(text)).otherwise(plain)


def domain(url: Column) -> Column:
    """The last two labels of the host, three under co.in and co.uk."""
    compact = F.regexp_replace(F.regexp_replace(url, r"(?U)\s+", ""), r"[.,;:)]+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(compact, r"^(?:(?i:[a-z]+)://)?([^/?#:]*)", 1)), r"^www\.", "")
    return F.regexp_replace(host, r"^(?:.*\.)?([^.]+\.(?:co\.in|co\.uk)|[^.]+\.(?!(?:in|uk)$)[^.]+|(?<!co)[^.]+\.(?:in|uk))$", "$1")


def url_tail(url: Column) -> Column:
    compact = F.regexp_replace(F.regexp_replace(url, r"(?U)\s+", ""), r"[.,;:)]+$", "")
    return F.regexp_extract(compact, r"^(?:(?i:[a-z]+)://)?[^/?#]*(.*)$", 1)


def numbered(values: DataFrame, seed: int, by: tuple[str, ...] = ("pii_type",)) -> DataFrame:
    """Distinct values (pii_type, canonical, ...) with _hash and _nth: their place in hash order within `by`, from 0."""
    rows = values.withColumn("_hash", digest(seed, F.col("pii_type"), F.col("canonical"))).withColumn("_range", F.floor(number(F.col("_hash")) / ((1 << 60) // RANGES)).cast("int"))
    where = [*by, "_range"]
    counts = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(*where, F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*where).orderBy("_hash", "canonical"))
    return rows.withColumn("_in", inside).join(base, where).withColumn("_nth", (F.col("_base") + F.col("_in") - 1).cast("long")).drop("_in", "_base", "_range")


def _pick(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (at % len(words)).cast("int") + 1)


def _syllables(nth: Column, count: int, ending: str = "") -> Column:
    """A name made of syllables, another for every number below (18 * 5) ** count."""
    size = len(_CONSONANTS) * len(_VOWELS)
    parts = [F.concat(F.substring(F.lit(_CONSONANTS), (F.floor(nth / size**i) % len(_CONSONANTS)).cast("int") + 1, F.lit(1)), F.substring(F.lit(_VOWELS), (F.floor(nth / (size**i * len(_CONSONANTS))) % len(_VOWELS)).cast("int") + 1, F.lit(1))) for i in range(count)]
    return F.initcap(F.concat(*parts, F.lit(ending)))


def person_base(nth: Column) -> Column:
    """First and last name: both differ for every number, so single names can stand for the person."""
    return F.concat_ws(" ", _syllables(nth, 4, "n"), _syllables(nth, 4, "kar"))


def company_base(nth: Column) -> Column:
    words, nouns = len(fixed.COMPANY_WORDS), len(fixed.COMPANY_NOUNS)
    round_ = F.floor(nth / (words * nouns))
    stem = F.concat_ws(" ", _pick(fixed.COMPANY_WORDS, nth), _pick(fixed.COMPANY_NOUNS, F.floor(nth / words)))
    return F.when(round_ == 0, stem).otherwise(F.concat_ws(" ", stem, round_.cast("string")))


def url_base(nth: Column) -> Column:
    return F.concat(F.lit("https://"), F.regexp_replace(F.lower(company_base(nth)), " ", "-"), F.lit(".example.com"))


def ip_base(nth: Column, six: Column) -> Column:
    """Addresses of the documentation networks, then of the benchmark network; for IPv6 of the documentation prefix."""
    three = F.element_at(F.array(F.lit("203.0.113."), F.lit("198.51.100."), F.lit("192.0.2.")), (F.floor(nth / 254) % 3).cast("int") + 1)
    small = F.concat(three, (nth % 254 + 1).cast("string"))
    m = nth - 762
    large = F.concat(F.lit("198."), (18 + F.floor(m / 65536) % 2).cast("string"), F.lit("."), (F.floor(m / 256) % 256).cast("string"), F.lit("."), (m % 256).cast("string"))
    beyond = F.concat(F.lit("10."), (F.floor((m - 131072) / 65536) % 256).cast("string"), F.lit("."), (F.floor(m / 256) % 256).cast("string"), F.lit("."), (m % 256).cast("string"))
    v4 = F.when(nth < 762, small).when(m < 131072, large).otherwise(beyond)
    v6 = F.concat(F.lit("2001:db8:0:0:0:"), F.lower(F.hex(F.floor(nth / (1 << 32)) % 65536)), F.lit(":"), F.lower(F.hex(F.floor(nth / 65536) % 65536)), F.lit(":"), F.lower(F.hex(nth % 65536)))
    return F.when(six, v6).otherwise(v4)


def address_base(nth: Column, hash_: Column, original: Column) -> Column:
    """Two lines in the United States, three in India; the house number runs with the value's number, so all differ."""
    us = original.rlike(r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b|(?i)\b(?:Washington|Kentucky|California|Texas|New York)\s+\d{5}")
    city = lambda table, i: _pick(tuple(c[i] for c in table), number(hash_, 20))
    digits = lambda n, at: F.lpad((number(hash_, at) % 10**n).cast("string"), n, "0")
    zip_ = F.concat(city(fixed.US_CITIES, 2), digits(2, 30), F.when(original.rlike(r"\b\d{5}-\d{4}\b"), F.concat(F.lit("-"), (1000 + number(hash_, 33) % 9000).cast("string"))).otherwise(""))
    place = F.concat(city(fixed.US_CITIES, 0), F.lit(", "), city(fixed.US_CITIES, 1), F.lit(" "), zip_)
    box = original.rlike(r"(?i)\bP\.?\s*O\.?\s+Box\b")
    home = F.when(box, F.concat(F.lit("P.O. Box "), (100000 + nth).cast("string"))).otherwise(F.concat((100 + nth).cast("string"), F.lit(" "), _pick(fixed.US_STREETS, number(hash_, 40))))
    flat = F.concat(F.lit("Flat "), (101 + nth).cast("string"), F.lit(", "), _pick(fixed.COMPANY_WORDS, number(hash_, 45)), F.lit(" Heights"))
    street = F.concat(_pick(fixed.STREETS, number(hash_, 40)), F.lit(", "), city(fixed.CITIES, 0), F.lit(" – "), city(fixed.CITIES, 2), digits(3, 30))
    return F.when(us, F.concat_ws("\n", home, place)).otherwise(F.concat_ws("\n", flat, street, F.concat(city(fixed.CITIES, 1), F.lit(", India"))))


# --- digits in a mask --------------------------------------------------------------------------------------------------

def fill_digits(mask: Column, stream: Column) -> Column:
    """The mask with its digits replaced, in turn, by those of the stream."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.when(digit, acc["i"] + 1).otherwise(acc["i"]).alias("i"), F.concat(acc["out"], F.when(digit, F.substring(stream, acc["i"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(mask, ""), start, step, lambda a: a["out"])


def digit_stream(hash_: Column) -> Column:
    """Some 54 decimal digits of a digest."""
    return F.concat(*(F.lpad(number(hash_, at).cast("string"), 18, "0") for at in (1, 17, 33)))


def spread(nth: Column, digits: int, salt: int) -> Column:
    """Another number of so many digits for every nth below 10 ** digits: a multiplication that can be undone."""
    return F.lpad(((nth * 7919 + salt) % 10**digits).cast("string"), digits, "0")


def luhn_complete(prefix: Column) -> Column:
    """The digits with the check digit behind them."""
    n = F.reverse(prefix)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(n, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(n) - 1), F.lit(0), step)
    return F.concat(prefix, ((10 - total % 10) % 10).cast("string"))


def verhoeff_complete(prefix: Column) -> Column:
    inverse = F.array(*(F.lit(str(next(d for d in range(10) if checks.TURNS[c][d] == 0))) for c in range(10)))
    return F.concat(prefix, F.element_at(inverse, checks.verhoeff_sum(prefix, 1) + 1))


def letters(hash_: Column, at: int, count: int) -> Column:
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.concat(*(F.substring(alphabet, (F.conv(F.substring(hash_, at + 2 * i, 2), 16, 10).cast("int") % 26) + 1, F.lit(1)) for i in range(count)))


def case_like(original: Column, value: Column) -> Column:
    """All capitals or all small, if the original's letters are."""
    only = F.regexp_replace(original, r"[^\p{L}]", "")
    return F.when((only != "") & (F.upper(only) == only) & (F.lower(only) != only), F.upper(value)).when((only != "") & (F.lower(only) == only) & (F.upper(only) != only), F.lower(value)).otherwise(value)


# --- bases and surfaces ------------------------------------------------------------------------------------------------

def _by_type(pii_type: Column, makers: dict, types: frozenset[str], otherwise: Column) -> Column:
    """The maker's column of each wanted type; the others' are never built, which keeps plans small."""
    out = None
    for kind, make in makers.items():
        if kind in types:
            out = F.when(pii_type == kind, make()) if out is None else out.when(pii_type == kind, make())
    return otherwise if out is None else out.otherwise(otherwise)


def base_value(pii_type: Column, canonical_: Column, nth: Column, hash_: Column, sample: Column, seed: int, types: frozenset[str] = ALL_TYPES) -> Column:
    """One value for each canonical value; surfaces are derived from it."""
    n = checks.digits(sample)
    stream = digit_stream(hash_)
    own = spread(nth, 6, seed)  # differs for every value, in the last digits
    wide = spread(nth, 9, seed)
    full = F.raise_error(F.lit("more values than a substitute's shape has room for"))

    def body(size: Column) -> Column:
        """So many digits, of which the last nine, or six of a short one, differ for every value."""
        return F.when(size >= 9, F.concat(F.substring(stream, F.lit(1), size - 9), F.when(nth < 10**9, wide).otherwise(full))).when(nth < 10**6, F.concat(F.substring(stream, F.lit(1), size - 6), own)).otherwise(full)


    def phone() -> Column:
        indian = sample.rlike(r"^\s*\+") & n.startswith("91")
        national = F.when(indian, F.substring(n, 3, 20)).otherwise(n)
        area = F.when(national.rlike("^0") & (F.length(national) >= 9), F.substring(national, 1, 3)).when(national.rlike("^[1-5]") & (F.length(national) >= 9), F.substring(national, 1, 2)).when(F.length(national) == 10, (6 + number(hash_, 50) % 4).cast("string")).otherwise(F.lit(""))
        return F.concat(F.when(indian, F.lit("91")).otherwise(""), area, body(F.length(national) - F.length(area)))

    def ssn() -> Column:
        area = F.lpad((1 + number(hash_, 40) % 665).cast("string"), 3, "0")
        return F.concat(area, F.lit("-"), F.lpad((1 + F.floor(nth / 9999) % 99).cast("string"), 2, "0"), F.lit("-"), F.lpad((1 + nth % 9999).cast("string"), 4, "0"))

    def born() -> Column:
        """Birthdays are 28 to 67 years before a fixed year, so reruns agree in any year."""
        return F.make_date((1957 + number(hash_, 5) % 40).cast("int"), (1 + number(hash_, 9) % 12).cast("int"), (1 + number(hash_, 12) % 28).cast("int")).cast("string")

    def cin() -> Column:
        kept = F.upper(sample)
        return F.concat(F.substring(kept, 1, 1), F.substring(stream, 1, 5), _pick(fixed.STATES, number(hash_, 20)), (1980 + number(hash_, 30) % 45).cast("string"), F.substring(kept, 13, 3), own)

    makers = {
        "PERSON": lambda: person_base(nth), "COMPANY": lambda: company_base(nth), "URL": lambda: url_base(nth),
        "EMAIL": lambda: F.concat(F.lower(_syllables(nth, 3)), F.lit("."), F.lower(_syllables(nth + F.floor(nth / 90**3), 3, "kar")), F.lit("@example.com")),
        "POSTAL_ADDRESS": lambda: address_base(nth, hash_, sample), "PHONE": phone, "SSN": ssn, "CREDIT_CARD": lambda: luhn_complete(F.concat(F.substring(n, 1, 1), body(F.length(n) - 2))),
        "IP_ADDRESS": lambda: ip_base(nth, sample.contains(":")), "DATE_OF_BIRTH": born, "PAN": lambda: F.concat(letters(hash_, 1, 3), _pick(_LETTERS, F.floor(nth / 10**4)), _pick(_LETTERS, F.floor(nth / (26 * 10**4))), spread(nth, 4, seed), letters(hash_, 20, 1)),
        "AADHAAR": lambda: verhoeff_complete(F.concat((2 + number(hash_, 50) % 8).cast("string"), body(F.lit(10)))), "DIN": lambda: spread(nth, 8, seed + 1), "CIN": cin,
        "SEBI_REG_NO": lambda: _alnum(sample, hash_, own, 2), "IFSC": lambda: F.concat(F.lit("FAKE0"), own), "BANK_ACCOUNT": lambda: body(F.length(n)),
        "GSTIN": lambda: _alnum(sample, hash_, own, 0), "PASSPORT": lambda: F.concat(letters(hash_, 1, 1), (1 + number(hash_, 40) % 9).cast("string"), own),
    }
    guarded = {kind: (lambda make=make, most=_ROOM.get(kind): make() if most is None else F.when(nth < most, make()).otherwise(full)) for kind, make in makers.items()}
    return _by_type(pii_type, guarded, types, F.lit(None).cast("string"))


def _alnum(mask: Column, hash_: Column, own: Column, keep: int) -> Column:
    """Letters for letters and digits for digits, the first `keep` characters as they are; the digits end in `own`."""
    stream = digit_stream(hash_)
    many = F.regexp_count(mask, F.lit("[0-9]"))
    filled = fill_digits(mask, F.concat(F.substring(stream, F.lit(1), F.greatest(many - 6, F.lit(0))), F.substring(own, F.greatest(F.lit(1), 7 - many), F.lit(6))))
    chars = F.transform(F.split(filled, ""), lambda c, i: F.when((i >= keep) & c.rlike("[A-Za-z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.conv(F.substring(hash_, (i % 60) + 1, F.lit(2)), 16, 10).cast("int") % 26) + 1, F.lit(1))).otherwise(c))
    return F.array_join(chars, "")


def surface(pii_type: Column, original: Column, canonical_: Column, base: Column, metadata: Column, types: frozenset[str] = ALL_TYPES) -> Column:
    """The substitute in the shape of one occurrence: number of names, possessive, case, separators, lines or segments."""
    part, parts = (F.try_element_at(metadata, F.lit(k)).cast("int") for k in ("block_segment_index", "block_segment_count"))
    segmented = part.isNotNull() & parts.isNotNull()

    def cut(words: Column) -> Column:
        first, last = (F.round(x * F.size(words) / parts).cast("int") for x in (part, part + 1))
        return F.array_join(F.slice(words, first + 1, F.greatest(F.lit(0), last - first)), " ")

    def person() -> Column:
        fake, name = F.split(base, " "), F.regexp_replace(F.regexp_replace(original, f"(?i){fixed.HONORIFIC}", ""), "['’]s$", "")
        tokens, whole = F.size(F.split(F.trim(name), r"(?U)\s+")), F.size(F.split(canonical_, r"(?U)\s+"))
        some = F.when(tokens == 1, F.element_at(fake, -1)).when((tokens == 2) & (whole > 2), F.concat_ws(" ", fake[0], F.element_at(fake, -1))).otherwise(base)
        return F.when(segmented, case_like(original, cut(fake))).otherwise(F.concat(case_like(name, some), F.regexp_extract(original, "(['’]s)$", 1)))

    def company() -> Column:
        suffix = F.regexp_extract(canonical_, f"(?iU){fixed.COMPANY_SUFFIX}", 1)
        whole = F.concat(F.when(canonical_.rlike(r"^(?i:the)\s"), F.lit("The ")).otherwise(""), base, F.lit(" "), F.when(suffix == "", F.lit("Limited")).otherwise(F.initcap(suffix)))
        return case_like(original, F.when(segmented, cut(F.split(whole, " "))).otherwise(whole))

    def address() -> Column:
        lines, wanted = F.split(base, "\n"), F.size(F.split(original, "\n"))
        segment = F.when(parts == 1, F.array_join(lines, ", ")).when(part >= parts - 1, F.array_join(F.slice(lines, part + 1, F.lit(9)), ", ")).otherwise(F.coalesce(F.try_element_at(lines, part + 1), F.lit("")))
        two = F.when(F.size(lines) == 2, base).otherwise(F.concat(lines[0], F.lit(", "), F.try_element_at(lines, F.lit(2)), F.lit("\n"), F.try_element_at(lines, F.lit(3))))
        padded = F.array_join(F.slice(F.concat(lines, F.array_repeat(F.lit(""), F.greatest(F.lit(0), wanted - 3))), F.lit(1), wanted), "\n")
        return F.when(segmented, segment).when(wanted == 1, F.array_join(lines, ", ")).when(wanted == 2, two).otherwise(padded)

    def birth() -> Column:
        day, sep = base.try_cast("date"), F.regexp_extract(original, "([/.-])", 1)
        numbers = F.concat(F.date_format(day, "dd"), sep, F.date_format(day, "MM"), sep, F.date_format(day, "yyyy"))
        return F.when(original.rlike("^[A-Za-z]"), F.date_format(day, "MMMM d, yyyy")).when(original.rlike("[A-Za-z]"), F.date_format(day, "d MMMM yyyy")).otherwise(numbers)

    masked = {k: lambda: fill_digits(original, base) for k in ("PHONE", "CREDIT_CARD", "AADHAAR", "BANK_ACCOUNT")}
    makers = {"PERSON": person, "COMPANY": company, "POSTAL_ADDRESS": address, "URL": lambda: F.concat(base, url_tail(original)), "DATE_OF_BIRTH": birth} | masked
    return _by_type(pii_type, makers, types, base)


def assign(spans: DataFrame, seed: int = 42, per_document: bool = False, types: frozenset[str] = ALL_TYPES) -> DataFrame:
    """spans: one row each with doc_id, pii_type, text, metadata. Adds canonical and replacement.

    One substitute for each type and canonical value: everywhere, or within a document. Emails take up the substitutes of the
    people whose names their local parts hold. Surnames that occur are not used as substitutes of others: made-up names are
    joined against the real ones and take a further syllable where they would meet.
    """
    by = ("doc_id", "pii_type") if per_document else ("pii_type",)
    named = spans.withColumn("canonical", canonical(F.col("pii_type"), F.col("text"), F.try_element_at("metadata", F.lit("canonical"))))
    values = named.groupBy(*by, "canonical").agg(F.min("text").alias("_sample"))
    bases = held(numbered(held(values), seed, by)).withColumn("_base", base_value(F.col("pii_type"), F.col("canonical"), F.col("_nth"), F.col("_hash"), F.col("_sample"), seed, types))
    if "PERSON" in types:
        bases = _linked_emails(_without_real_names(held(bases), by), by)
    bases = held(bases.select(*by, "canonical", "_base"))
    return named.join(bases, [*by, "canonical"]).withColumn("replacement", surface(F.col("pii_type"), F.col("text"), F.col("canonical"), F.col("_base"), F.col("metadata"), types)).drop("_base")


def protected_surnames(values: DataFrame) -> DataFrame:
    """surname: last names of at least three letters of people with two names or more."""
    words = F.regexp_extract_all("canonical", F.lit("[A-Za-z][A-Za-z'’-]*"), F.lit(0))
    rows = values.where("pii_type = 'PERSON'").select(words.alias("w")).where("size(w) >= 2")
    return rows.select(F.lower(F.element_at("w", -1)).alias("surname")).where("length(surname) >= 3").distinct()


def _without_real_names(bases: DataFrame, by: tuple[str, ...]) -> DataFrame:
    real = protected_surnames(bases).select(F.col("surname").alias("_last"), F.lit(True).alias("_real"))
    rows = bases.withColumn("_last", F.lower(F.element_at(F.split("_base", " "), -1))).join(real, "_last", "left")
    return rows.withColumn("_base", F.when((F.col("pii_type") == "PERSON") & F.col("_real"), F.concat("_base", F.lit("wadi"))).otherwise(F.col("_base"))).drop("_last", "_real")


def _linked_emails(bases: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """first.last of a person's substitute for local parts that are made of that person's names; the first of several by name.
    A second address of one person keeps a base of its own, so that no two addresses become one."""
    scope = [c for c in by if c != "pii_type"]
    people = bases.where("pii_type = 'PERSON'").select(*scope, F.split("canonical", " ").alias("t"), "canonical", F.col("_base").alias("_fake")).where("size(t) >= 2")
    keyed = people.select(*scope, F.concat_ws(".", F.regexp_replace(F.col("t")[0], "[^a-z]", ""), F.regexp_replace(F.element_at("t", -1), "[^a-z]", "")).alias("_key"), "canonical", "_fake")
    keyed = keyed.groupBy(*scope, "_key").agg(F.min_by("_fake", "canonical").alias("_fake"))
    local = F.array_join(F.filter(F.split(F.substring_index("canonical", "@", 1), "[^a-z]+"), lambda x: x != ""), ".")
    mail = bases.withColumn("_key", F.when(F.col("pii_type") == "EMAIL", local)).join(keyed, [*scope, "_key"], "left")
    # Only the addresses of one person are ranked; all other values stay where they are.
    own = mail.where("_fake IS NOT NULL").withColumn("_turn", F.row_number().over(Window.partitionBy(*by, "_fake", "_key").orderBy("_hash")))
    linked = F.concat(F.regexp_replace(F.lower("_fake"), " ", "."), F.when(F.col("_turn") > 1, F.col("_turn").cast("string")).otherwise(""), F.lit("@example.com"))
    return own.withColumn("_base", linked).drop("_key", "_fake", "_turn").unionByName(mail.where("_fake IS NULL").drop("_key", "_fake"))


def collisions(assigned: DataFrame) -> DataFrame:
    """Substitutes that stand for more than one value; empty if the assignment is injective. Single names and segments of
    people and companies are left out: they stand for whole names."""
    whole = ~F.coalesce(F.map_contains_key("metadata", F.lit("block_segment_index")), F.lit(False)) & ~((F.col("pii_type") == "PERSON") & ~F.col("text").contains(" ")) & ~F.col("pii_type").isin("DATE_OF_BIRTH")
    return assigned.where(whole).groupBy(F.lower("replacement").alias("replacement")).agg(F.count_distinct("pii_type", "canonical").alias("n_values")).where("n_values > 1")


def host_collisions(assigned: DataFrame) -> DataFrame:
    """Hosts of substitute URLs that stand for more than one registrable domain."""
    urls = assigned.where("pii_type = 'URL'").select("canonical", domain(F.col("replacement")).alias("_site"), F.regexp_extract("replacement", "^https?://([^/?#]+)", 1).alias("host"))
    return urls.groupBy("host").agg(F.count_distinct("canonical").alias("n_values")).where("n_values > 1")
