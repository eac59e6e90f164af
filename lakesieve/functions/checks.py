"""Checks of identifiers: checksums, issuers, ranges. Columns in, booleans out, in the JVM; plain values where a check digit is
made for a substitute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _turn(a: int, b: int) -> int:
    """The product of two symmetries of a pentagon: 0 to 4 are rotations, 5 to 9 reflections."""
    r, s = a % 5, b % 5
    if a < 5:
        return (r + s) % 5 + (5 if b >= 5 else 0)
    return (r - s) % 5 + (0 if b >= 5 else 5)


def _positions() -> list[list[int]]:
    """Powers of the permutation that moves a digit on by one position."""
    once = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([once[x] for x in rows[-1]])
    return rows


TURNS = [[_turn(a, b) for b in range(10)] for a in range(10)]
POSITIONS = _positions()


def luhn(value: Column, repeated: bool = False) -> Column:
    """13 to 19 digits, not all the same (unless repeated), whose check digit is right."""
    n = digits(value)
    return F.length(n).between(13, 19) & (F.lit(repeated) | ~n.rlike(r"^([0-9])\1*$")) & F.coalesce(F.call_function("luhn_check", n), F.lit(False))


def verhoeff_sum(number: Column, shift: int = 0) -> Column:
    """The checksum over a string of digits, read from the right; shift: the position of the last digit."""
    turns = F.array(*(F.lit(x) for row in TURNS for x in row))
    places = F.array(*(F.lit(x) for row in POSITIONS for x in row))
    n = F.reverse(number)

    def step(acc: Column, i: Column) -> Column:
        digit = F.substring(n, i + 1, F.lit(1)).cast("int")
        return F.element_at(turns, acc * 10 + F.element_at(places, ((i + shift) % 8) * 10 + digit + 1) + 1)

    return F.aggregate(F.sequence(F.lit(0), F.length(n) - 1), F.lit(0), step)


def verhoeff(value: Column) -> Column:
    n = digits(value)
    return (F.length(n) > 0) & (verhoeff_sum(n) == 0)


def known_issuer(value: Column) -> Column:
    n = digits(value)
    two, three, four, six = (F.substring(n, 1, k).try_cast("int") for k in (2, 3, 4, 6))
    # Ranges of issuer numbers.
    return F.coalesce(
        n.startswith("4") | two.between(51, 55) | four.between(2221, 2720) | two.isin(34, 37) | (four == 6011) | (two == 65) | three.between(644, 649)
        | four.between(3528, 3589) | two.isin(36, 38, 39) | three.between(300, 305) | two.between(60, 65) | two.between(81, 89) | six.between(508000, 508999),
        F.lit(False),
    )


def ssn(value: Column) -> Column:
    """Area not 000, 666 or from 900 on; group not 00; serial not 0000."""
    area, group, serial = (F.substring(value, a, n) for a, n in ((1, 3), (5, 2), (8, 4)))
    return ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")


_OCTET = "(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def ip(value: Column) -> Column:
    """IPv4 with octets up to 255 and no leading zeros, or IPv6 of eight groups or with one run of zeros left out."""
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    full = value.rlike("^(?i:[0-9a-f]{1,4}:){7}(?i:[0-9a-f]{1,4})$")
    short = value.contains("::") & ~value.contains(":::") & (F.size(F.split(value, "::")) == 2) & ~value.rlike("^:[^:]") & ~value.rlike("[^:]:$") & (groups <= 7) & (value != "::")
    return value.rlike(f"^{_OCTET}(?:[.]{_OCTET}){{3}}$") | full | short


def luhn_digit(prefix: str) -> str:
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(prefix)))
    return str(-total % 10)


def verhoeff_digit(prefix: str) -> str:
    check = 0
    for i, c in enumerate(reversed(prefix), 1):
        check = TURNS[check][POSITIONS[i % 8][int(c)]]
    return str(next(d for d in range(10) if TURNS[check][d] == 0))
