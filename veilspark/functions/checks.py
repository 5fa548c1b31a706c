"""Checksums and shapes of personal numbers, as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the two control digits of a 12-digit tax number and of the one of a 10-digit number.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_SECOND = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\D", "")


def _digit(s: Column, i: int) -> Column:
    return F.substring(s, i + 1, 1).cast("int")


def _weighted(s: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(s, i) * w
    return total


def inn10(s: Column) -> Column:
    """s has ten digits, the last of which is the weighted sum modulo 11, a remainder of 10 counting as 0."""
    return F.coalesce(s.rlike(r"^[0-9]{10}$") & (_weighted(s, INN10) % 11 % 10 == _digit(s, 9)), F.lit(False))


def inn12(s: Column) -> Column:
    first = _weighted(s, INN12_FIRST) % 11 % 10 == _digit(s, 10)
    second = _weighted(s, INN12_SECOND) % 11 % 10 == _digit(s, 11)
    return F.coalesce(s.rlike(r"^[0-9]{12}$") & first & second, F.lit(False))


def inn(s: Column) -> Column:
    return F.when(F.length(s) == 10, inn10(s)).otherwise(inn12(s))


def snils(s: Column) -> Column:
    """Eleven digits, not from 000 or 001; the last two equal the sum modulo 101 (so a remainder of 100 never passes)."""
    d = digits_only(s)
    sum_ = _weighted(d, tuple(range(9, 0, -1)))
    return F.coalesce(d.rlike(r"^[0-9]{11}$") & ~F.substring(d, 1, 3).isin("000", "001") & (sum_ % 101 == F.substring(d, 10, 2).cast("int")), F.lit(False))


def card(s: Column) -> Column:
    d = digits_only(s)
    return F.coalesce(F.length(d).between(13, 19) & F.call_function("luhn_check", d), F.lit(False))


def phone(s: Column) -> Column:
    d = digits_only(s)
    return F.coalesce(((F.length(d) == 11) & F.substring(d, 1, 1).isin("7", "8")) | (F.length(d) == 10), F.lit(False))


def passport(s: Column) -> Column:
    """Ten digits whose first two, the region, are not 00."""
    d = digits_only(s)
    return F.coalesce((F.length(d) == 10) & F.substring(d, 1, 2).cast("int").between(1, 99), F.lit(False))


Validator = Callable[[Column], Column]
