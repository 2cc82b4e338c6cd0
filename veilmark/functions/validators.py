"""Checks of numbers that a pattern alone can't settle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: The permutation of digits by position that the Verhoeff scheme uses.
PERMUTED = (
    "0123456789",
    "1576283094",
    "5803796142",
    "8916043527",
    "9453126870",
    "4286573901",
    "2793806415",
    "7046913258",
)


def _dihedral(a: int, b: int) -> int:
    """The product in the dihedral group of ten elements: 0-4 turn, 5-9 turn and mirror."""
    turn = (a + b) % 5 if a < 5 else (a - b) % 5
    return turn + (0 if (a < 5) == (b < 5) else 5)


PRODUCTS = [_dihedral(a, b) for a in range(10) for b in range(10)]


def digits(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "[^0-9]", "")


def luhn(x: Column | str) -> Column:
    """Mod-10 check of a text of digits only; anything else fails."""
    return F.call_function("luhn_check", col(x))


def is_payment_card(x: Column | str) -> Column:
    d = digits(x)
    return F.length(d).isin(13, 14, 15, 16, 19) & F.substring(d, 1, 1).between("3", "6") & luhn(d)


def verhoeff(x: Column | str) -> Column:
    """The Verhoeff check, from the last digit to the first, as a fold over a table of group products."""
    table = F.array(*[F.lit(p) for p in PRODUCTS])
    rows = F.array(*[F.lit(p) for p in PERMUTED])
    turned = F.split(F.reverse(col(x)), "")
    pairs = F.transform(turned, lambda d, i: F.substring(F.element_at(rows, (i % 8 + 1).cast("int")), d.try_cast("int") + 1, F.lit(1)).try_cast("int"))
    fold = F.aggregate(pairs, F.lit(0), lambda c, d: F.element_at(table, c * 10 + d + 1))
    return F.when(col(x).rlike("^[0-9]+$"), fold == 0).otherwise(False)


def is_aadhaar(x: Column | str) -> Column:
    d = digits(x)
    return F.when(d.rlike("^[2-9][0-9]{11}$"), verhoeff(d)).otherwise(False)


def is_phone(x: Column | str) -> Column:
    """With a plus sign 8 to 15 digits, else ten digits that begin with 6 to 9."""
    d = digits(x)
    return F.when(F.ltrim(col(x)).startswith("+"), F.length(d).between(8, 15)).otherwise(d.rlike("^[6-9][0-9]{9}$"))
