"""Exact amounts of mass, as four whole numbers.

An amount is ``a + b / 2^31 + c / 2^62 + d / 2^93``. Adding such amounts is exact, so sums do not
depend on the order of the terms, and dividing one is schoolbook division, rounded down to a whole
multiple of ``2^-93`` (about 1e-28): a unit of mass may pass through three vertices of 10^8
out-edges each and still be told to nine digits. Amounts stay below ``2^31``; up to ``2^32`` of
them may be added at a time; divisors stay below ``2^31``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 31
LIMBS = 4
_MASK = (1 << BITS) - 1


def names(prefix: str) -> list[str]:
    """Column names of one amount."""
    return [f"{prefix}{k}" for k in range(LIMBS)]


def from_double(value: Column) -> list[Column]:
    """The amount of a non-negative double; its digits below 2^-93 are dropped."""
    out = []
    for _ in range(LIMBS):
        out.append(F.floor(value).cast("long"))
        value = (value - F.floor(value)) * float(1 << BITS)
    return out


def to_double(amount: list[Column]) -> Column:
    """The nearest double, up to the last digit; equal amounts give equal doubles."""
    value = F.lit(0.0)
    for k in reversed(range(LIMBS)):
        value = amount[k].cast("double") * F.lit(2.0 ** (-BITS * k)) + value
    return value


def carried(amount: list[Column]) -> list[Column]:
    """The same amount with all but the first number below 2^31."""
    out, carry = [], F.lit(0).cast("long")
    for k in reversed(range(1, LIMBS)):
        total = amount[k] + carry
        out.append(total.bitwiseAND(F.lit(_MASK)))
        carry = F.shiftright(total, BITS)
    return [amount[0] + carry, *reversed(out)]


def divided(amount: list[Column], by: Column) -> list[Column]:
    """A carried amount over a whole number; the result is carried."""
    out, rest = [], F.lit(0).cast("long")
    for limb in amount:
        total = rest * F.lit(1 << BITS) + limb
        rest = total % by
        out.append(F.call_function("div", total, by))
    return out


def scaled(amount: list[Column], factor: float) -> list[Column]:
    """A carried amount times a factor up to 1, taken as the nearest fraction of whole numbers."""
    part = Fraction(factor).limit_denominator(_MASK)
    more = carried([limb * F.lit(part.numerator) for limb in amount])
    return divided(more, F.lit(part.denominator).cast("long"))
