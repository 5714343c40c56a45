"""Id mixers behind partitioners and reproducible random choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the affine mixer
MODULUS = 2147483647
FACTOR = 1000003


def affine(c: Column) -> Column:
    """``c * 1000003 mod 2147483647`` without leaving 64 bits; for checks against other engines."""
    return F.pmod(F.pmod(c, F.lit(MODULUS)) * F.lit(FACTOR), F.lit(MODULUS))


def mix(c: Column, mode: str = "xxhash64") -> Column:
    return affine(c) if mode == "affine" else F.xxhash64(c)


def pair_mix(a: Column, b: Column, mode: str = "xxhash64") -> Column:
    """Mixer of an ordered pair."""
    if mode == "affine":
        return F.pmod(affine(a) * F.lit(31) + affine(b), F.lit(MODULUS))
    return F.xxhash64(a, b)


def draw(source: Column, walk: Column, step: Column, current: Column, seed: int = 0, mode: str = "xxhash64") -> Column:
    """Non-negative pseudo-random number of one step of one walk."""
    if mode == "affine":
        bounded = F.pmod(source, F.lit(MODULUS)) * F.lit(1000003) + walk.cast("long") * F.lit(7919)
        return bounded + step.cast("long") * F.lit(104729) + F.pmod(current, F.lit(MODULUS)) * F.lit(31) + F.lit(7)
    mixed = F.xxhash64(F.lit(seed).cast("long"), source, walk.cast("long"), step.cast("long"), current)
    return mixed.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
