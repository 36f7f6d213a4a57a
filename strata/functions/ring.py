"""Arithmetic on bytes as the ring of integers modulo 256, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def neg(x: Column) -> Column:
    return (F.lit(256) - x).bitwiseAND(F.lit(255))


def bnot(x: Column) -> Column:
    return F.lit(255) - x


def xor(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)


def band(x: Column, y: Column) -> Column:
    return x.bitwiseAND(y)


def bor(x: Column, y: Column) -> Column:
    return x.bitwiseOR(y)


def succ(x: Column) -> Column:
    """neg(bnot(x)): the next byte, 0 after 255."""
    return neg(bnot(x))


def pred(x: Column) -> Column:
    """bnot(neg(x)): the byte before, 255 before 0."""
    return bnot(neg(x))


def stratum(x: Column) -> Column:
    """How many bits are set."""
    return F.bit_count(x)


def spectrum(x: Column) -> Column:
    """The eight bits, lowest first, as booleans."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit(x, i) == 1)


def set_positions(x: Column) -> Column:
    """The places of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit(x, i) == 1)


def triad(x: Column) -> Column:
    return F.struct(x.alias("datum"), stratum(x).alias("stratum"), spectrum(x).alias("spectrum"))
