"""Draws for rows from a counter: the numbers of mulberry32, of which row i's needs no row before it.

The generator's state only grows by a fixed step, so the state of draw i is seed + (i + 1) steps; what follows is a scramble of
that state. Products are taken in 32 bits: the low half of one factor times the other in 64-bit whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generator's step and the odd numbers of its scramble.
STEP, FIRST_ODD, SECOND_ODD = 0x6D2B79F5, 1, 61
WORD = (1 << 32) - 1


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of unsigned 32-bit numbers; no part exceeds 63 bits."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftrightunsigned(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(WORD)


def word(seed: Column | int, index: Column) -> Column:
    """Draw ``index`` (from 0) of the generator with this seed, as an unsigned 32-bit number."""
    start = (F.lit(seed) if isinstance(seed, int) else seed).cast("long").bitwiseAND(WORD)
    count = (index.cast("long") + 1).bitwiseAND(WORD)
    a = (start + _times(count, F.lit(STEP).cast("long"))).bitwiseAND(WORD)
    mixed = lambda x, shift, odd: _times(x.bitwiseXOR(F.shiftrightunsigned(x, shift)), x.bitwiseOR(odd))
    t = mixed(a, 15, FIRST_ODD)
    t = ((t + mixed(t, 7, SECOND_ODD)).bitwiseAND(WORD)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14))


def fraction(seed: Column | int, index: Column) -> Column:
    """A draw from 0 to below 1."""
    return word(seed, index) / F.lit(float(1 << 32))


def between(seed: Column | int, index: Column, least: int, most: int) -> Column:
    """A whole number from ``least`` to ``most``, both included."""
    return (F.floor(fraction(seed, index) * (most - least + 1)) + least).cast("long")


def picked(seed: Column | int, index: Column, values: list) -> Column:
    """One of ``values``."""
    return F.get(F.array(*[F.lit(v) for v in values]), between(seed, index, 0, len(values) - 1).cast("int"))


def swaps(seed: Column | int, first: Column, n: int) -> Column:
    """The order of 0 to n-1 after a shuffle that swaps from the end and takes draws ``first``, ``first`` + 1 and so on.

    For short lists: the order is one array.
    """

    def swapped(order: Column, step: Column) -> Column:
        last = F.lit(n - 1) - step
        other = F.floor(fraction(seed, first + step) * (last + 1)).cast("int")
        return F.transform(order, lambda x, i: F.when(i == other, F.get(order, last)).when(i == last, F.get(order, other)).otherwise(x))

    start = F.array(*[F.lit(i) for i in range(n)])
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 2)), start, swapped) if n > 1 else start
