"""Money, rounding and distance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_MILES


def half_up(x: Column) -> Column:
    """The nearest whole number, halves upwards, below zero too."""
    return F.floor(x + F.lit(0.5))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def fixed(x: Column, places: int) -> Column:
    """``x`` with so many places, by the exact value of the double, exact halves away from zero; no group marks."""
    # format_number rounds exact halves to even; only numbers with so short a binary fraction are exact halves
    half = F.abs(x) * F.lit(float(2 << places)) % 2 == 1
    text = F.format_number(F.when(half, x + F.signum(x) * F.lit(10.0 ** -(places + 1))).otherwise(x), places)
    return F.replace(text, F.lit(","), F.lit(""))


def _signed(cents: Column, text: Column) -> Column:
    return F.concat(F.when(cents < 0, "-$").otherwise("$"), text)


def money_text(cents: Column) -> Column:
    """``$1,234.56``."""
    return _signed(cents, F.format_number(F.abs(cents) / 100.0, 2))


#: Marks of compact numbers and what they stand for.
UNITS = (("T", 1e12), ("B", 1e9), ("M", 1e6), ("K", 1e3))


def compact_money(cents: Column) -> Column:
    """``$12.3K``, ``$2K``, ``$1.24M``, ``$2.50B``; below $1,000 in full. What would read 1000 of a unit is 1 of the next."""
    dollars = F.abs(cents) / 100.0

    def said(i: int) -> Column:
        mark, unit = UNITS[i]
        x = dollars / unit
        short = F.when(x < 10, F.regexp_replace(fixed(x, 2), r"\.?0+$", "")).otherwise(fixed(x, 1))
        return F.concat(short if mark == "K" else fixed(x, 2), F.lit(mark))

    out = None
    for i, (_, unit) in enumerate(UNITS):
        text = said(i) if not i else F.when(fixed(dollars / unit, 1).cast("double") >= 1000, said(i - 1)).otherwise(said(i))
        out = (F if out is None else out).when(dollars >= unit, text)
    return _signed(cents, out.otherwise(F.format_number(dollars, 2)))


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles, rounded to a tenth; null if an end isn't known."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return half_up(F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h))) * 10) / 10


def projected(lat: Column, lon: Column, box: tuple[float, float, float, float] = (24.0, 50.0, -125.0, -66.0), size: tuple[int, int] = (1000, 600)) -> Column:
    """A struct (x, y) of an equirectangular map of ``box`` (south, north, west, east)."""
    south, north, west, east = box
    return F.struct(((lon - west) / (east - west) * size[0]).alias("x"), ((F.lit(north) - lat) / (north - south) * size[1]).alias("y"))
