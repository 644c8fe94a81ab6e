"""Text expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, no-break and zero-width forms included.
BLANK = r"[\s\u0085   -     　﻿]"


#: The characters of ``BLANK``, as a text.
BLANKS = " \t\n\v\f\r\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    """Without white space at both ends; no regular expression, for every cell of a table passes here."""
    return F.btrim(text, F.lit(BLANKS))


def is_ascii(text: Column) -> Column:
    """Whether every character is one byte, so that there are no accents and no characters above the basic plane."""
    return F.length(text) == F.octet_length(text)


def place_key(text: Column) -> Column:
    """Trimmed, inner white space as one space, upper case: how places are compared."""
    return F.upper(F.regexp_replace(trimmed(text), f"{BLANK}+", " "))


def _unaccented() -> tuple[str, str]:
    """Latin letters that are a base letter with marks, and those base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    return tuple("".join(x) for x in zip(*[(a, b) for a, b in pairs if b.isascii() and a != b], strict=True))


ACCENTED, BASE = _unaccented()


def unaccented(text: Column) -> Column:
    """Latin letters with marks as their base letters."""
    return F.when(is_ascii(text), text).otherwise(F.translate(text, ACCENTED, BASE))


def natural_key(text: Column) -> Column:
    """A key whose plain order puts a2 before a10: case and Latin accents ignored, runs of digits by their value."""
    parts = F.regexp_extract_all(F.lower(unaccented(text)), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: F.ltrim(p, F.lit("0"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), 4, "0"), number(p))).otherwise(p)), "")


#: Letters by their base form, whatever case and accents; punctuation before symbols, digits and letters.
COLLATION = "en_CI_AI"


def collated(text: Column) -> Column:
    """A sort key in a collator's order for English: base letters only, runs of ASCII digits by their value.

    A run of digits is written as the length of its value and the value, so comparing digit by digit compares numbers. Texts that differ
    in case or accents alone tie.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: F.ltrim(p, F.lit("0"))
    valued = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), 4, "0"), number(p))).otherwise(p))
    return F.collate(F.array_join(valued, ""), COLLATION)


def matches_search(query: str, *columns: str) -> Column:
    """Every word of ``query`` is in some column, whatever its case; nulls hold nothing. An empty query matches all."""
    hit = F.lit(True)
    for term in query.lower().split():
        hit = hit & F.coalesce(F.greatest(*[F.contains(F.lower(F.col(c)), F.lit(term)) for c in (*columns, *columns[:1])]), F.lit(False))
    return hit


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x1f\x7f]")


def counted(n: Column, one: str, many: str) -> Column:
    """``1 day``, ``1,200 days``."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many))


def alias_key(text: Column) -> Column:
    """How names of columns are compared: trimmed, lower case, runs of white space and ``_ - . / ( )`` as one space."""
    return F.trim(F.regexp_replace(F.lower(trimmed(text)), rf"(?:{BLANK}|[_\-./()])+", " "))


def status_label(status: Column) -> Column:
    return F.when(status == "in_transit", "In transit").otherwise(F.initcap(status))
