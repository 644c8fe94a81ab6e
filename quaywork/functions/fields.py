"""Parsers of canonical fields: a text column to its value and what is wrong with it, without leaving the JVM.

A parser gives ``Parsed``: the value, and conditions in the order in which they are tried, each with a code and message.
The message of the first that holds is the field's problem; the value only counts where none does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import STATUSES
from .dates import iso_day
from .text import BLANK, clipped, has_control, is_ascii, trimmed

Problem = tuple[Column, str, Column]

# What is said of a field that can't be read, here and in the parsers below, and how much of it is quoted.
NUMBER_HELP = " is not a valid number. Use digits with an optional decimal point, e.g. 1250.50 (no currency symbols, thousands separators or spaces)."
CONTROL = "Value contains control characters (tabs, line breaks or other non-printing characters)."
MOST_SHOWN = 40


@dataclass
class Parsed:
    value: Column
    problems: list[Problem]


Parser = Callable[[Column], Parsed]


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def quoted(text: Column) -> Column:
    return _say('"', clipped(text, MOST_SHOWN), '"')


def plain_text(most: int, collapse: bool = False) -> Parser:
    """Up to ``most`` UTF-16 units; ``collapse`` turns inner white space into one space."""

    def parse(raw: Column) -> Parsed:
        text = F.regexp_replace(raw, f"{BLANK}+", " ") if collapse else raw
        # lengths count as UTF-16 units: characters above the basic plane are two
        length = F.when(is_ascii(text), F.length(text)).otherwise(F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", "")))
        return Parsed(text, [(length > most, "TOO_LONG", F.lit(f"Value exceeds {most} characters."))])

    return parse


def identifier(label: str) -> Parser:
    def parse(raw: Column) -> Parsed:
        value = F.upper(raw)
        said = _say(quoted(raw), f" is not a valid {label}. Use 3–32 letters, digits or hyphens, starting with a letter or digit.")
        return Parsed(value, [(~value.rlike(r"^[A-Z0-9][A-Z0-9-]{2,31}\z"), "INVALID_FORMAT", said)])

    return parse


def _range(raw: Column, value: Column, least: int, most: int) -> list[Problem]:
    below = F.startswith(raw, F.lit("-")) & raw.rlike("[1-9]")
    outside = value.isNull() | (value < least) | (value > most)
    return [(below, "NEGATIVE", _say("Must not be negative (got ", raw, ").")), (outside, "OUT_OF_RANGE", _say(f"Must be between {least} and {most} (got ", raw, ")."))]


def whole(least: int, most: int) -> Parser:
    def parse(raw: Column) -> Parsed:
        value = raw.try_cast("long")
        shaped = raw.rlike(r"^-?\d+\z")
        decimal = raw.rlike(r"^-?\d+\.\d+\z")
        return Parsed(value, [(decimal, "NOT_INTEGER", _say(quoted(raw), " must be a whole number.")), (~shaped, "INVALID_NUMBER", _say(quoted(raw), NUMBER_HELP)), *_range(raw, value, least, most)])

    return parse


def _decimal_shape(raw: Column, places: int) -> list[Problem]:
    long = raw.rlike(rf"\.\d{{{places + 1},}}\z")
    return [(~raw.rlike(r"^-?\d+(\.\d+)?\z"), "INVALID_NUMBER", _say(quoted(raw), NUMBER_HELP)), (long, "TOO_MANY_DECIMALS", _say(quoted(raw), f" has more than {places} decimal places."))]


def decimal(least: int, most: int, places: int = 2) -> Parser:
    def parse(raw: Column) -> Parsed:
        value = raw.try_cast("double")
        return Parsed(value, [*_decimal_shape(raw, places), *_range(raw, value, least, most)])

    return parse


def money(most_cents: int) -> Parser:
    """Dollars as whole cents, without floating point."""

    def parse(raw: Column) -> Parsed:
        part = F.rpad(F.regexp_extract(raw, r"\.(\d{1,2})\z", 1), 2, "0")
        cents = F.concat(F.regexp_extract(raw, r"^-?(\d+)", 1), part).try_cast("long")
        problems = [*_decimal_shape(raw, 2), *_range(raw, cents, 0, most_cents)]
        code, said = problems[-1][1], _say(f"Must be between 0 and {most_cents / 100:.2f} (got ", raw, ").")
        return Parsed(cents, [*problems[:-1], (problems[-1][0], code, said)])

    return parse


def day(raw: Column) -> Parsed:
    """YYYY-MM-DD from 2000 to 2100; a date that a spreadsheet rewrote gets a hint."""
    shaped = raw.rlike(r"^\d{4}-\d{2}-\d{2}\z")
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})\z"
    at = lambda i: F.regexp_extract(raw, slash, i)
    meant = F.concat_ws("-", at(3), F.lpad(at(1), 2, "0"), F.lpad(at(2), 2, "0"))
    example = F.when(iso_day(meant)["code"].isNull(), _say(", e.g. ", meant)).otherwise("")
    hint = _say(quoted(raw), " looks like Excel changed this date to M/D/YYYY. Dates must be YYYY-MM-DD", example, ". Re-download the file and upload it without opening it in Excel.")
    found = iso_day(raw)
    return Parsed(found["value"], [
        (raw.rlike(slash), "INVALID_DATE", hint),
        (~shaped, "INVALID_DATE", _say(quoted(raw), " is not a valid date. Use YYYY-MM-DD, e.g. 2026-03-15.")),
        (found["code"] == "INVALID_DATE", "INVALID_DATE", _say(quoted(raw), " is not a real calendar date.")),
        (found["code"] == "OUT_OF_RANGE", "OUT_OF_RANGE", _say("Year must be between 2000 and 2100 (got ", raw, ").")),
    ])


def status(raw: Column) -> Parsed:
    value = F.regexp_replace(F.lower(raw), f"(?:{BLANK}|-)+", "_")
    return Parsed(value, [(~value.isin(*STATUSES), "INVALID_STATUS", _say(quoted(raw), f" is not a valid status. Use one of: {', '.join(STATUSES)}."))])


def warehouse(codes: list[str]) -> Parser:
    """A code of the reference dimension, whatever its case."""

    def parse(raw: Column) -> Parsed:
        value = F.upper(raw)
        known = value.isin(*codes) if codes else F.lit(False)
        return Parsed(value, [(~known, "UNKNOWN_WAREHOUSE", _say("Unknown warehouse ", quoted(raw), f". Valid codes: {', '.join(codes)}."))])

    return parse


def field(raw: Column | None, parser: Parser, required: bool, default: Column | None = None) -> tuple[Column, Column]:
    """A field's value and its problem (a struct of code and message, null if there is none).

    ``raw`` is trimmed; None stands for a column that the table hasn't. A blank is a problem where ``required``, else the
    default; control characters are one before the parser is asked.
    """
    text = trimmed(F.coalesce(raw, F.lit(""))) if raw is not None else F.lit("")
    parsed = parser(text)
    problem = lambda code, said: F.struct(F.lit(code).alias("code"), said.alias("message"))
    blank = text == ""
    found = F.when(blank, problem("REQUIRED", F.lit("Value is required.")) if required else F.lit(None)).when(has_control(text), problem("CONTROL_CHARS", F.lit(CONTROL)))
    for when, code, said in parsed.problems:
        found = found.when(when, problem(code, said))
    return F.when(blank, F.lit(None) if default is None else default).otherwise(parsed.value), found
