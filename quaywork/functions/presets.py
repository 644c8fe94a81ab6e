"""Numbers and dates as they are written in different places, brought to one form; placeholders and currency marks."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_ascii, trimmed, unaccented

# What stands for "no value", currency marks, and the ways of writing numbers and dates.
PLACEHOLDERS = ("n/a", "na", "n.a.", "#n/a", "null", "none", "-", "--", "–", "—")
#: Placeholders in every mix of cases, so that no cell need be lowered.
PLACEHOLDER_FORMS = tuple(sorted({"".join(x) for p in PLACEHOLDERS for x in product(*[{c.lower(), c.upper()} for c in p])}))
CURRENCIES = (
    "€", "£", "¥", "₫", "₹", "₩", "₽", "฿", "₺", "₪", "₱", "eur", "gbp", "jpy", "vnd", "inr", "cny", "krw", "cad", "aud", "chf", "mxn", "brl",
    "sek", "nok", "dkk", "pln", "czk", "huf", "try", "aed", "sgd", "hkd", "nzd", "zar", "thb", "idr", "myr", "php",
)
NUMBER_PRESETS = ("plain", "us", "eu", "fr")
DATE_PRESETS = ("iso", "ymd_slash", "mdy_slash", "dmy_slash", "dmy_dot")

SPACES = " \u00a0\u202f"
_GRAMMAR = {
    "plain": r"^-?\d+(\.\d+)?\z",
    "us": r"^-?(\d+|[1-9]\d{0,2}(,\d{3})+)(\.\d+)?\z",
    "eu": r"^-?(\d+|[1-9]\d{0,2}(\.\d{3})+)(,\d+)?\z",
    "fr": rf"^-?(\d+|[1-9]\d{{0,2}}([{SPACES}])\d{{3}}(\2\d{{3}})*)(,\d+)?\z",
}
_GROUPS = {"us": ",", "eu": ".", "fr": SPACES}
#: A run of characters that can be a currency mark.
_MARK = r"[^0-9.,\-\s\u00a0\u202f]+"

_CLOCK = r":[0-5]\d(?::[0-5]\d(?:[.,]\d{1,9})?)?"
_ZONE = r"(?:\s?(?:Z|z|[+-](?:0\d|1[0-4])(?::?[0-5]\d)?))?"
_TIME = rf"(?:(?:[01]?\d|2[0-3]){_CLOCK}|(?:0?[1-9]|1[0-2]){_CLOCK}\s?[AaPp][Mm]){_ZONE}"
#: The form of a day, and which groups are year, month and day.
_DAYS = {
    "iso": (r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)),
    "ymd_slash": (r"(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)),
    "mdy_slash": (r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
    "dmy_slash": (r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 2, 1)),
    "dmy_dot": (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", (3, 2, 1)),
}


def blank_kind(text: Column) -> Column:
    """``blank``, ``placeholder``, or null for real content."""
    bare = trimmed(text)
    return F.when(bare == "", "blank").when(is_placeholder(bare), "placeholder")


def is_placeholder(bare: Column) -> Column:
    """Whether a trimmed text stands for "no value"."""
    return bare.isin(*PLACEHOLDER_FORMS)


def mark_ends(text: Column) -> dict[str, Column]:
    """What ``marked`` works with: whether a trimmed text is negative, its body without the sign, what stands before and after digits."""
    negative = F.startswith(text, F.lit("-"))
    body = F.when(negative, F.substring(text, 2, 1 << 20)).otherwise(text)
    return {"negative": negative, "body": body, "head": F.regexp_extract(body, f"^({_MARK})", 1), "tail": F.regexp_extract(body, rf"({_MARK})\z", 1)}


def marked(text: Column, negative: Column, body: Column, head: Column, tail: Column) -> tuple[Column, Column]:
    """``marked_number`` of a trimmed text and its ``mark_ends``, which it names many times."""
    unmarked = text.rlike(r"^[0-9.,\-]*\z")  # most cells; the rest is then not worked out
    token = F.when(head != "", head).otherwise(tail)
    rest = F.when(head != "", F.regexp_replace(body, f"^{_MARK}[{SPACES}]?", "")).otherwise(F.regexp_replace(body, rf"[{SPACES}]?{_MARK}\z", ""))
    low = F.lower(token)
    mark = F.when(low.isin("$", "usd"), "USD").when(low.isin(*CURRENCIES), F.upper(token))
    fit = ((head == "") | (tail == "")) & rest.rlike(r"\d") & ~F.startswith(rest, F.lit("-")) & mark.isNotNull()
    plain = (head == "") & (tail == "")
    return F.when(unmarked | plain, text).when(fit, F.concat(F.when(negative, "-").otherwise(""), rest)), F.when(unmarked, None).when(fit, mark)


def marked_number(text: Column) -> tuple[Column, Column]:
    """A trimmed text without its one currency mark at an end, and that mark (null if there is none).

    Both are null where marks stand at both ends or the mark is no currency's.
    """
    return marked(text, **mark_ends(text))


def plain_number(text: Column, preset: str) -> Column:
    """A number without marks, written by ``preset``, as digits with a decimal point; null for anything else."""
    bare = text if preset == "plain" else F.translate(text, _GROUPS[preset], "")
    value = F.replace(bare, F.lit(","), F.lit(".")) if preset in ("eu", "fr") else bare
    return F.when(text.rlike(_GRAMMAR[preset]), value)


def number(text: Column, preset: str, money: bool = True) -> Column:
    """``plain_number`` of a text that may carry a currency mark where it is ``money``."""
    bare, mark = marked_number(trimmed(text))
    value = plain_number(bare, preset)
    return value if money else F.when(mark.isNull(), value)


def date_text(text: Column, preset: str) -> Column:
    """A real day written by ``preset``, with or without a time of day, as YYYY-MM-DD; null for anything else."""
    day, (y, m, d) = _DAYS[preset]
    whole = rf"^{day}(?:{'(?:T|\\s+)' if preset == 'iso' else '\\s+'}{_TIME})?\z".replace(r"(\d{4})", r"((?!0000)\d{4})")  # there is no year 0
    bare = trimmed(text)
    # casts, for a parser with a pattern throws and catches at every day that isn't real
    return F.when(bare.rlike(whole), F.regexp_replace(bare, whole, f"${y}-${m}-${d}").try_cast("date").cast("string"))


def value_key(text: Column) -> Column:
    """How source values are compared: case, Latin accents, separators and punctuation ignored."""
    # fixed values: letters that have no base letter, separators that count as a space, and what stays
    low = F.lower(unaccented(text))
    based = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), [("ß", "ss"), ("æ", "ae"), ("œ", "oe")], F.translate(low, "đøł", "dol"))
    plain = F.when(is_ascii(text), F.lower(text)).otherwise(based)
    words = F.regexp_replace(F.regexp_replace(plain, r"[_\-./\\\u2010-\u2015\u2212]+", " "), r"[^\p{L}\p{N} ]+", "")
    return F.trim(F.regexp_replace(words, r"\s+", " "))
