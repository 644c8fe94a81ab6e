"""Rows of a raw table that aren't data: repeated headers, totals and a footer; listed first, taken out when confirmed.

A raw table has line and cells (an array). Repeated headers and totals are known by the row alone. The footer is the run of
rows with one filled cell at the table's end, which begins after the last row that is something else: one aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.presets import blank_kind, value_key
from ..functions.text import trimmed
from ..scratch import written

# Words that begin a row of totals, as value keys.
TOTAL_WORDS = ("grand total", "sub total", "subtotal", "total general", "total", "gesamtsumme", "gesamt", "summe", "tong cong", "tong so", "tong", "totale", "suma", "somme")
#: How much of a header a row repeats to be one, and how many columns a table has that may have a footer.
REPEATED_SHARE, FOOTER_COLUMNS = 0.8, 3
LABEL_LENGTH = 60


def _filled(cells: Column) -> Column:
    """The trimmed cells with content; placeholders have none."""
    return F.filter(F.transform(cells, trimmed), lambda c: blank_kind(c).isNull())


def _keys(cells: Column) -> Column:
    return F.filter(F.transform(cells, value_key), lambda k: k != "")


def header_keys(raw: DataFrame, header_line: int) -> list[str]:
    """The value keys of the header's cells that have one; an empty list if there is no such line."""
    row = raw.where(F.col("line") == header_line).select(_keys(F.col("cells")).alias("keys")).first()
    return row["keys"] if row else []


def _label(filled: Column) -> Column:
    first = F.coalesce(F.get(filled, F.lit(0)), F.lit(""))
    return F.when(F.length(first) > LABEL_LENGTH, F.concat(F.substring(first, 1, LABEL_LENGTH - 1), F.lit("…"))).otherwise(first)


def structural_rows(raw: DataFrame, header_line: int) -> DataFrame:
    """line, kind and label of the rows below the header that look like structure; none is taken out here.

    kind: ``repeated-header`` (at least 80 % of a header of two columns or more), ``total`` (begins with a total's word, and a
    later cell is a number) or ``footer`` (rows of one filled cell at the end of a table of three columns or more). label is the first
    filled cell, shortened. Rows without content are none of these. No rows below the header: none.

    The raw table is read once, when this is called: rows that are or may be structure are written, of all others the last line is.
    """
    keys = header_keys(raw, header_line)
    cells = F.col("cells")
    number = lambda c: trimmed(c).rlike(r"^[-+$€£]?\s?\d[\d.,\s]*\z") & blank_kind(c).isNull()
    rows = raw.where(F.col("line") > header_line).select("line", "cells", _filled(cells).alias("filled"))
    lettered = lambda c: c.rlike(r"\p{L}")
    least = math.ceil(len(keys) * REPEATED_SHARE)
    # cells without a letter fit no header's words and no total's, so keys are made where there are letters
    worded = F.size(F.filter(cells, lettered)) >= max(2, least) if all(any(x.isalpha() for x in k) for k in keys) else F.lit(True)
    known = F.size(F.filter("keys", lambda k: k.isin(*keys))) if keys else F.lit(0)
    repeats = F.lit(len(keys) >= 2) & (F.size("keys") >= 2) & (known >= least)
    first = F.get(F.col("filled"), F.lit(0))
    total = value_key(first).rlike(f"^({'|'.join(TOTAL_WORDS)})( |$)") & F.exists(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), number)
    keyed = rows.select("line", "cells", "filled", F.when(worded, _keys(cells)).alias("keys"))
    kind = F.when(F.when(F.col("keys").isNotNull(), repeats), "repeated-header").when(F.when(lettered(first), total), "total")
    told = keyed.select("line", kind.alias("kind"), F.size("filled").alias("n"), _label(F.col("filled")).alias("label"))
    footers = len(keys) >= FOOTER_COLUMNS
    maybe = F.col("kind").isNotNull() | (F.lit(footers) & (F.col("n") == 1))
    body = F.col("kind").isNull() & (F.col("n") > 1)
    split = told.select(F.when(maybe & (F.col("n") > 0), F.struct("line", "kind", "label")).alias("row"), F.when(body, F.col("line")).alias("body"))
    seen = written(split.groupBy("row").agg(F.max("body").alias("body"), F.count("*").alias("times")))
    body_end = F.broadcast(seen.agg(F.coalesce(F.max("body"), F.lit(header_line)).alias("body_end")))  # one row
    found = seen.where("row is not null").crossJoin(body_end).where(F.col("row.kind").isNotNull() | (F.col("row.line") > F.col("body_end")))
    out = found.select(F.inline(F.array_repeat("row", F.col("times").cast("int"))))
    return out.select("line", F.coalesce("kind", F.lit("footer")).alias("kind"), "label")


def apply_structure(raw: DataFrame, header_line: int, found: DataFrame, excluded: DataFrame | None = None) -> tuple[list[str], DataFrame, DataFrame]:
    """The header's trimmed cells, the data rows (as ``raw``), and line and kind of the rows taken out.

    ``excluded`` (line) are the rows that were confirmed, ``user`` where ``found`` has no kind for them; all of ``found`` if it
    isn't given. Lines that aren't below the header are left out of it.
    """
    header = raw.where(F.col("line") == header_line).select(F.transform("cells", trimmed).alias("cells")).first()
    below = raw.where(F.col("line") > header_line)
    gone = found.select("line", "kind") if excluded is None else excluded.select("line").distinct().join(found.select("line", "kind"), "line", "left")
    out = below.select("line").join(gone, "line").select("line", F.coalesce("kind", F.lit("user")).alias("kind"))
    return header["cells"] if header else [], below.join(gone.select("line"), "line", "left_anti"), out


def excluded_counts(gone: DataFrame, blank: DataFrame | None = None) -> DataFrame:
    """reason and rows: those taken out by kind, and as ``blank`` those of ``blank`` (rows without any mapped value)."""
    rows = gone.select(F.col("kind").alias("reason"))
    if blank is not None:
        rows = rows.unionByName(blank.select(F.lit("blank").alias("reason")))
    return rows.groupBy("reason").agg(F.count("*").alias("rows"))
