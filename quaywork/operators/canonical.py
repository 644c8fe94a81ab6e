"""From a raw table's own columns and words to canonical cells, and back: each problem with the place and text it came from.

A column map is checked once on the driver and compiled to a projection. Values of known words are mapped by key, the
user's choice first; what nothing fits stays as it is written, for the strict import to judge. Raw text and place travel
beside the cooked cells, so a problem is told in the user's own words without a join back to the source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import STATUSES
from ..functions import presets as ps
from ..functions.fields import MOST_SHOWN
from ..functions.text import clipped, trimmed
from . import importing as im
from . import profiling as pr
from .shipments import sent_if_few

# What kind of value a canonical field holds, which may be left unknown, and which one value may fill.
KINDS = {
    "quantity": "number", "reorder_point": "number", "unit_cost": "money", "avg_daily_usage": "number", "lead_time_days": "number", "shipping_cost": "money",
    "ship_date": "date", "estimated_delivery": "date", "actual_delivery": "date", "status": "status", "warehouse": "warehouse",
}
UNKNOWN_ALLOWED = ("estimated_delivery", "actual_delivery", "avg_daily_usage", "lead_time_days")
CONSTANT_ALLOWED = ("carrier", "warehouse", "origin", "destination", "category", "status", "lead_time_days")
NUMBER_CODES = ("INVALID_NUMBER", "TOO_MANY_DECIMALS", "NOT_INTEGER", "NEGATIVE", "OUT_OF_RANGE")
DATE_CODES = ("INVALID_DATE", "OUT_OF_RANGE")
NUMBER_NOTES = {"us": "1,234.56 (comma thousands, dot decimal)", "eu": "1.234,56 (decimal comma)", "fr": "1 234,56 (decimal comma, space thousands)"}
DATE_NOTES = {"ymd_slash": "2026/08/15", "mdy_slash": "8/15/2026 (month/day/year)", "dmy_slash": "15/8/2026 (day/month/year)", "dmy_dot": "15.8.2026 (day.month.year)"}


@dataclass(frozen=True)
class Plan:
    """How a raw table becomes canonical: the column of each field, constants, and the ways numbers and dates are written."""

    columns: Sequence[im.Spec]
    width: int
    assignment: Mapping[str, int]
    constants: Mapping[str, str] = field(default_factory=dict)
    number_preset: str = "plain"
    date_preset: str = "iso"
    date_presets: Mapping[str, str] = field(default_factory=dict)

    def date_preset_of(self, name: str) -> str:
        return self.date_presets.get(name, self.date_preset)


def map_problems(header: Sequence[str], columns: Sequence[im.Spec], column_map: Sequence[str | None], constants: Mapping[str, str] | None = None, warehouses: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(code, message) of what is wrong with a column map: one entry for each header cell, a field or None (ignored)."""
    names, constants = [c.name for c in columns], constants or {}
    if len(column_map) != len(header):
        return [("INVALID_MAPPING", f"The column mapping lists {len(column_map)} column(s) but the file header has {len(header)}.")]
    shown = lambda text: text if len(text) <= MOST_SHOWN else f"{text[:MOST_SHOWN]}…"
    if unknown := [m for m in column_map if m is not None and m not in names]:
        return [("INVALID_MAPPING", f'The column mapping uses unknown field "{shown(m)}".') for m in unknown]
    if twice := [n for n in names if list(column_map).count(n) > 1]:
        return [("DUPLICATE_COLUMNS", f'Field "{n}" is mapped from more than one column.') for n in twice]
    bad = [n for n, v in constants.items() if n not in CONSTANT_ALLOWED or n not in names or not v.strip() or (n == "status" and v.strip() not in STATUSES) or (n == "warehouse" and v.strip() not in warehouses)]
    if bad:
        return [("INVALID_MAPPING", f'No such value can fill the field "{shown(n)}".') for n in bad]
    missing = [n for n in names if n not in column_map and n not in constants and n not in UNKNOWN_ALLOWED]
    if not missing:
        return []
    mapped = ", ".join(m for m in column_map if m is not None) or "(none)"
    return [("MISSING_COLUMNS", f"Missing required column(s): {', '.join(missing)}. Mapped columns: {mapped}.")]


def plan(header: Sequence[str], columns: Sequence[im.Spec], column_map: Sequence[str | None], constants: Mapping[str, str] | None = None, warehouses: Sequence[str] = (), **presets) -> Plan:
    """The checked plan of a column map; a wrong one is refused. A field with a column doesn't take its constant."""
    if found := map_problems(header, columns, column_map, constants, warehouses):
        raise ValueError(found[0][1])
    assignment = {m: i for i, m in enumerate(column_map) if m is not None}
    return Plan(columns, len(header), assignment, {n: v.strip() for n, v in (constants or {}).items() if n not in assignment}, **presets)


def _number(raw: Column, preset: str, money: bool, optional: bool) -> Column:
    bare, mark = ps.marked_number(raw)
    read = F.when(F.coalesce(mark, F.lit("USD" if money else "")) == ("USD" if money else ""), ps.plain_number(bare, preset))
    return F.coalesce(F.when(ps.is_placeholder(raw), "" if optional else raw), read, raw)


def _chosen(rows: DataFrame, name: str, choices: DataFrame | None) -> DataFrame:
    """``rows`` with ``<name>_choice``: the target that ``choices`` (source, target) has for the raw text, null if none."""
    if choices is None:
        return rows.withColumn(f"{name}_choice", F.lit(None).cast("string"))
    picked = choices.groupBy(F.col("source").alias(f"{name}_source")).agg(F.min("target").alias(f"{name}_choice"))
    return rows.join(sent_if_few(picked), F.col(f"raw_{name}") == F.col(f"{name}_source"), "left").drop(f"{name}_source")


def cooked(raw: DataFrame, how: Plan, locations: DataFrame | None = None, choices: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """line, place, canonical, raws, ragged (found cells, else null) and blank of every row of ``raw`` (line, cells, and file if any).

    canonical and raws are arrays in schema order: cells as the strict import takes them, and the trimmed text they come from
    (empty for constants and fields left unknown). Numbers and dates are read by the plan's presets, dollar marks go from money;
    placeholders of optional fields are blank. A status or warehouse is what ``choices`` (by field: source, target) has for
    its text, else what the known words or ``locations`` say. What can't be read stays as written. A row is ragged if it has too
    few cells, or text beyond the header; it is blank if no mapped column gives a value.
    """
    choices = choices or {}
    cells = F.col("cells")
    beyond = F.exists(F.slice(cells, how.width + 1, F.greatest(F.size(cells) - how.width, F.lit(0))), lambda c: trimmed(c) != "")
    found = F.when((F.size(cells) < how.width) | ((F.size(cells) > how.width) & beyond), F.size(cells))
    file = F.regexp_extract(F.col("file"), r"([^/]*)\z", 1) if "file" in raw.columns else F.lit(None).cast("string")
    source = lambda c: trimmed(F.coalesce(F.get(cells, F.lit(how.assignment[c])), F.lit(""))) if c in how.assignment else F.lit("")
    rows = raw.select("line", file.alias("file"), "cells", *[source(c.name).alias(f"raw_{c.name}") for c in how.columns])
    for name in ("status", "warehouse"):
        if name in how.assignment:
            rows = _chosen(rows, name, choices.get(name))
            if name == "warehouse":
                keys = sent_if_few(pr.warehouse_keys(locations)).select(F.col("key").alias("warehouse_key"), F.col("target").alias("warehouse_known"))
                rows = rows.join(keys, ps.value_key(F.col("raw_warehouse")) == F.col("warehouse_key"), "left")
    known = {word: status for status, words in pr.STATUS_WORDS.items() for word in words} | {s.replace("_", " "): s for s in STATUSES}
    words = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def cell(name: str) -> Column:
        text, kind, optional = F.col(f"raw_{name}"), KINDS.get(name, "text"), name in UNKNOWN_ALLOWED
        if name not in how.assignment:
            return F.lit(how.constants.get(name, ""))
        if kind in ("number", "money"):
            return _number(text, how.number_preset, kind == "money", optional)
        if kind == "date":
            return F.coalesce(F.when(ps.is_placeholder(text), "" if optional else text), ps.date_text(text, how.date_preset_of(name)), text)
        if kind == "status":
            return F.coalesce("status_choice", F.try_element_at(words, ps.value_key(text)), text)
        if kind == "warehouse":
            return F.coalesce("warehouse_choice", "warehouse_known", text)
        return F.when(ps.is_placeholder(text), "").otherwise(text) if optional else text

    # ragged has a lambda, which keeps this projection out of whole-stage code: all cells in one method are too long for the JVM to compile
    done = rows.select("line", "file", found.alias("ragged"), *[cell(c.name).alias(f"cell_{c.name}") for c in how.columns], *[f"raw_{c.name}" for c in how.columns])
    both = F.struct(*[F.array(*[F.col(f"{kind}_{c.name}") for c in how.columns]).alias(name) for kind, name in (("cell", "canonical"), ("raw", "raws"))])
    # a generator of one row keeps the optimizer from writing a cell's whole expression wherever the cell is used
    made = done.select("line", "file", "ragged", F.inline(F.array(both)))
    filled = [F.get("canonical", F.lit(i)) != "" for i, c in enumerate(how.columns) if c.name in how.assignment]
    some = filled[0] if filled else F.lit(False)
    for f in filled[1:]:
        some = some | f
    place = F.concat(F.when(F.col("file").isNotNull(), F.concat("file", F.lit(", "))).otherwise(""), F.lit("line "), F.col("line").cast("string"))
    return made.select("line", place.alias("place"), "canonical", "raws", "ragged", (F.col("ragged").isNull() & ~some).alias("blank"))


def dry_run(rows: DataFrame, how: Plan, key: Sequence[str], duplicate: str) -> DataFrame:
    """The strict import's line, ``row`` and ``problems`` of every cooked row that isn't blank; place, canonical, raws and n_cells beside them.

    A ragged row has one problem, its number of cells. ``problems`` below tells problems in the user's words.
    """
    # a ragged row goes in without cells, so it has no key
    cells = F.when(F.col("ragged").isNull(), F.col("canonical")).otherwise(F.array().cast("array<string>"))
    given = rows.where("not blank").withColumn("cells", cells).withColumnRenamed("ragged", "n_cells")
    return im.checked(given, [c.name for c in how.columns], how.columns, key, duplicate, ["place", "canonical", "raws", "n_cells"])


def problems(rows: DataFrame, how: Plan) -> DataFrame:
    """line, place, column_order, column, code, message of every problem of a dry run, in the user's words.

    A quoted canonical text is quoted as it was written, numbers and dates tell which way of writing was read, and where a key was
    first seen is a place in the user's file.
    """
    kind = F.coalesce(*[F.when(F.col("column") == n, k) for n, k in KINDS.items()])
    quoted = lambda text: F.concat(F.lit('"'), clipped(text, MOST_SHOWN), F.lit('"'))
    flat = im.exploded(rows, "line", "place", "canonical", "raws", "n_cells").select("line", "place", "canonical", "raws", "n_cells", "p.*")
    flat = flat.withColumns({"text": F.get("canonical", F.col("column_order")), "written": F.get("raws", F.col("column_order")), "kind": kind})
    changed = (F.col("written") != "") & (F.col("written") != F.col("text"))
    said = F.when(changed, F.replace("message", quoted(F.col("text")), quoted(F.col("written")))).otherwise(F.col("message"))
    number = F.col("kind").isin("number", "money") & F.col("code").isin(*NUMBER_CODES)
    notes = [F.when(number, f" Number format: {NUMBER_NOTES[how.number_preset]}.")] if how.number_preset in NUMBER_NOTES else []
    dates = {c.name: DATE_NOTES.get(how.date_preset_of(c.name)) for c in how.columns if KINDS.get(c.name) == "date"}
    notes += [F.when((F.col("column") == n) & F.col("code").isin(*DATE_CODES), f" Date format: {note}.") for n, note in dates.items() if note]
    note = F.when(F.col("written") != "", F.coalesce(*notes, F.lit(""))).otherwise("")
    file = F.regexp_extract("place", r"^(.*, )?line \d+\z", 1)
    first = F.concat(F.regexp_extract("message", r"^(.*)line \d+\)\.\z", 1), file, F.regexp_extract("message", r"(line \d+\)\.)\z", 1))
    ragged = F.format_string(f"Expected {how.width} fields but found %d.", F.col("n_cells"))
    message = F.when(F.col("code") == "FIELD_COUNT", ragged).when(F.col("code") == "DUPLICATE_ID", first).otherwise(F.concat(said, F.coalesce(note, F.lit(""))))
    return flat.select("line", "place", "column_order", "column", "code", message.alias("message"))


def problem_lines(found: DataFrame) -> DataFrame:
    """``value``: the CSV lines row,column,problem of ``problems``, header first; ``order`` puts them in order by line and column."""
    cell = lambda c: F.coalesce(im.csv_cell(F.col(c)), F.lit(""))
    head = found.sparkSession.range(1).select(F.struct(F.lit(-1).cast("long").alias("line"), F.lit(-2).alias("column_order")).alias("order"), F.lit("row,column,problem").alias("value"))
    return head.unionByName(found.select(F.struct("line", "column_order").alias("order"), F.concat_ws(",", cell("place"), cell("column"), cell("message")).alias("value")))


def canonical_lines(rows: DataFrame, how: Plan) -> DataFrame:
    """``value``: the canonical CSV's lines, header first, all columns in schema order; ``line`` is the source line (null for the header).

    Ragged and blank rows are left out: the first are problems, the second no rows.
    """
    head = rows.sparkSession.range(1).select(F.lit(None).cast("long").alias("line"), F.lit(",".join(c.name for c in how.columns)).alias("value"))
    body = rows.where("ragged is null and not blank").select("line", F.array_join(F.transform("canonical", im.csv_cell), ",").alias("value"))
    return head.unionByName(body)
