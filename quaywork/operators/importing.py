"""Strict import of raw tables: every row's fields parsed, every problem listed, all rows or none.

A raw table has a line number and its cells as an array, for rows may be ragged. Checking is one pass over the rows, dealt by
key. Nothing is collected but whether a table has any problem.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_LEAD_DAYS, MAX_ISSUES_SHOWN
from ..functions import fields as f
from ..functions.text import trimmed


@dataclass(frozen=True)
class Spec:
    """A canonical column: its name in the table and in the result, how it is parsed, whether column and value must be there."""

    name: str
    parser: f.Parser
    column_required: bool = True
    value_required: bool = True
    default: object = None
    out: str | None = None
    kind: str | None = None


# Fixed values of the canonical schemas.
def inventory_columns(warehouses: list[str]) -> list[Spec]:
    return [
        Spec("sku", f.identifier("SKU")),
        Spec("product_name", f.plain_text(120)),
        Spec("category", f.plain_text(60)),
        Spec("warehouse", f.warehouse(warehouses)),
        Spec("quantity", f.whole(0, 10_000_000)),
        Spec("reorder_point", f.whole(0, 10_000_000)),
        Spec("unit_cost", f.money(100_000_000), out="unit_cost_cents"),
        Spec("avg_daily_usage", f.decimal(0, 1_000_000), False, False),
        Spec("lead_time_days", f.whole(1, 365), False, False, DEFAULT_LEAD_DAYS, kind="int"),
    ]


SHIPMENT_COLUMNS = [
    Spec("shipment_id", f.identifier("shipment ID")),
    Spec("origin", f.plain_text(64, collapse=True)),
    Spec("destination", f.plain_text(64, collapse=True)),
    Spec("carrier", f.plain_text(60)),
    Spec("status", f.status),
    Spec("ship_date", f.day),
    Spec("estimated_delivery", f.day, value_required=False),
    Spec("actual_delivery", f.day, value_required=False),
    Spec("shipping_cost", f.money(100_000_000), out="shipping_cost_cents"),
]


def header_key(name: str) -> str:
    """A header as the canonical names are written: trimmed, lower case, white space and hyphens as underscores."""
    import re

    return re.sub(r"[\s-]+", "_", name.strip().lower())


def header_problems(header: Sequence[str], columns: Sequence[Spec]) -> list[tuple[str, str]]:
    """(code, message) of what keeps a header from being read: repeated columns, else missing ones."""
    names = [header_key(h) for h in header]
    twice = [n for i, n in enumerate(names) if n in names[:i]]
    if twice:
        return [("DUPLICATE_COLUMNS", f'Column "{n}" appears more than once.') for n in twice]
    missing = [c.name for c in columns if c.column_required and c.name not in names]
    return [("MISSING_COLUMNS", f"Missing required column(s): {', '.join(missing)}. Found columns: {', '.join(names) or '(none)'}.")] if missing else []


def checked(raw: DataFrame, header: Sequence[str], columns: Sequence[Spec], key: Sequence[str], duplicate: str, carry: Sequence[str] = ()) -> DataFrame:
    """line, ``carry``, ``row`` (a struct of parsed values) and ``problems`` (an array of column_order, column, code, message) of ``raw``.

    ``raw`` has line (long, different in every row) and cells (array of strings) below the header. A row with too few
    cells, or with text beyond the header, has that one problem. A key that stood on an earlier line is a problem of its
    first column, whatever else is wrong with the earlier row, if the key's fields could be read; ``duplicate`` is how the
    message shows it, with {} for each field.
    """
    if found := header_problems(header, columns):
        raise ValueError(found[0][1])
    names = [header_key(h) for h in header]
    width = len(names)
    cells = F.col("cells")
    beyond = F.exists(F.slice(cells, width + 1, F.greatest(F.size(cells) - width, F.lit(0))), lambda c: trimmed(c) != "")
    ragged = (F.size(cells) < width) | ((F.size(cells) > width) & beyond)
    parsed = {c.name: f.field(F.get(cells, F.lit(names.index(c.name))) if c.name in names else None, c.parser, c.value_required, None if c.default is None else F.lit(c.default)) for c in columns}

    def of_row(order: int, column: Column, code: Column, message: Column) -> Column:
        return F.struct(F.lit(order).alias("column_order"), column.alias("column"), code.alias("code"), message.alias("message"))

    count = F.struct(F.lit("FIELD_COUNT").alias("code"), F.format_string(f"Expected {width} fields but found %d.", F.size(cells)).alias("message"))
    readable = ~ragged
    for k in key:
        readable = readable & parsed[k][1].isNull()
    told = duplicate.split("{}")
    shown = F.concat(F.lit(told[0]), *[x for k, rest in zip(key, told[1:], strict=True) for x in (F.coalesce(parsed[k][0].cast("string"), F.lit("null")), F.lit(rest))])
    # rows are dealt by key as they came, before the other fields are parsed, and once; those without a key by their line
    keyed = raw.select("line", *carry, "cells", F.when(readable, shown).alias("key"))
    seat = F.when(F.col("key").isNotNull(), F.xxhash64("key")).otherwise(F.xxhash64("line"))
    same = Window.partitionBy("seat", "key").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    dealt = keyed.withColumn("seat", seat).withColumn("first_line", F.when(F.col("key").isNotNull(), F.min("line").over(same)))
    out = dealt.select("line", *carry, "cells", "key", "first_line", ragged.alias("ragged"), *[v.alias(f"{n}_value") for n, (v, _) in parsed.items()], *[p.alias(f"{n}_problem") for n, (_, p) in parsed.items()])
    whole = ~F.col("ragged")
    own = [F.when(F.col(f"{c.name}_problem").isNotNull(), of_row(i, F.lit(c.name), F.col(f"{c.name}_problem.code"), F.col(f"{c.name}_problem.message"))) for i, c in enumerate(columns)]
    first = next(i for i, c in enumerate(columns) if c.name == key[0])
    again = F.when(F.col("line") > F.col("first_line"), of_row(first, F.lit(key[0]), F.lit("DUPLICATE_ID"), F.concat(F.lit("Duplicate "), F.col("key"), F.format_string(" (first seen on line %d).", F.col("first_line")))))
    problems = F.when(whole, F.array_compact(F.array(*own, again))).otherwise(F.array(of_row(-1, F.lit(None).cast("string"), count["code"], count["message"])))
    values = [F.col(f"{c.name}_value").cast(c.kind) if c.kind else F.col(f"{c.name}_value") for c in columns]
    return out.select("line", *carry, F.struct(*[v.alias(c.out or c.name) for v, c in zip(values, columns, strict=True)]).alias("row"), problems.alias("problems"))


def check_inventory(raw: DataFrame, header: Sequence[str], warehouses: list[str]) -> DataFrame:
    return checked(raw, header, inventory_columns(warehouses), ["sku", "warehouse"], 'SKU + warehouse "{} @ {}"')


def check_shipments(raw: DataFrame, header: Sequence[str]) -> DataFrame:
    return checked(raw, header, SHIPMENT_COLUMNS, ["shipment_id"], 'shipment ID "{}"')


def issues(rows: DataFrame) -> DataFrame:
    """line, column_order, column, code, message of every problem."""
    return exploded(rows, "line").select("line", "p.*")


def exploded(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and a problem, p, for every problem; the outer kind, for the optimizer puts a filter that parses all once more before the other."""
    return rows.select(*columns, F.explode_outer("problems").alias("p")).where("p is not null")


def first_issues(rows: DataFrame, most: int = MAX_ISSUES_SHOWN) -> DataFrame:
    """The first ``most`` problems by line and column, and in ``total`` how many there are."""
    every = issues(rows)
    total = F.broadcast(every.agg(F.count("*").alias("total")))  # one row
    return every.orderBy("line", "column_order").limit(most).crossJoin(total)


def accepted(rows: DataFrame) -> DataFrame:
    """The parsed rows if no row of the table has a problem, else none; all rows are judged when this is called."""
    refused = rows.agg(F.coalesce(F.bool_or(F.size("problems") > 0), F.lit(False)).alias("refused")).first()["refused"]
    return rows.where(F.lit(not refused)).select("row.*")


def issue_counts(rows: DataFrame) -> DataFrame:
    """Problems and rows with problems by code."""
    return issues(rows).groupBy("code").agg(F.count("*").alias("problems"), F.count_distinct("line").alias("rows"))


def csv_cell(text: Column) -> Column:
    """A cell as CSV: in quotes if it holds a comma, a quote or a line break."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One text column ``value`` with a CSV line a row; nulls are empty. Write it with ``write.text``."""
    return rows.select(F.concat_ws(",", *[F.coalesce(csv_cell(F.col(c).cast("string")), F.lit("")) for c in columns]).alias("value"))
