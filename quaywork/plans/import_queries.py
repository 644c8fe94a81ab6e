"""Queries of the strict import over raw tables made of the stand-ins, with planted mistakes, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import importing as im
from ..operators import profiling as pr
from . import standins as st
from .queries import query

WAREHOUSES = [f"WH-{w}" for w in range(5)]
INVENTORY_HEADER = [" SKU", "Product Name", "category", "Warehouse", "quantity", "reorder-point", "unit cost", "avg_daily_usage", "lead_time_days"]
SHIPMENT_HEADER = ["shipment_id", "origin", "destination", "carrier", "status", "ship_date", "estimated_delivery", "actual_delivery", "shipping_cost"]

# Cells in the words that both engines have; {p} and {w} are the numbers of a row.
INVENTORY_CELLS = [
    "case when p % 97 = 0 then 'p' when p % 89 = 0 then '' when p % 101 = 0 then concat('P-', p - 1) when p % 83 = 0 then concat('p-', p) else concat('P-', p) end",
    "case when p % 71 = 0 then concat(name, chr(9), 'x') when p % 73 = 0 then repeat('n', 121) else concat('  ', name, ' ') end",
    "case when p % 79 = 0 then ' ' else kind end",
    "case when p % 67 = 0 then 'WH-9' when p % 61 = 0 then concat('wh-', w) else concat('WH-', w) end",
    "case when p % 59 = 0 then '12.5' when p % 53 = 0 then '-3' when p % 47 = 0 then '20000000' when p % 43 = 0 then '1,200' else concat('', (p * 37 + w * 101) % 900) end",
    "concat('', (p * 13 + w * 7) % 300)",
    "case when p % 41 = 0 then '$5.00' when p % 37 = 0 then '1.234' when p % 31 = 0 then '-1.00' when p % 29 = 0 then '1000000.01' else concat(p % 500, '.', 10 + p % 90) end",
    "case when p % 23 = 0 then '1.005' when p % 19 = 0 then 'n/a' when p % 7 = 0 then '' else concat(p % 40, '.', w) end",
    "case when p % 17 = 0 then '' when p % 13 = 0 then '0' when p % 11 = 0 then '366' else concat('', 7 * (1 + p % 4)) end",
]
SHIPMENT_CELLS = [
    "case when o % 97 = 0 then concat('SHP_', o) when o % 89 = 0 then concat('SHP-', o, '-1') else concat('shp-', o, '-', n) end",
    "case when o % 83 = 0 then '' when o % 79 = 0 then repeat('x', 65) else concat('Port  ', o % 7) end",
    "concat('Town ', p % 11)",
    "case when o % 73 = 0 then concat('a', chr(10), 'b') else concat('Carrier ', p % 5) end",
    "case when o % 71 = 0 then 'arrived' when o % 67 = 0 then 'In Transit' when o % 3 = 0 then 'delivered' else 'pending' end",
    "case when o % 61 = 0 then '8/15/2026' when o % 59 = 0 then '2026-02-30' when o % 53 = 0 then '1999-12-31' when o % 47 = 0 then 'soon' when o % 43 = 0 then '13/40/2026' else concat('20', 10 + o % 15, '-0', 1 + o % 9, '-', 10 + o % 19) end",
    "case when o % 5 = 0 then '' else concat('20', 10 + o % 15, '-1', o % 3, '-', 10 + o % 19) end",
    "case when o % 3 = 0 then concat('20', 10 + o % 15, '-1', o % 3, '-', 10 + o % 18) else '' end",
    "case when o % 41 = 0 then '' when o % 37 = 0 then '12,50' else concat(p % 900, '.', 10 + o % 90) end",
]


def raw_inventory(spark, d, clean: bool = False):
    """line, cells of every part at its warehouses; some rows are short, some too long. Without mistakes if ``clean``."""
    rows = st.parts(spark, d).selectExpr("p_partkey as p", "p_name as name", "p_type as kind", "explode(sequence(0, 4)) as w").where("p % 5 <> w")
    if clean:
        cells = ["concat('P-', p)", "name", "kind", *[c.rpartition("else ")[2].removesuffix(" end") for c in INVENTORY_CELLS[3:]]]
        return rows.selectExpr("p * 5 + w + 2 as line", f"array({', '.join(cells)}) as cells")
    cells = f"array({', '.join(INVENTORY_CELLS)})"
    ragged = "case when p % 103 = 0 then slice(cells, 1, 8) when p % 107 = 0 then array_append(cells, 'x') when p % 109 = 0 then array_append(cells, ' ') else cells end"
    return rows.selectExpr("p", "p * 5 + w + 2 as line", f"{cells} as cells").selectExpr("line", f"{ragged} as cells")


def raw_shipments(spark, d):
    rows = st.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).selectExpr("l_orderkey as o", "l_linenumber as n", "p")
    return rows.selectExpr("o * 8 + n as line", f"array({', '.join(SHIPMENT_CELLS)}) as cells")


def _blank_or(rest: str, required: bool) -> str:
    blank = "['REQUIRED', 'Value is required.']" if required else "null"
    return f"case when v = '' then {blank} when regexp_matches(v, '[\\x00-\\x1f\\x7f]') then ['CONTROL_CHARS', 'Value contains control characters (tabs, line breaks or other non-printing characters).'] {rest} end"


QUOTED = "'\"' || v || '\"'"
BAD_NUMBER = f"['INVALID_NUMBER', {QUOTED} || ' is not a valid number. Use digits with an optional decimal point, e.g. 1250.50 (no currency symbols, thousands separators or spaces).']"
BELOW = "when v like '-%' then ['NEGATIVE', 'Must not be negative (got ' || v || ').']"


def _id(label):
    return f"when not regexp_full_match(upper(v), '[A-Z0-9][A-Z0-9-]{{2,31}}') then ['INVALID_FORMAT', {QUOTED} || ' is not a valid {label}. Use 3–32 letters, digits or hyphens, starting with a letter or digit.']"


def _text(most):
    return f"when length(v) > {most} then ['TOO_LONG', 'Value exceeds {most} characters.']"


def _whole(least, most):
    return f"when regexp_full_match(v, '-?[0-9]+[.][0-9]+') then ['NOT_INTEGER', {QUOTED} || ' must be a whole number.'] when not regexp_full_match(v, '-?[0-9]+') then {BAD_NUMBER} {BELOW} when cast(v as bigint) not between {least} and {most} then ['OUT_OF_RANGE', 'Must be between {least} and {most} (got ' || v || ').']"


def _decimal(most, shown):
    return f"when not regexp_full_match(v, '-?[0-9]+([.][0-9]+)?') then {BAD_NUMBER} when regexp_matches(v, '[.][0-9]{{3,}}$') then ['TOO_MANY_DECIMALS', {QUOTED} || ' has more than 2 decimal places.'] {BELOW} when cast(v as decimal(18, 2)) > {most} then ['OUT_OF_RANGE', 'Must be between 0 and {shown} (got ' || v || ').']"


SLASH = "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
MEANT = "split_part(v, '/', 3) || '-' || lpad(split_part(v, '/', 1), 2, '0') || '-' || lpad(split_part(v, '/', 2), 2, '0')"
DAY = f"""when regexp_full_match(v, '{SLASH}') then ['INVALID_DATE', {QUOTED} || ' looks like Excel changed this date to M/D/YYYY. Dates must be YYYY-MM-DD' || case when try_cast({MEANT} as date) is not null then ', e.g. ' || {MEANT} else '' end || '. Re-download the file and upload it without opening it in Excel.']
  when not regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then ['INVALID_DATE', {QUOTED} || ' is not a valid date. Use YYYY-MM-DD, e.g. 2026-03-15.']
  when try_cast(v as date) is null then ['INVALID_DATE', {QUOTED} || ' is not a real calendar date.'] when v not between '2000' and '2101' then ['OUT_OF_RANGE', 'Year must be between 2000 and 2100 (got ' || v || ').']"""
STATUS = f"when regexp_replace(lower(v), '[ -]+', '_', 'g') not in ('pending', 'in_transit', 'delivered', 'cancelled') then ['INVALID_STATUS', {QUOTED} || ' is not a valid status. Use one of: pending, in_transit, delivered, cancelled.']"
WAREHOUSE = f"when upper(v) not in ('WH-0', 'WH-1', 'WH-2', 'WH-3', 'WH-4') then ['UNKNOWN_WAREHOUSE', 'Unknown warehouse ' || {QUOTED} || '. Valid codes: WH-0, WH-1, WH-2, WH-3, WH-4.']"

# name, check, value required
INVENTORY_CHECKS = [("sku", _id("SKU"), True), ("product_name", _text(120), True), ("category", _text(60), True), ("warehouse", WAREHOUSE, True), ("quantity", _whole(0, 10000000), True), ("reorder_point", _whole(0, 10000000), True), ("unit_cost", _decimal(1000000, "1000000.00"), True), ("avg_daily_usage", _decimal(1000000, "1000000"), False), ("lead_time_days", _whole(1, 365), False)]
SHIPMENT_CHECKS = [("shipment_id", _id("shipment ID"), True), ("origin", _text(64), True), ("destination", _text(64), True), ("carrier", _text(60), True), ("status", STATUS, True), ("ship_date", DAY, True), ("estimated_delivery", DAY, False), ("actual_delivery", DAY, False), ("shipping_cost", _decimal(1000000, "1000000.00"), True)]


def _issues_sql(source: str, cells: list[str], checks, width: str, key: str, shown: str, first: str) -> str:
    """CTEs up to ``found`` (line, column_order, column, code, message): ``source`` has line and what the cells need."""
    collapse = lambda n, c: f"regexp_replace({c}, ' +', ' ', 'g')" if n in ("origin", "destination") else c
    named = ", ".join(f"trim({collapse(n, c)}, ' ' || chr(9) || chr(10)) as {n}" for (n, _, _), c in zip(checks, cells, strict=True))
    each = " union all ".join(f"select line, {i} as column_order, '{n}' as \"column\", {_blank_or(rest, required)} as found from (select line, {n} as v from whole)" for i, (n, rest, required) in enumerate(checks))
    return f"""src as ({source}), named as (select line, {width} as width, {named} from src), whole as (select * from named where width in (9, 10)),
  own as (select line, column_order, "column", found[1] as code, found[2] as message from ({each}) where found is not null),
  keyed as (select line, {key} as key from whole w where not exists (select 1 from own where own.line = w.line and own."column" in ({first}))),
  repeated as (select key, min(line) as first_line from keyed group by key having count(*) > 1),
  found as (
    select * from own union all select line, -1, null, 'FIELD_COUNT', 'Expected 9 fields but found ' || (case width when -10 then 10 else width end) || '.' from named where width not in (9, 10)
    union all select line, 0, [{first}][1], 'DUPLICATE_ID', 'Duplicate ' || {shown} || ' (first seen on line ' || first_line || ').' from keyed join repeated using (key) where line > first_line
  )"""


INVENTORY_ISSUES = _issues_sql(
    "select p_partkey as p, w, p_name as name, p_type as kind, p_partkey * 5 + w + 2 as line from part, range(5) t(w) where p_partkey % 5 <> w",
    INVENTORY_CELLS, INVENTORY_CHECKS, "case when p % 103 = 0 then 8 when p % 107 = 0 then -10 when p % 109 = 0 then 10 else 9 end", "upper(sku) || ' @ ' || upper(warehouse)", "'SKU + warehouse \"' || key || '\"'", "'sku', 'warehouse'",
)
SHIPMENT_ISSUES = _issues_sql(
    "select l_orderkey as o, l_linenumber as n, min(l_partkey) as p, l_orderkey * 8 + l_linenumber as line from lineitem group by 1, 2",
    SHIPMENT_CELLS, SHIPMENT_CHECKS, "9", "upper(shipment_id)", "'shipment ID \"' || key || '\"'", "'shipment_id'",
)


def inventory_rows(spark, d):
    return im.check_inventory(raw_inventory(spark, d), INVENTORY_HEADER, WAREHOUSES)


def shipment_rows(spark, d):
    return im.check_shipments(raw_shipments(spark, d), SHIPMENT_HEADER)


@query(f"with {INVENTORY_ISSUES} select * from found")
def import_inventory_issues(spark, d):
    return im.issues(inventory_rows(spark, d))


@query(f"with {SHIPMENT_ISSUES} select * from found")
def import_shipment_issues(spark, d):
    return im.issues(shipment_rows(spark, d))


@query(f"with {INVENTORY_ISSUES} select *, (select count(*) from found) as total from found order by line, column_order limit 500")
def import_first_issues(spark, d):
    """What an import reports: the first 500 problems in order, and their number."""
    return im.first_issues(inventory_rows(spark, d))


@query(f"with {SHIPMENT_ISSUES} select code, count(*) as problems, count(distinct line) as rows from found group by 1")
def import_issue_counts(spark, d):
    return im.issue_counts(shipment_rows(spark, d))


@query(f"with {SHIPMENT_ISSUES} select shipment_id from named where not exists (select 1 from found)")
def import_refused(spark, d):
    """A table with any problem gives no rows."""
    return im.accepted(shipment_rows(spark, d)).select("shipment_id")


CLEAN_SQL = """select 'P-' || p_partkey as sku, p_name as product_name, p_type as category, 'WH-' || w as warehouse, (p_partkey * 37 + w * 101) % 900 as quantity, (p_partkey * 13 + w * 7) % 300 as reorder_point,
  (p_partkey % 500) * 100 + 10 + p_partkey % 90 as unit_cost_cents, cast((p_partkey % 40) || '.' || w as double) as avg_daily_usage, cast(7 * (1 + p_partkey % 4) as integer) as lead_time_days
  from part, range(5) t(w) where p_partkey % 5 <> w"""


@query(CLEAN_SQL)
def import_accepted(spark, d):
    """A table without problems gives all its rows, typed."""
    return im.accepted(im.check_inventory(raw_inventory(spark, d, clean=True), INVENTORY_HEADER, WAREHOUSES))


@query(f"with src as ({CLEAN_SQL}) select concat_ws(',', sku, '\"' || product_name || ', \"\"' || category || '\"\"\"', warehouse, quantity, unit_cost_cents, lead_time_days) as value from src")
def canonical_csv(spark, d):
    rows = im.accepted(im.check_inventory(raw_inventory(spark, d, clean=True), INVENTORY_HEADER, WAREHOUSES))
    rows = rows.withColumn("product_name", F.concat("product_name", F.lit(', "'), "category", F.lit('"')))
    return im.csv_lines(rows, ["sku", "product_name", "warehouse", "quantity", "unit_cost_cents", "lead_time_days"])


# Source values as carriers and suppliers write them.
MONEY_CELLS = "case when o % 11 = 0 then '' when o % 13 = 0 then 'n/a' when o % 7 = 0 then concat('$', 1 + o % 8, ',', 100 + o % 800, '.', 10 + p % 90) else concat('', p % 900) end"
EURO_CELLS = "case when o % 17 = 0 then concat(1 + o % 8, '.', 100 + o % 800, ',', 10 + p % 90, ' €') when o % 19 = 0 then concat('£ ', o % 50) when o % 23 = 0 then 'free' else concat(p % 90, ',5') end"
DATE_CELLS = "case when o % 29 = 0 then '-' when o % 5 = 0 then concat(1 + o % 12, '/', 13 + p % 15, '/2026 8:05 PM') else concat(1 + o % 12, '/', 1 + p % 12, '/2026') end"
OPEN_DATES = "concat(1 + o % 12, '/', 1 + p % 12, '/2026')"
STATUS_CELLS = "case o % 9 when 0 then 'En Tránsito' when 1 then 'delivered' when 2 then 'CANCELED' when 3 then ' on-hold' when 4 then 'Đã giao' when 5 then 'lost' when 6 then '' when 7 then 'In_Transit' else 'offen' end"
PLACE_CELLS = "case o % 8 when 0 then concat('wh-', p % 7) when 1 then concat('Hub ', p % 6) when 2 then concat('', p % 5) when 3 then 'NATION_3' when 4 then '  nation_4 ' when 5 then concat('N0', p % 9) when 6 then '' else concat('Depot ', p % 30) end"
LINES_SQL = "lines as (select l_orderkey * 8 + l_linenumber as line, l_orderkey as o, min(l_partkey) as p from lineitem group by l_orderkey, l_linenumber)"


def lines(spark, d):
    return st.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).selectExpr("l_orderkey * 8 + l_linenumber as line", "l_orderkey as o", "p")


def values_of(spark, d, cells: str):
    return pr.distinct_values(lines(spark, d).selectExpr("line", f"{cells} as cell"), "cell")


def _values_sql(cells: str) -> str:
    return f"{LINES_SQL}, v as (select trim({cells}) as value, count(*) as count, min(line) as first from lines where trim({cells}) <> '' group by 1)"


@query(f"with {_values_sql(STATUS_CELLS)} select * from v")
def distinct_status_values(spark, d):
    return values_of(spark, d, STATUS_CELLS)


@query(f"with {_values_sql(MONEY_CELLS)}, real as (select * from v where value <> 'n/a') select 'unique' as kind, 'us' as preset, 'us' as among, cast(sum(count) as bigint) as examined, cast(0 as bigint) as unfit, count(*) as \"distinct\", true as touched from real")
def number_preset_unique(spark, d):
    """Whole numbers and dollars with group marks: one preset reads all."""
    return pr.number_preset(values_of(spark, d, MONEY_CELLS))


@query(f"with {_values_sql(EURO_CELLS)} select 'unique' as kind, 'eu' as preset, 'eu' as among, cast(sum(count) as bigint) as examined, cast(coalesce(sum(count) filter (value = 'free'), 0) as bigint) as unfit, count(*) as \"distinct\", true as touched from v")
def number_preset_marked(spark, d):
    return pr.number_preset(values_of(spark, d, EURO_CELLS))


@query(f"with {_values_sql(DATE_CELLS)} select 'unique' as kind, 'mdy_slash' as preset, 'mdy_slash' as among, cast(sum(count) as bigint) as examined, cast(0 as bigint) as unfit, count(*) as \"distinct\", true as touched from v where value <> '-'")
def date_preset_unique(spark, d):
    """Days above 12 and a time of day leave one reading."""
    return pr.date_preset(values_of(spark, d, DATE_CELLS))


@query(f"with {_values_sql(OPEN_DATES)} select 'ambiguous' as kind, cast(null as varchar) as preset, 'mdy_slash,dmy_slash' as among, cast(sum(count) as bigint) as examined, cast(0 as bigint) as unfit, count(*) as \"distinct\", false as touched from v")
def date_preset_ambiguous(spark, d):
    return pr.date_preset(values_of(spark, d, OPEN_DATES))


@query(f"with {_values_sql(EURO_CELLS)} select case when value like '%€' then '€' else '£' end as mark, cast(sum(count) as bigint) as \"values\" from v where value like '%€' or value like '£%' group by 1")
def currency_marks(spark, d):
    return pr.currency_scan(values_of(spark, d, EURO_CELLS))


@query("select 'mixed' as kind, '£,€' as marks")
def currency_decision(spark, d):
    return pr.currency_decision(pr.currency_scan(values_of(spark, d, EURO_CELLS)))


@query(f"""with {_values_sql(STATUS_CELLS)} select value, count, case value when 'En Tránsito' then 'in_transit' when 'In_Transit' then 'in_transit' when 'delivered' then 'delivered' when 'Đã giao' then 'delivered'
  when 'CANCELED' then 'cancelled' when 'offen' then 'pending' end as target, value = 'on-hold' as ambiguous from v""")
def status_words(spark, d):
    return pr.status_map(values_of(spark, d, STATUS_CELLS))


SHORT_SQL = "short as (select lower(code) as key, code as target, 'code' as \"by\" from locations where kind = 'warehouse' union all select lower(replace(code, 'WH-', '')), code, 'alias' from locations where kind = 'warehouse' union all select lower(name), code, 'name' from locations where kind = 'warehouse')"


@query(f"with {st.LOCATIONS_SQL}, {SHORT_SQL}, {_values_sql(PLACE_CELLS)} select value, count, target, \"by\" from v left join short on lower(value) = key")
def warehouse_words(spark, d):
    return pr.warehouse_map(values_of(spark, d, PLACE_CELLS), st.locations(spark, d))


@query(f"""with {st.LOCATIONS_SQL}, {SHORT_SQL}, {_values_sql(PLACE_CELLS)}, located as (select v.*, code, target from v left join places on upper(value) = place left join short on lower(value) = key)
select cast(sum(count) as bigint) as rows, cast(sum(count) filter (code is not null or target is not null) as bigint) as recognized, cast(sum(count) filter (code is null and target is null) as bigint) as unmapped, count_if(code is null and target is null) as unmapped_values from located""")
def location_summary(spark, d):
    return pr.location_summary(pr.located_values(values_of(spark, d, PLACE_CELLS), st.locations(spark, d)))


@query(f"""with {LINES_SQL}, cells as (select line, 'cost' as "column", trim({MONEY_CELLS}) as value from lines union all select line, 'day', trim({DATE_CELLS}) from lines union all select line, 'state', trim({STATUS_CELLS}) from lines),
counted as (select "column", value, count(*) as n, min(line) as first, value not in ('', 'n/a', '-') as filled from cells group by 1, 2)
select "column", cast(sum(n) as bigint) as rows, cast(sum(n) filter (filled) as bigint) as filled, count_if(filled) as "distinct", cast(coalesce(sum(n) filter (filled and "column" = 'day'), 0) as bigint) as dates, cast(0 as bigint) as iso_dates,
  cast(coalesce(sum(n) filter (filled and "column" = 'cost'), 0) as bigint) as numbers, cast(coalesce(sum(n) filter (filled and "column" = 'cost' and value not like '$%'), 0) as bigint) as integers,
  cast(coalesce(sum(n) filter (filled and "column" = 'state'), 0) as bigint) as texts, cast(coalesce(sum(n) filter (filled and regexp_full_match(value, '[A-Za-z0-9][A-Za-z0-9-]{{2,31}}')), 0) as bigint) as ids,
  cast(coalesce(sum(n * length(value)) filter (filled), 0) as bigint) as characters, (array_agg(value order by n desc, first) filter (filled))[1] as top from counted group by 1""")
def column_profile(spark, d):
    cells = lines(spark, d).selectExpr("line", f"{MONEY_CELLS} as cost", f"{DATE_CELLS} as day", f"{STATUS_CELLS} as state")
    return pr.column_profile(cells, ["cost", "day", "state"])
