"""Queries from raw files' own shapes and words to canonical rows, over tables made of the stand-ins, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws
from ..operators import canonical as ca
from ..operators import flatten as fl
from ..operators import importing as im
from ..operators import spelling as sg
from ..operators import structure as sr
from . import import_queries as iq
from . import standins as st
from .queries import query

# ---- nested records ----------------------------------------------------------------------------------------------------

K = "cast(get_json_object(props, '$.k') as int)"
PARTS = "array_join(transform(filter(sequence(1, 3), j -> j <= i % 3), j -> concat('{\"x\":', i * j, '}')), ',')"
MARK = f"concat('{{\"n\":', i, case when i = 2 then '' else concat(',\"value\":\"v', i * k, '\"') end, ',\"parts\":[', {PARTS}, ']}}')"
NESTED = f"""concat('{{"event":{{"id":', event_id, ',"type":"', coalesce(event_type, ''), '"}},"props":', coalesce(props, '{{}}'), ',"place":', case when k % 5 = 0 then concat('{{"zone":', k, '}}') when k % 5 = 1 then 'null' else concat('"Z-', k, '"') end,
  case when k % 11 = 0 then '' else concat(',"marks":[', array_join(transform(filter(sequence(1, 3), i -> i <= k % 4), i -> {MARK}), ','), ']') end, '}}')"""
NESTED_SQL = "e as (select *, coalesce(cast(json_extract(props, '$.k') as integer), 0) as k from events), m as (select event_id, k, unnest(range(1, k % 4 + 1)) as i from e where k % 11 <> 0)"


def nested_records(spark, d):
    """event_id and record: each event's props, told again as an object with objects, an array of objects and arrays in those."""
    rows = st.read(spark, d, "events").selectExpr("event_id", "event_type", "props", f"coalesce({K}, 0) as k")
    return rows.selectExpr("event_id", f"{NESTED} as record")


def nested_table(spark, d, name):
    return fl.flatten(nested_records(spark, d), "event_id", "record", "events")[name]


@query(f"""with {NESTED_SQL} select cast(event_id as varchar) as _key, cast(event_id as varchar) as "event.id", event_type as "event.type", cast(json_extract(props, '$.k') as varchar) as "props.k",
  case when k % 5 = 0 then '{{"zone":' || k || '}}' when k % 5 > 1 then 'Z-' || k end as place from e""")
def flatten_records(spark, d):
    """The main table: leaves of nested objects by dotted path; what is an object here and a text there is one column."""
    return nested_table(spark, d, "events")


@query(f"""with {NESTED_SQL} select event_id || '.marks[' || (i - 1) || ']' as _key, cast(event_id as varchar) as _parent, cast(i - 1 as integer) as _ordinal, cast(i as varchar) as n, case when i <> 2 then 'v' || (i * k) end as value from m""")
def flatten_children(spark, d):
    return nested_table(spark, d, "events.marks")


@query(f"""with {NESTED_SQL}, p as (select *, unnest(range(1, i % 3 + 1)) as j from m)
select event_id || '.marks[' || (i - 1) || '].parts[' || (j - 1) || ']' as _key, event_id || '.marks[' || (i - 1) || ']' as _parent, cast(j - 1 as integer) as _ordinal, cast(i * j as varchar) as x from p""")
def flatten_grandchildren(spark, d):
    return nested_table(spark, d, "events.marks.parts")


# ---- rows that aren't data ---------------------------------------------------------------------------------------------

#: A sheet: line and cells in words that both engines have; {a} begins and {b} ends an array.
SHEET_HEADER = "{a}'Order No.', ' Part_name', 'Qty', 'Cost (USD)', 'Note'{b}"
SHEET_ROWS = """case when o % 97 = 0 then {a}'order-no', 'PART NAME', 'qty', 'cost usd', ''{b} when o % 101 = 0 then {a}'Order no', 'Part name', 'Qty', '7', 'x'{b} when o % 89 = 0 then {a}'', 'Sub-Total', '', concat('$', p), '-'{b}
  when o % 83 = 0 then {a}'Tổng cộng', 'none', '', ''{b} when o % 79 = 0 then {a}'total', concat('', p % 90, ',5')
{b} when o % 73 = 0 then {a}'', 'a note of its own', '', 'n/a'{b} when o % 71 = 0 then {a}'-', '', 'N/A'{b} when o % 67 = 0 then {a}'Totals of the year', '5'{b}
  else {a}concat('', o), concat('Part ', p), concat('', p % 9), concat(p % 90, '.5'), case when p % 3 = 0 then 'ok' else '' end{b} end"""
#: Rows at the sheet's end, by region: notes, a total among them, an empty row.
SHEET_END = "case r when 0 then {a}repeat('Report by the system. ', 4), ''{b} when 1 then {a}'Total', '', '', '12'{b} when 2 then {a}'', ' '{b} else {a}'', name, 'null'{b} end"
END = 1 << 40
SHEET_SQL = f"""{iq.LINES_SQL}, sheet as (select 1 as line, {SHEET_HEADER.format(a='[', b=']')} as cells union all select line + 1, {SHEET_ROWS.format(a='[', b=']')} from lines
  union all select {END} + r, {SHEET_END.format(a='[', b=']')} from (select r_regionkey as r, r_name as name from region)),
keyed as (select line, cells, list_filter(list_transform(cells, lambda c: trim(c)), lambda c: c <> '' and lower(c) not in ('n/a', 'none', 'null', '-')) as filled,
  list_transform(cells, lambda c: trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(c)), '[_./-]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))) as keys from sheet),
told as (select line, filled, case when len(list_filter(keys, lambda k: k <> '')) >= 2 and len(list_filter(keys, lambda k: k in ('order no', 'part name', 'qty', 'cost usd', 'note'))) >= 4 then 'repeated-header'
  when regexp_matches(trim(regexp_replace(regexp_replace(lower(strip_accents(filled[1])), '[_./-]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')), '^(total|sub total|tong cong)( |$)')
    and len(list_filter(cells[2:], lambda c: regexp_full_match(trim(c), '[-+$€£]?[ ]?[0-9][0-9., ]*'))) > 0 then 'total' end as kind from keyed where line > 1 and len(filled) > 0),
found as (select line, coalesce(kind, 'footer') as kind, case when len(filled[1]) > 60 then substr(filled[1], 1, 59) || '…' else filled[1] end as label
  from told where kind is not null or line > (select max(line) from told where kind is null and len(filled) > 1))"""


def sheet(spark, d):
    """line and cells: a header, lines of orders with repeated headers, totals and notes between them, and an end."""
    a, b = "array(", ")"
    lines = iq.lines(spark, d).selectExpr("line + 1 as line", f"{SHEET_ROWS.format(a=a, b=b)} as cells")
    end = st.read(spark, d, "region").selectExpr("r_regionkey as r", "r_name as name").selectExpr(f"cast({END} + r as bigint) as line", f"{SHEET_END.format(a=a, b=b)} as cells")
    return spark.range(1).selectExpr("1L as line", f"{SHEET_HEADER.format(a=a, b=b)} as cells").unionByName(lines).unionByName(end)


@query(f"with {SHEET_SQL} select * from found")
def structural_rows(spark, d):
    return sr.structural_rows(sheet(spark, d), 1)


@query(f"""with {SHEET_SQL}, gone as (select kind as reason from found where line % 3 <> 0 union all select 'user' from sheet where line > 1 and line % 1000 = 9 and line % 3 <> 0 and line not in (select line from found))
select reason, count(*) as rows from gone group by 1 union all select 'kept', count(*) - 1 - (select count(*) from gone) from sheet""")
def excluded_counts(spark, d):
    """Two thirds of the rows found are confirmed, and some more that the user names."""
    raw = sheet(spark, d)
    found = sr.structural_rows(raw, 1)
    chosen = found.select("line").where("line % 3 <> 0").unionByName(raw.select("line").where("line % 1000 = 9 and line % 3 <> 0"))
    _, rows, gone = sr.apply_structure(raw, 1, found, chosen)
    return sr.excluded_counts(gone).unionByName(rows.agg(F.lit("kept").alias("reason"), F.count("*").alias("rows")))


# ---- from a user's columns and words to canonical rows, and back ----------------------------------------------------------

WORDS_HEADER = ["Ref", "From", "To", "Haulier", "State", "Shipped", "ETA", "Arrived", "Freight (USD)", "Remark"]
WORDS_MAP = ["shipment_id", "origin", "destination", "carrier", "status", "ship_date", "estimated_delivery", "actual_delivery", "shipping_cost", None]
LONG_STATE = "waiting for the customs papers of the port"
WORDS = [
    "case when o % 97 = 0 then concat('SHP_', o) when o % 89 = 0 then concat('SHP-', o, '-1') else concat(' shp-', o, '-', n) end",
    "case when o % 83 = 0 then ' ' else concat(' Port  ', o % 7) end",
    "concat('Town ', p % 11)",
    "concat('Carrier ', p % 5)",
    f"case o % 9 when 0 then 'En Tránsito' when 1 then 'Delivered' when 2 then 'CANCELED' when 3 then ' on-hold' when 4 then 'Đã giao' when 5 then case when o % 2 = 0 then '{LONG_STATE}' else 'lost' end when 6 then 'shipped' when 7 then 'In_Transit' else 'offen' end",
    "case when o % 61 = 0 then '15/8/2026' when o % 59 = 0 then '2026-03-02' when o % 53 = 0 then '2/3/1999' when o % 47 = 0 then 'n/a' else concat(1 + o % 12, '/', 1 + p % 28, '/20', 10 + o % 15, case when o % 4 = 0 then ' 8:05 PM' else '' end) end",
    "case when o % 5 = 0 then '-' when o % 43 = 0 then ' N/A' else concat(1 + o % 12, '/', 1 + o % 28, '/2025') end",
    "case when o % 3 = 0 then concat('0', 1 + o % 9, '/', 10 + o % 18, '/2025') else '' end",
    "case when o % 41 = 0 then '' when o % 37 = 0 then '€ 5.00' when o % 31 = 0 then '12,50' when o % 29 = 0 then '-$3' when o % 7 = 0 then concat('$ ', 1 + o % 8, ',', 100 + o % 800, '.', 10 + p % 90) when o % 23 = 0 then '1.005' else concat(p % 900, '.5') end",
    "'remark'",
]
#: Pairs of a text and the status that the user chose for it; the second goes against the known words.
STATUS_CHOICES = [("on-hold", "pending"), ("shipped", "delivered")]
WORDS_FILE = "/uploads/orders.csv"
SHAPE = "case when p % 103 = 0 then 8 when p % 107 = 0 then 11 else 10 end"
EMPTY = "p % 113 = 0"


def word_rows(spark, d):
    """file, line, cells of shipments as a carrier writes them; some rows are short, too long or without any value."""
    rows = st.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).selectExpr("l_orderkey as o", "l_linenumber as n", "p")
    made = rows.selectExpr("p", "o * 8 + n as line", f"case when {EMPTY} then array('', ' ', '', '', '', '', '-', 'N/A', '', 'remark') else array({', '.join(WORDS)}) end as cells")
    return made.selectExpr(f"'{WORDS_FILE}' as file", "line", "case when p % 103 = 0 then slice(cells, 1, 8) when p % 107 = 0 then array_append(cells, 'y') when p % 109 = 0 then array_append(cells, ' ') else cells end as cells")


def words_plan():
    return ca.plan(WORDS_HEADER, im.SHIPMENT_COLUMNS, WORDS_MAP, number_preset="us", date_preset="mdy_slash")


def word_choices(spark):
    return {"status": spark.createDataFrame(STATUS_CHOICES, "source string, target string")}


def cooked_words(spark, d):
    return ca.cooked(word_rows(spark, d), words_plan(), choices=word_choices(spark))


FIELDS = [c for c in WORDS_MAP if c]
_day = lambda c, blank: f"""case when {blank} then '' when regexp_full_match({c}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}( 8:05 PM)?') and try_cast(split_part(split_part({c}, '/', 3), ' ', 1) || '-' || lpad(split_part({c}, '/', 1), 2, '0') || '-' || lpad(split_part({c}, '/', 2), 2, '0') as date) is not null
  then split_part(split_part({c}, '/', 3), ' ', 1) || '-' || lpad(split_part({c}, '/', 1), 2, '0') || '-' || lpad(split_part({c}, '/', 2), 2, '0') else {c} end"""  # noqa: E731
_PLAIN = "regexp_replace(raw_shipping_cost, '^(-?)[$] ?', '\\1')"
COOK = {
    "status": "case raw_status when 'on-hold' then 'pending' when 'shipped' then 'delivered' when 'En Tránsito' then 'in_transit' when 'In_Transit' then 'in_transit' when 'Delivered' then 'delivered' when 'Đã giao' then 'delivered' when 'CANCELED' then 'cancelled' when 'offen' then 'pending' else raw_status end",
    "ship_date": _day("raw_ship_date", "false"),
    "estimated_delivery": _day("raw_estimated_delivery", "lower(raw_estimated_delivery) in ('-', 'n/a')"),
    "actual_delivery": _day("raw_actual_delivery", "lower(raw_actual_delivery) in ('-', 'n/a')"),
    "shipping_cost": f"case when regexp_full_match({_PLAIN}, '-?([0-9]+|[1-9][0-9]{{0,2}}(,[0-9]{{3}})+)([.][0-9]+)?') then replace({_PLAIN}, ',', '') else raw_shipping_cost end",
}
COOKED_SQL = f"""sold as (select l_orderkey as o, l_linenumber as n, min(l_partkey) as p, l_orderkey * 8 + l_linenumber as line from lineitem group by 1, 2),
written as (select line, {SHAPE} as width, {EMPTY} as empty, {', '.join(f"case when {EMPTY}{' or p % 103 = 0' if i >= 8 else ''} then '' else trim({c}) end as raw_{f}" for i, (c, f) in enumerate(zip(WORDS, FIELDS)))} from sold),
cooked as (select *, {', '.join(f"{COOK.get(f, f'raw_{f}')} as c_{f}" for f in FIELDS)} from written)"""


@query(f"""with {COOKED_SQL} select line, 'orders.csv, line ' || line as place, {', '.join(f'c_{f} as {f}' for f in FIELDS)}, case when width <> 10 then width end as ragged, width = 10 and empty as blank from cooked""")
def cooked_cells(spark, d):
    """Every canonical cell that the user's columns and words give."""
    rows = cooked_words(spark, d)
    return rows.select("line", "place", *[F.get("canonical", F.lit(i)).alias(f) for i, f in enumerate(FIELDS)], "ragged", "blank")


DRY_SQL = f"""{COOKED_SQL}, {iq._issues_sql("select * from cooked where width = 10 and not empty", [f"c_{f}" for f in FIELDS], iq.SHIPMENT_CHECKS, "9", "upper(shipment_id)", "'shipment ID " + chr(34) + "' || key || '" + chr(34) + "'", "'shipment_id'")},
texts as (select line, {', '.join(f"c_{f}, raw_{f}" for f in FIELDS)} from cooked),
paired as (select found.*, case "column" {' '.join(f"when '{f}' then c_{f}" for f in FIELDS)} end as canonical, case "column" {' '.join(f"when '{f}' then raw_{f}" for f in FIELDS)} end as written from found join texts using (line)),
quoted as (select *, replace(message, '"' || canonical || '"', '"' || case when len(written) > 40 then written[:40] || '…' else written end || '"') as said from paired),
dry as (select line, column_order, "column", code, case when code = 'DUPLICATE_ID' then regexp_replace(said, 'line ([0-9]+)\\).$', 'orders.csv, line \\1).')
    when written <> '' and "column" = 'shipping_cost' and code <> 'CONTROL_CHARS' then said || ' Number format: 1,234.56 (comma thousands, dot decimal).'
    when written <> '' and "column" in ('ship_date', 'estimated_delivery', 'actual_delivery') and code in ('INVALID_DATE', 'OUT_OF_RANGE') then said || ' Date format: 8/15/2026 (month/day/year).' else said end as message from quoted
  union all select line, -1, null, 'FIELD_COUNT', 'Expected 10 fields but found ' || width || '.' from cooked where width <> 10)"""


def word_problems(spark, d):
    return ca.problems(ca.dry_run(cooked_words(spark, d), words_plan(), ["shipment_id"], 'shipment ID "{}"'), words_plan())


@query(f"with {DRY_SQL} select line, 'orders.csv, line ' || line as place, column_order, \"column\", code, message from dry")
def dry_run_problems(spark, d):
    """Every problem at its place in the user's file, quoting what the user wrote."""
    return word_problems(spark, d)


@query(f"""with {DRY_SQL}, cells as (select 'orders.csv, line ' || line as place, coalesce("column", '') as name, message from dry)
select 'row,column,problem' as value union all select '"' || place || '",' || name || ',' || case when regexp_matches(message, '[,"]') then '"' || replace(message, '"', '""') || '"' else message end from cells""")
def problems_csv(spark, d):
    return ca.problem_lines(word_problems(spark, d)).select("value")


STOCK_HEADER = ["Artikel", "Bezeichnung", "Lager", "Bestand", "Meldebestand", "Preis (USD)", "Bemerkung"]
STOCK_MAP = ["sku", "product_name", "warehouse", "quantity", "reorder_point", "unit_cost", None]
STOCK_CELLS = [
    "concat('p-', p, '-', w)",
    "concat(name, case when p % 3 = 0 then ', \"neu\"' else '' end)",
    "case (p + w) % 4 when 0 then concat('Hub ', w) when 1 then concat('wh_', w) when 2 then concat('', w) else case when w = 0 then 'Haupt lager' else concat(' WH-', w) end end",
    "case when (p + w) % 2 = 0 then concat(1 + p % 7, '.', 100 + p % 800) else concat('', p % 900) end",
    "concat('', p % 300)",
    "case when p % 5 = 0 then concat('$1.', 100 + p % 800, ',', 10 + p % 90) when p % 5 = 1 then concat(p % 500, ' USD') else concat(p % 500, ',5') end",
    "'-'",
]


def stock_words(spark, d):
    rows = st.parts(spark, d).selectExpr("p_partkey as p", "p_name as name", "explode(sequence(0, 4)) as w").where("p % 5 <> w")
    return rows.selectExpr("p * 5 + w + 2 as line", f"array({', '.join(STOCK_CELLS)}) as cells")


def stock_plan():
    columns = im.inventory_columns(iq.WAREHOUSES)
    return ca.plan(STOCK_HEADER, columns, STOCK_MAP, {"category": "Parts", "lead_time_days": "10"}, iq.WAREHOUSES, number_preset="eu")


def cooked_stock(spark, d):
    choices = {"warehouse": spark.createDataFrame([("Haupt lager", "WH-0")], "source string, target string")}
    return ca.cooked(stock_words(spark, d), stock_plan(), st.locations(spark, d), choices)


STOCK_SQL = """stock as (select p_partkey * 5 + w + 2 as line, 'P-' || p_partkey || '-' || w as sku, p_name || case when p_partkey % 3 = 0 then ', "neu"' else '' end as product_name, 'Parts' as category, 'WH-' || w as warehouse,
  case when (p_partkey + w) % 2 = 0 then (1 + p_partkey % 7) * 1000 + 100 + p_partkey % 800 else p_partkey % 900 end as quantity, p_partkey % 300 as reorder_point,
  case when p_partkey % 5 = 0 then 100000 + (100 + p_partkey % 800) * 100 + 10 + p_partkey % 90 when p_partkey % 5 = 1 then p_partkey % 500 * 100 else p_partkey % 500 * 100 + 50 end as cents,
  case when p_partkey % 5 = 0 then (1100 + p_partkey % 800) || '.' || (10 + p_partkey % 90) when p_partkey % 5 = 1 then '' || (p_partkey % 500) else (p_partkey % 500) || '.5' end as cost from part, range(5) t(w) where p_partkey % 5 <> w)"""


@query(f"with {STOCK_SQL} select sku, product_name, category, warehouse, quantity, reorder_point, cast(cents as bigint) as unit_cost_cents, cast(null as double) as avg_daily_usage, cast(10 as integer) as lead_time_days from stock")
def cooked_accepted(spark, d):
    """From a user's words, with constants for whole columns and one field left unknown, to the rows that the strict import takes."""
    return im.accepted(ca.dry_run(cooked_stock(spark, d), stock_plan(), ["sku", "warehouse"], 'SKU + warehouse "{} @ {}"'))


@query(f"""with {STOCK_SQL} select cast(null as bigint) as line, 'sku,product_name,category,warehouse,quantity,reorder_point,unit_cost,avg_daily_usage,lead_time_days' as value
union all select line, concat_ws(',', lower(sku), case when product_name like '%,%' then '"' || replace(product_name, '"', '""') || '"' else product_name end, category, warehouse, quantity, reorder_point, cost, '', '10') from stock""")
def canonical_file(spark, d):
    """The canonical CSV, header and all columns, money in dollars, beside the source line of each row."""
    return ca.canonical_lines(cooked_stock(spark, d), stock_plan())


# ---- words spelled alike -----------------------------------------------------------------------------------------------------

WORD_LIST = "explode(regexp_extract_all(lower(text), '[a-zà-ÿ]+', 0))"
WORDS_SQL = "w as (select distinct unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) as w from benchmark)"
#: Row by row of the table of distances, for pairs that an unrestricted distance lets through; that one counts bytes, two a letter at most.
OSA_SQL = """pairs as (select a.w as a, b.w as b, case when least(len(a.w), len(b.w)) >= 9 then 2 else 1 end as most from w a join w b on a.w < b.w and abs(len(a.w) - len(b.w)) <= 2 and least(len(a.w), len(b.w)) >= 5
  where damerau_levenshtein(a.w, b.w) <= case when least(len(a.w), len(b.w)) >= 9 then 4 else 2 end),
dp(a, b, most, i, before, row) as (
  select a, b, most, cast(0 as bigint), range(0, len(b) + 1), range(0, len(b) + 1) from pairs
  union all
  select a, b, most, i + 1, row, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda cur, j: list_append(cur, least(row[j[1] + 1] + 1, cur[-1] + 1, row[j[1]] + case when a[i + 1] = b[j[1]] then 0 else 1 end,
    case when i > 0 and j[1] > 1 and a[i + 1] = b[j[1] - 1] and a[i] = b[j[1]] then before[j[1] - 1] + 1 else 99 end)), [i + 1]) from dp where i < len(a))"""


@query(f"with recursive {WORDS_SQL}, {OSA_SQL} select a as word, b as other, cast(row[-1] as integer) as distance from dp where i = len(a) and row[-1] <= most")
def spelling_pairs(spark, d):
    """Words of the benchmark's texts that one or two slips of the pen make of each other."""
    words = st.read(spark, d, "benchmark").selectExpr(f"{WORD_LIST} as word")
    return sg.spelled_alike(words)


# ---- draws -------------------------------------------------------------------------------------------------------------------

SEED, W32 = 20260315, 4294967295
_MUL = "cast((cast({a} as hugeint) * {b}) & {w} as bigint)"
DRAWS_SQL = f"""s0 as (select event_id, cast(({SEED} + (event_id + 1) * cast(1831565813 as hugeint)) & {W32} as bigint) as a from events where event_id is not null),
s1 as (select event_id, {_MUL.format(a="xor(a, a >> 15)", b="(a | 1)", w=W32)} as t from s0),
s2 as (select event_id, xor((t + {_MUL.format(a="xor(t, t >> 7)", b="(t | 61)", w=W32)}) & {W32}, t) as t from s1), drawn as (select event_id, xor(t, t >> 14) as word from s2)"""


@query(f"with {DRAWS_SQL} select event_id, word, cast(floor(word / 4294967296e0 * 6) + 1 as bigint) as die, ['pending', 'in_transit', 'delivered'][cast(floor(word / 4294967296e0 * 3) as integer) + 1] as status from drawn")
def event_draws(spark, d):
    """A draw for every event by its number, each made without the ones before."""
    rows = st.read(spark, d, "events").where("event_id is not null")
    at = F.col("event_id")
    return rows.select("event_id", draws.word(SEED, at).alias("word"), draws.between(SEED, at, 1, 6).alias("die"), draws.picked(SEED, at, ["pending", "in_transit", "delivered"]).alias("status"))
