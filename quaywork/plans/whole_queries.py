"""Queries whose SQL works out every figure: the snapshot, the whole metrics bundle, presets of every kind, gates with both outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import reference as rf
from ..functions.text import alias_key
from ..operators import attention as at
from ..operators import figures as fi
from ..operators import importing as im
from ..operators import listing as li
from ..operators import profiling as pr
from ..operators import series as se
from ..operators import snapshot as sn
from ..operators.inventory import enrich_inventory
from ..operators.shipments import located
from ..scratch import written
from . import import_queries as iq
from . import standins as st
from .queries import BOTH, PLAN_SQL, SQL, inventory, query, routes, scaled, shipments

# ---- the snapshot --------------------------------------------------------------------------------------------------------------

#: Columns of each section that both engines write alike, and the SQL that has them.
SECTIONS = {
    "inventory": ("inventory_enriched", "item_id warehouse quantity value_cents stock_status stockout_risk"),
    "shipments": ("shipments_enriched", "shipment_id route_key status ship_date delivery_state days_late transit_days"),
    "alerts": ("alerts_all", "alert_id type severity title message kind"),
    "kpis": ("kpi_summary", "items units value_cents out_of_stock low_stock shipments open_shipments delivered cancelled delayed overdue late on_time shipping_cents average_cost_cents"),
    "utilization": ("warehouse_utilization", "code name capacity_units units value_cents items"),
    "value_by_warehouse": ("inventory_value_by_warehouse", "warehouse name value_cents units items"),
    "value_by_category": ("inventory_value_by_category", "category value_cents units items"),
    "shipments_by_status": ("shipments_by_status", "status shipments"),
    "cost_by_month": ("shipping_cost_by_month", "month shipping_cents shipments"),
    "ontime_by_month": ("ontime_vs_delayed_by_month", "month on_time delayed"),
    "lanes": ("route_summary", "route_key route_label shipments shipping_cents average_cost_cents delayed is_mapped"),
}
_said = lambda c: f"strftime({c}, '%Y-%m-%d')" if c == "ship_date" else c
SNAPSHOT_SQL = " union all ".join(f"select '{name}' as section, cast(to_json({{{', '.join(f'{chr(39)}{c}{chr(39)}: {_said(c)}' for c in columns.split())}}}) as varchar) as value from ({SQL[source]})" for name, (source, columns) in SECTIONS.items())


@query(f"{SNAPSHOT_SQL} union all select 'metrics', cast(to_json({{'high': high, 'medium': medium, 'low': low, 'unknown': unknown}}) as varchar) from ({SQL['stockout_risk_counts']}) union all select 'locations', cast(to_json({{'code': code, 'name': name, 'kind': kind}}) as varchar) from (with {st.LOCATIONS_SQL} select * from locations)")
def snapshot(spark, d):
    """Both tables, key figures, series, lanes, alerts and places as JSON lines by section."""
    made = sn.snapshot_sections(st.inventory(spark, d), st.shipments(spark, d), st.locations(spark, d), st.TODAY)
    shown = {name: made[name].select(*columns.split()) for name, (_, columns) in SECTIONS.items()}
    shown["metrics"] = made["metrics"].select("risk.high", "risk.medium", "risk.low", "risk.unknown")
    shown["locations"] = made["locations"].select("code", "name", "kind")
    return sn.snapshot_lines(shown)


_MILLIONTHS = "cast(floor(1e6 * {} + 0.5e0) as bigint)"


@query(f"""with {BOTH}, s as (select sum(avg_daily_usage * 365 * unit_cost_cents) / sum(value_cents) as turnover, count(avg_daily_usage) as items_with_usage, count(*) as items from inventory)
select {_MILLIONTHS.format('turnover')} as turnover_millionths, {_MILLIONTHS.format('365e0 / turnover')} as days_of_inventory_millionths, items_with_usage, items, risk.*, {_MILLIONTHS.format('on_time')} as on_time_millionths, {_MILLIONTHS.format('days')} as delivery_days_millionths
from s, (select count_if(stockout_risk = 'high') as high, count_if(stockout_risk = 'medium') as medium, count_if(stockout_risk = 'low') as low, count_if(stockout_risk = 'unknown') as unknown from inventory) risk,
  (select cast(count_if(delivery_state = 'on_time') as double) / nullif(count_if(delivery_state in ('on_time', 'late')), 0) as on_time, avg(transit_days) as days from shipments)""")
def metrics_whole(spark, d):
    """All figures of the metrics bundle."""
    rows = fi.metrics_bundle(inventory(spark, d), shipments(spark, d))
    return rows.select(scaled("supply.turnover").alias("turnover_millionths"), scaled("supply.days_of_inventory").alias("days_of_inventory_millionths"), "supply.items_with_usage", "supply.items", "risk.*", scaled("delivery.on_time_rate").alias("on_time_millionths"), scaled("delivery.average_delivery_days").alias("delivery_days_millionths"))


# ---- items without usage, gates ----------------------------------------------------------------------------------------------------

UNUSED = "quantity = 0 and (p % 2 = 0 or w = 1)"
_IDLE_SQL = PLAN_SQL.replace("case when (p_partkey + w * 11) % 90 = 0 then null", "case when (p_partkey + w * 11) % 90 = 0 or ((p_partkey + w * 11) % 37 = 0 or (p_partkey * 37 + w * 101) % 900 = 0) and (p_partkey % 2 = 0 or w = 1) then null")


@query(f"with {_IDLE_SQL} select key, tone, what, damage, action from idle")
def idle_items(spark, d):
    """Items out of stock of whose usage nothing is known: most of those out of stock here."""
    bare = st.inventory(spark, d).selectExpr("*", "cast(substring(sku, 3) as bigint) as p", "cast(substring(warehouse, 4) as int) as w")
    bare = bare.withColumn("avg_daily_usage", F.when(~F.expr(UNUSED), F.col("avg_daily_usage"))).drop("p", "w")
    return at.no_usage_rows(at.transfer_plan(enrich_inventory(bare), st.locations(spark, d))).drop("sort_key")


@query(f"""with {iq.INVENTORY_ISSUES}, bad as (select count(distinct line) as n from found)
select 'with mistakes' as source, (select count(*) from src) as rows, n as rows_with_problems, case when n = 0 then (select count(*) from src) else 0 end as accepted from bad
union all select 'without', count(*), 0, count(*) from ({iq.CLEAN_SQL})""")
def import_gate(spark, d):
    """Of two tables, one with mistakes and one without, how many rows come, have problems and are let through."""
    def told(name, rows):
        sums = rows.agg(F.lit(name).alias("source"), F.count("*").alias("rows"), F.count_if(F.size("problems") > 0).alias("rows_with_problems"))
        return sums.crossJoin(im.accepted(rows).agg(F.count("*").alias("accepted")))

    clean = im.check_inventory(iq.raw_inventory(spark, d, clean=True), iq.INVENTORY_HEADER, iq.WAREHOUSES)
    return told("with mistakes", iq.inventory_rows(spark, d)).unionByName(told("without", clean))


# ---- presets of every kind ----------------------------------------------------------------------------------------------------------

#: Columns of numbers as different sources write them; b is the no-break space.
NUMBERS = {
    "plain": "concat(p % 900, '.', 10 + p % 90)",
    "whole": "concat('', p)",
    "us": "case when o % 3 = 0 then concat(1 + o % 9, ',', 100 + p % 800, '.5') else concat(p % 90, '') end",
    "eu": "case when o % 3 = 0 then concat(1 + o % 9, '.', 100 + p % 800, ',50') else concat('', p % 90) end",
    "fr": "case when o % 3 = 0 then concat(1 + o % 9, ' ', 100 + p % 800, ',5') when o % 3 = 1 then concat('', 10 + p % 9, chr(160), '000') else '-' end",
    "open": "concat(1 + o % 9, ',', 100 + p % 800)",
    "mixed": "case when o % 2 = 0 then concat(1 + o % 9, ',', 100 + p % 800, '.25') else concat(p % 90, ',25') end",
    "texts": "case when o % 3 = 0 then concat('', p) else concat('part ', p) end",
    "some_texts": "case when o % 3 = 0 then concat('part ', p) else concat(p % 90, ',5') end",
    "dollars": "concat('$', p % 90, '.', 10 + o % 90)",
}
DATES = {
    "iso": "concat('20', 10 + o % 15, '-0', 1 + p % 9, '-', 10 + p % 18, case when o % 4 = 0 then 'T08:30:00Z' else '' end)",
    "ymd_slash": "concat('2026/', 1 + o % 12, '/', 1 + p % 28)",
    "mdy_slash": "concat(1 + o % 12, '/', 1 + p % 28, '/2026')",
    "dmy_slash": "concat(1 + p % 28, '/', 1 + o % 12, '/2026')",
    "dmy_dot": "concat(1 + p % 28, '.', 1 + o % 12, '.2026')",
    "open": "concat(1 + o % 12, '/', 1 + p % 12, '/2026')",
    "same": "concat(1 + o % 12, '/', 1 + o % 12, '/2026')",
    "mixed": "case when o % 2 = 0 then concat(13 + p % 9, '/', 1 + o % 12, '/2026') else concat(1 + o % 12, '/', 13 + p % 9, '/2026') end",
    "no_days": "case when o % 3 = 0 then '2026-01-05' else concat('2026-02-', 30 + o % 2) end",
}
_GROUP = {"plain": ("[0-9]+", "", "."), "us": ("([0-9]+|[1-9][0-9]{0,2}(,[0-9]{3})+)", ",", "."), "eu": ("([0-9]+|[1-9][0-9]{0,2}([.][0-9]{3})+)", ".", ",")}


def _number_sql(preset: str) -> str:
    bare = "regexp_replace(value, '^[$] ?', '')"
    if preset == "fr":
        spaces = "' ' || chr(160)"
        fits = " or ".join(f"regexp_full_match({bare}, '-?[1-9][0-9]{{0,2}}(' || {s} || '[0-9]{{3}})+(,[0-9]+)?')" for s in ("' '", "chr(160)"))
        return f"case when regexp_full_match({bare}, '-?[0-9]+(,[0-9]+)?') or {fits} then replace(translate({bare}, {spaces}, ''), ',', '.') end"
    whole, group, point = _GROUP[preset]
    value = f"replace({bare}, '{group}', '')" if group else bare
    return f"case when regexp_full_match({bare}, '-?{whole}([{point}][0-9]+)?') then replace({value}, '{point}', '.') end"


_ORDER = {"iso": ("([0-9]{4})-([0-9]{2})-([0-9]{2})(T08:30:00Z)?", 1, 2, 3), "ymd_slash": ("([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", 1, 2, 3), "mdy_slash": ("([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", 3, 1, 2), "dmy_slash": ("([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", 3, 2, 1), "dmy_dot": ("([0-9]{1,2})[.]([0-9]{1,2})[.]([0-9]{4})", 3, 2, 1)}


def _date_sql(preset: str) -> str:
    form, y, m, d = _ORDER[preset]
    part = lambda i: f"lpad(regexp_extract(value, '^{form}$', {i}), 2, '0')"
    day = f"regexp_extract(value, '^{form}$', {y}) || '-' || {part(m)} || '-' || {part(d)}"
    return f"case when regexp_full_match(value, '{form}') and try_cast({day} as date) is not null then {day} end"


def _decisions_sql(cells: dict[str, str], presets: list[str], normal) -> str:
    """Which presets read all values that some preset reads, and whether those say the same, for each column of cells."""
    read = ", ".join(f"{normal(p)} as {p}" for p in presets)
    fits = f"coalesce({', '.join(presets)})"
    every = "[" + ", ".join(f"'{p}'" for p in presets) + "]"
    whole = ", ".join(f"coalesce(bool_and({p} is not null) filter ({fits} is not null), true) as fit_{p}" for p in presets)
    picked = "list_filter(" + every + ", lambda p: case p " + " ".join(f"when '{p}' then fit_{p}" for p in presets) + " end)"
    texts = "map {" + ", ".join(f"'{p}': {p}" for p in presets) + "}"
    parts = " union all ".join(f"select '{name}' as source, trim({cell}) as value from lines" for name, cell in cells.items())
    return f"""{iq.LINES_SQL}, cells as ({parts}), v as (select source, value, count(*) as count from cells where value not in ('', '-') group by 1, 2), told as (select source, value, count, {read} from v),
fit as (select source, sum(count) as examined, coalesce(sum(count) filter ({fits} is null), 0) as unfit, count(*) as n, {whole} from told group by 1),
chosen as (select *, case when examined > unfit and unfit * 2 <= examined then {picked} else [] end as among, examined > unfit and unfit * 2 <= examined as usable from fit),
agreed as (select c.source, bool_and(len(list_distinct(list_transform(c.among, lambda p: coalesce({texts}[p], '')))) <= 1) as same, any_value(c.among) as among from chosen c join told t on c.source = t.source where {fits} is not null group by 1),
decided as (select c.*, case when not usable then 'none' when len(c.among) = 0 then 'mixed' when len(c.among) = 1 then 'unique' when same then 'equivalent' else 'ambiguous' end as kind from chosen c left join agreed a on a.source = c.source)
select d.source, kind, case when kind in ('unique', 'equivalent') then among[1] end as preset, array_to_string(among, ',') as among, cast(examined as bigint) as examined, cast(unfit as bigint) as unfit, n as "distinct",
  coalesce((select bool_or({texts}[d.among[1]] <> value) from told t where t.source = d.source and {fits} is not null and kind in ('unique', 'equivalent')), false) as touched from decided d"""


def _cell_values(spark, d, cells):
    """source, value, count of the cells of all columns. The lines are made once, and written; a column is a projection of its own,
    for the code of all of them in one function would be too long for the JVM to compile."""
    lines = written(iq.lines(spark, d).select("line", "o", "p"))
    each = [lines.select(F.lit(name).alias("source"), "line", F.expr(cell).alias("cell")) for name, cell in cells.items()]
    return pr.distinct_values(reduce(DataFrame.unionAll, each), "cell", by=["source"])


@query(f"with {_decisions_sql(NUMBERS, ['plain', 'us', 'eu', 'fr'], _number_sql)}")
def number_decisions(spark, d):
    """Columns of numbers of every kind: read by one preset, by several that agree or don't, by none, or by no single one."""
    return pr.number_preset(_cell_values(spark, d, NUMBERS), ["source"])


@query(f"with {_decisions_sql(DATES, ['iso', 'ymd_slash', 'mdy_slash', 'dmy_slash', 'dmy_dot'], _date_sql)}")
def date_decisions(spark, d):
    return pr.date_preset(_cell_values(spark, d, DATES), ["source"])


PRICES = {
    "none": "concat('', p % 90)",
    "dollars": "case when o % 2 = 0 then concat('$', p % 90) else concat(p % 90, ' usd') end",
    "euros": "case when o % 2 = 0 then concat('€ ', p % 90) else concat('', p) end",
    "two": "case when o % 2 = 0 then concat('€', p % 90) else concat(p % 90, ' GBP') end",
    "with_dollars": "case when o % 2 = 0 then concat('$', p % 90) else concat(p % 90, ' chf') end",
    "not_numbers": "case when o % 2 = 0 then concat('€ about ', p) else concat('USD', p) end",
}
MARKS_SQL = f"""{iq.LINES_SQL}, cells as ({' union all '.join(f"select '{n}' as source, {c} as value from lines" for n, c in PRICES.items())}),
marked as (select source, upper(regexp_extract(value, '^([$€]|[A-Za-z]+) ?[0-9]+$|^[0-9]+ ([A-Za-z]+)$', 1) || regexp_extract(value, '^([$€]|[A-Za-z]+) ?[0-9]+$|^[0-9]+ ([A-Za-z]+)$', 2)) as mark from cells),
kinds as (select source, list_sort(list(distinct case mark when '$' then 'USD' else mark end) filter (mark <> '')) as marks from marked group by 1)"""


@query(f"""with {MARKS_SQL} select source, case when len(foreign_) = 0 then 'ok' when len(marks) > 1 then 'mixed' else 'foreign' end as kind, array_to_string(foreign_, ',') as marks
from (select source, coalesce(marks, []) as marks, list_filter(coalesce(marks, []), lambda m: m <> 'USD') as foreign_ from kinds)""")
def currency_decisions(spark, d):
    return pr.currency_decisions(_cell_values(spark, d, PRICES), ["source"])


# ---- pages and lanes ---------------------------------------------------------------------------------------------------------------

PAGES = [(1, 10), (2, 25), (10**6, 25), (-3, 50), (1, 7)]


_PAGE = "least(greatest(n, 1), pages)"


@query(f"""with {st.INVENTORY_SQL}, kept as (select 'all' as list, item_id, row_number() over (order by item_id) as place, count(*) over () as total from inventory union all select 'none', null, null, 0),
asked(i, n, size) as (values {', '.join(f'({i}, {n}, {s if s in (10, 25, 50, 100) else 25})' for i, (n, s) in enumerate(PAGES))}),
told as (select list, total, i, n, size, greatest(1, cast(ceil(total / size) as bigint)) as pages from (select distinct list, total from kept), asked), placed as (select *, {_PAGE} as page, ({_PAGE} - 1) * size as start from told)
select a.list, cast(i as integer) as i, cast(any_value(a.total) as bigint) as total, any_value(pages) as pages, any_value(page) as page, case when any_value(a.total) > 0 then any_value(start) + 1 else 0 end as first,
  cast(least(any_value(a.total), any_value(start) + any_value(size)) as bigint) as last, min(item_id) as first_item, count(item_id) as rows
from placed a left join kept k on k.list = a.list and k.place > start and k.place <= start + size group by a.list, i""")
def pages(spark, d):
    """Pages by number and size: the first, one inside, beyond the end, below one, of a size that isn't offered; and of an empty list."""
    stock = inventory(spark, d).select("item_id").orderBy("item_id")
    out = None
    for name, rows in (("all", stock), ("none", stock.where("false"))):
        for i, (number, size) in enumerate(PAGES):
            page, told = li.page(rows, number, size)
            one = page.agg(F.min("item_id").alias("first_item"), F.count("*").alias("rows")).select(F.lit(name).alias("list"), F.lit(i).alias("i"), *[F.lit(told[k]).cast("long").alias(k) for k in ("total", "pages", "page", "first", "last")], "first_item", "rows")
            out = one if out is None else out.unionByName(one)
    return out


@query(f"select route_key, shipments from ({SQL['route_summary']}) where is_mapped and not is_same_place order by shipments desc, route_key limit 12")
def mapped_lanes(spark, d):
    """The dozen busiest lanes between two known places."""
    return se.listed_lanes(routes(spark, d), mapped_only=True, k=12).select("route_key", "shipments")


# ---- the reference dimension ---------------------------------------------------------------------------------------------------------

_values = lambda rows: ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}" for v in r) + ")" for r in rows)
_PLACES = _values([(code, name, lat, lon) for code, name, lat, lon, *_ in (*rf.WAREHOUSES, *rf.CITIES)])
_LANES = _values([(a, b, i) for i, (a, b) in enumerate((a, b) for a, ends in rf.LANES.items() for b in ends)])


@query(f"""with place(code, name, lat, lon) as (values {_PLACES}), lane(origin, destination, i) as (values {_LANES}), carrier(carrier, rate, i) as (values {_values([(*c, i) for i, c in enumerate(rf.CARRIERS)])}),
sent as (select l_orderkey % 30 as lane, l_suppkey % 5 as carrier, count(*) as shipments from lineitem group by 1, 2),
far as (select l.i, a.code || '>' || b.code as route_key, a.name || ' → ' || b.name as route_label, floor(7917.6e0 * asin(least(1e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) * 10 + 0.5e0) / 10 as miles
  from lane l join place a on a.code = l.origin join place b on b.code = l.destination)
select route_key, route_label, c.carrier, cast(floor(miles * 10 + 0.5e0) as bigint) as tenths, shipments, cast(floor(cast(miles as double) * cast(rate as double) * 100 + 0.5e0) as bigint) as typical_cents from sent s join far on far.i = s.lane join carrier c on c.i = s.carrier""")
def reference_lanes(spark, d):
    """Lines of orders on the lanes of the reference dimension: distance, and what each carrier's rate makes of it."""
    lines = st.read(spark, d, "lineitem").select((F.col("l_orderkey") % 30).cast("int").alias("lane"), (F.col("l_suppkey") % 5).cast("int").alias("by")).groupBy("lane", "by").agg(F.count("*").alias("shipments"))
    on = F.broadcast(rf.lanes(spark)).withColumnRenamed("_ord", "lane")
    by = F.broadcast(rf.carriers(spark)).withColumnRenamed("_ord", "by")
    placed = located(lines.join(on, "lane").join(by, "by"), rf.locations(spark))
    typical = F.floor(F.col("distance_miles") * F.col("rate_per_mile") * 100 + 0.5).cast("long")
    return placed.select("route_key", "route_label", "carrier", F.floor(F.col("distance_miles") * 10 + 0.5).cast("long").alias("tenths"), "shipments", typical.alias("typical_cents"))


ALIASES = "case p_partkey % 4 when 0 then concat(' ', p_name, ' (', p_type, ')') when 1 then concat(upper(p_name), '__', p_type) when 2 then concat(p_name, '-./', p_type, chr(9)) else concat('(', p_type, ') / ', p_name) end"


@query(f"select trim(regexp_replace(lower({ALIASES}), '[ \\t_./()-]+', ' ', 'g')) as key, count(*) as parts, min(p_partkey) as first from part group by 1")
def alias_keys(spark, d):
    """Names of parts, written in four ways, by the key under which column names are compared."""
    named = st.read(spark, d, "part").select("p_partkey", alias_key(F.expr(ALIASES)).alias("key"))
    return named.groupBy("key").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first"))
