"""Registered queries over the stand-in tables and the DuckDB SQL of each.

Doubles that depend on the order of a sum or on trigonometry are returned as scaled whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import alerts as al
from ..operators import attention as at
from ..operators import listing as li
from ..operators import metrics as me
from ..operators import series as se
from ..operators.inventory import enrich_inventory
from ..operators.shipments import assess_costs, enrich_shipments, located, with_states
from ..scratch import written
from . import standins as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def inventory(spark, d):
    return enrich_inventory(st.inventory(spark, d))


def shipments(spark, d):
    return enrich_shipments(st.shipments(spark, d), st.locations(spark, d), st.TODAY)


#: What the assessment of costs needs of enriched shipments.
PRICED = ("shipment_id", "route_key", "carrier", "status", "shipping_cost_cents", "distance_miles")


def assessed(spark, d, *columns):
    """Shipments with costs assessed; with ``columns`` only those beside what costs need, so that no others are made and written."""
    rows = shipments(spark, d)
    return assess_costs(written(rows.select(*dict.fromkeys([*PRICED, *columns])) if columns else rows))


def utilization(spark, d):
    return me.warehouse_utilization(inventory(spark, d), st.locations(spark, d))


def routes(spark, d):
    return se.route_summary(shipments(spark, d))


#: What alerts need of shipments whose ends are known; what follows from these columns isn't written.
PLACED = ("shipment_id", "route_key", "route_label", "carrier", "status", "ship_date", "estimated_delivery", "actual_delivery", "shipping_cost_cents", "distance_miles", "origin_code", "origin_text", "destination_code", "destination_text")


def alert_maker(spark, d):
    """A function that makes the wanted alerts; shipments are read and their costs assessed once for all its calls."""
    placed = written(located(st.shipments(spark, d), st.locations(spark, d)).select(*PLACED))
    costs = assess_costs(placed)

    def made(wanted):
        rows = with_states(costs, st.TODAY, wanted.texts)
        return al.all_alerts(inventory(spark, d), rows, utilization(spark, d), st.locations(spark, d), st.TODAY, wanted)

    return made


def alerts(spark, d, texts=True):
    return alert_maker(spark, d)(al.Wanted(texts=texts))


def scaled(column, by: int = 10**6):
    return half_up(F.col(column) * by).cast("long")


def fixed_sql(x: str, places: int) -> str:
    """Text of a double of 0 or more with so many places, exact halves upwards."""
    return f"format('{{:.{places}f}}', ({x}) + case when ({x}) * {2 << places}e0 % 2 = 1 then 1e-{places + 1} else 0e0 end)"


def count_sql(n: str) -> str:
    return f"format('{{:,}}', cast({n} as bigint))"


def money_sql(cents: str) -> str:
    return f"('$' || {count_sql(f'({cents}) // 100')} || '.' || lpad(cast(({cents}) % 100 as varchar), 2, '0'))"


def compact_sql(cents: str) -> str:
    """Of 0 cents or more."""
    of = lambda unit: f"(({cents}) / 100e0 / {unit}e0)"
    plain = lambda unit, mark: f"{fixed_sql(of(unit), 2)} || '{mark}'"
    kilo = f"case when {of('1')} < 1e4 then regexp_replace({fixed_sql(of('1000'), 2)}, '\\.?0+$', '') else {fixed_sql(of('1000'), 1)} end || 'K'"
    texts = [("1000000000000", plain("1000000000000", "T")), ("1000000000", plain("1000000000", "B")), ("1000000", plain("1000000", "M")), ("1000", kilo)]
    cases = []
    for i, (unit, text) in enumerate(texts):
        up = text if not i else f"case when cast({fixed_sql(of(unit), 1)} as double) >= 1000 then {texts[i - 1][1]} else {text} end"
        cases.append(f"when {of('1')} >= {unit} then '$' || {up}")
    return f"case {' '.join(cases)} else {money_sql(cents)} end"


def day_sql(day: str) -> str:
    return f"strftime({day}, '%b %-d, %Y')"


def natural_sql(text: str) -> str:
    part = "case when p[1] between '0' and '9' then lpad(cast(len(ltrim(p, '0')) as varchar), 4, '0') || ltrim(p, '0') else p end"
    return f"array_to_string(list_transform(regexp_extract_all(lower(strip_accents({text})), '[0-9]+|[^0-9]+'), lambda p: {part}), '')"


SHIPMENT_KPIS = """count(*) as shipments, count_if(status in ('pending', 'in_transit')) as open_shipments, count_if(status = 'delivered') as delivered,
  count_if(status = 'cancelled') as cancelled, count_if(is_delayed) as delayed, count_if(delivery_state = 'overdue') as overdue,
  count_if(delivery_state = 'late') as late, count_if(delivery_state = 'on_time') as on_time,
  cast(count_if(delivery_state = 'on_time') as double) / nullif(count_if(delivery_state in ('on_time', 'late')), 0) as on_time_rate,
  cast(coalesce(sum(case when status <> 'cancelled' then shipping_cost_cents end), 0) as bigint) as shipping_cents,
  cast(floor(cast(sum(case when status <> 'cancelled' then shipping_cost_cents end) as double) / nullif(count_if(status <> 'cancelled'), 0) + 0.5e0) as bigint) as average_cost_cents,
  avg(transit_days) as average_delivery_days"""
INVENTORY_KPIS = """count(*) as items, cast(sum(quantity) as bigint) as units, cast(sum(value_cents) as bigint) as value_cents,
  count_if(stock_status = 'out_of_stock') as out_of_stock, count_if(stock_status = 'low_stock') as low_stock"""
# both sides have CTEs; the shipment ones bring the locations along
BOTH = st.SHIPMENTS_SQL + st.INVENTORY_SQL.removeprefix(st.LOCATIONS_SQL)
COSTS_AND_STOCK = st.COSTS_SQL + st.INVENTORY_SQL.removeprefix(st.LOCATIONS_SQL)


@query(f"with {BOTH} select * from (select {INVENTORY_KPIS} from inventory), (select {SHIPMENT_KPIS} from shipments)")
def kpi_summary(spark, d):
    return me.kpi_summary(inventory(spark, d), shipments(spark, d))


@query(f"""with {st.INVENTORY_SQL} select cast(floor(1e6 * sum(avg_daily_usage * 365 * unit_cost_cents) / sum(value_cents) + 0.5e0) as bigint) as turnover_millionths,
  cast(floor(1e6 * 365e0 / (sum(avg_daily_usage * 365 * unit_cost_cents) / sum(value_cents)) + 0.5e0) as bigint) as days_millionths,
  count(avg_daily_usage) as items_with_usage, count(*) as items from inventory""")
def supply_metrics(spark, d):
    out = me.supply_metrics(inventory(spark, d))
    return out.select(scaled("turnover").alias("turnover_millionths"), scaled("days_of_inventory").alias("days_millionths"), "items_with_usage", "items")


UTILIZATION_SQL = """utilization as (
  select l.code, l.name, cast(l.capacity_units as bigint) as capacity_units, cast(coalesce(sum(quantity), 0) as bigint) as units, cast(coalesce(sum(value_cents), 0) as bigint) as value_cents, count(sku) as items,
    cast(coalesce(sum(quantity), 0) as double) / nullif(l.capacity_units, 0) as utilization
  from locations l left join inventory i on l.code = i.warehouse where l.kind = 'warehouse' group by 1, 2, l.capacity_units
)"""


@query(f"with {st.INVENTORY_SQL}, {UTILIZATION_SQL} select * from utilization")
def warehouse_utilization(spark, d):
    return utilization(spark, d).drop("_ord")


@query(f"with {st.INVENTORY_SQL} select count_if(stockout_risk = 'high') as high, count_if(stockout_risk = 'medium') as medium, count_if(stockout_risk = 'low') as low, count_if(stockout_risk = 'unknown') as unknown from inventory")
def stockout_risk_counts(spark, d):
    return me.stockout_risk_counts(inventory(spark, d))


@query(f"with {st.INVENTORY_SQL} select sku, product_name, category, warehouse, cast(quantity as bigint) as quantity, cast(reorder_point as bigint) as reorder_point, unit_cost_cents, avg_daily_usage, lead_time_days, item_id, cast(value_cents as bigint) as value_cents, stock_status, days_of_supply, stockout_risk from inventory")
def inventory_enriched(spark, d):
    return inventory(spark, d)


@query(f"with {st.INVENTORY_SQL} select i.warehouse, coalesce(name, i.warehouse) as name, cast(sum(value_cents) as bigint) as value_cents, cast(sum(quantity) as bigint) as units, count(*) as items from inventory i left join locations l on i.warehouse = l.code group by 1, 2")
def inventory_value_by_warehouse(spark, d):
    return se.inventory_value_by_warehouse(inventory(spark, d), st.locations(spark, d)).select("warehouse", "name", "value_cents", "units", "items")


@query(f"with {st.INVENTORY_SQL} select category, cast(sum(value_cents) as bigint) as value_cents, cast(sum(quantity) as bigint) as units, count(*) as items from inventory group by 1")
def inventory_value_by_category(spark, d):
    return se.inventory_value_by(inventory(spark, d), "category")


SHIPMENT_COLUMNS = ["shipment_id", "origin", "destination", "carrier", "status", "ship_date", "estimated_delivery", "actual_delivery", "shipping_cost_cents", "route_key", "route_label", "delivery_state", "days_late", "is_delayed", "transit_days"]
SHIP, ETA, ACTUAL = (day_sql(c) for c in ("ship_date", "estimated_delivery", "actual_delivery"))
STATUS = "replace(status, '_', ' ')"
ISSUES = {
    "ACTUAL_BEFORE_SHIP": f"'Actual delivery ' || {ACTUAL} || ' is before ship date ' || {SHIP} || '.'",
    "ETA_BEFORE_SHIP": f"'Estimated delivery ' || {ETA} || ' is before ship date ' || {SHIP} || '.'",
    "OPEN_WITH_ACTUAL": f"'Status is ' || {STATUS} || ' but an actual delivery date (' || {ACTUAL} || ') is recorded.'",
    "SAME_ORIGIN_DESTINATION": "'Origin and destination are the same (' || coalesce(origin_code, origin_text) || ').'",
    "ZERO_COST": f"'Shipping cost is $0.00 for a ' || {STATUS} || ' shipment.'",
    "SHIP_DATE_IN_FUTURE": f"'Ship date ' || {SHIP} || ' is in the future for a ' || {STATUS} || ' shipment.'",
    "ACTUAL_IN_FUTURE": f"'Actual delivery ' || {ACTUAL} || ' is in the future.'",
}
ISSUE_LIST = "concat_ws(',', " + ", ".join(f"case when i{i} then '{c}' end" for i, c in enumerate(ISSUES, 1)) + ")"
ISSUE_TEXTS = "concat_ws(' ', " + ", ".join(f"case when i{i} then {m} end" for i, m in enumerate(ISSUES.values(), 1)) + ")"
ISSUE_PAIRS = "[" + ", ".join(f"case when i{i} then {{'code': '{c}', 'message': {m}}} end" for i, (c, m) in enumerate(ISSUES.items(), 1)) + "]"


@query(f"""with {st.SHIPMENTS_SQL} select shipment_id, origin, destination, carrier, status, ship_date, estimated_delivery, actual_delivery, cast(shipping_cost_cents as bigint) as shipping_cost_cents, route_key, route_label, delivery_state,
  cast(days_late as integer) as days_late, is_delayed, cast(transit_days as integer) as transit_days, concat_ws(',', case when lacks_estimate then 'estimated_delivery' end, case when lacks_actual then 'actual_delivery' end) as missing, {ISSUE_LIST} as issue_codes, {ISSUE_TEXTS} as issue_messages, origin_name, destination_name from shipments""")
def shipments_enriched(spark, d):
    return shipments(spark, d).select(*SHIPMENT_COLUMNS, F.array_join("missing_dates", ",").alias("missing"), F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("issue_codes"), F.array_join(F.transform("issues", lambda i: i["message"]), " ").alias("issue_messages"), "origin_name", "destination_name")


@query(f"with {st.SHIPMENTS_SQL} select delivery_state, count(*) as shipments, cast(sum(days_late) as bigint) as days_late from shipments group by 1")
def delivery_state_counts(spark, d):
    return shipments(spark, d).groupBy("delivery_state").agg(F.count("*").alias("shipments"), F.sum("days_late").alias("days_late"))


@query(f"with {st.SHIPMENTS_SQL} select code, count(*) as shipments from (select unnest(string_split({ISSUE_LIST}, ',')) as code from shipments) where code <> '' group by 1")
def data_issue_counts(spark, d):
    return shipments(spark, d).select(F.explode("issues").alias("i")).groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("shipments"))


@query(f"with {st.SHIPMENTS_SQL} select 'estimated_delivery' as missing, count(*) as shipments from shipments where lacks_estimate union all select 'actual_delivery', count(*) from shipments where lacks_actual")
def missing_date_counts(spark, d):
    return shipments(spark, d).select(F.explode("missing_dates").alias("missing")).groupBy("missing").agg(F.count("*").alias("shipments"))


@query(f"with {st.SHIPMENTS_SQL} select route_key, cast(floor(min(distance_miles) * 10 + 0.5e0) as bigint) as tenths, count(*) as shipments from shipments group by 1")
def distance_by_lane(spark, d):
    return shipments(spark, d).groupBy("route_key").agg(half_up(F.min("distance_miles") * 10).cast("long").alias("tenths"), F.count("*").alias("shipments"))


@query(f"with {st.COSTS_SQL} select shipment_id, cost_method, cost_peers, baseline_cents, score_hundredths, is_cost_anomaly from assessed")
def cost_assessment(spark, d):
    return assessed(spark, d, *PRICED).select("shipment_id", "cost_method", "cost_peers", "baseline_cents", scaled("cost_score", 100).alias("score_hundredths"), "is_cost_anomaly")


@query(f"with {st.COSTS_SQL} select shipment_id, route_key, carrier, cast(shipping_cost_cents as bigint) as shipping_cost_cents, cost_method, baseline_cents from assessed where is_cost_anomaly")
def cost_anomalies(spark, d):
    return assessed(spark, d, *PRICED).where("is_cost_anomaly").select("shipment_id", "route_key", "carrier", "shipping_cost_cents", "cost_method", "baseline_cents")


@query(f"with {st.COSTS_SQL} select cost_method, count(*) as shipments, count_if(is_cost_anomaly) as anomalies, cast(coalesce(sum(score_hundredths), 0) as bigint) as score_hundredths from assessed group by 1")
def cost_method_counts(spark, d):
    return assessed(spark, d, *PRICED).groupBy("cost_method").agg(F.count("*").alias("shipments"), F.count_if("is_cost_anomaly").alias("anomalies"), F.coalesce(F.sum(scaled("cost_score", 100)), F.lit(0)).alias("score_hundredths"))


def _months_sql(source: str, measures: str, zeros: str) -> str:
    return f"""with {st.SHIPMENTS_SQL}, found as ({source.format(measures=measures)}), span as (
  select strftime(m, '%Y-%m') as month from (select unnest(generate_series(min(cast(month || '-01' as date)), max(cast(month || '-01' as date)), interval 1 month)) as m from found)
) select span.month, {zeros} from span left join found on span.month = found.month"""


@query(_months_sql("select strftime(ship_date, '%Y-%m') as month, {measures} from shipments where status <> 'cancelled' and ship_date <= date '1998-07-01' group by 1", "sum(shipping_cost_cents) as cents, count(*) as n", "cast(coalesce(cents, 0) as bigint) as shipping_cents, coalesce(n, 0) as shipments"))
def shipping_cost_by_month(spark, d):
    return se.shipping_cost_by_month(shipments(spark, d), st.TODAY)


@query(_months_sql("select strftime(estimated_delivery, '%Y-%m') as month, {measures} from shipments where estimated_delivery is not null and delivery_state in ('on_time', 'late', 'overdue') group by 1", "count_if(delivery_state = 'on_time') as a, count_if(delivery_state <> 'on_time') as b", "coalesce(a, 0) as on_time, coalesce(b, 0) as delayed"))
def ontime_vs_delayed_by_month(spark, d):
    return se.ontime_vs_delayed_by_month(shipments(spark, d))


@query(f"with {st.SHIPMENTS_SQL} select status, count(*) as shipments from shipments group by 1")
def shipments_by_status(spark, d):
    return se.shipments_by_status(shipments(spark, d)).drop("_ord")


def _range(days: int):
    @query(f"with {st.SHIPMENTS_SQL} select {SHIPMENT_KPIS} from shipments where ship_date >= date '1998-07-01' - {days}")
    def kpis(spark, d):
        return me.shipment_kpis(se.in_range(shipments(spark, d), days, st.TODAY))

    QUERIES[f"range_{days}d_kpis"], SQL[f"range_{days}d_kpis"] = QUERIES.pop("kpis"), SQL.pop("kpis")


for _days in (30, 90, 180, 365):
    _range(_days)

ROUTES_SQL = st.SHIPMENTS_SQL + """, live as (select * from shipments where status <> 'cancelled'), routes as (
  select route_key, arg_min(route_label, shipment_id) as route_label, count(*) as shipments, cast(sum(shipping_cost_cents) as bigint) as shipping_cents,
    cast(floor(cast(sum(shipping_cost_cents) as double) / count(*) + 0.5e0) as bigint) as average_cost_cents, count_if(is_delayed) as delayed,
    cast(count_if(is_delayed) as double) / count(*) as delayed_share, count(origin_code) > 0 and count(destination_code) > 0 as is_mapped,
    coalesce(min(origin_code) = min(destination_code), false) as is_same_place
  from live group by 1
)"""


@query(f"with {ROUTES_SQL} select * from routes")
def route_summary(spark, d):
    return routes(spark, d).drop("carriers")


@query(f"with {ROUTES_SQL} select route_key, route_label, shipments, shipping_cents from routes order by shipments desc, route_key limit 10")
def top_routes_by_count(spark, d):
    return se.top_routes(routes(spark, d), "shipments").select("route_key", "route_label", "shipments", "shipping_cents")


@query(f"with {ROUTES_SQL} select route_key, route_label, shipments, shipping_cents from routes order by shipping_cents desc, route_key limit 10")
def top_routes_by_cost(spark, d):
    return se.top_routes(routes(spark, d), "shipping_cents").select("route_key", "route_label", "shipments", "shipping_cents")


@query(f"with {ROUTES_SQL} select route_key, string_agg(carrier || ':' || n, ',' order by n desc, carrier) as carriers from (select route_key, carrier, count(*) as n from live group by 1, 2) group by 1")
def route_carriers(spark, d):
    return routes(spark, d).select("route_key", F.array_join(F.transform("carriers", lambda c: F.concat(c["carrier"], F.lit(":"), c["shipments"].cast("string"))), ",").alias("carriers"))


LANE = "(not is_mapped or not is_same_place)"


@query(f"with {ROUTES_SQL} select route_key, route_label, shipments, delayed, delayed_share from routes where is_mapped and not is_same_place and delayed > 0 and delayed_share >= 0.1e0 order by delayed_share desc, shipments desc, route_key limit 1")
def most_delayed_lane(spark, d):
    return se.most_delayed_lane(routes(spark, d)).select("route_key", "route_label", "shipments", "delayed", "delayed_share")


@query(f"with {ROUTES_SQL} select route_key, shipments, delayed, case when delayed_share >= 0.2e0 then 'critical' else 'watch' end as tone from routes where {LANE} and delayed_share >= 0.1e0")
def delayed_lanes(spark, d):
    lanes = routes(spark, d)
    pick = lambda show: se.listed_lanes(lanes, show).select("route_key", "shipments", "delayed", F.lit(show).alias("tone"))
    return pick("critical").unionByName(pick("watch"))


@query(f"with {st.COSTS_SQL}{ROUTES_SQL.removeprefix(st.SHIPMENTS_SQL)} select route_key, shipments, average_cost_cents from routes where {LANE} and route_key in (select route_key from assessed where is_cost_anomaly and status <> 'cancelled')")
def lanes_with_anomaly(spark, d):
    return se.listed_lanes(routes(spark, d), "cost", assessed(spark, d, *PRICED)).select("route_key", "shipments", "average_cost_cents")


@query(f"with {st.SHIPMENTS_SQL} select shipment_id, case when status = 'delivered' then actual_delivery else ship_date end as activity_date, delivery_state from shipments where activity_date <= date '1998-07-01' order by activity_date desc, shipment_id limit 10")
def recent_activity(spark, d):
    return se.recent_activity(shipments(spark, d), st.TODAY).select("shipment_id", "activity_date", "delivery_state")


@query(f"with {st.SHIPMENTS_SQL} select shipment_id, cast(floor(1e6 * least(1e0, greatest(0e0, cast(date '1998-07-01' - ship_date as double) / (estimated_delivery - ship_date))) + 0.5e0) as bigint) as progress_millionths from shipments where status = 'in_transit' and estimated_delivery > ship_date")
def transit_progress(spark, d):
    rows = shipments(spark, d).where("status = 'in_transit'").withColumn("progress", se.transit_progress(st.TODAY)).where("progress is not null")
    return rows.select("shipment_id", scaled("progress").alias("progress_millionths"))


PLACE = "coalesce((select name from locations where code = warehouse), warehouse)"
OF_ITEM = f"item_id as entity_id, 'inventory' as entity_kind, sku || ' @ ' || warehouse as entity_label"
OF_SHIPMENT = "shipment_id as entity_id, 'shipment' as entity_kind, shipment_id as entity_label"
STOCK_ALERTS = f"""select 'low_stock:inventory:' || item_id as alert_id, 'low_stock' as type, case stock_status when 'out_of_stock' then 'critical' else 'warning' end as severity,
  case stock_status when 'out_of_stock' then 'Out of stock: ' else 'Low stock: ' end || sku as title,
  product_name || ' at ' || {PLACE} || case stock_status when 'out_of_stock' then ' has 0 units (reorder point ' || reorder_point || ').' else ' has ' || quantity || ' units, at or below the reorder point of ' || reorder_point || '.' end as message,
  {OF_ITEM} from inventory where stock_status <> 'in_stock'"""
USAGE_ALERTS = f"""select 'missing_info:inventory:' || item_id || ':usage' as alert_id, 'missing_info' as type, 'info' as severity, 'Missing usage data: ' || sku as title,
  product_name || ' at ' || {PLACE} || ' has no average daily usage; stockout risk and turnover exclude it.' as message, {OF_ITEM} from inventory where avg_daily_usage is null"""
DELAY_ALERTS = f"""select 'shipment_delayed:shipment:' || shipment_id as alert_id, 'shipment_delayed' as type, case when delivery_state = 'late' then 'info' when days_late >= 7 then 'critical' else 'warning' end as severity,
  case delivery_state when 'late' then 'Delivered late: ' else 'Shipment overdue: ' end || shipment_id as title,
  route_label || ' via ' || carrier || case delivery_state when 'late' then ' arrived ' || days_late || ' day(s) after the estimated ' || {ETA} || '.' else ' was due ' || {ETA} || ' and is ' || days_late || ' day(s) late.' end as message,
  {OF_SHIPMENT} from assessed where delivery_state = 'overdue' or (delivery_state = 'late' and actual_delivery >= date '1998-07-01' - 14)"""
COST_ALERTS = f"""select 'cost_anomaly:shipment:' || shipment_id as alert_id, 'cost_anomaly' as type, case when shipping_cost_cents >= 3 * baseline_cents then 'critical' else 'warning' end as severity, 'Unusual shipping cost: ' || shipment_id as title,
  {money_sql('shipping_cost_cents')} || ' is ' || {fixed_sql('cast(shipping_cost_cents as double) / baseline_cents', 1)} || '× the typical ' || {money_sql('baseline_cents')} || ' for '
    || case cost_method when 'route_carrier' then 'this route with this carrier' when 'route' then 'this route' else 'a shipment of this distance' end || '.' as message,
  {OF_SHIPMENT} from assessed where is_cost_anomaly and baseline_cents > 0"""
DATE_ALERTS = f"""select 'missing_info:shipment:' || shipment_id || ':eta' as alert_id, 'missing_info' as type, 'warning' as severity, 'Missing estimated delivery: ' || shipment_id as title,
  route_label || ' (' || {STATUS} || ') has no estimated delivery date, so delays cannot be detected.' as message, {OF_SHIPMENT} from assessed where lacks_estimate
  union all select 'missing_info:shipment:' || shipment_id || ':actual', 'missing_info', 'warning', 'Missing delivery date: ' || shipment_id,
  route_label || ' is marked delivered but has no actual delivery date.', {OF_SHIPMENT} from assessed where lacks_actual"""
ISSUE_ALERTS = f"""select 'invalid_data:shipment:' || shipment_id || ':' || issue.code as alert_id, 'invalid_data' as type, 'warning' as severity, 'Data issue: ' || shipment_id as title, issue.message as message,
  {OF_SHIPMENT} from (select shipment_id, unnest({ISSUE_PAIRS}) as issue from assessed) where issue is not null"""
CAPACITY_ALERTS = f"""select 'invalid_data:warehouse:' || code as alert_id, 'invalid_data' as type, 'warning' as severity, 'Over capacity: ' || name as title,
  units || ' units stored vs capacity ' || capacity_units || ' (' || {fixed_sql('utilization * 100', 1)} || '%).' as message, code as entity_id, 'warehouse' as entity_kind, name as entity_label from utilization where utilization > 1"""
EVERY_ALERT = " union all ".join([STOCK_ALERTS, USAGE_ALERTS, DELAY_ALERTS, COST_ALERTS, DATE_ALERTS, ISSUE_ALERTS, CAPACITY_ALERTS])
ALERTS_SQL = f"{COSTS_AND_STOCK}, {UTILIZATION_SQL}, alerts as ({EVERY_ALERT})"
KIND_SQL = """case when severity = 'info' then null when type = 'low_stock' then case severity when 'critical' then 'out_of_stock' else 'low_stock' end when type = 'shipment_delayed' then 'overdue'
  when type = 'cost_anomaly' then 'unusual_cost' when type = 'invalid_data' and entity_kind = 'warehouse' then 'over_capacity' else 'records' end"""
ORDER_SQL = f"list_position(['critical', 'warning', 'info'], severity) || list_position(['low_stock', 'shipment_delayed', 'cost_anomaly', 'missing_info', 'invalid_data'], type) || {natural_sql('entity_id')}"
ALERT_COLUMNS = ["alert_id", "type", "severity", "title", "message", "entity.id as entity_id", "entity.kind as entity_kind", "entity.label as entity_label"]


@query(f"with {st.INVENTORY_SQL} {STOCK_ALERTS}")
def alerts_low_stock(spark, d):
    return al.inventory_alerts(inventory(spark, d), st.locations(spark, d)).where("type = 'low_stock'").selectExpr(*ALERT_COLUMNS)


@query(f"with {st.SHIPMENTS_SQL}, assessed as (select * from shipments) {DELAY_ALERTS}")
def alerts_delay(spark, d):
    return al.record_alerts(shipments(spark, d), st.TODAY).where("type = 'shipment_delayed'").selectExpr(*ALERT_COLUMNS)


@query(f"with {st.COSTS_SQL} {COST_ALERTS}")
def alerts_cost(spark, d):
    return al.cost_alerts(assessed(spark, d, *PRICED)).selectExpr(*ALERT_COLUMNS)


@query(f"with {BOTH}, assessed as (select * from shipments) {DATE_ALERTS} union all {USAGE_ALERTS}")
def alerts_missing(spark, d):
    both = al.record_alerts(shipments(spark, d), st.TODAY).unionByName(al.inventory_alerts(inventory(spark, d), st.locations(spark, d)))
    return both.where("type = 'missing_info'").selectExpr(*ALERT_COLUMNS)


@query(f"with {st.SHIPMENTS_SQL}, assessed as (select * from shipments) {ISSUE_ALERTS}")
def alerts_invalid(spark, d):
    return al.record_alerts(shipments(spark, d), st.TODAY).where("type = 'invalid_data'").selectExpr(*ALERT_COLUMNS)


@query(f"with {st.INVENTORY_SQL}, {UTILIZATION_SQL} {CAPACITY_ALERTS}")
def alerts_capacity(spark, d):
    return al.capacity_alerts(utilization(spark, d)).selectExpr(*ALERT_COLUMNS)


@query(f"with {ALERTS_SQL} select *, {KIND_SQL} as kind, {ORDER_SQL} as order_key from alerts")
def alerts_all(spark, d):
    """Every alert with its place in the list."""
    return alerts(spark, d).withColumn("order_key", al.order_key()).selectExpr(*ALERT_COLUMNS, "kind", "order_key")


@query(f"with {ALERTS_SQL} select *, (select count(*) from alerts) as total, cast(row_number() over (order by {ORDER_SQL}, alert_id) as integer) as place from alerts order by {ORDER_SQL}, alert_id limit 25 offset 50")
def alert_page_3(spark, d):
    """The third page of 25 of the list, in its order: counted without texts, then only the alerts of the page's groups are sorted."""
    made = alert_maker(spark, d)
    counts = {(r["severity"], r["type"]): r["n"] for r in made(al.Wanted(texts=False)).groupBy("severity", "type").agg(F.count("*").alias("n")).collect()}
    at = li.place_of(total := sum(counts.values()), 3, 25)
    groups, before = al.groups_of_page(counts, start := (at["page"] - 1) * 25, 25)
    some = made(al.Wanted(tuple(dict.fromkeys(t for _, t in groups)) or al.ALERT_TYPES)).where(reduce(Column.__or__, [(F.col("severity") == s) & (F.col("type") == t) for s, t in groups], F.lit(False)))
    rows = al.in_order(some).offset(start - before).limit(25)
    place = F.row_number().over(Window.orderBy(al.order_key(), "alert_id")) + at["first"] - 1
    return rows.select("*", F.lit(total).cast("long").alias("total"), place.cast("int").alias("place")).selectExpr(*ALERT_COLUMNS, "total", "place")


@query(f"with {ALERTS_SQL} select alert_id from (select *, {KIND_SQL} as kind from alerts) where severity = 'warning' and kind = 'overdue' and (contains(lower(title), '12') or contains(lower(message), '12') or contains(lower(entity_label), '12')) and (contains(lower(title), 'carrier') or contains(lower(message), 'carrier') or contains(lower(entity_label), 'carrier'))")
def filter_alerts(spark, d):
    return al.filter_alerts(alerts(spark, d), severity="warning", kind="shipment_delayed", attention="overdue", query="12 carrier").select("alert_id")


@query(f"with {ALERTS_SQL} select severity, coalesce(alerts, 0) as alerts from (select unnest(['critical', 'warning', 'info']) as severity) left join (select severity, count(*) as alerts from alerts group by 1) using (severity)")
def alert_severity_counts(spark, d):
    return al.severity_counts(alerts(spark, d, texts=False))


@query(f"with {ALERTS_SQL} select type, count(*) as alerts from alerts group by 1")
def alert_type_counts(spark, d):
    return alerts(spark, d, texts=False).groupBy("type").agg(F.count("*").alias("alerts"))


@query(f"with {ALERTS_SQL} select severity, type, count(*) as alerts from alerts group by 1, 2")
def alert_counts(spark, d):
    return alerts(spark, d, texts=False).groupBy("severity", "type").agg(F.count("*").alias("alerts"))


@query(f"with {ALERTS_SQL} select kind, count(*) as alerts from (select {KIND_SQL} as kind from alerts) where kind is not null group by 1")
def attention_kind_counts(spark, d):
    return at.kind_counts(alerts(spark, d, texts=False))


PLAN_SQL = st.INVENTORY_SQL + f""", short as (
  select *, case when avg_daily_usage is not null then cast(ceil(greatest(0, cast(floor(avg_daily_usage * 100 + 0.5e0) as bigint) * lead_time_days - quantity * 100) / 100e0) as bigint) end as short_units
  from inventory where stock_status <> 'in_stock'
), donors as (
  select sku, warehouse as donor, greatest(0, quantity - reorder_point - 1) as can_give, row_number() over (partition by sku order by greatest(0, quantity - reorder_point - 1) desc, warehouse) as n from inventory
), named as (
  select code, regexp_replace(name, ' DC$', '') as place from locations
), needed as (
  select short.*, short_units * unit_cost_cents as short_cents, coalesce(short_units, reorder_point - quantity) as need, donor, can_give, coalesce(g.place, donor) as donor_place, coalesce(w.place, warehouse) as place
  from short left join donors on short.sku = donors.sku and n = 1 and can_give > 0 left join named g on donor = g.code left join named w on warehouse = w.code
), plan as (
  select *, case when need <= 0 then 'Reorder now' when donor is null then 'Reorder ' || {count_sql('need')} when can_give >= need then 'Move ' || {count_sql('need')} || ' from ' || donor_place
      else 'Move ' || {count_sql('can_give')} || ' from ' || donor_place || ', reorder ' || {count_sql('need - can_give')} end as action,
    product_name || case when stock_status = 'out_of_stock' then ' is out of stock in ' || place else ' runs out in ' || place || ' '
      || case floor(coalesce(days_of_supply, 0)) when 0 then 'today' when 1 then 'in 1 day' else 'in ' || {count_sql('floor(days_of_supply)')} || ' days' end end as what
  from needed
), stocked as (
  select 'stock:' || item_id as key, case stock_status when 'out_of_stock' then 'critical' else 'warning' end as tone, cast(short_cents as bigint) as cents, coalesce(days_of_supply, 0) as days, 1 as shipments, {natural_sql('item_id')} as sort_key,
    what, {compact_sql('cast(short_cents as bigint)')} || ' short before restock' as damage, action from plan where short_cents > 0
), idle as (
  select 'stock:' || item_id as key, 'critical' as tone, what, 'usage unknown' as damage, action, {natural_sql('item_id')} as sort_key from plan where stock_status = 'out_of_stock' and avg_daily_usage is null
)"""


@query(f"with {PLAN_SQL} select item_id, short_units, cast(short_cents as bigint) as short_cents, donor, cast(case when need > 0 then coalesce(least(need, can_give), 0) else 0 end as bigint) as moved_units, place, donor_place, action from plan")
def transfer_plan(spark, d):
    plan = at.transfer_plan(inventory(spark, d), st.locations(spark, d))
    return plan.select("item_id", "short_units", "short_cents", "donor", F.col("moved_units").cast("long").alias("moved_units"), "place", F.coalesce("donor_place", "donor").alias("donor_place"), "action")


@query(f"with {PLAN_SQL} select key, tone, cents, what, damage, action from stocked")
def stock_candidates(spark, d):
    return at.stock_candidates(at.transfer_plan(inventory(spark, d), st.locations(spark, d))).select("key", "tone", "cents", "what", "damage", "action")


@query(f"with {PLAN_SQL} select key, tone, what, damage, action from idle")
def no_usage_items(spark, d):
    return at.no_usage_rows(at.transfer_plan(inventory(spark, d), st.locations(spark, d))).drop("sort_key")


OVERBILLING = "select carrier, cast(sum(shipping_cost_cents - baseline_cents) as bigint) as cents, count(*) as shipments, bool_or(shipping_cost_cents >= 3 * baseline_cents) as critical, min(shipment_id) as first_id from assessed where is_cost_anomaly and baseline_cents > 0 group by 1"


@query(f"with {st.COSTS_SQL} {OVERBILLING}")
def carrier_overbilling(spark, d):
    return at.carrier_overbilling(assessed(spark, d, *PRICED))


BILLED = f"""select 'billing:' || carrier as key, case when critical then 'critical' else 'warning' end as tone, cents, cast(null as double) as days, shipments, {natural_sql('carrier')} as sort_key,
    carrier || ' billed ' || {compact_sql('cents')} || ' above typical on ' || case shipments when 1 then first_id else {count_sql('shipments')} || ' shipments' end as what, cast(null as varchar) as damage,
    case shipments when 1 then 'Check the invoice' else 'Check the invoices' end as action from ({OVERBILLING})"""


@query(f"with {st.COSTS_SQL} select key, tone, cents, shipments, what, action from ({BILLED})")
def billing_candidates(spark, d):
    return at.billing_candidates(at.carrier_overbilling(assessed(spark, d, *PRICED))).select("key", "tone", "cents", "shipments", "what", "action")


LATE = "select carrier, count(*) as shipments, cast(min(days_late) as integer) as min_days, cast(max(days_late) as integer) as max_days, min(shipment_id) as first_id from shipments where delivery_state = 'overdue' and days_late >= 7 group by 1"


@query(f"with {st.SHIPMENTS_SQL} {LATE}")
def late_carrier(spark, d):
    return at.late_carriers(shipments(spark, d))


WORST = "cents desc, tone, days nulls last, shipments desc, sort_key"


@query(f"""with {COSTS_AND_STOCK}{PLAN_SQL.removeprefix(st.INVENTORY_SQL)}, billed as ({BILLED}), ranked as (select *, row_number() over (order by {WORST}) as n from stocked),
late as (select * from ({LATE}) order by shipments desc, max_days desc, {natural_sql('carrier')} limit 1),
parts as (
  select *, 0 as part, row_number() over (order by {WORST}) as m from (select * exclude n from ranked where n <= 3 union all select * from billed)
  union all select key, tone, null, null, null, sort_key, what, damage, action, 1, row_number() over (order by sort_key) from idle
  union all select * exclude n, 2, n from ranked where n > 3
), shown as (
  select * from (select *, row_number() over (order by part, m) as turn from parts) where turn <= 5 - (select count(*) from late)
)
select cast(row_number() over (order by part = 1, {WORST}) as integer) as rank, key, tone, cast(cents as bigint) as cents, what, damage, action from shown
union all select cast((select count(*) from shown) + 1 as integer), 'late:' || carrier, 'critical', null,
  case shipments when 1 then carrier || ': ' || first_id || ' is ' || {count_sql('max_days')} || case max_days when 1 then ' day' else ' days' end || ' late'
    else carrier || ' has ' || {count_sql('shipments')} || ' shipments ' || case when min_days = max_days then {count_sql('max_days')} else {count_sql('min_days')} || ' to ' || {count_sql('max_days')} end || ' days late' end,
  null, case shipments when 1 then 'Ask for a new date' else 'Ask for new dates' end from late""")
def action_queue(spark, d):
    return at.action_queue(inventory(spark, d), assessed(spark, d, "delivery_state", "days_late"), st.locations(spark, d)).select("rank", "key", "tone", "cents", "what", "damage", "action")


@query(f"with {st.COSTS_SQL} select shipment_id, status from assessed where (contains(lower(origin), 'na') or contains(lower(destination), 'na') or contains(lower(shipment_id), 'na') or contains(lower(carrier), 'na') or contains(lower(route_label), 'na')) and (contains(lower(origin), 'carrier') or contains(lower(destination), 'carrier') or contains(lower(shipment_id), 'carrier') or contains(lower(carrier), 'carrier') or contains(lower(route_label), 'carrier'))")
def search_shipments(spark, d):
    return li.filter_shipments(assessed(spark, d, "origin", "destination", "route_label"), query="na carrier").select("shipment_id", "status")


@query(f"with {st.COSTS_SQL} select shipment_id, status, delivery_state from assessed where status in ('pending', 'in_transit') and (is_delayed or lacks_estimate or lacks_actual or is_cost_anomaly or {ISSUE_LIST} <> '')")
def filter_shipments_flags(spark, d):
    return li.filter_shipments(assessed(spark, d), status="open", flag="any_issue").select("shipment_id", "status", "delivery_state")


@query(f"with {st.INVENTORY_SQL} select item_id, stock_status, stockout_risk from inventory where stock_status in ('low_stock', 'out_of_stock') and stockout_risk = 'high' and warehouse = 'WH-2'")
def filter_inventory(spark, d):
    return li.filter_inventory(inventory(spark, d), stock="low_or_out", risk="high", warehouse="WH-2").select("item_id", "stock_status", "stockout_risk")


@query(f"with {st.INVENTORY_SQL} select item_id, days_of_supply from inventory order by days_of_supply desc nulls last, cast(regexp_extract(sku, '([0-9]+)', 1) as integer), warehouse")
def sort_nulls_last(spark, d):
    return inventory(spark, d).orderBy(F.desc_nulls_last("days_of_supply"), li.natural_key(F.col("item_id"))).select("item_id", "days_of_supply")


@query(f"with {st.INVENTORY_SQL} select item_id, value_cents from (select item_id, cast(value_cents as bigint) as value_cents, sku, warehouse from inventory) order by value_cents desc, item_id limit 25 offset 25")
def page_2(spark, d):
    rows = li.sorted_by(inventory(spark, d), "value_cents", descending=True, then="item_id")
    return li.page(rows, 2, 25)[0].select("item_id", "value_cents")


@query(f"""with {st.INVENTORY_SQL} select item_id, case when stock_status = 'out_of_stock' then 3 when stock_status = 'low_stock' then 2 when stockout_risk = 'high' then 1 else 0 end as attention, cast(value_cents as bigint) as value_cents from inventory order by attention desc, value_cents desc, item_id""")
def attention_first(spark, d):
    return inventory(spark, d).withColumn("attention", li.attention_rank()).orderBy(F.desc("attention"), F.desc("value_cents"), "item_id").select("item_id", "attention", "value_cents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
