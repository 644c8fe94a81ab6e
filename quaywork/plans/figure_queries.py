"""Queries of the figures beside lists, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import figures as fi
from ..operators import listing as li
from ..sources.store import json_lines
from . import standins as st
from .queries import BOTH, ISSUE_LIST, assessed, count_sql, fixed_sql, inventory, query, scaled, shipments

ISSUE = f"{ISSUE_LIST} <> ''"
MISSING = "lacks_estimate or lacks_actual"


@query(f"""with {st.COSTS_SQL} select count_if(status = 'pending') as pending, count_if(status = 'in_transit') as in_transit, count_if(status = 'delivered') as delivered, count_if(status = 'cancelled') as cancelled,
  count_if(is_delayed) as delayed, count_if({MISSING}) as missing_dates, count_if(is_cost_anomaly) as cost_anomaly, count_if({ISSUE}) as data_issue, count_if(is_delayed or {MISSING} or is_cost_anomaly or {ISSUE}) as any_issue,
  count_if(delivery_state = 'overdue') as overdue, count_if(delivery_state = 'late') as late from assessed""")
def shipment_figures(spark, d):
    return fi.shipment_figures(assessed(spark, d))


@query(f"with {st.INVENTORY_SQL} select cast(sum(value_cents) as bigint) as value_cents, count_if(stock_status = 'out_of_stock') as out_of_stock, count_if(stock_status = 'low_stock') as low_stock, count_if(stockout_risk = 'high') as high_risk, count_if(stockout_risk = 'unknown') as unknown_risk from inventory")
def inventory_figures(spark, d):
    return fi.inventory_figures(inventory(spark, d))


@query(f"with {st.INVENTORY_SQL} select cast(sum(value_cents) as bigint) as value_cents, count(*) as items from inventory where stockout_risk = 'medium' and warehouse = 'WH-3'")
def filtered_inventory_value(spark, d):
    return li.filter_inventory(inventory(spark, d), risk="medium", warehouse="WH-3").agg(F.sum("value_cents").alias("value_cents"), F.count("*").alias("items"))


SHORT = "coalesce(replace(origin_code, 'WH-', ''), trim(origin)) || ' → ' || coalesce(replace(destination_code, 'WH-', ''), trim(destination))"


@query(f"""with {st.SHIPMENTS_SQL}, lanes as (
  select route_key, arg_min({SHORT}, shipment_id) as short_label, cast(count_if(is_delayed) as double) / count(*) as share, cast(count_if(delivery_state = 'on_time') as double) / nullif(count_if(delivery_state in ('on_time', 'late')), 0) as rate
  from shipments where status <> 'cancelled' group by 1
) select route_key, short_label, case when share >= 0.2e0 then 'critical' when share >= 0.1e0 then 'warning' else 'neutral' end as tone,
  case when rate is null then 'neutral' when rate >= 0.9e0 then 'good' when rate >= 0.8e0 then 'warning' else 'critical' end as on_time_tone from lanes""")
def lane_labels(spark, d):
    return fi.lane_labels(shipments(spark, d))


@query(f"""with {BOTH} select * from (select cast(floor(1e6 * sum(avg_daily_usage * 365 * unit_cost_cents) / sum(value_cents) + 0.5e0) as bigint) as turnover_millionths, count_if(stockout_risk = 'high') as high, count_if(stockout_risk = 'unknown') as unknown from inventory),
  (select cast(floor(1e6 * count_if(delivery_state = 'on_time') / count_if(delivery_state in ('on_time', 'late')) + 0.5e0) as bigint) as on_time_millionths from shipments)""")
def metrics_bundle(spark, d):
    rows = fi.metrics_bundle(inventory(spark, d), shipments(spark, d))
    return rows.select(scaled("supply.turnover").alias("turnover_millionths"), "risk.high", "risk.unknown", scaled("delivery.on_time_rate").alias("on_time_millionths"))


POINT = "cast(floor(1e3 * ({a} + ({b} - {a}) * progress) + 0.5e0) as bigint)"
X, Y = (POINT.format(a=a, b=a.replace("lon1", "lon2").replace("lat1", "lat2")) for a in ("((lon1 + 125e0) / 59e0 * 1000e0)", "((50e0 - lat1) / 26e0 * 600e0)"))


@query(f"""with {st.SHIPMENTS_SQL}, moving as (
  select *, least(1e0, greatest(0e0, cast(date '1998-07-01' - ship_date as double) / (estimated_delivery - ship_date))) as progress from shipments
  where status = 'in_transit' and estimated_delivery > ship_date and origin_code <> destination_code
) select shipment_id, route_label, {X} as x_thousandths, {Y} as y_thousandths, delivery_state = 'overdue' as overdue from moving""")
def transit_dots(spark, d):
    rows = fi.transit_dots(shipments(spark, d), st.TODAY)
    return rows.select("shipment_id", "route_label", scaled("x", 1000).alias("x_thousandths"), scaled("y", 1000).alias("y_thousandths"), "overdue")


@query(f"with {st.SHIPMENTS_SQL} select distinct carrier from shipments")
def carrier_options(spark, d):
    return li.options(shipments(spark, d), "carrier")


RATE = "cast(count_if(delivery_state = 'on_time') as double) / nullif(count_if(delivery_state in ('on_time', 'late')), 0) * 100"


@query(f"""with {st.SHIPMENTS_SQL}, both_rates as (select (select {fixed_sql(RATE, 1)} from shipments) || '%' as old, (select {fixed_sql(RATE, 1)} from shipments where ship_date >= date '1995-01-01') || '%' as new, (select count(*) from shipments) as n)
select case when old = new then 'On-time rate stays at ' || new || '.' else 'On-time rate moves from ' || old || ' to ' || new || '.' end || ' Replaces the ' || {count_sql('n')} || ' current shipments.' as impact from both_rates""")
def import_impact(spark, d):
    """The shipments from 1995 on, taken as an incoming table, against all."""
    rows = shipments(spark, d)
    return fi.shipments_impact(rows, rows.where("ship_date >= date '1995-01-01'"))


@query(f"""with {st.INVENTORY_SQL}, counts as (select count_if(stock_status = 'low_stock') as old, count_if(stock_status = 'low_stock' and warehouse <> 'WH-1') as new, count(*) as n from inventory)
select case when old = new then 'Low-stock items stay at ' || new || '.' else 'Low-stock items go from ' || old || ' to ' || new || '.' end || ' Replaces the ' || {count_sql('n')} || ' current inventory rows.' as impact from counts""")
def import_inventory_impact(spark, d):
    rows = inventory(spark, d)
    return fi.inventory_impact(rows, rows.where("warehouse <> 'WH-1'"))


@query(f"with {st.COSTS_SQL} select shipment_id, cast(is_delayed or {MISSING} or is_cost_anomaly or {ISSUE} as boolean) as flagged, ship_date from assessed order by flagged desc, ship_date desc, shipment_id")
def shipments_attention_first(spark, d):
    return assessed(spark, d).withColumn("flagged", li.shipment_flag("any_issue")).select("shipment_id", "flagged", "ship_date").orderBy(F.desc("flagged"), F.desc("ship_date"), "shipment_id")


@query(f"with {st.SHIPMENTS_SQL} select cast(to_json({{'status': status, 'shipments': count(*), 'latest': strftime(max(actual_delivery), '%Y-%m-%d')}}) as varchar) as value from shipments group by status")
def snapshot_json(spark, d):
    rows = shipments(spark, d).groupBy("status").agg(F.count("*").alias("shipments"), F.max("actual_delivery").alias("latest"))
    return json_lines(rows)
