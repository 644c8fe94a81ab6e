"""Key figures, turnover, utilization and risk counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DAYS_IN_YEAR, RISKS
from ..functions.numbers import half_up, ratio


def on_time_rate() -> Column:
    """On time over delivered with both dates; overdue shipments aren't in it."""
    state = F.col("delivery_state")
    return ratio(F.count_if(state == "on_time"), F.count_if(state.isin("on_time", "late")))


def average_cost() -> Column:
    """Rounded cents over shipments that aren't cancelled."""
    live = F.col("status") != "cancelled"
    return half_up(ratio(F.sum(F.when(live, F.col("shipping_cost_cents"))), F.count_if(live))).cast("long")


def shipment_kpis(shipments: DataFrame) -> DataFrame:
    state, status = F.col("delivery_state"), F.col("status")
    return shipments.agg(
        F.count("*").alias("shipments"),
        F.count_if(status.isin("pending", "in_transit")).alias("open_shipments"),
        F.count_if(status == "delivered").alias("delivered"),
        F.count_if(status == "cancelled").alias("cancelled"),
        F.count_if("is_delayed").alias("delayed"),
        F.count_if(state == "overdue").alias("overdue"),
        F.count_if(state == "late").alias("late"),
        F.count_if(state == "on_time").alias("on_time"),
        on_time_rate().alias("on_time_rate"),
        F.coalesce(F.sum(F.when(status != "cancelled", F.col("shipping_cost_cents"))), F.lit(0)).alias("shipping_cents"),
        average_cost().alias("average_cost_cents"),
        F.avg("transit_days").alias("average_delivery_days"),
    )


def inventory_kpis(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count("*").alias("items"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"),
        F.coalesce(F.sum("value_cents"), F.lit(0)).alias("value_cents"),
        F.count_if(F.col("stock_status") == "out_of_stock").alias("out_of_stock"),
        F.count_if(F.col("stock_status") == "low_stock").alias("low_stock"),
    )


def kpi_summary(inventory: DataFrame, shipments: DataFrame) -> DataFrame:
    """One row of 17 measures over enriched inventory and shipments: one pass over each."""
    return inventory_kpis(inventory).crossJoin(shipment_kpis(shipments))


def supply_metrics(inventory: DataFrame) -> DataFrame:
    """Yearly usage at cost over the value of all items, days of inventory, and how many items have usage data."""
    used = F.col("avg_daily_usage").isNotNull()
    yearly = F.sum(F.col("avg_daily_usage") * DAYS_IN_YEAR * F.col("unit_cost_cents"))
    turnover = ratio(yearly, F.sum("value_cents"))
    out = inventory.agg(turnover.alias("turnover"), F.count_if(used).alias("items_with_usage"), F.count("*").alias("items"))
    return out.select("turnover", F.try_divide(F.lit(float(DAYS_IN_YEAR)), "turnover").alias("days_of_inventory"), "items_with_usage", "items")


def warehouse_utilization(inventory: DataFrame, locations: DataFrame) -> DataFrame:
    """Units, value and share of capacity of every warehouse, those without stock too; null where capacity is unknown."""
    held = inventory.groupBy("warehouse").agg(F.sum("quantity").alias("u"), F.sum("value_cents").alias("v"), F.count("*").alias("n"))
    out = locations.where("kind = 'warehouse'").join(held, F.col("code") == F.col("warehouse"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("code", "name", "capacity_units", zero("u").alias("units"), zero("v").alias("value_cents"), zero("n").alias("items"), ratio(zero("u"), F.col("capacity_units")).alias("utilization"), "_ord")


def stockout_risk_counts(inventory: DataFrame) -> DataFrame:
    """One row with a count for every class."""
    return inventory.agg(*[F.count_if(F.col("stockout_risk") == r).alias(r) for r in RISKS])
