"""Ranges, groups, monthly series, lanes and recent activity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LANE_CRITICAL_SHARE, LANE_WATCH_SHARE, STATUSES
from ..functions.dates import month_key, months
from ..functions.numbers import half_up, ratio


def in_range(shipments: DataFrame, days: int | None, today: date) -> DataFrame:
    """Shipped in the last ``days`` days or in the future; all if None."""
    return shipments if days is None else shipments.where(F.col("ship_date") >= F.date_sub(F.lit(today), days))


def inventory_value_by(inventory: DataFrame, by: str) -> DataFrame:
    return inventory.groupBy(by).agg(F.sum("value_cents").alias("value_cents"), F.sum("quantity").alias("units"), F.count("*").alias("items")).orderBy(F.desc("value_cents"), by)


def inventory_value_by_warehouse(inventory: DataFrame, locations: DataFrame) -> DataFrame:
    named = inventory_value_by(inventory, "warehouse").join(locations.select(F.col("code").alias("warehouse"), "name"), "warehouse", "left")
    return named.withColumn("name", F.coalesce("name", "warehouse")).orderBy(F.desc("value_cents"), "warehouse")


def shipments_by_status(shipments: DataFrame) -> DataFrame:
    """A row for each status in fixed order, zeros too."""
    counts = shipments.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    rows = F.array(*[F.struct(F.lit(i).alias("_ord"), F.lit(s).alias("status"), F.col(s).alias("shipments")) for i, s in enumerate(STATUSES)])
    return counts.select(F.inline(rows))


def _gap_filled(series: DataFrame, measures: list[str]) -> DataFrame:
    """``series`` (month and measures) with a row of zeros for every month missing between its first and last."""
    first, last = F.to_date(F.concat(F.min("month"), F.lit("-01"))), F.to_date(F.concat(F.max("month"), F.lit("-01")))
    span = series.agg(first.alias("a"), last.alias("b")).where("a is not null").select(F.explode(months(F.col("a"), F.col("b"))).alias("day"))
    every = span.select(month_key(F.col("day")).alias("month"))
    return every.join(series, "month", "left").select("month", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in measures]).orderBy("month")


def shipping_cost_by_month(shipments: DataFrame, today: date) -> DataFrame:
    """Of shipments that aren't cancelled and have left by today."""
    live = shipments.where((F.col("status") != "cancelled") & (F.col("ship_date") <= F.lit(today)))
    return _gap_filled(live.groupBy(month_key(F.col("ship_date")).alias("month")).agg(F.sum("shipping_cost_cents").alias("shipping_cents"), F.count("*").alias("shipments")), ["shipping_cents", "shipments"])


def ontime_vs_delayed_by_month(shipments: DataFrame) -> DataFrame:
    """By the month of the estimated delivery, whatever today is."""
    state = F.col("delivery_state")
    rated = shipments.where(F.col("estimated_delivery").isNotNull() & state.isin("on_time", "late", "overdue"))
    return _gap_filled(rated.groupBy(month_key(F.col("estimated_delivery")).alias("month")).agg(F.count_if(state == "on_time").alias("on_time"), F.count_if(state != "on_time").alias("delayed")), ["on_time", "delayed"])


def route_summary(shipments: DataFrame) -> DataFrame:
    """One row for each lane: counts, costs, delays, the label of its first shipment by id, carriers by count."""
    live = shipments.where("status <> 'cancelled'")
    first = F.min_by(F.struct("route_label", "origin_name", "destination_name", "origin_code", "destination_code"), "shipment_id")
    by_carrier = live.groupBy("route_key", "carrier").agg(
        F.count("*").alias("n"), F.sum("shipping_cost_cents").alias("cents"), F.count_if("is_delayed").alias("late"), F.min("shipment_id").alias("lowest"), first.alias("first")
    )
    carriers = F.array_sort(F.collect_list(F.struct(F.col("carrier"), F.col("n").alias("shipments"))), lambda a, b: F.when(a["shipments"] != b["shipments"], F.when(a["shipments"] > b["shipments"], -1).otherwise(1)).when(a["carrier"] < b["carrier"], -1).when(a["carrier"] > b["carrier"], 1).otherwise(0))
    lanes = by_carrier.groupBy("route_key").agg(F.sum("n").alias("shipments"), F.sum("cents").alias("shipping_cents"), F.sum("late").alias("delayed"), F.min_by("first", "lowest").alias("first"), carriers.alias("carriers"))
    return lanes.select(
        "route_key", "first.route_label", "shipments", "shipping_cents", half_up(ratio(F.col("shipping_cents"), F.col("shipments"))).cast("long").alias("average_cost_cents"), "delayed",
        ratio(F.col("delayed"), F.col("shipments")).alias("delayed_share"), (F.col("first.origin_code").isNotNull() & F.col("first.destination_code").isNotNull()).alias("is_mapped"),
        F.coalesce(F.col("first.origin_code") == F.col("first.destination_code"), F.lit(False)).alias("is_same_place"), "carriers",
    ).orderBy(F.desc("shipments"), "route_key")


def top_routes(routes: DataFrame, by: str, k: int = 10) -> DataFrame:
    return routes.orderBy(F.desc(by), "route_key").limit(k)


def listed_lanes(routes: DataFrame, show: str = "all", anomalous: DataFrame | None = None, mapped_only: bool = False, k: int | None = None) -> DataFrame:
    """Lanes of two places (or unmapped): all, ``critical``, ``watch`` or ``cost`` (with a shipment in ``anomalous``)."""
    out = routes.where(~F.col("is_mapped") | ~F.col("is_same_place"))
    if show == "critical":
        out = out.where(F.col("delayed_share") >= LANE_CRITICAL_SHARE)
    elif show == "watch":
        out = out.where((F.col("delayed_share") >= LANE_WATCH_SHARE) & (F.col("delayed_share") < LANE_CRITICAL_SHARE))
    elif show == "cost":
        out = out.join(anomalous.where("is_cost_anomaly and status <> 'cancelled'").select("route_key").distinct(), "route_key", "left_semi")
    if mapped_only:
        out = out.where("is_mapped")
    out = out.orderBy(F.desc("shipments"), "route_key")
    return out if k is None else out.limit(k)


def most_delayed_lane(routes: DataFrame) -> DataFrame:
    fit = F.col("is_mapped") & ~F.col("is_same_place") & (F.col("delayed") > 0) & (F.col("delayed_share") >= LANE_WATCH_SHARE)
    return routes.where(fit).orderBy(F.desc("delayed_share"), F.desc("shipments"), "route_key").limit(1)


def activity_date() -> Column:
    return F.when(F.col("status") == "delivered", F.col("actual_delivery")).otherwise(F.col("ship_date"))


def recent_activity(shipments: DataFrame, today: date, k: int = 10) -> DataFrame:
    """The last ``k`` shipments that something happened to by today."""
    return shipments.withColumn("activity_date", activity_date()).where(F.col("activity_date") <= F.lit(today)).orderBy(F.desc("activity_date"), "shipment_id").limit(k)


def transit_progress(today: date) -> Column:
    """How far along its planned time a shipment is, 0 to 1; null without an estimate after shipping."""
    planned, gone = F.datediff("estimated_delivery", "ship_date"), F.datediff(F.lit(today), F.col("ship_date"))
    return F.when(planned > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(gone, planned))))
