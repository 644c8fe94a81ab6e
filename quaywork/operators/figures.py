"""Figures beside lists: counts over whole tables, tones, short labels, the metrics bundle, dots on the map, what an import changes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LANE_CRITICAL_SHARE, LANE_WATCH_SHARE, ON_TIME_FLOOR, ON_TIME_TARGET, STATUSES
from ..functions.numbers import fixed, projected
from .listing import shipment_flag
from .metrics import on_time_rate, stockout_risk_counts, supply_metrics
from .series import transit_progress


def shipment_figures(assessed: DataFrame) -> DataFrame:
    """One row: shipments by status, by what asks for attention, overdue and late ones; over all, by the filters' own tests."""
    flags = ("delayed", "missing_dates", "cost_anomaly", "data_issue", "any_issue")
    return assessed.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], *[F.count_if(shipment_flag(f)).alias(f) for f in flags], *[F.count_if(F.col("delivery_state") == s).alias(s) for s in ("overdue", "late")])


def inventory_figures(inventory: DataFrame) -> DataFrame:
    """One row: value and items by what asks for attention."""
    stock, risk = F.col("stock_status"), F.col("stockout_risk")
    return inventory.agg(F.coalesce(F.sum("value_cents"), F.lit(0)).alias("value_cents"), F.count_if(stock == "out_of_stock").alias("out_of_stock"), F.count_if(stock == "low_stock").alias("low_stock"), F.count_if(risk == "high").alias("high_risk"), F.count_if(risk == "unknown").alias("unknown_risk"))


def lane_tone(share: Column) -> Column:
    return F.when(share >= LANE_CRITICAL_SHARE, "critical").when(share >= LANE_WATCH_SHARE, "warning").otherwise("neutral")


def on_time_tone(rate: Column) -> Column:
    return F.when(rate.isNull(), "neutral").when(rate >= ON_TIME_TARGET, "good").when(rate >= ON_TIME_FLOOR, "warning").otherwise("critical")


def short_label() -> Column:
    """``DFW → BNA``: codes without ``WH-``, or the name of an unmapped end."""
    end = lambda name: F.coalesce(F.regexp_replace(f"{name}_code", "^WH-", ""), f"{name}_name", F.trim(F.col(name)))
    return F.concat_ws(" → ", end("origin"), end("destination"))


def lane_labels(shipments: DataFrame) -> DataFrame:
    """Each lane's short label (of its first shipment by id), tone, and the tone of its on-time rate."""
    live = shipments.where("status <> 'cancelled'")
    rows = live.groupBy("route_key").agg(F.min_by(short_label(), "shipment_id").alias("short_label"), (F.count_if("is_delayed") / F.count("*")).alias("delayed_share"), on_time_rate().alias("on_time_rate"))
    return rows.select("route_key", "short_label", lane_tone(F.col("delayed_share")).alias("tone"), on_time_tone(F.col("on_time_rate")).alias("on_time_tone"))


def metrics_bundle(inventory: DataFrame, shipments: DataFrame) -> DataFrame:
    """One row of nested figures: supply, risk counts and the on-time rate; each is a one-row aggregate."""
    supply, risk = supply_metrics(inventory), stockout_risk_counts(inventory)
    delivery = shipments.agg(on_time_rate().alias("on_time_rate"), F.avg("transit_days").alias("average_delivery_days"))
    packed = lambda rows, name: rows.select(F.struct(*rows.columns).alias(name))
    return packed(supply, "supply").crossJoin(packed(risk, "risk")).crossJoin(packed(delivery, "delivery"))


def transit_dots(shipments: DataFrame, today: date) -> DataFrame:
    """shipment_id, route_label, x, y, progress, overdue of shipments in transit between two known places."""
    at = lambda end: projected(F.col(f"{end}_lat"), F.col(f"{end}_lon"))
    rows = shipments.where("status = 'in_transit' and origin_code is not null and destination_code is not null and origin_code <> destination_code")
    rows = rows.withColumns({"progress": transit_progress(today), "a": at("origin"), "b": at("destination")}).where("progress is not null")
    place = lambda c: (F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * F.col("progress")).alias(c)
    return rows.select("shipment_id", "route_label", place("x"), place("y"), "progress", (F.col("delivery_state") == "overdue").alias("overdue"))


def _percent(rate: Column) -> Column:
    return F.when(rate.isNull(), "none").otherwise(F.concat(fixed(rate * 100, 1), F.lit("%")))


def shipments_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: what importing ``after`` in place of ``before`` (both enriched) does to the on-time rate, in words."""
    old = before.agg(_percent(on_time_rate()).alias("old"), F.count("*").alias("n"))
    new = after.agg(_percent(on_time_rate()).alias("new"))
    move = F.when(F.col("old") == F.col("new"), F.concat(F.lit("On-time rate stays at "), F.col("new"), F.lit("."))).otherwise(F.concat(F.lit("On-time rate moves from "), F.col("old"), F.lit(" to "), F.col("new"), F.lit(".")))
    return old.crossJoin(new).select(F.concat(move, F.lit(" Replaces the "), F.format_number("n", 0), F.lit(" current shipments.")).alias("impact"))


def inventory_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: what importing ``after`` does to the number of low-stock items, in words."""
    low = F.count_if(F.col("stock_status") == "low_stock")
    both = before.agg(low.alias("old"), F.count("*").alias("n")).crossJoin(after.agg(low.alias("new")))
    move = F.when(F.col("old") == F.col("new"), F.format_string("Low-stock items stay at %d.", "new")).otherwise(F.format_string("Low-stock items go from %d to %d.", "old", "new"))
    return both.select(F.concat(move, F.lit(" Replaces the "), F.format_number("n", 0), F.lit(" current inventory rows.")).alias("impact"))
