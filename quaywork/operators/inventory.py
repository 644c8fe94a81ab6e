"""Enrichment of inventory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import STOCKOUT_BUFFER_DAYS
from ..functions.numbers import ratio


def stock_status() -> Column:
    return F.when(F.col("quantity") == 0, "out_of_stock").when(F.col("quantity") <= F.col("reorder_point"), "low_stock").otherwise("in_stock")


def days_of_supply() -> Column:
    """Null without usage, or with none."""
    return ratio(F.col("quantity"), F.col("avg_daily_usage"))


def stockout_risk() -> Column:
    usage, days, lead = F.col("avg_daily_usage"), F.col("days_of_supply"), F.col("lead_time_days")
    return F.when(F.col("quantity") == 0, "high").when(usage.isNull(), "unknown").when(usage == 0, "low").when(days < lead, "high").when(days < lead + STOCKOUT_BUFFER_DAYS, "medium").otherwise("low")


def short_units() -> Column:
    """Whole units short before a reorder placed today arrives; null without usage. Counted in hundredths of a unit."""
    hundredths = (F.floor(F.col("avg_daily_usage") * 100 + 0.5) * F.col("lead_time_days") - F.col("quantity") * 100).cast("long")
    return F.when(F.col("avg_daily_usage").isNotNull(), F.ceil(F.greatest(hundredths, F.lit(0)) / 100)).cast("long")


def enrich_inventory(inventory: DataFrame) -> DataFrame:
    """Adds item_id, value_cents, stock_status, days_of_supply and stockout_risk."""
    return inventory.withColumns({
        "item_id": F.concat_ws("@", "sku", "warehouse"),
        "value_cents": F.col("quantity") * F.col("unit_cost_cents"),
        "stock_status": stock_status(),
        "days_of_supply": days_of_supply(),
    }).withColumn("stockout_risk", stockout_risk())
