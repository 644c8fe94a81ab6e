"""The snapshot: everything that is derived from the two tables and a day, as one table of JSON lines by section."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from . import alerts as al
from . import metrics as me
from . import series as se
from .figures import metrics_bundle
from .inventory import enrich_inventory
from .shipments import assess_costs, located, with_states


def snapshot_sections(inventory: DataFrame, shipments: DataFrame, locations: DataFrame, today: date) -> dict[str, DataFrame]:
    """The snapshot's tables by name, from raw inventory and shipments.

    inventory, shipments (enriched, costs assessed), alerts, kpis and metrics (one row each), utilization, value_by_warehouse,
    value_by_category, shipments_by_status, cost_by_month, ontime_by_month, lanes, locations. Inventory, and shipments
    with both ends known, are written once; states and assessed costs are worked out where a section needs them.
    """
    stock = written(enrich_inventory(inventory))
    known = with_states(written(located(shipments, locations)), today)
    sent = assess_costs(known)
    held = me.warehouse_utilization(stock, locations)
    return {
        "inventory": stock,
        "shipments": sent,
        "alerts": al.all_alerts(stock, sent, held, locations, today),
        "kpis": me.kpi_summary(stock, known),
        "metrics": metrics_bundle(stock, known),
        "utilization": held,
        "value_by_warehouse": se.inventory_value_by_warehouse(stock, locations),
        "value_by_category": se.inventory_value_by(stock, "category"),
        "shipments_by_status": se.shipments_by_status(known),
        "cost_by_month": se.shipping_cost_by_month(known, today),
        "ontime_by_month": se.ontime_vs_delayed_by_month(known),
        "lanes": se.route_summary(known),
        "locations": locations,
    }


def snapshot_lines(sections: Mapping[str, DataFrame]) -> DataFrame:
    """section and value: a JSON object for each row of each table, nulls written out. Write it partitioned by section."""
    each = [rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")) for name, rows in sections.items()]
    return reduce(DataFrame.unionByName, each)
