"""The alert list: one scan of each source makes an array of alerts a row, which is exploded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ALERT_TYPES, COST_CRITICAL_MULTIPLE, DELAY_CRITICAL_DAYS, RECENT_LATE_DAYS, SEVERITIES
from ..functions.dates import day_text
from ..functions.numbers import fixed, money_text
from ..functions.text import collated, natural_key, status_label


@dataclass(frozen=True)
class Wanted:
    """Which alerts are made: of which types, and whether with ids and texts or only with type, severity and the entity's kind."""

    types: tuple[str, ...] = ALERT_TYPES
    texts: bool = True


EVERY = Wanted()


def _alert(when: Column, kind: str, key: Column, severity: Column | str, title: Column, message: Column, entity: str, entity_id: Column, label: Column) -> Callable[[Wanted], Column | None]:
    """Makes the alert where ``when`` holds, for what is wanted; None for a type that isn't."""
    grade = F.lit(severity) if isinstance(severity, str) else severity

    def made(wanted: Wanted) -> Column | None:
        if kind not in wanted.types:
            return None
        who = F.struct(F.lit(entity).alias("kind"), *([entity_id.alias("id"), label.alias("label")] if wanted.texts else []))
        fields = [F.lit(kind).alias("type"), grade.alias("severity"), who.alias("entity")]
        return F.when(when, F.struct(key.alias("alert_id"), *fields[:2], title.alias("title"), message.alias("message"), fields[2]) if wanted.texts else F.struct(*fields))

    return made


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _exploded(rows: DataFrame, alerts: list[Callable[[Wanted], Column | None]], wanted: Wanted = EVERY, more: Column | None = None) -> DataFrame | None:
    """A row for each alert, ``more`` being an array of further ones; None if no alert is of a wanted type."""
    made = [a for make in alerts if (a := make(wanted)) is not None]
    arrays = [F.array_compact(F.array(*made))] * bool(made) + [more] * (more is not None)
    return rows.select(F.explode(F.concat(*arrays)).alias("a")).select("a.*") if arrays else None


def inventory_alerts(inventory: DataFrame, locations: DataFrame, wanted: Wanted = EVERY) -> DataFrame | None:
    named = inventory.join(locations.select(F.col("code").alias("warehouse"), F.col("name").alias("warehouse_name")), "warehouse", "left")
    place = F.coalesce("warehouse_name", "warehouse")
    sku, item, product = F.col("sku"), F.col("item_id"), F.col("product_name")
    quantity, reorder = F.col("quantity").cast("string"), F.col("reorder_point").cast("string")
    label = _say(sku, " @ ", F.col("warehouse"))
    out, low = F.col("stock_status") == "out_of_stock", F.col("stock_status") == "low_stock"
    key = _say("low_stock:inventory:", item)
    return _exploded(named, [
        _alert(out, "low_stock", key, "critical", _say("Out of stock: ", sku), _say(product, " at ", place, " has 0 units (reorder point ", reorder, ")."), "inventory", item, label),
        _alert(low, "low_stock", key, "warning", _say("Low stock: ", sku), _say(product, " at ", place, " has ", quantity, " units, at or below the reorder point of ", reorder, "."), "inventory", item, label),
        _alert(F.col("avg_daily_usage").isNull(), "missing_info", _say("missing_info:inventory:", item, ":usage"), "info", _say("Missing usage data: ", sku), _say(product, " at ", place, " has no average daily usage; stockout risk and turnover exclude it."), "inventory", item, label),
    ], wanted)


def _of_shipment(when: Column, kind: str, key: Column, severity: Column | str, title: Column, message: Column) -> Callable[[Wanted], Column | None]:
    return _alert(when, kind, key, severity, title, message, "shipment", F.col("shipment_id"), F.col("shipment_id"))


def record_alerts(shipments: DataFrame, today: date, *more: Callable[[Wanted], Column | None], wanted: Wanted = EVERY) -> DataFrame | None:
    """Delays, missing dates and data issues, and ``more``; by itself it needs no cost assessment."""
    sid, route, carrier = F.col("shipment_id"), F.col("route_label"), F.col("carrier")
    days, eta = F.col("days_late").cast("string"), day_text(F.col("estimated_delivery"))
    state = F.col("delivery_state")
    delayed = _say("shipment_delayed:shipment:", sid)
    recent = (state == "late") & (F.col("actual_delivery") >= F.date_sub(F.lit(today), RECENT_LATE_DAYS))
    issue = lambda i: _of_shipment(F.lit(True), "invalid_data", _say("invalid_data:shipment:", sid, ":", i["code"]), "warning", _say("Data issue: ", sid), i["message"])(wanted)
    issues = F.transform("issues", issue) if "invalid_data" in wanted.types else None
    return _exploded(shipments, [
        _of_shipment(state == "overdue", "shipment_delayed", delayed, F.when(F.col("days_late") >= DELAY_CRITICAL_DAYS, "critical").otherwise("warning"), _say("Shipment overdue: ", sid), _say(route, " via ", carrier, " was due ", eta, " and is ", days, " day(s) late.")),
        _of_shipment(recent, "shipment_delayed", delayed, "info", _say("Delivered late: ", sid), _say(route, " via ", carrier, " arrived ", days, " day(s) after the estimated ", eta, ".")),
        _of_shipment(F.array_contains("missing_dates", "estimated_delivery"), "missing_info", _say("missing_info:shipment:", sid, ":eta"), "warning", _say("Missing estimated delivery: ", sid), _say(route, " (", F.lower(status_label(F.col("status"))), ") has no estimated delivery date, so delays cannot be detected.")),
        _of_shipment(F.array_contains("missing_dates", "actual_delivery"), "missing_info", _say("missing_info:shipment:", sid, ":actual"), "warning", _say("Missing delivery date: ", sid), _say(route, " is marked delivered but has no actual delivery date.")),
        *more,
    ], wanted, issues)


def _cost_alert() -> Callable[[Wanted], Column | None]:
    sid, cost, base = F.col("shipment_id"), F.col("shipping_cost_cents"), F.col("baseline_cents")
    usual = F.when(F.col("cost_method") == "route_carrier", "this route with this carrier").when(F.col("cost_method") == "route", "this route").otherwise("a shipment of this distance")
    grade = F.when(cost >= base * COST_CRITICAL_MULTIPLE, "critical").otherwise("warning")
    said = _say(money_text(cost), " is ", fixed(cost / base, 1), "× the typical ", money_text(base), " for ", usual, ".")
    return _of_shipment(F.col("is_cost_anomaly") & (base > 0), "cost_anomaly", _say("cost_anomaly:shipment:", sid), grade, _say("Unusual shipping cost: ", sid), said)


def cost_alerts(assessed: DataFrame) -> DataFrame:
    return _exploded(assessed.where("is_cost_anomaly and baseline_cents > 0"), [_cost_alert()])


def shipment_alerts(assessed: DataFrame, today: date, wanted: Wanted = EVERY) -> DataFrame | None:
    """All alerts of shipments, in one pass over their assessed rows."""
    return record_alerts(assessed, today, _cost_alert(), wanted=wanted)


def capacity_alerts(utilization: DataFrame, wanted: Wanted = EVERY) -> DataFrame | None:
    code, name = F.col("code"), F.col("name")
    said = _say(F.col("units").cast("string"), " units stored vs capacity ", F.col("capacity_units").cast("string"), " (", fixed(F.col("utilization") * 100, 1), "%).")
    return _exploded(utilization, [_alert(F.col("utilization") > 1, "invalid_data", _say("invalid_data:warehouse:", code), "warning", _say("Over capacity: ", name), said, "warehouse", code, name)], wanted)


def all_alerts(inventory: DataFrame, assessed: DataFrame, utilization: DataFrame, locations: DataFrame, today: date, wanted: Wanted = EVERY) -> DataFrame:
    """Every alert of the wanted types, with its attention kind."""
    each = (inventory_alerts(inventory, locations, wanted), shipment_alerts(assessed, today, wanted), capacity_alerts(utilization, wanted))
    return reduce(DataFrame.unionByName, [a for a in each if a is not None]).withColumn("kind", attention_kind())


def groups_of_page(counts: dict[tuple[str, str], int], start: int, size: int) -> tuple[list[tuple[str, str]], int]:
    """The groups (severity, type) that hold the alerts from ``start`` (0 the first) on, and how many alerts stand before those groups.

    The list goes by severity and type first, so how many there are of each tells where a page lies.
    """
    found, upto, before = [], 0, 0
    for group in sorted(counts, key=lambda g: (SEVERITIES.index(g[0]), ALERT_TYPES.index(g[1]))):
        if upto + counts[group] <= start:
            before = upto + counts[group]
        elif upto < start + size:
            found.append(group)
        upto += counts[group]
    return found, before


def order_key() -> Column:
    """The place of an alert in the list as text: by severity, type, then its entity's id with numbers in number order."""
    place = lambda column, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)).cast("string")
    return F.concat(place("severity", SEVERITIES), place("type", ALERT_TYPES), natural_key(F.col("entity.id")))


def in_order(alerts: DataFrame) -> DataFrame:
    """The alerts in the order of the list; sorts all of them, so what isn't shown is better left to ``order_key``."""
    place = lambda column, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return alerts.orderBy(place("severity", SEVERITIES), place("type", ALERT_TYPES), collated(F.col("entity.id")), "alert_id")


def attention_kind() -> Column:
    """What a critical or warning alert asks attention for; null for information."""
    kind = F.when(F.col("type") == "low_stock", F.when(F.col("severity") == "critical", "out_of_stock").otherwise("low_stock")).when(F.col("type") == "shipment_delayed", "overdue")
    kind = kind.when(F.col("type") == "cost_anomaly", "unusual_cost").when((F.col("type") == "invalid_data") & (F.col("entity.kind") == "warehouse"), "over_capacity").otherwise("records")
    return F.when(F.col("severity") != "info", kind)


def severity_counts(alerts: DataFrame) -> DataFrame:
    """A row for each severity in fixed order, zeros too."""
    counts = alerts.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("alerts")) for s in SEVERITIES])))


def filter_alerts(alerts: DataFrame, severity: str = "all", kind: str = "all", attention: str = "all", query: str = "") -> DataFrame:
    from ..functions.text import matches_search

    out = alerts
    if severity in SEVERITIES:
        out = out.where(F.col("severity") == severity)
    if kind in ALERT_TYPES:
        out = out.where(F.col("type") == kind)
    if attention == "any":
        out = out.where("kind is not null")
    elif attention != "all":
        out = out.where(F.col("kind") == attention)
    return out.withColumn("_label", F.col("entity.label")).where(matches_search(query, "title", "message", "_label")).drop("_label")
