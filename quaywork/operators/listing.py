"""Filters, sorts and pages of the enriched tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_PAGE_SIZE, PAGE_SIZES, RISKS, STATUSES
from ..functions.text import collated, matches_search, natural_key  # noqa: F401 - natural_key is used from here


def shipment_flag(flag: str) -> Column:
    """delayed, missing_dates, cost_anomaly, data_issue or any_issue; anything else holds for every row."""
    some = {
        "delayed": F.col("is_delayed"),
        "missing_dates": F.size("missing_dates") > 0,
        "cost_anomaly": F.col("is_cost_anomaly"),
        "data_issue": F.size("issues") > 0,
    }
    if flag == "any_issue":
        return some["delayed"] | some["missing_dates"] | some["cost_anomaly"] | some["data_issue"]
    return some.get(flag, F.lit(True))


def filter_shipments(assessed: DataFrame, query: str = "", status: str = "all", carrier: str = "all", flag: str = "all") -> DataFrame:
    """All conditions together; a status that isn't known, or ``all``, doesn't narrow."""
    out = assessed.where(shipment_flag(flag)).where(matches_search(query, "shipment_id", "origin", "destination", "carrier", "route_label"))
    if status in STATUSES:
        out = out.where(F.col("status") == status)
    elif status == "open":
        out = out.where(F.col("status").isin("pending", "in_transit"))
    return out if carrier == "all" else out.where(F.col("carrier") == carrier)


def filter_inventory(inventory: DataFrame, query: str = "", stock: str = "all", risk: str = "all", warehouse: str = "all", category: str = "all") -> DataFrame:
    out = inventory.where(matches_search(query, "sku", "product_name", "category"))
    if stock == "low_or_out":
        out = out.where(F.col("stock_status").isin("low_stock", "out_of_stock"))
    elif stock in ("in_stock", "low_stock", "out_of_stock"):
        out = out.where(F.col("stock_status") == stock)
    if risk in RISKS:
        out = out.where(F.col("stockout_risk") == risk)
    for column, value in (("warehouse", warehouse), ("category", category)):
        if value != "all":
            out = out.where(F.col(column) == value)
    return out


def attention_rank() -> Column:
    """Out of stock 3, low 2, high risk 1, else 0."""
    return F.when(F.col("stock_status") == "out_of_stock", 3).when(F.col("stock_status") == "low_stock", 2).when(F.col("stockout_risk") == "high", 1).otherwise(0)


def sorted_by(rows: DataFrame, column: str, descending: bool = False, text: bool = False, then: str | None = None) -> DataFrame:
    """Nulls last either way; text in a collator's order, numbers by value; ties by ``then``, ascending."""
    key = collated(F.col(column)) if text else F.col(column)
    first = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return rows.orderBy(first, *([then] if then else []))


def place_of(total: int, number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> dict[str, int]:
    """Where a page of ``total`` rows lies: page, pages, first and last row from 1 (0 if there are none)."""
    size = size if size in PAGE_SIZES else DEFAULT_PAGE_SIZE
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    start = (number - 1) * size
    return {"page": number, "pages": pages, "first": start + 1 if total else 0, "last": min(total, start + size), "total": total}


def page(rows: DataFrame, number: int = 1, size: int = DEFAULT_PAGE_SIZE, total: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """A page of sorted rows and its place, ``place_of``."""
    size = size if size in PAGE_SIZES else DEFAULT_PAGE_SIZE
    at = place_of(rows.count() if total is None else total, number, size)
    return rows.offset((at["page"] - 1) * size).limit(size), at


def options(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct().orderBy(column)
