"""The reference dimension: places, carriers and lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import LOCATIONS

# Code, name, latitude, longitude and capacity in units of the warehouses.
WAREHOUSES = [
    ("WH-DFW", "Dallas-Fort Worth DC", 32.9, -97.04, 72_000),
    ("WH-ATL", "Atlanta DC", 33.64, -84.43, 75_000),
    ("WH-ORD", "Chicago DC", 41.98, -87.9, 91_000),
    ("WH-LAX", "Los Angeles DC", 33.94, -118.41, 55_000),
    ("WH-EWR", "Newark DC", 40.69, -74.17, 62_000),
]
# Code, name, latitude and longitude of the cities.
CITIES = [
    ("HOU", "Houston, TX", 29.76, -95.37),
    ("SAT", "San Antonio, TX", 29.42, -98.49),
    ("PHX", "Phoenix, AZ", 33.45, -112.07),
    ("DEN", "Denver, CO", 39.74, -104.99),
    ("MCI", "Kansas City, MO", 39.1, -94.58),
    ("BNA", "Nashville, TN", 36.16, -86.78),
    ("MIA", "Miami, FL", 25.76, -80.19),
    ("CLT", "Charlotte, NC", 35.23, -80.84),
    ("CMH", "Columbus, OH", 39.96, -83.0),
    ("BOS", "Boston, MA", 42.36, -71.06),
    ("MSP", "Minneapolis, MN", 44.98, -93.27),
    ("DTW", "Detroit, MI", 42.33, -83.05),
    ("LAS", "Las Vegas, NV", 36.17, -115.14),
    ("SLC", "Salt Lake City, UT", 40.76, -111.89),
    ("SEA", "Seattle, WA", 47.61, -122.33),
    ("PDX", "Portland, OR", 45.52, -122.68),
]
# Carriers and their dollars a mile, and where each warehouse sends.
CARRIERS = [("Northstar Freight", 1.85), ("BlueLine Logistics", 2.1), ("Cascade Carriers", 1.7), ("Summit Express", 2.35), ("Redwood Transport", 1.95)]
LANES = {
    "WH-DFW": ["HOU", "SAT", "PHX", "DEN", "MCI", "BNA"],
    "WH-ATL": ["MIA", "CLT", "BNA", "CMH", "HOU", "BOS"],
    "WH-ORD": ["MSP", "DTW", "CMH", "MCI", "DEN", "BOS"],
    "WH-LAX": ["PHX", "LAS", "SLC", "SEA", "PDX", "DEN"],
    "WH-EWR": ["BOS", "CLT", "DTW", "CMH", "MIA", "BNA"],
}


def locations(spark: SparkSession) -> DataFrame:
    """code, name, kind, lat, lon, capacity_units, _ord: warehouses, then cities."""
    rows = [(code, name, "warehouse", lat, lon, units) for code, name, lat, lon, units in WAREHOUSES] + [(code, name, "city", lat, lon, None) for code, name, lat, lon in CITIES]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], LOCATIONS)


def carriers(spark: SparkSession) -> DataFrame:
    """carrier, rate_per_mile and _ord."""
    return spark.createDataFrame([(*c, i) for i, c in enumerate(CARRIERS)], "carrier string, rate_per_mile double, _ord int")


def lanes(spark: SparkSession) -> DataFrame:
    """origin, destination (codes) and _ord."""
    pairs = [(a, b) for a, ends in LANES.items() for b in ends]
    return spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "origin string, destination string, _ord int")
