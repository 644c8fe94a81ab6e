"""Canonical column lists; their order is the order in which a row's errors are reported."""

INVENTORY = "sku string, product_name string, category string, warehouse string, quantity long, reorder_point long, unit_cost_cents long, avg_daily_usage double, lead_time_days int"
SHIPMENTS = "shipment_id string, origin string, destination string, carrier string, status string, ship_date date, estimated_delivery date, actual_delivery date, shipping_cost_cents long"
LOCATIONS = "code string, name string, kind string, lat double, lon double, capacity_units long, _ord int"
