"""Business constants, in one place; tests pin them."""

# Fixed values of the domain rules.
DELAY_CRITICAL_DAYS = 7
RECENT_LATE_DAYS = 14
Z_THRESHOLD = 3.5
MIN_RATIO = 1.5
MIN_PEERS = 8
MIN_MILES = 50
COST_CRITICAL_MULTIPLE = 3
MAD_SCALE = 0.6745
MEAN_AD_SCALE = 1.253314
STOCKOUT_BUFFER_DAYS = 7
DEFAULT_LEAD_DAYS = 14
DAYS_IN_YEAR = 365
LANE_CRITICAL_SHARE = 0.20
LANE_WATCH_SHARE = 0.10
ON_TIME_TARGET = 0.90
ON_TIME_FLOOR = 0.80
EARTH_RADIUS_MILES = 3958.8
MAX_ISSUES_SHOWN = 500
PAGE_SIZES = (10, 25, 50, 100)
DEFAULT_PAGE_SIZE = 25
QUEUE_ROWS = 5
QUEUE_STOCK_ROWS = 3

STATUSES = ("pending", "in_transit", "delivered", "cancelled")
RISKS = ("high", "medium", "low", "unknown")
SEVERITIES = ("critical", "warning", "info")
ALERT_TYPES = ("low_stock", "shipment_delayed", "cost_anomaly", "missing_info", "invalid_data")
ATTENTION_KINDS = ("out_of_stock", "low_stock", "overdue", "unusual_cost", "over_capacity", "records")
ISSUE_CODES = ("ACTUAL_BEFORE_SHIP", "ETA_BEFORE_SHIP", "OPEN_WITH_ACTUAL", "SAME_ORIGIN_DESTINATION", "ZERO_COST", "SHIP_DATE_IN_FUTURE", "ACTUAL_IN_FUTURE")
