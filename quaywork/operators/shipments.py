"""Enrichment of shipment rows and the assessment of their costs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAD_SCALE, MEAN_AD_SCALE, MIN_MILES, MIN_PEERS, MIN_RATIO, Z_THRESHOLD
from ..functions.dates import day_text
from ..functions.numbers import half_up, miles
from ..functions.text import place_key, trimmed
from ..scratch import written


#: Rows of a table that is broadcast, at most.
MOST_SENT = 10_000
#: And of the table of lanes, whose rows are some 100 bytes.
MOST_LANES = 100_000


def sent_if_few(rows: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``rows``, marked for broadcast if there are no more than ``most``; they are counted for that."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def location_keys(locations: DataFrame) -> DataFrame:
    """One row for each text that names a location (its code or its name, upper case): first location by ``_ord``.

    So a lookup by code or name is an equi-join.
    """
    named = locations.select(F.explode(F.array(F.upper("code"), F.upper("name"))).alias("place"), "code", "name", "lat", "lon", "_ord")
    first = F.min_by(F.struct("code", "name", "lat", "lon"), "_ord").alias("at")
    return named.groupBy("place").agg(first).select("place", "at.*")


def _at(keys: DataFrame, end: str) -> DataFrame:
    return keys.select(*[F.col(c).alias(f"{end}_{c}") for c in ("place", "code", "name", "lat", "lon")])


def located(shipments: DataFrame, locations: DataFrame) -> DataFrame:
    """Adds both ends' codes and names, route_key, route_label and distance_miles.

    Texts that name locations are broadcast if they are few, else this is a keyed join.
    """
    keys = sent_if_few(location_keys(locations))
    out = shipments.withColumns({f"{end}_text": place_key(F.col(end)) for end in ("origin", "destination")})
    for end in ("origin", "destination"):
        at = _at(keys, end)
        out = out.join(at, F.col(f"{end}_text") == F.col(f"{end}_place"), "left").drop(f"{end}_place")
    key = F.concat_ws(">", F.coalesce("origin_code", "origin_text"), F.coalesce("destination_code", "destination_text"))
    label = F.concat_ws(" → ", F.coalesce("origin_name", trimmed(F.col("origin"))), F.coalesce("destination_name", trimmed(F.col("destination"))))
    distance = miles(F.col("origin_lat"), F.col("origin_lon"), F.col("destination_lat"), F.col("destination_lon"))
    return out.withColumns({"route_key": key, "route_label": label, "distance_miles": distance})


def issue_conditions(today: date) -> dict[str, Column]:
    """What makes each data issue, in reporting order."""
    ship, eta, actual, status = (F.col(c) for c in ("ship_date", "estimated_delivery", "actual_delivery", "status"))
    start, end = F.coalesce("origin_code", "origin_text"), F.coalesce("destination_code", "destination_text")
    return {
        "ACTUAL_BEFORE_SHIP": actual < ship,
        "ETA_BEFORE_SHIP": eta < ship,
        "OPEN_WITH_ACTUAL": status.isin("pending", "in_transit") & actual.isNotNull(),
        "SAME_ORIGIN_DESTINATION": start == end,
        "ZERO_COST": (status != "cancelled") & (F.col("shipping_cost_cents") == 0),
        "SHIP_DATE_IN_FUTURE": status.isin("in_transit", "delivered") & (ship > F.lit(today)),
        "ACTUAL_IN_FUTURE": actual > F.lit(today),
    }


def _issue_messages() -> dict[str, Column]:
    ship, eta, actual = (day_text(F.col(c)) for c in ("ship_date", "estimated_delivery", "actual_delivery"))
    label = F.when(F.col("status") == "in_transit", "in transit").otherwise(F.lower("status"))
    place = F.coalesce("origin_code", "origin_text")
    lit = F.lit
    return {
        "ACTUAL_BEFORE_SHIP": F.concat(lit("Actual delivery "), actual, lit(" is before ship date "), ship, lit(".")),
        "ETA_BEFORE_SHIP": F.concat(lit("Estimated delivery "), eta, lit(" is before ship date "), ship, lit(".")),
        "OPEN_WITH_ACTUAL": F.concat(lit("Status is "), label, lit(" but an actual delivery date ("), actual, lit(") is recorded.")),
        "SAME_ORIGIN_DESTINATION": F.concat(lit("Origin and destination are the same ("), place, lit(").")),
        "ZERO_COST": F.concat(lit("Shipping cost is $0.00 for a "), label, lit(" shipment.")),
        "SHIP_DATE_IN_FUTURE": F.concat(lit("Ship date "), ship, lit(" is in the future for a "), label, lit(" shipment.")),
        "ACTUAL_IN_FUTURE": F.concat(lit("Actual delivery "), actual, lit(" is in the future.")),
    }


def data_issues(today: date, texts: bool = True) -> Column:
    """Array of (code, message), in order; messages are null without ``texts``."""
    said = _issue_messages() if texts else dict.fromkeys(issue_conditions(today), F.lit(None).cast("string"))
    return F.array_compact(F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), said[code].alias("message"))) for code, when in issue_conditions(today).items()]))


def delivery_state(today: date) -> Column:
    status, ship, eta, actual = (F.col(c) for c in ("status", "ship_date", "estimated_delivery", "actual_delivery"))
    return (
        F.when(status == "cancelled", "cancelled")
        .when(actual < ship, "unknown")
        .when(status == "delivered", F.when(eta.isNull() | actual.isNull(), "unknown").when(actual <= eta, "on_time").otherwise("late"))
        .when(eta.isNull(), "unknown")
        .when(F.lit(today) > eta, "overdue")
        .otherwise("in_progress")
    )


def enrich_shipments(shipments: DataFrame, locations: DataFrame, today: date) -> DataFrame:
    """Adds the route, the distance, delivery state, lateness, transit days, missing dates and data issues of each row."""
    return with_states(located(shipments, locations), today)


def with_states(placed: DataFrame, today: date, texts: bool = True) -> DataFrame:
    """What ``enrich_shipments`` adds to located rows; cheap enough to be worked out where it is read rather than written."""
    state, eta, actual = F.col("delivery_state"), F.col("estimated_delivery"), F.col("actual_delivery")
    late = F.when(state == "late", F.datediff(actual, eta)).when(state == "overdue", F.datediff(F.lit(today), eta))
    missing = F.array_compact(F.array(F.when((F.col("status") != "cancelled") & eta.isNull(), F.lit("estimated_delivery")), F.when((F.col("status") == "delivered") & actual.isNull(), F.lit("actual_delivery"))))
    transit = F.when((F.col("status") == "delivered") & (actual >= F.col("ship_date")), F.datediff(actual, F.col("ship_date")))
    out = placed.withColumn("delivery_state", delivery_state(today))
    return out.withColumns({"days_late": late, "is_delayed": state.isin("late", "overdue"), "transit_days": transit, "missing_dates": missing, "issues": data_issues(today, texts)})


def _score(x: Column, mid: Column, mad: Column, mean_ad: Column) -> Column:
    """Modified z-score; by the mean deviation where the median one is 0, and 0 where both are."""
    return F.when(mad > 0, F.lit(MAD_SCALE) * (x - mid) / mad).when(mean_ad > 0, (x - mid) / (F.lit(MEAN_AD_SCALE) * mean_ad)).otherwise(0.0)


def grouped_medians(values: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """``by``, mid and peers of every group with ``least`` values or more; ``values``: v (0 or more), each c times.

    Sums by bins of the logarithm tell which bins hold a group's middle ranks, and only those bins' values are put in order. So
    a task sees a group's bins (some tens of thousands) or one bin's different values, never a whole group.
    """
    binned = values.withColumn("bin", F.when(F.col("v") > 0, F.floor(F.log2("v") * 1024)).otherwise(-(1 << 40)))
    totals = binned.groupBy(*by, "bin").agg(F.sum("c").alias("n"))
    group = Window.partitionBy(*by)
    ranked = totals.withColumn("upto", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group)).where(F.col("total") >= least)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = ranked.withColumn("before", F.col("upto") - F.col("n")).where(((F.col("before") < low) & (low <= F.col("upto"))) | ((F.col("before") < high) & (high <= F.col("upto"))))
    inside = binned.join(middle.select(*by, "bin", "before", "total"), [*by, "bin"])
    own = Window.partitionBy(*by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("at", F.col("before") + F.sum("c").over(own))
    hit = lambda rank: F.min(F.when(F.col("at") >= rank, F.col("v")))
    return placed.groupBy(*by).agg(((hit(low) + hit(high)) / 2.0).alias("mid"), F.max("total").alias("peers"))


def peer_statistics(counted: DataFrame, by: list[str]) -> DataFrame:
    """``by``, peers, mid, mad and mean_ad of every group of ``MIN_PEERS`` values or more: median, median and mean deviation.

    ``counted``: a written table of values v and how often each occurs in its group, c.
    """
    mids = grouped_medians(counted, by, MIN_PEERS)
    apart = written(counted.join(mids, by).select(*by, F.abs(F.col("v") - F.col("mid")).alias("v"), "c", "mid", "peers"))
    whole = apart.groupBy(*by).agg(F.first("peers").alias("peers"), F.first("mid").alias("mid"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean_ad"))
    return whole.join(grouped_medians(apart.select(*by, "v", "c"), by).select(*by, F.col("mid").alias("mad")), by)


def cost_statistics(shipments: DataFrame) -> tuple[DataFrame, tuple | None]:
    """Statistics of costs by route and carrier: route_key, carrier, rc_… and r_…, a table of those that have any; and (peers, mid, mad, mean_ad) of costs per
    mile over all, None if they are too few.

    One pass over the shipments counts equal costs of each route and carrier; routes and the pool add those counts up, and
    all groups of the three kinds are worked on together.
    """
    priced = (F.col("status") != "cancelled") & (F.col("shipping_cost_cents") > 0)
    cost, none = F.col("shipping_cost_cents").cast("double"), F.lit("")
    costs = shipments.where(priced).groupBy("route_key", F.coalesce("carrier", none).alias("carrier"), "shipping_cost_cents", "distance_miles").agg(F.count("*").alias("c"))
    per_mile = F.when(F.col("distance_miles") >= MIN_MILES, cost / F.col("distance_miles"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), route.alias("route_key"), carrier.alias("carrier"), v.alias("v")) for kind, route, carrier, v in (("rc", F.col("route_key"), F.col("carrier"), cost), ("r", F.col("route_key"), none, cost), ("m", none, none, per_mile))])
    by = ["kind", "route_key", "carrier"]
    counted = written(costs.select("c", F.inline(kinds)).where("v is not null").groupBy(*by, "v").agg(F.sum("c").alias("c")))
    found = written(peer_statistics(counted, by))
    figures = ("peers", "mid", "mad", "mean_ad")
    one = found.where("kind = 'm'").select(*figures).first()
    lanes = counted.where("kind = 'rc'").select("route_key", "carrier").distinct()
    close = found.where("kind = 'rc'").select("route_key", "carrier", *[F.col(c).alias(f"rc_{c}") for c in figures])
    route = found.where("kind = 'r'").select("route_key", *[F.col(c).alias(f"r_{c}") for c in figures])
    known = lanes.join(close, ["route_key", "carrier"], "left").join(route, "route_key", "left").where("rc_peers is not null or r_peers is not null")
    return written(known), one and tuple(one)


def assess_costs(shipments: DataFrame) -> DataFrame:
    """Adds cost_method, cost_peers, baseline_cents, cost_score and is_cost_anomaly to enriched shipments.

    Peers are the shipments of the same route and carrier, else of the route, else all of 50 miles or more by cost per
    mile, with eight at least, the row itself included; cancelled and free ones have no peers and are none. An anomaly
    has a score over 3.5 and 1.5 times the median, both unrounded; what is shown is rounded. The statistics are worked out, and
    written, when this is called.
    """
    cost = F.col("shipping_cost_cents").cast("double")
    priced = (F.col("status") != "cancelled") & (F.col("shipping_cost_cents") > 0)
    far = F.col("distance_miles") >= MIN_MILES
    per_mile = cost / F.col("distance_miles")
    lanes, pool = cost_statistics(shipments)
    keyed = sent_if_few(lanes, MOST_LANES).withColumnsRenamed({"route_key": "of_route", "carrier": "of_carrier"})
    out = shipments.join(keyed, (F.col("route_key") == F.col("of_route")) & (F.coalesce("carrier", F.lit("")) == F.col("of_carrier")), "left").drop("of_route", "of_carrier")
    figures = dict(zip(("peers", "mid", "mad", "mean_ad"), pool or (None,) * 4, strict=True))
    out = out.withColumns({f"m_{c}": F.when(far, F.lit(v)).cast("long" if c == "peers" else "double") for c, v in figures.items()})
    method = F.when(~priced, "none").when(F.col("rc_peers") >= MIN_PEERS, "route_carrier").when(F.col("r_peers") >= MIN_PEERS, "route").when(F.col("m_peers").isNotNull(), "per_mile").otherwise("none")
    out = out.withColumn("cost_method", method)

    def of(column: str) -> Column:
        return F.when(F.col("cost_method") == "route_carrier", F.col(f"rc_{column}")).when(F.col("cost_method") == "route", F.col(f"r_{column}")).when(F.col("cost_method") == "per_mile", F.col(f"m_{column}"))

    by_mile = F.col("cost_method") == "per_mile"
    some = F.col("cost_method") != "none"
    x = F.when(by_mile, per_mile).otherwise(cost)
    raw = F.when(some, _score(x, of("mid"), of("mad"), of("mean_ad")))
    baseline = F.when(some, half_up(F.when(by_mile, of("mid") * F.col("distance_miles")).otherwise(of("mid")))).cast("long")
    out = out.withColumns({
        "cost_peers": F.coalesce(of("peers"), F.lit(0)).cast("long"),
        "baseline_cents": baseline,
        "cost_score": half_up(raw * 100) / 100,
        "is_cost_anomaly": F.coalesce((raw > Z_THRESHOLD) & (x >= of("mid") * MIN_RATIO), F.lit(False)),
    })
    return out.drop(*[f"{g}_{c}" for g in ("rc", "r", "m") for c in ("peers", "mid", "mad", "mean_ad")])
