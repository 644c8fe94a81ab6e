"""Transfers between warehouses and the ranked action queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ATTENTION_KINDS, COST_CRITICAL_MULTIPLE, DELAY_CRITICAL_DAYS, QUEUE_ROWS, QUEUE_STOCK_ROWS
from ..functions.numbers import compact_money
from ..functions.text import collated, counted
from ..scratch import written
from .inventory import short_units


def kind_counts(alerts: DataFrame) -> DataFrame:
    """Alerts by attention kind in fixed order; kinds without any are left out."""
    place = F.array_position(F.array(*[F.lit(k) for k in ATTENTION_KINDS]), F.col("kind"))
    return alerts.where("kind is not null").groupBy("kind").agg(F.count("*").alias("alerts")).orderBy(place)


def place_name(locations: DataFrame) -> DataFrame:
    return locations.select(F.col("code").alias("warehouse"), F.regexp_replace("name", " DC$", "").alias("place"))


def transfer_plan(inventory: DataFrame, locations: DataFrame) -> DataFrame:
    """For every item not in stock: units and cents short before a restock, the best donor and what it moves.

    The donor is the other warehouse with the SKU that can give most and keep more than its reorder point, then the
    first by code. Need without usage data is what is missing to the reorder point. A SKU's two best donors are found
    by grouped extremes, so no SKU's rows are ranked against one another.
    """
    give = F.greatest(F.lit(0), F.col("quantity") - F.col("reorder_point") - 1)
    short = inventory.where("stock_status <> 'in_stock'").withColumn("short_units", short_units())
    short = short.withColumn("short_cents", F.col("short_units") * F.col("unit_cost_cents")).withColumn("need", F.coalesce("short_units", F.col("reorder_point") - F.col("quantity")))
    # a short item can give nothing, so it is never its own donor
    donors = inventory.select("sku", F.col("warehouse").alias("donor"), give.alias("can_give")).where("can_give > 0")
    best = donors.groupBy("sku").agg(F.min_by(F.struct("donor", "can_give"), F.struct(-F.col("can_give"), collated(F.col("donor")))).alias("best")).select("sku", "best.*")
    named = place_name(locations)
    out = short.join(best, "sku", "left").join(named.select(F.col("warehouse").alias("donor"), F.col("place").alias("donor_place")), "donor", "left").join(named, "warehouse", "left")
    moved = F.coalesce(F.least("need", "can_give"), F.lit(0))
    number = lambda c: F.format_number(c, 0)
    source = F.coalesce("donor_place", "donor")
    action = (
        F.when(F.col("need") <= 0, "Reorder now")
        .when(F.col("donor").isNull(), F.concat(F.lit("Reorder "), number(F.col("need"))))
        .when(F.col("can_give") >= F.col("need"), F.concat(F.lit("Move "), number(F.col("need")), F.lit(" from "), source))
        .otherwise(F.concat(F.lit("Move "), number(F.col("can_give")), F.lit(" from "), source, F.lit(", reorder "), number(F.col("need") - F.col("can_give"))))
    )
    return out.withColumns({"moved_units": F.when(F.col("need") > 0, moved).otherwise(0), "action": action, "place": F.coalesce("place", "warehouse")})


def stock_candidates(plan: DataFrame) -> DataFrame:
    """Rows of the transfer plan that cost something, as candidates of the queue."""
    days = F.floor(F.coalesce("days_of_supply", F.lit(0.0)))
    out = F.col("stock_status") == "out_of_stock"
    runs_out = F.when(days == 0, F.lit("today")).otherwise(F.concat(F.lit("in "), counted(days, "day", "days")))
    what = F.when(out, F.concat("product_name", F.lit(" is out of stock in "), "place")).otherwise(F.concat("product_name", F.lit(" runs out in "), "place", F.lit(" "), runs_out))
    return plan.where("short_cents > 0").select(
        F.concat(F.lit("stock:"), "item_id").alias("key"), F.when(out, "critical").otherwise("warning").alias("tone"), F.col("short_cents").alias("cents"), F.coalesce("days_of_supply", F.lit(0.0)).alias("days_of_supply"),
        F.lit(1).cast("long").alias("shipments"), F.col("item_id").alias("sort_key"), what.alias("what"), F.concat(compact_money(F.col("short_cents")), F.lit(" short before restock")).alias("damage"), "action",
    )


def no_usage_rows(plan: DataFrame) -> DataFrame:
    """Items out of stock without usage data."""
    rows = plan.where("stock_status = 'out_of_stock' and avg_daily_usage is null")
    return rows.select(F.concat(F.lit("stock:"), "item_id").alias("key"), F.lit("critical").alias("tone"), F.col("item_id").alias("sort_key"), F.concat("product_name", F.lit(" is out of stock in "), "place").alias("what"), F.lit("usage unknown").alias("damage"), "action")


def _over() -> Column:
    return F.col("is_cost_anomaly") & (F.col("baseline_cents") > 0)


def _overbilling(over: Column) -> list[Column]:
    some = lambda c: F.when(over, c)
    critical = F.col("shipping_cost_cents") >= F.col("baseline_cents") * COST_CRITICAL_MULTIPLE
    return [F.sum(some(F.col("shipping_cost_cents") - F.col("baseline_cents"))).alias("cents"), F.count_if(over).alias("shipments"), F.bool_or(some(critical)).alias("critical"), F.min(some(F.col("shipment_id"))).alias("first_id")]


def carrier_overbilling(assessed: DataFrame) -> DataFrame:
    """Carrier, cents above typical over its unusual costs, how many, and whether one is critical."""
    return assessed.where(_over()).groupBy("carrier").agg(*_overbilling(F.lit(True)))


def billing_candidates(overbilling: DataFrame) -> DataFrame:
    on = F.when(F.col("shipments") == 1, F.col("first_id")).otherwise(F.concat(F.format_number("shipments", 0), F.lit(" shipments")))
    return overbilling.select(
        F.concat(F.lit("billing:"), "carrier").alias("key"), F.when(F.col("critical"), "critical").otherwise("warning").alias("tone"), "cents", F.lit(None).cast("double").alias("days_of_supply"), "shipments",
        F.col("carrier").alias("sort_key"), F.concat("carrier", F.lit(" billed "), compact_money(F.col("cents")), F.lit(" above typical on "), on).alias("what"), F.lit(None).cast("string").alias("damage"),
        F.when(F.col("shipments") == 1, "Check the invoice").otherwise("Check the invoices").alias("action"),
    )


def _late() -> Column:
    return (F.col("delivery_state") == "overdue") & (F.col("days_late") >= DELAY_CRITICAL_DAYS)


def _lateness(late: Column) -> list[Column]:
    days, id_ = F.when(late, F.col("days_late")), F.when(late, F.col("shipment_id"))
    return [F.count_if(late).alias("shipments"), F.min(days).alias("min_days"), F.max(days).alias("max_days"), F.min(id_).alias("first_id")]


def _worst_carriers(late: DataFrame) -> DataFrame:
    return late.orderBy(F.desc("shipments"), F.desc("max_days"), collated(F.col("carrier")))


def late_carriers(shipments: DataFrame) -> DataFrame:
    """Carriers with shipments overdue for a week or more, worst first."""
    return _worst_carriers(shipments.where(_late()).groupBy("carrier").agg(*_lateness(F.lit(True))))


def carrier_figures(assessed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``carrier_overbilling`` and ``late_carriers`` of assessed shipments in one pass, which is made here."""
    over, late = _overbilling(_over()), _lateness(_late())
    both = written(assessed.where(_over() | _late()).groupBy("carrier").agg(F.struct(*over).alias("over"), F.struct(*late).alias("late")))
    return both.where("over.shipments > 0").select("carrier", "over.*"), _worst_carriers(both.where("late.shipments > 0").select("carrier", "late.*"))


def late_row(carriers: DataFrame) -> DataFrame:
    number = lambda c: F.format_number(c, 0)
    span = F.when(F.col("min_days") == F.col("max_days"), number("max_days")).otherwise(F.concat(number("min_days"), F.lit(" to "), number("max_days")))
    one = F.concat("carrier", F.lit(": "), "first_id", F.lit(" is "), counted(F.col("max_days"), "day", "days"), F.lit(" late"))
    many = F.concat("carrier", F.lit(" has "), number("shipments"), F.lit(" shipments "), span, F.lit(" days late"))
    only = F.col("shipments") == 1
    return carriers.limit(1).select(F.concat(F.lit("late:"), "carrier").alias("key"), F.lit("critical").alias("tone"), F.when(only, one).otherwise(many).alias("what"), F.when(only, "Ask for a new date").otherwise("Ask for new dates").alias("action"))


def _worst_first() -> list[Column]:
    return [F.desc("cents"), F.when(F.col("tone") == "critical", 0).otherwise(1), F.asc_nulls_last("days_of_supply"), F.desc("shipments"), collated(F.col("sort_key")), F.col("sort_key")]


def action_queue(inventory: DataFrame, assessed: DataFrame, locations: DataFrame) -> DataFrame:
    """At most five rows (rank, key, tone, what, damage, action): money rows by money, at most three of stock while others
    are left; then items out of stock without usage; the worst late carrier last.

    ``assessed`` are enriched shipments with costs. Each part is cut to a few rows before the parts are put together, so ranking them in one place is free.
    """
    plan = written(transfer_plan(inventory, locations))
    columns = ["key", "tone", "cents", "days_of_supply", "shipments", "sort_key", "what", "damage", "action"]
    everyone = Window.orderBy(*_worst_first())
    stock = stock_candidates(plan).orderBy(*_worst_first()).limit(QUEUE_STOCK_ROWS + QUEUE_ROWS).withColumn("n", F.row_number().over(everyone))
    overbilling, carriers = carrier_figures(assessed)
    billing = billing_candidates(overbilling).orderBy(*_worst_first()).limit(QUEUE_ROWS)
    late = written(late_row(carriers))  # no row or one
    room = late.groupBy().agg((F.lit(QUEUE_ROWS) - F.least(F.count("*"), F.lit(1))).alias("room"))
    money = stock.where(F.col("n") <= QUEUE_STOCK_ROWS).select(*columns).unionByName(billing.select(*columns)).withColumn("n", F.row_number().over(everyone)).withColumn("part", F.lit(0))
    idle = no_usage_rows(plan).orderBy(collated(F.col("sort_key")), "sort_key").limit(QUEUE_ROWS).withColumns({"cents": F.lit(None).cast("long"), "days_of_supply": F.lit(None).cast("double"), "shipments": F.lit(None).cast("long")})
    idle = idle.withColumn("n", F.row_number().over(Window.orderBy(collated(F.col("sort_key")), "sort_key"))).withColumn("part", F.lit(1))
    extra = stock.where(F.col("n") > QUEUE_STOCK_ROWS).withColumn("part", F.lit(2))
    parts = money.unionByName(idle.select(*money.columns)).unionByName(extra.select(*money.columns))
    taken = parts.withColumn("turn", F.row_number().over(Window.orderBy("part", "n"))).crossJoin(F.broadcast(room)).where("turn <= room")
    shown = taken.select(*columns, F.when(F.col("part") == 1, 1).otherwise(0).alias("section"))
    last = late.select("key", "tone", F.lit(None).cast("long").alias("cents"), F.lit(None).cast("double").alias("days_of_supply"), F.lit(None).cast("long").alias("shipments"), F.col("key").alias("sort_key"), "what", F.lit(None).cast("string").alias("damage"), "action", F.lit(2).alias("section"))
    rank = F.row_number().over(Window.orderBy("section", *_worst_first()))
    return shown.unionByName(last).withColumn("rank", rank.cast("int")).select("rank", "key", "tone", "cents", "what", "damage", "action")
