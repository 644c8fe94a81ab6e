"""Supply-chain tables projected from the order tables of the test data, and the SQL that says the same."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = date(1998, 7, 1)
#: Bits of a cost in a packed row, and what makes a day's number positive.
COST_BITS, EPOCH_SHIFT = 32, 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").where("n_nationkey < 23")
    cities = nation.select(
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
        F.col("n_name").alias("name"),
        F.lit("city").alias("kind"),
        (F.lit(25.0) + (F.col("n_nationkey") * 7) % 24).alias("lat"),
        (F.lit(-120.0) + (F.col("n_nationkey") * 11) % 50).alias("lon"),
        F.lit(None).cast("long").alias("capacity_units"),
        (F.col("n_nationkey") + 5).cast("int").alias("_ord"),
    )
    parts = read(spark, sf_dir, "part").agg(F.count("*").alias("parts"))
    per_part = F.try_element_at(F.array(*[F.lit(x) for x in (360, 300, 450, 400)]), F.col("w") + 1)
    hubs = parts.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        F.concat(F.lit("WH-"), F.col("w").cast("string")).alias("code"),
        F.concat(F.lit("Hub "), F.col("w").cast("string")).alias("name"),
        F.lit("warehouse").alias("kind"),
        (F.lit(30.0) + F.col("w") * 3.5).alias("lat"),
        (F.lit(-115.0) + F.col("w") * 9.0).alias("lon"),
        (F.col("parts") * per_part).cast("long").alias("capacity_units"),
        F.col("w").cast("int").alias("_ord"),
    )
    return hubs.unionByName(cities)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt to all tasks: the file is so small that a task or two would read it, and make all rows of a part's stock.

    With a number of tasks, for so few bytes would be put together again.
    """
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("p_partkey % 5 <> w")
    return rows.selectExpr(
        "concat('P-', p_partkey) as sku",
        "p_name as product_name",
        "p_type as category",
        "concat('WH-', w) as warehouse",
        "case when (p_partkey + w * 11) % 37 = 0 then 0L else (p_partkey * 37 + w * 101) % 900 end as quantity",
        "(p_partkey * 13 + w * 7) % 300 as reorder_point",
        "cast(floor(p_retailprice * 100 + 0.5) as bigint) as unit_cost_cents",
        "case when (p_partkey + w * 11) % 90 = 0 then null else cast((p_partkey * 7 + w * 29) % 400 as double) / 10.0d end as avg_daily_usage",
        "cast(7 * (1 + p_partkey % 4) as int) as lead_time_days",
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each id; of rows that share an id the first by all other columns."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("s_nation")).distinct()
    customer = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("c_nation"))
    orders = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "c_nation")
    # rows that share an id agree in all that keys decide; status, day and cost decide the rest, packed into one number so
    # that the least of them is a plain hash aggregate. Lines are dealt once, by order and as numbers: orders have their customers'
    # nations before, the aggregate finds its rows where that join left them, and suppliers come to what it keeps
    status = "case when l_partkey % 33 = 0 then 0 when o_orderstatus = 'F' or returned then 1 when o_orderstatus = 'P' then 3 else 2 end"
    cost = "case when l_partkey % 211 = 0 then 0L else cast(8000 + l_quantity * 40 as bigint) * case when l_orderkey % 61 = 0 then 6 else 1 end end"
    dated = f"shiftleft(cast(unix_date(cast(l_shipdate as date)) + {EPOCH_SHIFT} as bigint), {COST_BITS}) + {cost}"
    line = read(spark, sf_dir, "lineitem").selectExpr(*keys, "l_returnflag <> 'N' as returned", f"{dated} as dated")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    once = rows.selectExpr(*keys, "c_nation", f"shiftleft(cast({status} as bigint), 60) + dated as packed").groupBy(*keys, "c_nation").agg(F.min("packed").alias("packed"))
    kept = once.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    out = kept.selectExpr(
        "concat_ws('-', 'SHP', l_orderkey, l_linenumber, l_partkey, l_suppkey) as shipment_id",
        "case when l_orderkey % 173 = 0 then concat('WH-', l_partkey % 5) when l_orderkey % 7 = 0 then concat('  ', lower(s_nation), ' ') else s_nation end as origin",
        "case when l_orderkey % 211 = 0 then concat('Depot ', l_orderkey) else c_nation end as destination",
        "case when l_partkey % 17 = 0 then concat('Spot ', l_partkey % 23) else concat('Carrier ', l_suppkey % 5) end as carrier",
        "element_at(array('cancelled', 'delivered', 'in_transit', 'pending'), cast(shiftright(packed, 60) + 1 as int)) as status",
        f"date_from_unix_date(cast(shiftright(packed, {COST_BITS}) % {1 << 60 - COST_BITS} - {EPOCH_SHIFT} as int)) as ship_date",
        f"packed % {1 << COST_BITS} as shipping_cost_cents",
        "l_orderkey", "l_partkey", "l_suppkey",
    )
    return out.selectExpr(
        "shipment_id", "origin", "destination", "carrier", "status", "ship_date",
        "case when l_orderkey % 97 = 0 then null else date_add(ship_date, cast(3 + l_partkey % 7 as int)) end as estimated_delivery",
        "case when status <> 'cancelled' and ((status = 'delivered' and l_orderkey % 89 <> 0) or l_orderkey % 83 = 0) then date_add(ship_date, cast(l_suppkey % 11 - case when l_partkey % 50 = 0 then 4 else 0 end as int)) end as actual_delivery",
        "shipping_cost_cents",
    )


LOCATIONS_SQL = """locations as (
  select 'WH-' || w as code, 'Hub ' || w as name, 'warehouse' as kind, 30e0 + w * 3.5e0 as lat, -115e0 + w * 9e0 as lon,
    case w when 0 then 360 when 1 then 300 when 2 then 450 when 3 then 400 end * (select count(*) from part) as capacity_units, w as _ord
  from range(5) t(w)
  union all
  select 'N' || lpad(cast(n_nationkey as varchar), 2, '0'), n_name, 'city', 25e0 + (n_nationkey * 7) % 24, -120e0 + (n_nationkey * 11) % 50, null, n_nationkey + 5
  from nation where n_nationkey < 23
), places as (
  select place, arg_min(code, _ord) as code, arg_min(name, _ord) as name, arg_min(lat, _ord) as lat, arg_min(lon, _ord) as lon
  from (select upper(code) as place, * from locations union all select upper(name), * from locations) group by place
)"""

INVENTORY_SQL = LOCATIONS_SQL + """, stock as (
  select 'P-' || p_partkey as sku, p_name as product_name, p_type as category, 'WH-' || w as warehouse,
    case when (p_partkey + w * 11) % 37 = 0 then 0 else (p_partkey * 37 + w * 101) % 900 end as quantity,
    (p_partkey * 13 + w * 7) % 300 as reorder_point,
    cast(floor(p_retailprice * 100 + 0.5e0) as bigint) as unit_cost_cents,
    case when (p_partkey + w * 11) % 90 = 0 then null else cast((p_partkey * 7 + w * 29) % 400 as double) / 10e0 end as avg_daily_usage,
    cast(7 * (1 + p_partkey % 4) as integer) as lead_time_days
  from part, range(5) t(w) where p_partkey % 5 <> w
), supplied as (
  select *, sku || '@' || warehouse as item_id, quantity * unit_cost_cents as value_cents,
    case when quantity = 0 then 'out_of_stock' when quantity <= reorder_point then 'low_stock' else 'in_stock' end as stock_status,
    cast(quantity as double) / nullif(avg_daily_usage, 0) as days_of_supply
  from stock
), inventory as (
  select *, case when quantity = 0 then 'high' when avg_daily_usage is null then 'unknown' when avg_daily_usage = 0 then 'low'
    when days_of_supply < lead_time_days then 'high' when days_of_supply < lead_time_days + 7 then 'medium' else 'low' end as stockout_risk
  from supplied
)"""

SHIPMENTS_SQL = LOCATIONS_SQL + """, lines as (
  select 'SHP-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as shipment_id,
    case when l_orderkey % 173 = 0 then 'WH-' || (l_partkey % 5) when l_orderkey % 7 = 0 then '  ' || lower(sn.n_name) || ' ' else sn.n_name end as origin,
    case when l_orderkey % 211 = 0 then 'Depot ' || l_orderkey else cn.n_name end as destination,
    case when l_partkey % 17 = 0 then 'Spot ' || (l_partkey % 23) else 'Carrier ' || (l_suppkey % 5) end as carrier,
    case when l_partkey % 33 = 0 then 'cancelled' when o_orderstatus = 'F' or l_returnflag <> 'N' then 'delivered' when o_orderstatus = 'P' then 'pending' else 'in_transit' end as status,
    cast(l_shipdate as date) as ship_date, l_orderkey, l_partkey, l_suppkey, l_quantity
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey
    join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey
), dated as (
  select shipment_id, origin, destination, carrier, status, ship_date,
    case when l_orderkey % 97 = 0 then null else ship_date + cast(3 + l_partkey % 7 as integer) end as estimated_delivery,
    case when status <> 'cancelled' and ((status = 'delivered' and l_orderkey % 89 <> 0) or l_orderkey % 83 = 0)
      then ship_date + cast(l_suppkey % 11 - case when l_partkey % 50 = 0 then 4 else 0 end as integer) end as actual_delivery,
    case when l_partkey % 211 = 0 then 0 else cast(8000 + l_quantity * 40 as bigint) * case when l_orderkey % 61 = 0 then 6 else 1 end end as shipping_cost_cents
  from lines
), one as (
  select * from (select *, row_number() over (partition by shipment_id order by origin, destination, carrier, status, ship_date,
    estimated_delivery nulls first, actual_delivery nulls first, shipping_cost_cents) as n from dated) where n = 1
), ended as (
  select one.*, a.code as origin_code, a.name as origin_name, b.code as destination_code, b.name as destination_name,
    a.lat as lat1, a.lon as lon1, b.lat as lat2, b.lon as lon2, upper(trim(origin)) as origin_text, upper(trim(destination)) as destination_text
  from one left join places a on upper(trim(origin)) = a.place left join places b on upper(trim(destination)) = b.place
), routed as (
  select *, coalesce(origin_code, origin_text) || '>' || coalesce(destination_code, destination_text) as route_key,
    coalesce(origin_name, trim(origin)) || ' → ' || coalesce(destination_name, trim(destination)) as route_label,
    case when lat1 is not null and lat2 is not null then floor(7917.6e0 * asin(least(1e0, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))) * 10 + 0.5e0) / 10 end as distance_miles,
    case when status = 'cancelled' then 'cancelled' when actual_delivery < ship_date then 'unknown'
      when status = 'delivered' then case when estimated_delivery is null or actual_delivery is null then 'unknown' when actual_delivery <= estimated_delivery then 'on_time' else 'late' end
      when estimated_delivery is null then 'unknown' when date '1998-07-01' > estimated_delivery then 'overdue' else 'in_progress' end as delivery_state
  from ended
), shipments as (
  select *, case delivery_state when 'late' then actual_delivery - estimated_delivery when 'overdue' then date '1998-07-01' - estimated_delivery end as days_late,
    delivery_state in ('late', 'overdue') as is_delayed,
    case when status = 'delivered' and actual_delivery >= ship_date then actual_delivery - ship_date end as transit_days,
    status <> 'cancelled' and estimated_delivery is null as lacks_estimate, status = 'delivered' and actual_delivery is null as lacks_actual,
    actual_delivery < ship_date as i1, estimated_delivery < ship_date as i2, status in ('pending', 'in_transit') and actual_delivery is not null as i3,
    coalesce(origin_code, origin_text) = coalesce(destination_code, destination_text) as i4, status <> 'cancelled' and shipping_cost_cents = 0 as i5,
    status in ('in_transit', 'delivered') and ship_date > date '1998-07-01' as i6, actual_delivery > date '1998-07-01' as i7
  from routed
)"""

COSTS_SQL = SHIPMENTS_SQL + """, priced as (
  select *, cast(shipping_cost_cents as double) as x, cast(shipping_cost_cents as double) / distance_miles as y from shipments where status <> 'cancelled' and shipping_cost_cents > 0
), rc1 as (select route_key, carrier, count(*) as peers, median(x) as mid from priced group by 1, 2 having count(*) >= 8),
rc as (select p.route_key, p.carrier, any_value(peers) as peers, any_value(mid) as mid, median(abs(x - mid)) as mad, sum(abs(x - mid)) / count(*) as mean_ad
  from priced p join rc1 on p.route_key = rc1.route_key and p.carrier = rc1.carrier group by 1, 2),
r1 as (select route_key, count(*) as peers, median(x) as mid from priced group by 1 having count(*) >= 8),
r as (select p.route_key, any_value(peers) as peers, any_value(mid) as mid, median(abs(x - mid)) as mad, sum(abs(x - mid)) / count(*) as mean_ad
  from priced p join r1 on p.route_key = r1.route_key group by 1),
m1 as (select count(*) as peers, median(y) as mid from priced where distance_miles >= 50),
m as (select any_value(peers) as peers, any_value(mid) as mid, median(abs(y - mid)) as mad, sum(abs(y - mid)) / count(*) as mean_ad from priced, m1 where distance_miles >= 50 and peers >= 8),
chosen as (
  select p.shipment_id, case when rc.peers is not null then 'route_carrier' when r.peers is not null then 'route' when distance_miles >= 50 and m.peers is not null then 'per_mile' else 'none' end as cost_method,
    p.x, p.y, p.distance_miles, rc.peers as p1, rc.mid as a1, rc.mad as b1, rc.mean_ad as c1, r.peers as p2, r.mid as a2, r.mad as b2, r.mean_ad as c2, m.peers as p3, m.mid as a3, m.mad as b3, m.mean_ad as c3
  from priced p left join rc on p.route_key = rc.route_key and p.carrier = rc.carrier left join r on p.route_key = r.route_key left join m on true
), rated as (
  select shipment_id, cost_method, case cost_method when 'per_mile' then y else x end as v, distance_miles,
    case cost_method when 'route_carrier' then p1 when 'route' then p2 when 'per_mile' then p3 end as peers,
    case cost_method when 'route_carrier' then a1 when 'route' then a2 when 'per_mile' then a3 end as mid,
    case cost_method when 'route_carrier' then b1 when 'route' then b2 when 'per_mile' then b3 end as mad,
    case cost_method when 'route_carrier' then c1 when 'route' then c2 when 'per_mile' then c3 end as mean_ad
  from chosen
), scored as (
  select *, case when cost_method = 'none' then null when mad > 0 then 6745e-4 * (v - mid) / mad when mean_ad > 0 then (v - mid) / (1253314e-6 * mean_ad) else 0 end as z from rated
), assessed as (
  select s.*, coalesce(c.cost_method, 'none') as cost_method, cast(coalesce(c.peers, 0) as bigint) as cost_peers,
    cast(floor(case c.cost_method when 'per_mile' then c.mid * c.distance_miles else c.mid end + 0.5e0) as bigint) as baseline_cents,
    cast(floor(z * 100 + 0.5e0) as bigint) as score_hundredths, coalesce(z > 3.5e0 and v >= mid * 1.5e0, false) as is_cost_anomaly
  from shipments s left join scored c on s.shipment_id = c.shipment_id
)"""
