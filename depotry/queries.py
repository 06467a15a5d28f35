"""Registered queries of the facility-location operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotry import schema
from depotry.functions.geo import haversine, mulberry, to_plane
from depotry.operators import assign, auction, bounds, capacity, cost, exact, interchange, mapping, medians, solve
from depotry.plans import whatif
from depotry.schema import ORDER_KM, RUPEE, Config
from depotry.sources import export, points, samples, tables
from depotry.storage import new_folder
from depotry.streaming.demand import demand_by_window
from depotry.streaming.loads import window_loads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CONFIG = Config()
RATE = CONFIG.rate_per_km


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


# --- SQL pieces for the other engine -------------------------------------------------------------

def _km(a: str, b: str, c: str, d: str, radius: float = 6371.0088, arc: str = "asin") -> str:
    h = f"(sin(radians({c}-{a})/2)*sin(radians({c}-{a})/2)+cos(radians({a}))*cos(radians({c}))*sin(radians({d}-{b})/2)*sin(radians({d}-{b})/2))"
    return f"{2 * radius}e0*asin(least(1e0,sqrt({h})))" if arc == "asin" else f"{radius}e0*(2e0*atan2(sqrt({h}),sqrt(1e0-{h})))"


def _spot(key: str) -> str:
    return f"12.8e0+({key}*37%101)/250.0e0 AS lat, 77.4e0+({key}*53%97)/220.0e0 AS lon"


NATIONS = f"pts AS (SELECT 'nations' AS dataset, CAST(c_nationkey AS BIGINT) AS ord, 'N'||c_nationkey AS id, {_spot('c_nationkey')}, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey)"
CUSTOMERS = f"pts AS (SELECT 'customers' AS dataset, CAST(c_custkey AS BIGINT) AS ord, 'C'||c_custkey AS id, {_spot('c_custkey')}, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"
FIVE = f"sites AS (SELECT 'nations' AS dataset, 5 AS k, i AS wh_ord, 'W'||(i+1) AS wh_id, {_spot('(i*5+1)')} FROM range(5) t(i))"
_PAIRS = f"pairs AS (SELECT p.*, s.wh_ord, s.wh_id, s.lat AS wh_lat, s.lon AS wh_lon, {_km('p.lat', 'p.lon', 's.lat', 's.lon')} AS dist_km FROM pts p JOIN sites s ON p.dataset = s.dataset)"
_NEAR = "near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, ord ORDER BY dist_km, wh_ord) AS rn FROM pairs) WHERE rn = 1)"
BASE = f"WITH {NATIONS}, {FIVE}, {_PAIRS}, {_NEAR}"
_TRIPS = "CAST(ceil(greatest(orders, 0) / 25e0) AS BIGINT)"
PRICED = f"""priced AS (SELECT *, dist_km*1.32e0 AS road_km, {_TRIPS} AS trips FROM near), costed AS (SELECT *, 2e0*road_km*trips AS vehicle_km, 2e0*road_km*trips/(34e0/1.25e0) AS hours,
 2e0*road_km*trips*(0.02e0*111e0+0.9e0) AS fuel, 2e0*road_km*trips/(34e0/1.25e0)*120e0 AS driver FROM priced)"""
WEIGHTED = f"w AS (SELECT *, 2e0*{_TRIPS}*1.32e0*{RATE!r}e0 AS weight FROM pts)".replace("e0e0", "e0")


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return tables.nation_points(spark, d)


def _near(spark: SparkSession, d: str) -> DataFrame:
    return assign.nearest(_nations(spark, d), tables.five_sites(spark))


# --- distances and assignment ------------------------------------------------------------------

@query(f"WITH {NATIONS} SELECT a.ord AS i, b.ord AS j, round({_km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km FROM pts a JOIN pts b ON a.dataset = b.dataset")
def haversine_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exact.distance_matrix(_nations(spark, d)).drop("dataset"), "km", places=6)


@query(f"{BASE} SELECT id, orders, wh_id, round(dist_km, 6) AS dist_km FROM near")
def nearest_assign(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_near(spark, d).select("id", "orders", "wh_id", "dist_km"), "dist_km", places=6)


@query(f"WITH {CUSTOMERS}, sites AS (SELECT 'customers' AS dataset, s_suppkey AS wh_ord, 'S'||s_suppkey AS wh_id, {_spot('s_suppkey')} FROM supplier), {_PAIRS}, {_NEAR} SELECT ord, wh_id, round(dist_km, 6) AS dist_km FROM near")
def nearest_supplier(spark: SparkSession, d: str) -> DataFrame:
    """Nearest of many sites, by the widening grid."""
    return rounded(assign.nearest_of_many(tables.customer_points(spark, d), tables.supplier_sites(spark, d)).select("ord", "wh_id", "dist_km"), "dist_km", places=6)


@query(f"WITH {NATIONS}, {FIVE}, {_PAIRS} SELECT id, wh_id, CAST(row_number() OVER (PARTITION BY ord ORDER BY dist_km, wh_ord) AS INTEGER) AS rank FROM pairs")
def site_ranking(spark: SparkSession, d: str) -> DataFrame:
    return assign.ranked_sites(_nations(spark, d), tables.five_sites(spark)).select("id", "wh_id", "rank")


@query(f"{BASE} SELECT s.wh_id, CAST(coalesce(sum(n.orders), 0) AS BIGINT) AS load FROM sites s LEFT JOIN near n ON n.wh_id = s.wh_id GROUP BY s.wh_id")
def load_by_site(spark: SparkSession, d: str) -> DataFrame:
    return assign.loads(_near(spark, d), tables.five_sites(spark)).select("wh_id", "load")


@query(f"{BASE}, l AS (SELECT s.wh_id, s.wh_ord, coalesce(sum(n.orders), 0) AS load FROM sites s LEFT JOIN near n ON n.wh_id = s.wh_id GROUP BY 1, 2) SELECT wh_id, CAST(load AS BIGINT) AS load, 'W'||row_number() OVER (ORDER BY load DESC, wh_ord) AS label FROM l")
def relabel_by_load(spark: SparkSession, d: str) -> DataFrame:
    sites = tables.five_sites(spark)
    return assign.relabel(assign.loads(assign.nearest(_nations(spark, d), sites), sites), sites).select("wh_id", "load", "label")


@query(f"{BASE} SELECT round(sum(orders*dist_km), 4) AS cost FROM near")
def weighted_cost(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cost.weighted_cost(_near(spark, d)).drop("dataset"), "cost")


@query(f"{BASE} SELECT count(*) AS unknown FROM near WHERE wh_id NOT IN (SELECT wh_id FROM sites)")
def assigned_to_known(spark: SparkSession, d: str) -> DataFrame:
    return assign.unknown_sites(_near(spark, d), tables.five_sites(spark)).agg(F.count(F.lit(1)).alias("unknown"))


@query(f"{BASE} SELECT id, wh_id, round(dist_km*1.32e0, 4) AS road_km FROM near WHERE dist_km*1.32e0 > 5")
def radius_flags(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.out_of_radius(_near(spark, d), 5.0, 1.32).select("id", "wh_id", (F.col("dist_km") * 1.32).alias("road_km")), "road_km")


@query(f"{BASE}, l AS (SELECT wh_id, sum(orders) AS load FROM near GROUP BY 1) SELECT 'nations' AS dataset, coalesce(string_agg(wh_id, ',' ORDER BY wh_id) FILTER (WHERE load > 3000), '') AS over_capacity FROM l")
def capacity_overflow(spark: SparkSession, d: str) -> DataFrame:
    sites = tables.five_sites(spark)
    over = assign.over_capacity(assign.loads(assign.nearest(_nations(spark, d), sites), sites), 3000)
    return over.select("dataset", F.array_join("over_capacity", ",").alias("over_capacity"))


@query(f"""WITH RECURSIVE {NATIONS}, {FIVE}, {_PAIRS},
o AS (SELECT *, row_number() OVER (ORDER BY orders DESC, ord) AS turn FROM pts),
step AS (SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS wh_id, CAST(NULL AS DOUBLE) AS dist_km, list_transform(range(5), lambda i: CAST(3200 AS BIGINT)) AS room
 UNION ALL
 SELECT o.turn, o.id, c.wh_id, c.dist_km, list_transform(step.room, lambda r, i: CASE WHEN i = c.wh_ord + 1 THEN r - o.orders ELSE r END)
 FROM step JOIN o ON o.turn = step.turn + 1,
 LATERAL (SELECT p.wh_id, p.wh_ord, p.dist_km FROM pairs p WHERE p.ord = o.ord ORDER BY step.room[p.wh_ord + 1] >= o.orders DESC, p.dist_km, p.wh_ord LIMIT 1) c)
SELECT id, wh_id, round(dist_km, 6) AS dist_km FROM step WHERE turn > 0""")
def greedy_capacity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.greedy_capacity(_nations(spark, d), tables.five_sites(spark), 3200).select("id", "wh_id", "dist_km"), "dist_km", places=6)


def _room(pts: DataFrame, sites: DataFrame) -> int:
    """A tenth more than an even share of all orders: what every site takes in the queries with capacities."""
    total, n = pts.agg(F.sum("orders")).first()[0] or 0, sites.count()
    return max(1, -(-total * 11 // (10 * max(n, 1))))


SUPPLIERS = f"sites AS (SELECT 'customers' AS dataset, s_suppkey AS wh_ord, 'S'||s_suppkey AS wh_id, {_spot('s_suppkey')}, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier)"


@query(f"""WITH RECURSIVE {CUSTOMERS}, {SUPPLIERS}, cap AS (SELECT CAST(ceil(sum(orders) * 11 / (10.0 * (SELECT count(*) FROM sites))) AS BIGINT) AS cap FROM pts),
pairs AS MATERIALIZED (SELECT p.ord, list(s.place ORDER BY {_km('p.lat', 'p.lon', 's.lat', 's.lon')}, s.wh_ord) AS near FROM pts p JOIN sites s ON p.dataset = s.dataset GROUP BY p.ord),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p.orders DESC, p.ord) AS turn, p.ord, p.orders, q.near FROM pts p JOIN pairs q ON q.ord = p.ord),
step AS (SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS pick, (SELECT list_transform(range((SELECT count(*) FROM sites)), lambda i: cap) FROM cap) AS room
 UNION ALL
 SELECT c.turn, c.ord, c.pick, list_transform(c.room, lambda r, i: CASE WHEN i = c.pick THEN r - c.orders ELSE r END)
 FROM (SELECT o.turn, o.ord, o.orders, step.room, coalesce(list_filter(o.near, lambda s: step.room[s] >= o.orders)[1], o.near[1]) AS pick FROM step JOIN o ON o.turn = step.turn + 1) c)
SELECT step.ord, s.wh_id FROM step JOIN sites s ON s.place = step.pick""")
def greedy_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """All customers to all suppliers, which take a tenth more than an even share."""
    pts, sites = tables.customer_points(spark, d), tables.supplier_sites(spark, d)
    return assign.greedy_of_many(pts, sites, _room(pts, sites)).select("ord", "wh_id")


def _auction_sql(turns: int, eps: float) -> str:
    out = "st0 AS (SELECT ord, id, orders, CAST(NULL AS BIGINT) AS site, CAST(NULL AS DOUBLE) AS level FROM pts), pr0 AS (SELECT wh_ord, 0e0 AS price FROM sites)"
    for i in range(turns):
        out += f""", v{i} AS (SELECT t.ord, p.wh_ord, r.price, row_number() OVER w AS rn, lead(p.dist_km + r.price) OVER w - (p.dist_km + r.price) AS more FROM st{i} t JOIN pairs p ON p.ord = t.ord JOIN pr{i} r ON r.wh_ord = p.wh_ord WHERE t.site IS NULL WINDOW w AS (PARTITION BY t.ord ORDER BY p.dist_km + r.price, p.wh_ord)),
b{i} AS (SELECT t.ord, t.id, t.orders, coalesce(t.site, v.wh_ord) AS site, coalesce(t.level, v.price + coalesce(v.more, 0e0) + {eps}e0) AS level FROM st{i} t LEFT JOIN v{i} v ON v.ord = t.ord AND v.rn = 1),
k{i} AS MATERIALIZED (SELECT *, sum(orders) OVER (PARTITION BY site ORDER BY level DESC, ord) > (SELECT cap FROM cap) AS no FROM b{i}),
st{i + 1} AS MATERIALIZED (SELECT ord, id, orders, CASE WHEN NOT no THEN site END AS site, CASE WHEN NOT no THEN level END AS level FROM k{i}),
pr{i + 1} AS MATERIALIZED (SELECT r.wh_ord, greatest(r.price, coalesce(max(k.level), r.price)) AS price FROM pr{i} r LEFT JOIN k{i} k ON k.site = r.wh_ord AND k.no GROUP BY r.wh_ord, r.price)"""
    return out


@query(f"""WITH {NATIONS}, {FIVE}, {_PAIRS}, cap AS (SELECT CAST(ceil(sum(orders) * 11 / 50.0) AS BIGINT) AS cap FROM pts), {_auction_sql(4, 0.5)}
SELECT t.id, 'W'||(t.site + 1) AS wh_id, round(t.level, 6) AS level, round(r.price, 6) AS price FROM st4 t LEFT JOIN pr4 r ON r.wh_ord = t.site""")
def auction_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Four rounds of bids of the nations for five sites: who holds a place, at which bid and price."""
    pts, sites = _nations(spark, d), tables.five_sites(spark)
    room = _room(pts, sites)
    state, prices = auction.opened(pts, sites, RUPEE)
    for _ in range(4):
        state, prices = auction.bid_round(state, prices, room, 0.5)
    held = state.join(prices, "dataset").select("id", F.concat(F.lit("W"), (F.col("site") + 1).cast("string")).alias("wh_id"), "level", F.get("prices", F.col("site")).alias("price"))
    return rounded(held, "level", "price", places=6)


@query()
def auction_plan(spark: SparkSession, d: str) -> DataFrame:
    """Nations to five sites by auction, moves and exchanges: cost, proven bound, overload."""
    pts, sites = _nations(spark, d), tables.five_sites(spark)
    return rounded(auction.auction(pts, sites, _room(pts, sites), eps=(1.0,))[1], "cost", "bound", "gap_pct")


# --- pricing -----------------------------------------------------------------------------------

_PRICES = [(90.0, 100.0), (111.0, 120.0), (140.0, 300.0)]
_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}e0" if isinstance(x, float) else str(x) for x in v) + ")" for v in schema.VEHICLES)


@query(f"""WITH v AS (SELECT * FROM (VALUES {_ROWS}) t(vehicle, label, capacity, fuel_per_km, speed, upkeep, co2, energy)), t AS (SELECT * FROM (VALUES ('free', 1.0e0), ('light', 1.25e0), ('peak', 1.85e0), ('gridlock', 2.6e0)) t(traffic, congestion)),
p AS (SELECT * FROM (VALUES (90e0, 100e0), (111e0, 120e0), (140e0, 300e0)) t(fuel_price, driver_wage))
SELECT vehicle, traffic, fuel_price, driver_wage, round(coalesce(CAST(energy AS DOUBLE), fuel_per_km*fuel_price) + upkeep + driver_wage/(speed/congestion), 6) AS rate_per_km FROM v, t, p""")
def rate_grid(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame(_PRICES, "fuel_price double, driver_wage double")
    return rounded(cost.rate_grid(schema.vehicles(spark), schema.traffic(spark), prices).select("vehicle", "traffic", "fuel_price", "driver_wage", "rate_per_km"), "rate_per_km", places=6)


@query(f"WITH {NATIONS}, {WEIGHTED} SELECT id, round(weight, 4) AS weight FROM w")
def cost_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cost.cost_weight(_nations(spark, d), CONFIG).select("id", "weight"), "weight")


@query(f"{BASE}, {PRICED} SELECT id, wh_id, round(road_km, 4) AS road_km, trips, round(vehicle_km, 4) AS vehicle_km, round(hours, 4) AS hours, round(fuel, 4) AS fuel, round(driver, 4) AS driver, round(fuel+driver, 4) AS total, road_km <= 6 AS within_radius FROM costed")
def row_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = cost.row_cost(_near(spark, d), CONFIG.with_(max_radius_km=6.0))
    return rounded(rows.select("id", "wh_id", "road_km", "trips", "vehicle_km", "hours", "fuel", "driver", "total", "within_radius"), "road_km", "vehicle_km", "hours", "fuel", "driver", "total")


@query(f"""{BASE}, {PRICED}, s AS (SELECT sum(fuel) AS fuel, sum(driver) AS driver, sum(fuel+driver) AS delivery, sum(vehicle_km) AS vehicle_km, sum(hours) AS driver_hours, sum(orders*dist_km) AS order_km FROM costed)
SELECT round(fuel, 3) AS fuel, round(driver, 3) AS driver, round(delivery, 3) AS delivery, round(vehicle_km, 3) AS vehicle_km, round(driver_hours, 3) AS driver_hours, round(order_km, 3) AS order_km, 5*2500e0 AS infrastructure, round(delivery+12500e0, 3) AS total FROM s""")
def cost_breakdown(spark: SparkSession, d: str) -> DataFrame:
    out = cost.breakdown(cost.row_cost(_near(spark, d), CONFIG), tables.five_sites(spark), CONFIG).drop("dataset")
    return rounded(out, "fuel", "driver", "delivery", "vehicle_km", "driver_hours", "order_km", "total", places=3)


@query(f"""{BASE}, {PRICED}, a AS (SELECT sum(vehicle_km) AS km, sum(fuel+driver)+12500e0 AS total FROM costed),
one AS (SELECT p.*, {_km('p.lat', 'p.lon', 's.lat', 's.lon')} AS dist_km FROM pts p JOIN sites s ON s.wh_ord = 0), b AS (SELECT sum(2e0*dist_km*1.32e0*{_TRIPS}) AS km, sum(2e0*dist_km*1.32e0*{_TRIPS})*{RATE!r}e0+2500e0 AS total FROM one)
SELECT round(greatest(0, b.total-a.total)*365, 2) AS saved_per_year, round(a.km*46e0/1000, 4) AS co2_kg_per_day, round(greatest(0, b.km-a.km)*46e0/1000*365/1000, 6) AS co2_t_saved_per_year FROM a, b""")
def impact(spark: SparkSession, d: str) -> DataFrame:
    pts, sites = _nations(spark, d), tables.five_sites(spark)
    plan = cost.breakdown(cost.row_cost(assign.nearest(pts, sites), CONFIG), sites, CONFIG)
    base = cost.breakdown(cost.row_cost(assign.nearest(pts, sites.where("wh_ord = 0")), CONFIG), sites.where("wh_ord = 0"), CONFIG).select("dataset", F.col("total").alias("base_total"), F.col("vehicle_km").alias("base_vehicle_km"))
    out = cost.impact(plan.join(base, "dataset"), CONFIG)
    return out.select(F.round("saved_per_year", 2).alias("saved_per_year"), F.round("co2_kg_per_day", 4).alias("co2_kg_per_day"), F.round("co2_t_saved_per_year", 6).alias("co2_t_saved_per_year"))


@query(f"WITH {NATIONS} SELECT round(sum(lat*orders)/sum(orders), 9) AS lat_weighted, round(sum(lon*orders)/sum(orders), 9) AS lon_weighted, round(avg(lat), 9) AS lat_centre, round(avg(lon), 9) AS lon_centre, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, count(*) AS n, CAST(sum(orders) AS BIGINT) AS orders_total, max(orders) AS orders_max, min(orders) AS orders_min, round(avg(orders), 6) AS orders_mean FROM pts")
def centroid_bbox(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(cost.centroids(_nations(spark, d)).drop("dataset"), "lat_weighted", "lon_weighted", "lat_centre", "lon_centre", places=9)
    return rounded(out, "orders_mean", places=6)


# --- exact placement ---------------------------------------------------------------------------

def _pmedian_sql(k: int) -> str:
    joins = "".join(f" JOIN pts p{i} ON p{i}.ord > p{i - 1}.ord" for i in range(2, k + 1))
    keys = ", ".join(f"p{i}.ord AS s{i}" for i in range(1, k + 1))
    least = "least(" + ", ".join(f"km{i}" for i in range(1, k + 1)) + ")" if k > 1 else "km1"
    km = " ".join(f"JOIN (SELECT i, j, km AS km{i} FROM m) m{i} ON m{i}.i = s.s{i} AND m{i}.j = q.ord" for i in range(1, k + 1))
    cols = ", ".join(f"s.s{i}" for i in range(1, k + 1))
    return f"""WITH {NATIONS}, {WEIGHTED}, m AS (SELECT a.ord AS i, b.ord AS j, {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM pts a, pts b), s AS (SELECT {keys} FROM pts p1{joins}),
t AS (SELECT {cols}, sum(q.weight*{least}) AS objective FROM s CROSS JOIN w q {km} GROUP BY {cols})
SELECT '[' || (SELECT concat_ws(',', {", ".join(f"s{i}" for i in range(1, k + 1))}) FROM t ORDER BY round(objective, 9), {", ".join(f"s{i}" for i in range(1, k + 1))} LIMIT 1) || ']' AS sites, round(min(objective), 4) AS objective, count(*) AS evaluated FROM t"""


def _pmedian(k: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        best = exact.pmedian(cost.cost_weight(_nations(spark, d), CONFIG), k, "weight")
        return best.select(F.concat(F.lit("["), F.array_join(F.col("sites").cast("array<string>"), ","), F.lit("]")).alias("sites"), F.round("objective", 4).alias("objective"), "evaluated")

    run.__name__ = f"pmedian_k{k}"
    return run


for _k in (1, 2, 3, 4):
    query(_pmedian_sql(_k))(_pmedian(_k))


@query(f"""WITH {NATIONS}, {WEIGHTED}, m AS (SELECT a.ord AS i, b.ord AS j, {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM pts a, pts b),
c1 AS (SELECT m.i, sum(q.weight*m.km) AS c FROM m JOIN w q ON q.ord = m.j GROUP BY 1), c2 AS (SELECT a.ord AS s1, b.ord AS s2, sum(q.weight*least(x.km, y.km)) AS c FROM pts a JOIN pts b ON a.ord < b.ord CROSS JOIN w q JOIN m x ON x.i = a.ord AND x.j = q.ord JOIN m y ON y.i = b.ord AND y.j = q.ord GROUP BY 1, 2)
SELECT 1 AS k, round(min(c), 3) AS delivery, round(min(c)+2500e0, 3) AS total, CAST(0 AS DOUBLE) AS improvement_pct FROM c1
UNION ALL SELECT 2, round(min(c), 3), round(min(c)+5000e0, 3), round(100e0*((SELECT min(c) FROM c1)+2500e0-(min(c)+5000e0))/((SELECT min(c) FROM c1)+2500e0), 6) FROM c2""")
def plan_k2(spark: SparkSession, d: str) -> DataFrame:
    """Best one and best two sites among the nations, points assigned and priced: the whole slice end to end."""
    pts = cost.cost_weight(_nations(spark, d), CONFIG)
    plans = None
    for k in (1, 2):
        sites = exact.sites_of(pts, exact.pmedian(pts, k, "weight"))
        one = cost.breakdown(cost.row_cost(assign.nearest(pts, sites), CONFIG), sites, CONFIG).select(F.lit(k).alias("k"), "delivery", "total")
        plans = one if plans is None else plans.unionByName(one)
    base = F.first("total").over(Window.partitionBy(F.lit(1)).orderBy("k"))
    return rounded(plans.withColumn("improvement_pct", F.round(cost.improvement_pct(base, F.col("total")), 6)), "delivery", "total", places=3)


@query(f"""WITH {NATIONS}, {FIVE}, g AS (SELECT -2e0+4e0*i/20e0 AS v FROM range(21) t(i)), s3 AS (SELECT * FROM sites WHERE wh_ord < 3),
pr AS (SELECT s.wh_ord, a.v AS y, b.v AS x, s.lat+a.v/(radians(1e0)*6371.0088e0) AS plat, s.lon+b.v/(radians(1e0)*6371.0088e0*cos(radians(s.lat))) AS plon FROM s3 s, g a, g b),
rest AS (SELECT p.ord, s.wh_ord, p.lat, p.lon, p.orders, min({_km('p.lat', 'p.lon', 'o.lat', 'o.lon')}) AS km FROM pts p, s3 s JOIN s3 o ON o.wh_ord <> s.wh_ord GROUP BY ALL),
c AS (SELECT pr.wh_ord, pr.x, pr.y, sum(r.orders*least(r.km, {_km('r.lat', 'r.lon', 'pr.plat', 'pr.plon')})) AS c FROM pr JOIN rest r ON r.wh_ord = pr.wh_ord GROUP BY 1, 2, 3),
now AS (SELECT sum(orders*d) AS o FROM (SELECT p.ord, p.orders, min({_km('p.lat', 'p.lon', 's.lat', 's.lon')}) AS d FROM pts p, s3 s GROUP BY 1, 2))
SELECT count(*) AS probes, round((SELECT o FROM now), 4) AS objective, round(min(c), 4) AS best_probe, 100*((SELECT o FROM now)-min(c))/(SELECT o FROM now) <= 1e-7 AS is_local_optimum FROM c""")
def local_certificate(spark: SparkSession, d: str) -> DataFrame:
    out = exact.certificate(_nations(spark, d), tables.five_sites(spark).where("wh_ord < 3"), "orders")
    return rounded(out.select("probes", "objective", "best_probe", "is_local_optimum"), "objective", "best_probe")


@query(f"""WITH {NATIONS}, b AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM pts), g AS (SELECT i, s+(n-s)*(i//6)/5e0 AS lat, w+(e-w)*(i%6)/5e0 AS lon FROM b, range(36) t(i)),
t AS (SELECT a.i AS s1, c.i AS s2, sum(p.orders*least({_km('p.lat', 'p.lon', 'a.lat', 'a.lon')}, {_km('p.lat', 'p.lon', 'c.lat', 'c.lon')})) AS o FROM g a JOIN g c ON a.i < c.i, pts p GROUP BY 1, 2) SELECT round(min(o), 4) AS objective, count(*) AS evaluated FROM t""")
def lattice_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exact.lattice(_nations(spark, d), 2, 6).select("objective", "evaluated"), "objective")


def _swaps_sql(turns: int) -> str:
    """Exchanges worked out the long way: the objective of every plan that one exchange leads to."""
    out = "z0 AS MATERIALIZED (SELECT wh_ord, lat, lon FROM sites)"
    for i in range(turns):
        d = _km("p.lat", "p.lon", "s.lat", "s.lon")
        out += f""", e{i} AS (SELECT p.ord, p.orders, s.wh_ord, {d} AS km FROM pts p, z{i} s), r{i} AS MATERIALIZED (SELECT a.ord, a.orders, a.wh_ord AS gone, min(b.km) AS km FROM e{i} a JOIN e{i} b ON b.ord = a.ord AND b.wh_ord <> a.wh_ord GROUP BY 1, 2, 3),
n{i} AS (SELECT sum(orders * km) AS c FROM (SELECT ord, orders, min(km) AS km FROM e{i} GROUP BY 1, 2)),
t{i} AS (SELECT c.ord AS cand, r.gone, sum(r.orders * least(r.km, {_km('p.lat', 'p.lon', 'c.lat', 'c.lon')})) AS c FROM r{i} r JOIN pts p ON p.ord = r.ord CROSS JOIN pts c GROUP BY 1, 2),
b{i} AS MATERIALIZED (SELECT * FROM t{i} WHERE c < (SELECT c * (1 - 1e-9) FROM n{i}) ORDER BY round((SELECT c FROM n{i}) - c, 9) DESC, cand, gone LIMIT 1),
z{i + 1} AS MATERIALIZED (SELECT z.wh_ord, coalesce(p.lat, z.lat) AS lat, coalesce(p.lon, z.lon) AS lon FROM z{i} z LEFT JOIN b{i} b ON b.gone = z.wh_ord LEFT JOIN pts p ON p.ord = b.cand)"""
    return out


def _own_candidates(pts: DataFrame) -> DataFrame:
    return pts.select("dataset", F.col("ord").alias("cand_ord"), "lat", "lon")


@query(f"WITH {NATIONS}, {FIVE}, {_swaps_sql(3)} SELECT wh_ord, round(lat, 9) AS lat, round(lon, 9) AS lon FROM z3")
def interchange_steps(spark: SparkSession, d: str) -> DataFrame:
    """Five sites of the nations after the three best exchanges with nations."""
    pts = _nations(spark, d)
    sites, _ = interchange.interchange(pts, tables.five_sites(spark), _own_candidates(pts), swaps=3)
    return rounded(sites.select("wh_ord", "lat", "lon"), "lat", "lon", places=9)


@query()
def interchange_customers(spark: SparkSession, d: str) -> DataFrame:
    """Four of the suppliers' places for all customers, exchanged until none helps."""
    pts, sup = tables.customer_points(spark, d), tables.supplier_sites(spark, d)
    sites, made = interchange.interchange(pts, sup.where("wh_ord BETWEEN 1 AND 4"), sup.select("dataset", F.col("wh_ord").alias("cand_ord"), "lat", "lon"))
    return rounded(cost.weighted_cost(assign.nearest(pts, sites)).withColumn("exchanges", F.lit(made)), "cost")


@query()
def placement_customers(spark: SparkSession, d: str) -> DataFrame:
    """Four sites anywhere for all customers: the driver loop's plan, improved by exchanges."""
    sites, total = interchange.place(tables.customer_points(spark, d), 4)
    return rounded(sites.withColumn("objective", F.lit(total)), "lat", "lon", "objective")


def _prices_sql(turns: int, k: int) -> str:
    out = f"m AS MATERIALIZED (SELECT a.ord AS i, b.ord AS j, a.orders AS w, {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM pts a, pts b), l0 AS (SELECT i, w, w * list(km ORDER BY km)[least(count(*), greatest(1, count(*) // {2 * k}) + 1)] AS price, 0e0 AS drift FROM m GROUP BY 1, 2)"
    for t in range(turns):
        out += f""", r{t} AS (SELECT m.j, sum(least(0e0, m.w * m.km - l.price)) AS worth FROM m JOIN l{t} l ON l.i = m.i GROUP BY 1), s{t} AS MATERIALIZED (SELECT j, worth FROM r{t} ORDER BY round(worth, 9), j LIMIT {k}),
g{t} AS MATERIALIZED (SELECT l.i, l.w, l.price, 1 - count(*) FILTER (WHERE m.w * m.km < l.price) + l.drift / 2 AS s, l.w * min(m.km) AS c FROM l{t} l JOIN m ON m.i = l.i JOIN s{t} s ON s.j = m.j GROUP BY l.i, l.w, l.price, l.drift),
q{t} AS MATERIALIZED (SELECT sum(price) + (SELECT sum(worth) FROM s{t}) AS low, sum(c) AS high, sum(s * s) AS ss FROM g{t}),
l{t + 1} AS MATERIALIZED (SELECT i, w, greatest(0e0, price + CASE WHEN ss > 0 THEN (high - low) / ss ELSE 0e0 END * s) AS price, s AS drift FROM g{t}, q{t})"""
    return out


@query(f"WITH {NATIONS}, {_prices_sql(3, 4)} SELECT (SELECT string_agg(j, ',' ORDER BY j) FROM s2) AS sites, round(low, 4) AS low, round(high, 4) AS high FROM q2")
def price_steps(spark: SparkSession, d: str) -> DataFrame:
    """Bounds on the best four of the nations at the third prices."""
    pts = _nations(spark, d)
    own, told = _own_candidates(pts), None
    state = bounds.priced(pts, own, 4)
    for _ in range(3):
        state, told = bounds.price_step(state, own, 4, 1.0)
    return rounded(told.select(F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"), "low", "high"), "low", "high")


_ALL_FOUR = _pmedian_sql(4).replace(f"WITH {NATIONS}, {WEIGHTED}, ", f"WITH {NATIONS}, w AS (SELECT *, orders AS weight FROM pts), ").split("\nSELECT '['")[0]


@query(f"{_ALL_FOUR} SELECT TRUE AS low_holds, TRUE AS high_holds, round(min(objective), 4) AS objective FROM t")
def price_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The best four of the nations by enumeration, and whether the bounds from prices hold it."""
    pts = _nations(spark, d)
    best = exact.pmedian(pts, 4).select("dataset", "objective")
    held = bounds.relaxed_pmedian(pts, _own_candidates(pts), 4, steps=6).join(best, "dataset")
    return held.select((F.col("low") <= F.col("objective") + 1e-6).alias("low_holds"), (F.col("high") >= F.col("objective") - 1e-6).alias("high_holds"), F.round("objective", 4).alias("objective"))


@query()
def price_bounds_customers(spark: SparkSession, d: str) -> DataFrame:
    """Bounds on the best four of all suppliers' places for all customers, without enumeration."""
    pts, sup = tables.customer_points(spark, d), tables.supplier_sites(spark, d)
    told = bounds.relaxed_pmedian(pts, sup.select("dataset", F.col("wh_ord").alias("cand_ord"), "lat", "lon"), 4, steps=20)
    return rounded(told.select(F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"), "low", "high", "gap"), "low", "high", "gap")


@query(f"""WITH RECURSIVE {CUSTOMERS}, it AS (SELECT 0 AS n, (SELECT sum(orders * lat) / sum(orders) FROM pts) AS a, (SELECT sum(orders * lon) / sum(orders) FROM pts) AS b
 UNION ALL SELECT it.n + 1, x.a, x.b FROM it, LATERAL (SELECT sum(p.orders * p.lat / greatest({_km('p.lat', 'p.lon', 'it.a', 'it.b')}, 1e-9)) / sum(p.orders / greatest({_km('p.lat', 'p.lon', 'it.a', 'it.b')}, 1e-9)) AS a, sum(p.orders * p.lon / greatest({_km('p.lat', 'p.lon', 'it.a', 'it.b')}, 1e-9)) / sum(p.orders / greatest({_km('p.lat', 'p.lon', 'it.a', 'it.b')}, 1e-9)) AS b FROM pts p) x WHERE it.n < 80)
SELECT round(sum(p.orders * {_km('p.lat', 'p.lon', 'it.a', 'it.b')}), 0) AS objective, TRUE AS proven FROM pts p, it WHERE it.n = 80""")
def single_site_customers(spark: SparkSession, d: str) -> DataFrame:
    """The best place for one site for all customers, proven to a millionth."""
    return rounded(bounds.single_site(tables.customer_points(spark, d)).select("objective", "proven"), "objective", places=0)


@query()
def medians_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Medians of the customers of every nation, all at once."""
    nation = tables.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("ord"), F.col("c_nationkey").cast("string").alias("nation"))
    return rounded(medians.geometric_medians(tables.customer_points(spark, d).join(nation, "ord"), ("nation",)), "lat", "lon", places=7)


# --- what-if -----------------------------------------------------------------------------------

@query(f"""WITH {NATIONS}, c AS (SELECT avg(lat) AS a, avg(lon) AS b FROM pts), f AS (SELECT p.*, {_km('p.lat', 'p.lon', 'c.a', 'c.b')} AS d FROM pts p, c), s AS (SELECT * FROM (VALUES ('today', 1.0e0, 0e0), ('growth', 1.4e0, 0e0), ('sprawl', 1.35e0, 0.9e0), ('infill', 1.3e0, -0.7e0), ('downturn', 0.75e0, 0e0)) t(variant, growth, bias))
SELECT variant, id, CAST(CASE WHEN growth = 1 AND bias = 0 THEN orders ELSE greatest(0, round(orders*greatest(0e0, growth*(1+0.5e0*(bias*(d/(SELECT greatest(max(d), 1e-9) FROM f)-0.5e0)*2))))) END AS BIGINT) AS orders FROM f, s""")
def demand_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return whatif.demand_scenarios(_nations(spark, d), schema.scenarios(spark)).select("variant", "id", "orders")


def _mulberry_sql(seed: int, turn: str) -> str:
    m, h = "4294967295", "65535"

    def times(a: str, b: str) -> str:
        return f"((({a})*(({b})&{h})+(((({a})*(({b})>>16))&{h})<<16))&{m})"

    return f"""t0 AS (SELECT *, ({seed}+({turn})*1831565813)&{m} AS t FROM base), t1 AS (SELECT *, {times('xor(t,t>>15)', '(t|1)')} AS u FROM t0), t2 AS (SELECT *, {times('xor(u,u>>7)', '(u|61)')} AS q FROM t1),
t3 AS (SELECT *, xor(u,(u+q)&{m}) AS v FROM t2), draws AS (SELECT *, (xor(v,v>>14)&{m})/4294967296e0 AS r FROM t3)"""


@query(f"""WITH {NATIONS}, base AS (SELECT trial, id, orders, row_number() OVER (PARTITION BY trial ORDER BY ord) AS i, count(*) OVER (PARTITION BY trial) AS n FROM pts, range(16) x(trial)), {_mulberry_sql(20260920, 'trial*n+i')}
SELECT CAST(trial AS VARCHAR) AS variant, id, CAST(greatest(0, round(orders*(1+(2*r-1)*0.3e0))) AS BIGINT) AS orders FROM draws""")
def demand_perturb(spark: SparkSession, d: str) -> DataFrame:
    return whatif.perturbed(_nations(spark, d), 16, 0.3, 20260920).select("variant", "id", "orders")


@query(f"WITH base AS (SELECT i FROM range(1, 2001) x(i)), {_mulberry_sql(7, 'i')} SELECT i, r FROM draws")
def random_draws(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 2001).select(F.col("id").alias("i"), mulberry(7, F.col("id")).alias("r"))


@query(f"""WITH {NATIONS}, base AS (SELECT ord AS i, id, orders FROM pts), s AS (SELECT *, sum(orders) OVER (ORDER BY i) AS upto, sum(orders) OVER () AS total FROM base)
SELECT id, CAST(upto AS BIGINT) AS upto FROM s WHERE upto >= 0.37e0*total ORDER BY i LIMIT 1""")
def roulette_pick(spark: SparkSession, d: str) -> DataFrame:
    """The point where a running sum of weights passes a share of the total."""
    return solve.roulette(_nations(spark, d), 0.37).select("id", "upto")


def _discrete_sweep(spark: SparkSession, d: str) -> DataFrame:
    pts = _nations(spark, d).cache()
    out = None
    for k in (1, 2, 3):
        one = exact.pmedian(pts, k).select("dataset", F.lit(k).alias("k"), F.col("objective").alias("cost"))
        out = one if out is None else out.unionByName(one)
    return out


_SWEEP = ", ".join(f"r{k} AS ({_pmedian_sql(k)})".replace(f"WITH {NATIONS}, {WEIGHTED}, ", f"WITH {NATIONS}, w AS (SELECT *, orders AS weight FROM pts), ").replace("round(min(objective), 4)", "min(objective)") for k in (1, 2, 3))
_CURVE = f"WITH {_SWEEP}, curve AS (SELECT 1 AS k, objective AS cost FROM r1 UNION ALL SELECT 2, objective FROM r2 UNION ALL SELECT 3, objective FROM r3)"


@query(f"{_CURVE} SELECT k, round(cost, 4) AS cost, round(100*(lag(cost) OVER (ORDER BY k)-cost)/lag(cost) OVER (ORDER BY k), 6) AS saving_vs_prev_pct FROM curve")
def k_sweep_discrete(spark: SparkSession, d: str) -> DataFrame:
    out = whatif.saving_vs_previous(_discrete_sweep(spark, d))
    return rounded(rounded(out.drop("dataset"), "cost"), "saving_vs_prev_pct", places=6)


@query(f"{_CURVE}, e AS (SELECT k, (1-(k-1)/2e0)-(cost-(SELECT cost FROM curve WHERE k = 3))/((SELECT cost FROM curve WHERE k = 1)-(SELECT cost FROM curve WHERE k = 3)) AS gap FROM curve) SELECT k FROM e ORDER BY round(gap, 12) DESC, k LIMIT 1")
def elbow(spark: SparkSession, d: str) -> DataFrame:
    return whatif.elbow(_discrete_sweep(spark, d)).select("k")


@query(f"{_CURVE} SELECT k, round(cost+2500e0*k*20, 4) AS total FROM curve ORDER BY cost+2500e0*k*20, k LIMIT 1")
def optimal_k(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest K with rent, at a rent that makes the optimum an inner one."""
    s = _discrete_sweep(spark, d).withColumn("total", F.col("cost") + 2500.0 * F.col("k") * 20)
    return rounded(s.groupBy("dataset").agg(F.min(F.struct("total", "k")).alias("b")).select("b.k", "b.total"), "total")


def _steps_sql(turns: int) -> str:
    out = "m0 AS (SELECT sum(orders*lat)/sum(orders) AS a, sum(orders*lon)/sum(orders) AS b FROM pts)"
    for i in range(turns):
        out += f", q{i} AS (SELECT p.*, orders/greatest({_km('p.lat', 'p.lon', 'm.a', 'm.b')}, 1e-9) AS pull FROM pts p, m{i} m), m{i + 1} AS (SELECT sum(pull*lat)/sum(pull) AS a, sum(pull*lon)/sum(pull) AS b FROM q{i})"
    return out


@query(f"WITH {NATIONS}, {_steps_sql(6)} SELECT round(a, 8) AS lat, round(b, 8) AS lon FROM m6")
def weiszfeld_fixed_iters(spark: SparkSession, d: str) -> DataFrame:
    return rounded(solve.median_steps(_nations(spark, d).cache(), 6).drop("dataset"), "lat", "lon", places=8)


def _means_sql(turns: int) -> str:
    out = "s0 AS (SELECT wh_ord, wh_id, lat, lon FROM sites WHERE wh_ord < 3)"
    for i in range(turns):
        out += f""", n{i} AS (SELECT * FROM (SELECT p.*, s.wh_ord, row_number() OVER (PARTITION BY p.ord ORDER BY {_km('p.lat', 'p.lon', 's.lat', 's.lon')}, s.wh_ord) AS rn FROM pts p, s{i} s) WHERE rn = 1),
s{i + 1} AS (SELECT s.wh_ord, s.wh_id, coalesce(sum(n.orders*n.lat)/sum(n.orders), any_value(s.lat)) AS lat, coalesce(sum(n.orders*n.lon)/sum(n.orders), any_value(s.lon)) AS lon FROM s{i} s LEFT JOIN n{i} n ON n.wh_ord = s.wh_ord GROUP BY 1, 2)"""
    return out


@query(f"WITH {NATIONS}, {FIVE}, {_means_sql(4)} SELECT wh_id, round(lat, 8) AS lat, round(lon, 8) AS lon FROM s4")
def kmeans_fixed_iters(spark: SparkSession, d: str) -> DataFrame:
    out = solve.means_steps(_nations(spark, d).cache(), tables.five_sites(spark).where("wh_ord < 3"), 4)
    return rounded(out.select("wh_id", "lat", "lon"), "lat", "lon", places=8)


@query(f"WITH {NATIONS}, c AS (SELECT avg(lat) AS a, avg(lon) AS b FROM pts), f AS (SELECT id, {_km('p.lat', 'p.lon', 'c.a', 'c.b')} AS km FROM pts p, c) SELECT id, round(km, 6) AS km FROM f ORDER BY km DESC, id LIMIT 1")
def farthest_point(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cost.farthest(_nations(spark, d)).select("id", "km"), "km", places=6)


@query(f"{BASE} SELECT count(DISTINCT wh_id) AS used FROM near")
def sites_used(spark: SparkSession, d: str) -> DataFrame:
    return assign.used_sites(_near(spark, d)).select("used")


@query(f"WITH v AS (SELECT * FROM (VALUES {_ROWS}) t(vehicle, label, capacity, fuel, speed, upkeep, co2, energy)) SELECT vehicle, round(co2/nullif(fuel, 0), 6) AS grams_per_litre, CASE WHEN fuel > 0 THEN abs(co2-fuel*2310) <= 3 OR abs(co2-fuel*2680) <= 3 END AS consistent FROM v")
def co2_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whatif.co2_matches_fuel(schema.vehicles(spark)), "grams_per_litre", places=6)


@query(f"{_CURVE} SELECT CAST(count(*) FILTER (WHERE cost > before) AS BIGINT) AS rising FROM (SELECT cost, lag(cost) OVER (ORDER BY k) AS before FROM curve)")
def monotone_cost(spark: SparkSession, d: str) -> DataFrame:
    return whatif.rising_steps(_discrete_sweep(spark, d), value="cost").agg(F.count(F.lit(1)).alias("rising"))


# --- ingest ------------------------------------------------------------------------------------

_DIRTY = """raw AS (SELECT CAST(p_partkey AS BIGINT) AS line_no,
 CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN NULL ELSE ' P'||p_partkey END AS id,
 CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'north' WHEN p_partkey % 23 = 0 THEN '12,'||(p_partkey % 100 + 100) WHEN p_partkey % 13 = 0 THEN '12.'||(p_partkey % 100 + 100)||'°' ELSE '12.'||(p_partkey % 100 + 100) END AS lat,
 CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE '77.'||(p_partkey % 90 + 100) END AS lon,
 CASE WHEN p_partkey % 7 = 0 THEN '1,'||(p_partkey % 900 + 100) WHEN p_partkey % 11 = 0 THEN '3.5' WHEN p_partkey % 41 = 0 THEN '12.0' ELSE CAST(p_partkey % 500 AS VARCHAR) END AS orders FROM part)"""


def _float_sql(c: str) -> str:
    return f"try_cast(CASE WHEN len(string_split(replace(trim({c}), '°', ''), ',')) = 2 AND NOT contains({c}, '.') THEN replace(replace(trim({c}), '°', ''), ',', '.') ELSE replace(replace(trim({c}), '°', ''), ',', '') END AS DOUBLE)"


_COERCED = f"""typed AS (SELECT line_no, trim(id) AS id, {_float_sql('lat')} AS lat, {_float_sql('lon')} AS lon, try_cast(replace(replace(trim(orders), ',', ''), '_', '') AS DOUBLE) AS o, id AS rid, lat AS rlat, lon AS rlon, orders AS ro FROM raw)"""


@query(f"WITH {_DIRTY}, {_COERCED} SELECT line_no AS ord, id, lat, lon, CAST(o AS BIGINT) AS orders FROM typed WHERE id <> '' AND lat IS NOT NULL AND lon IS NOT NULL AND o = floor(o)")
def coerce_rows(spark: SparkSession, d: str) -> DataFrame:
    return points.good_and_bad(points.coerce(tables.dirty_points(spark, d)))[0].drop("dataset")


@query(f"""WITH {_DIRTY}, {_COERCED}, e AS (SELECT line_no, unnest([
 CASE WHEN rid IS NULL THEN '''id'' is missing.' WHEN trim(rid) = '' THEN '''id'' is empty.' END,
 CASE WHEN rlat IS NULL THEN '''lat'' is missing.' WHEN trim(rlat) = '' THEN '''lat'' is empty.' WHEN lat IS NULL THEN '''lat'' is not a number (got "'||rlat||'").' END,
 CASE WHEN rlon IS NULL THEN '''lon'' is missing.' WHEN trim(rlon) = '' THEN '''lon'' is empty.' WHEN lon IS NULL THEN '''lon'' is not a number (got "'||rlon||'").' END,
 CASE WHEN o IS NULL THEN '''orders'' is not a number (got "'||ro||'").' WHEN o <> floor(o) THEN '''orders'' must be a whole number of orders (got "'||ro||'").' END]) AS m FROM typed)
SELECT line_no, 'Row '||line_no||': '||m AS error FROM e WHERE m IS NOT NULL""")
def ingest_errors(spark: SparkSession, d: str) -> DataFrame:
    return points.good_and_bad(points.coerce(tables.dirty_points(spark, d)))[1].drop("dataset")


def _uploaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The dirty rows written as a folder of CSV files under other headers, and read as an upload."""
    at, dirty = new_folder(spark), tables.dirty_points(spark, d)
    named = dirty.select(F.col("id").alias("Locality"), F.lit("x;y").alias("Manager"), F.col("lon").alias("Lng"), F.col("lat").alias(" Latitude "), F.col("orders").alias("Daily-Orders"))
    named.repartition(3).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(at)
    return points.read_folder(spark, at)


@query(f"WITH {_DIRTY}, {_COERCED} SELECT id, lat, lon, CAST(o AS BIGINT) AS orders FROM typed WHERE id <> '' AND lat IS NOT NULL AND lon IS NOT NULL AND o = floor(o)")
def csv_upload(spark: SparkSession, d: str) -> DataFrame:
    """Points of an uploaded folder of CSV files."""
    return _uploaded(spark, d)[0].select("id", "lat", "lon", "orders")


@query(f"""WITH {_DIRTY}, {_COERCED}, e AS (SELECT line_no, unnest([CASE WHEN coalesce(trim(rid), '') = '' THEN 'id' END, CASE WHEN lat IS NULL THEN 'lat' END, CASE WHEN lon IS NULL THEN 'lon' END, CASE WHEN o IS NULL OR o <> floor(o) THEN 'orders' END]) AS field FROM typed)
SELECT field, count(*) AS errors FROM e WHERE field IS NOT NULL GROUP BY 1""")
def csv_upload_errors(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of the upload are refused for each field."""
    return _uploaded(spark, d)[1].groupBy(F.regexp_extract("error", "'([a-z]+)'", 1).alias("field")).agg(F.count(F.lit(1)).alias("errors"))


_ODD = "odd AS (SELECT CAST(p_partkey AS BIGINT) AS ord, CASE WHEN p_partkey % 29 = 0 THEN ' ' ELSE 'P'||(p_partkey % 700) END AS id, CASE WHEN p_partkey % 17 = 0 THEN 120e0 ELSE 12e0 END AS lat, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 77e0 END AS lon, p_partkey % 50 - 1 AS orders FROM part)"


@query(f"""WITH {_ODD}, f AS (SELECT *, min(ord) OVER (PARTITION BY id) AS first FROM odd), e AS (SELECT ord, unnest([CASE WHEN trim(id) = '' THEN 'id is blank' END, CASE WHEN first < ord THEN 'id repeats row '||first END, CASE WHEN NOT (lat BETWEEN -90 AND 90) THEN 'lat is not in -90..90' END,
 CASE WHEN lon IS NULL THEN 'lon is not in -180..180' END, CASE WHEN orders < 0 THEN 'orders is not a whole number of 0 or more' END]) AS error FROM f) SELECT * FROM e WHERE error IS NOT NULL""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    return points.validate(_odd(spark, d)).drop("dataset")


def _odd(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    return tables.table(spark, d, "part").select(F.lit("p").alias("dataset"), k.alias("ord"), F.when(k % 29 == 0, " ").otherwise(F.concat(F.lit("P"), (k % 700).cast("string"))).alias("id"), F.when(k % 17 == 0, 120.0).otherwise(12.0).alias("lat"), F.when(k % 19 == 0, None).otherwise(F.lit(77.0)).alias("lon"), (k % 50 - 1).alias("orders"))


_HEADERS = [(0, "Locality"), (1, " Latitude "), (2, "X_Coord"), (3, "Daily-Orders"), (4, "Manager"), (5, "y"), (6, "lng")]
_HEADER_ROWS = ", ".join(f"({i}, '{h}')" for i, h in _HEADERS)
_ALIAS_ROWS = ", ".join(f"('{a}', '{f}')" for a, f in mapping.ALIASES.items())
_MAPPED = f"h AS (SELECT * FROM (VALUES {_HEADER_ROWS}) t(col_ord, header)), a AS (SELECT * FROM (VALUES {_ALIAS_ROWS}) t(alias, field)), m AS (SELECT h.col_ord, h.header AS source_column, a.field, row_number() OVER (PARTITION BY a.field ORDER BY h.col_ord) AS rn FROM h JOIN a ON a.alias = regexp_replace(lower(trim(h.header)), '[\\s_\\-.]', '', 'g'))"


def _headers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_HEADERS, "col_ord int, header string")


@query(f"WITH {_MAPPED} SELECT source_column, field FROM m WHERE rn = 1")
def alias_map(spark: SparkSession, d: str) -> DataFrame:
    return mapping.alias_mapping(_headers(spark)).select("source_column", "field")


@query(f"WITH {_MAPPED} SELECT f AS field FROM (VALUES ('id'), ('lat'), ('lon'), ('orders')) t(f) WHERE f NOT IN (SELECT field FROM m WHERE col_ord > 2)")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return mapping.missing_fields(spark, mapping.alias_mapping(_headers(spark).where("col_ord > 2"))).select("field")


@query("""WITH h AS (SELECT * FROM (VALUES ('a,b,c'), ('a;b,c;d'), ('a|b|c'), ('one'), ('a' || chr(9) || 'b'), ('a,b;c')) t(header)), d AS (SELECT * FROM (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) t(place, sep))
SELECT header, sep FROM (SELECT *, row_number() OVER (PARTITION BY header ORDER BY len(string_split(header, sep)) DESC, place) AS rn FROM h, d) WHERE rn = 1""")
def delimiters(spark: SparkSession, d: str) -> DataFrame:
    heads = spark.createDataFrame([("a,b,c",), ("a;b,c;d",), ("a|b|c",), ("one",), ("a\tb",), ("a,b;c",)], "header string")
    return heads.select("header", points.delimiter(F.col("header")).alias("sep"))


@query(f"WITH {NATIONS} SELECT id FROM pts WHERE (lat, lon) NOT IN (SELECT (lat, lon) FROM pts WHERE ord % 4 = 0)")
def unseeded_points(spark: SparkSession, d: str) -> DataFrame:
    pts = _nations(spark, d)
    return assign.unseeded(pts, pts.where("ord % 4 = 0")).select("id")


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y*y)))) AS v FROM u)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.v, b.v), 6) AS score FROM n a JOIN n b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of consecutive vectors, as the score of unit vectors."""
    v = tables.table(spark, d, "embeddings")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = v.select("vec_id", length.alias("_l"), "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("_l")).alias("v"))
    other = unit.select(F.col("vec_id").alias("b"), F.col("v").alias("w"), (F.col("vec_id") - 1).alias("vec_id"))
    return unit.join(other, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(mapping.cosine(F.col("v"), F.col("w")), 6).alias("score"))


@query("""WITH c AS (SELECT 0 AS col_ord, CAST(p_partkey AS VARCHAR) AS value FROM part UNION ALL SELECT 1, p_name FROM part UNION ALL SELECT 2, '12.'||p_partkey FROM part UNION ALL SELECT 3, '-'||p_size FROM part),
x AS (SELECT col_ord, try_cast(replace(trim(value), ',', '') AS DOUBLE) AS x FROM c WHERE trim(value) <> '') SELECT col_ord, count(*) AS n, round(avg(CAST(x IS NOT NULL AS INTEGER)), 6) AS numeric_share, min(x) AS low, max(x) AS high, bool_and(x = floor(x)) AS whole FROM x GROUP BY 1""")
def value_evidence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mapping.value_evidence(_part_cells(spark, d)), "numeric_share", places=6)


def _part_cells(spark: SparkSession, d: str) -> DataFrame:
    part = tables.table(spark, d, "part")
    cells = [F.col("p_partkey").cast("string"), F.col("p_name"), F.concat(F.lit("12."), F.col("p_partkey").cast("string")), F.concat(F.lit("-"), F.col("p_size").cast("string"))]
    return part.select(F.posexplode(F.array(*cells)).alias("col_ord", "value"))


# --- output ------------------------------------------------------------------------------------

@query(f"""{BASE}, l AS (SELECT s.wh_id, CAST(coalesce(sum(n.orders), 0) AS BIGINT) AS load FROM sites s LEFT JOIN near n ON n.wh_id = s.wh_id GROUP BY 1)
SELECT 'warehouse' AS type, s.wh_id AS id, round(s.lat, 6) AS lat, round(s.lon, 6) AS lon, l.load AS orders_per_day, NULL AS assigned_to, CAST(NULL AS DOUBLE) AS distance_km FROM sites s JOIN l ON l.wh_id = s.wh_id
UNION ALL SELECT 'area', id, lat, lon, orders, wh_id, round(dist_km, 3) FROM near""")
def plan_export(spark: SparkSession, d: str) -> DataFrame:
    sites = tables.five_sites(spark)
    near = assign.nearest(_nations(spark, d), sites)
    return export.plan_rows(near, sites, assign.loads(near, sites)).drop("dataset")


@query(f"""{BASE} SELECT id, wh_id, round(5+13*sqrt(orders/CAST((SELECT max(orders) FROM near) AS DOUBLE)), 3) AS radius, dist_km > 8 AS out_of_radius FROM near""")
def geojson_properties(spark: SparkSession, d: str) -> DataFrame:
    """Features read back, so that two writers of JSON can be compared."""
    back = F.from_json("feature", "properties struct<id string, site string, radius double, out_of_radius boolean>")
    return export.geojson(_near(spark, d), 8.0).select(back.alias("f")).select("f.properties.id", F.col("f.properties.site").alias("wh_id"), "f.properties.radius", "f.properties.out_of_radius")


def _setting(key: str) -> str:
    return f"nullif(regexp_extract(link, '(^#?|&){key}=([^&]*)', 2), '')"


def _within(key: str) -> str:
    low, high = schema.RANGES[key]
    return f"CASE WHEN try_cast({_setting(key)} AS DOUBLE) BETWEEN {low} AND {high} THEN try_cast({_setting(key)} AS DOUBLE) END"


@query(f"""WITH l AS (SELECT * FROM (VALUES ('s=a&k=3&v=ev&f=90'), ('#k=9&v=boat&f=1000'), ('s=b&k=x&f=40')) t(link)), v AS (SELECT * FROM (VALUES {_ROWS}) t(vehicle, label, capacity, fuel, speed, upkeep, co2, energy))
SELECT link, {_setting('s')} AS sample, {_within('k')} AS k, CASE WHEN {_setting('v')} IN (SELECT vehicle FROM v) THEN {_setting('v')} END AS vehicle, {_within('f')} AS fuel_price FROM l""")
def decode_links(spark: SparkSession, d: str) -> DataFrame:
    links = spark.createDataFrame([("s=a&k=3&v=ev&f=90",), ("#k=9&v=boat&f=1000",), ("s=b&k=x&f=40",)], "link string")
    return points.decode_link(links).select("link", "sample", "k", "vehicle", "fuel_price")


@query("SELECT o_orderdate::TIMESTAMP AS window_start, o_custkey, count(*) AS orders FROM orders GROUP BY 1, 2")
def demand_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming counts: orders of each customer by day."""
    o = tables.table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), "o_custkey")
    return demand_by_window(o, "o_custkey").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_DAY_LOADS = "l AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id % 10 AS site, CAST(count(DISTINCT event_id) AS BIGINT) AS load FROM events GROUP BY 1, 2)"


@query(f"WITH {_DAY_LOADS} SELECT window_start, site, load, load > 40 AS is_over, true AS is_final FROM l UNION ALL SELECT window_start, site, 40, true, false FROM l WHERE load > 40")
def loads_over_capacity(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming loads: events of ten sites by day, and the days on which a site passes 40 (rows not final, with that limit as load)."""
    e = tables.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("site", F.col("user_id") % 10)
    told = window_loads(e.unionByName(e.where("event_id % 7 = 0")), capacity=40, key="site")  # some events come twice
    return told.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("load", F.coalesce("load", F.lit(40)))


@query(f"WITH {_ODD}, f AS (SELECT ord, id, min(ord) OVER (PARTITION BY id) AS first FROM odd) SELECT id, ord, first FROM f WHERE first < ord")
def dup_ids(spark: SparkSession, d: str) -> DataFrame:
    return points.repeated_ids(_odd(spark, d)).select("id", "ord", "first")


@query(f"WITH {_MAPPED} SELECT field, min(col_ord) AS col_ord FROM m GROUP BY 1")
def first_col_per_field(spark: SparkSession, d: str) -> DataFrame:
    return mapping.alias_mapping(_headers(spark)).select("field", "col_ord")


_EVIDENCE = """c AS (SELECT 0 AS col_ord, CAST(p_partkey AS VARCHAR) AS value FROM part UNION ALL SELECT 1, p_name FROM part UNION ALL SELECT 2, '12.'||p_partkey FROM part UNION ALL SELECT 3, '-'||p_size FROM part),
x AS (SELECT col_ord, try_cast(replace(trim(value), ',', '') AS DOUBLE) AS x FROM c WHERE trim(value) <> ''), ev AS (SELECT col_ord, avg(CAST(x IS NOT NULL AS INTEGER)) AS share, min(x) AS low, max(x) AS high, bool_and(x = floor(x)) AS whole FROM x GROUP BY 1),
f AS (SELECT * FROM (VALUES (0, 'id'), (1, 'lat'), (2, 'lon'), (3, 'orders')) t(field_ord, field)), p AS (SELECT col_ord, field_ord, field, CASE WHEN field = 'id' THEN CASE WHEN share > 0.9e0 THEN -0.12e0 ELSE 0.1e0 END WHEN share < 0.9e0 OR low IS NULL THEN -0.12e0
 WHEN field = 'lat' THEN CASE WHEN low < -90 OR high > 90 THEN -0.12e0 WHEN NOT whole AND abs(high) <= 90 THEN 0.12e0 ELSE 0.02e0 END
 WHEN field = 'lon' THEN CASE WHEN low < -180 OR high > 180 THEN -0.12e0 WHEN NOT whole AND abs(high) > 90 THEN 0.12e0 WHEN NOT whole THEN 0.06e0 ELSE 0.02e0 END
 WHEN low < 0 THEN -0.12e0 WHEN whole THEN 0.12e0 ELSE -0.04e0 END AS prior FROM ev, f)"""


@query(f"WITH {_EVIDENCE} SELECT col_ord, field, prior FROM p")
def value_prior(spark: SparkSession, d: str) -> DataFrame:
    fields = spark.createDataFrame([(f,) for f in mapping.FIELDS], "field string")
    return mapping.value_evidence(_part_cells(spark, d)).crossJoin(F.broadcast(fields)).select("col_ord", "field", mapping.value_prior().alias("prior"))  # four rows on the right


@query(f"WITH {_EVIDENCE}, s AS (SELECT field, col_ord, prior + CASE WHEN field_ord = col_ord THEN 0.8e0 ELSE 0.2e0 END AS score FROM p) SELECT field, col_ord, round(score, 6) AS score FROM s")
def score_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Scores of fields and columns for vectors of which a field and the column of its place agree by 0.8, others by 0.2."""
    side, own = 0.2**0.5, 0.6**0.5
    vectors = [[side, *(own if i == j else 0.0 for j in range(4))] for i in range(4)]
    fields = spark.createDataFrame([(i, f, vectors[i]) for i, f in enumerate(mapping.FIELDS)], "field_ord int, field string, vector array<double>")
    heads = spark.createDataFrame([(i, f"h{i}", vectors[i]) for i in range(4)], "col_ord int, header string, vector array<double>")
    return rounded(mapping.score_matrix(fields, heads, mapping.value_evidence(_part_cells(spark, d))).select("field", "col_ord", "score"), "score", places=6)


@query(f"""{BASE}, {PRICED}, t AS (SELECT count(*) AS n, CAST(sum(orders) AS BIGINT) AS o, round(sum(fuel+driver)+12500e0) AS total FROM costed)
SELECT 'nations: '||n||' areas, '||o||' orders a day.' AS first, 'Cheapest at K=5.' AS third, CAST(total AS BIGINT) AS total FROM t""")
def summary_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the text summary of the five sites, its rupees read back as a number."""
    sites = tables.five_sites(spark)
    rows = cost.row_cost(_near(spark, d), CONFIG)
    totals = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("orders").alias("orders_total")).join(cost.breakdown(rows, sites, CONFIG).select("dataset", "total"), "dataset")
    said = export.summary(totals.select("*", F.lit(5).alias("k"), F.col("total").alias("base_total"), F.lit(5).alias("best_k"), F.lit(None).cast("double").alias("saved_per_year"), F.lit(None).cast("double").alias("regret_pct")))
    lines = F.split("summary", "\n")
    return said.select(lines[0].alias("first"), lines[2].alias("third"), F.regexp_replace(F.regexp_extract(lines[1], "₹([0-9,]+) a day", 1), ",", "").cast("long").alias("total"))


@query(f"WITH {NATIONS}, c AS (SELECT avg(lat) AS a, avg(lon) AS b FROM pts) SELECT 'centre' AS label, round(sum(orders*{_km('p.lat', 'p.lon', 'c.a', 'c.b', 6371.0, 'atan2')}), 3) AS cost FROM pts p, c")
def centre_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The ladder's first rung: one depot at the centre of the map."""
    return rounded(whatif.centre_baseline(_nations(spark, d)).select("label", "cost"), "cost", places=3)


@query("SELECT n, k, CASE WHEN k = 1 OR k = n THEN 1 WHEN k = 2 THEN CAST(pow(2, n-1) AS BIGINT)-1 ELSE CAST((pow(3, n)-3*pow(2, n)+3)/6 AS BIGINT) END AS partitions FROM (SELECT CAST(range AS BIGINT) AS n FROM range(3, 13)), (SELECT CAST(range AS BIGINT) AS k FROM range(1, 4))")
def partition_counts(spark: SparkSession, d: str) -> DataFrame:
    """Ways to part n points into K groups that are not empty: what an exact search has to look at."""
    return spark.createDataFrame([(n, k, exact.partitions(n, k)) for n in range(3, 13) for k in range(1, 4)], "n long, k long, partitions long")


@query(f"{BASE} SELECT round(sum(orders*dist_km), 4) AS cost FROM near")
def plan_score(spark: SparkSession, d: str) -> DataFrame:
    """A plan given as (id, wh_id) scored; it raises where a point has no site."""
    given = _near(spark, d).select("dataset", "id", "wh_id")
    return rounded(cost.plan_score(_nations(spark, d), given, tables.five_sites(spark)).select("cost"), "cost")


@query(f"""SELECT 'c'||c_custkey AS sample, concat_ws('&', 's=c'||c_custkey, 'k='||(c_custkey % 8 + 1), CASE WHEN c_custkey % 3 <> 0 THEN 'v='||['truck', 'van'][CAST(c_custkey % 3 AS INTEGER)] END, CASE WHEN 100 + c_custkey % 30 <> 111 THEN 'f='||(100 + c_custkey % 30) END,
 CASE WHEN c_custkey % 4 > 0 THEN 'cap='||(c_custkey % 4 * 500) END, CASE WHEN c_custkey % 2 = 1 THEN 'sc=sprawl' END) AS link, CAST(c_custkey % 8 + 1 AS DOUBLE) AS k, CASE WHEN 100 + c_custkey % 30 <> 111 THEN CAST(100 + c_custkey % 30 AS DOUBLE) END AS fuel_price FROM customer""")
def encode_links(spark: SparkSession, d: str) -> DataFrame:
    """A link for the settings of every customer, and what is read back from it."""
    n = F.col("c_custkey")
    settings = tables.table(spark, d, "customer").select(F.concat(F.lit("c"), n.cast("string")).alias("sample"), (n % 8 + 1).alias("k"), F.when(n % 3 == 0, "bike").when(n % 3 == 1, "truck").otherwise("van").alias("vehicle"), F.lit("light").alias("traffic"), (100 + n % 30).alias("fuel_price"),
        F.lit(120.0).alias("driver_wage"), F.lit(2500.0).alias("rent"), (n % 4 * 500).alias("capacity"), F.lit(0).alias("max_radius"), F.when(n % 2 == 1, "sprawl").otherwise("today").alias("scenario"))
    return points.decode_link(export.link(settings)).select("sample", "link", "k", "fuel_price")


_ORDER_KM = f"WITH {NATIONS}, {FIVE}, o AS (SELECT p.ord, p.orders, min({_km('p.lat', 'p.lon', 's.lat', 's.lon', 6371.0, 'atan2')}) AS km FROM pts p, sites s GROUP BY 1, 2), c AS (SELECT avg(lat) AS a, avg(lon) AS b FROM pts), t AS (SELECT (SELECT sum(orders*km) FROM o) AS order_km, (SELECT sum(orders*{_km('p.lat', 'p.lon', 'c.a', 'c.b', 6371.0, 'atan2')}) FROM pts p, c) AS base_order_km)"


@query(f"{_ORDER_KM} SELECT round(order_km, 3) AS order_km, round(base_order_km, 3) AS base_order_km, round(greatest(0, base_order_km-order_km)*10*365, 2) AS money_per_year, round(greatest(0, base_order_km-order_km)*46*365/1000, 2) AS co2_kg_per_year, round(order_km/(SELECT sum(orders) FROM pts), 6) AS km_per_order FROM t")
def order_km_impact(spark: SparkSession, d: str) -> DataFrame:
    """What five sites save against one depot at the centre of the map, in order-km, money and CO2."""
    pts = _nations(spark, d)
    plan = cost.weighted_cost(assign.nearest(pts, tables.five_sites(spark), ORDER_KM)).withColumnRenamed("cost", "order_km")
    base = whatif.centre_baseline(pts).select("dataset", F.col("cost").alias("base_order_km"))
    total = pts.groupBy("dataset").agg(F.sum("orders").alias("_o"))
    out = cost.impact_order_km(plan.join(base, "dataset"), 10.0, 46.0).join(total, "dataset").withColumn("km_per_order", F.round(F.col("order_km") / F.col("_o"), 6))
    return rounded(rounded(out.select("order_km", "base_order_km", "money_per_year", "co2_kg_per_year", "km_per_order"), "order_km", "base_order_km", places=3), "money_per_year", "co2_kg_per_year", places=2)


@query(f"{_CURVE}, b AS (SELECT k, cost AS delivery, cost+2500e0*k AS total FROM curve) SELECT k, round(delivery/(SELECT max(total)*1.08 FROM b), 8) AS y_delivery, round(total/(SELECT max(total)*1.08 FROM b), 8) AS y_total FROM b")
def chart_bars(spark: SparkSession, d: str) -> DataFrame:
    """Stacked bars of the sweep over the nations."""
    sweep = _discrete_sweep(spark, d).select("dataset", "k", F.col("cost").alias("delivery"), (F.col("cost") + 2500.0 * F.col("k")).alias("total"))
    return rounded(export.chart(sweep).drop("dataset"), "y_delivery", "y_total", places=8)


@query("SELECT CASE WHEN m < 1 THEN 'holds up' WHEN m < 3 THEN 'small regret' WHEN m < 7 THEN 'some regret' ELSE 'rethink' END AS verdict, count(*) AS n FROM (SELECT (c_custkey % 100) / 10e0 AS m FROM customer) GROUP BY 1")
def verdict_bands(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the verdict on a mean regret made of their keys."""
    means = tables.table(spark, d, "customer").select(((F.col("c_custkey") % 100) / F.lit(10.0)).alias("m"))
    return means.groupBy(whatif.verdict_of_regret(F.col("m")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CUSTOMERS} SELECT ord, round((lon-77.6e0)*radians(1e0)*6371.0088e0*cos(radians(13e0)), 6) AS x, round((lat-13e0)*radians(1e0)*6371.0088e0, 6) AS y FROM pts")
def local_plane(spark: SparkSession, d: str) -> DataFrame:
    """Customers in km east and north of one place."""
    x, y = to_plane(F.col("lat"), F.col("lon"), F.lit(13.0), F.lit(77.6))
    return tables.customer_points(spark, d).select("ord", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"{BASE} SELECT n.id, n.wh_id, s.lat AS wh_lat, s.lon AS wh_lon FROM near n JOIN sites s ON s.wh_id = n.wh_id WHERE s.wh_ord < 3")
def site_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Assignments with their sites' places; points of unknown sites drop out."""
    given = _near(spark, d).select("dataset", "id", "wh_id")
    return assign.lookup(given, tables.five_sites(spark).where("wh_ord < 3")).select("id", "wh_id", "wh_lat", "wh_lon")


# --- iterative: checked by tests -----------------------------------------------------------------

@query()
def kmedian_objective(spark: SparkSession, d: str) -> DataFrame:
    plans = solve.solve_grouped(samples.sample(spark, "cross_13"), (1, 2, 3, 4, 5), profile=ORDER_KM)
    return plans.groupBy("dataset", "k").agg(F.round(F.first("objective"), 2).alias("objective"))


@query()
def rupee_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whatif.k_sweep(samples.sample(spark, "bengaluru_12"), 8, CONFIG), "delivery", "total", "improvement_pct", places=2)


@query()
def stress_regret(spark: SparkSession, d: str) -> DataFrame:
    pts = _nations(spark, d).cache()
    sites = solve.solve_grouped(cost.cost_weight(pts, CONFIG), (3,), "weight")
    return rounded(whatif.regret(pts, sites, 16, 0.3, 20260920, RUPEE, CONFIG), "mean_regret_pct", "worst_regret_pct")


@query()
def proof_k3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whatif.proof(_nations(spark, d), 3, CONFIG), "heuristic", "discrete", "continuous_advantage_pct", "best_gain_pct", "kmeans", "kmeans_delivery_penalty_pct", "kmeans_total_penalty_pct")


@query()
def comparison_ladder(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whatif.comparison_ladder(_nations(spark, d), 3), "cost", "improvement_pct", "saving_vs_prev_pct")


@query()
def capacity_search(spark: SparkSession, d: str) -> DataFrame:
    pts = samples.sample(spark, "cross_13")
    best = capacity.best_plan(capacity.search(pts, solve.solve_grouped(pts, (3,), profile=ORDER_KM), 2400))
    return rounded(best.select("dataset", "k", "cost", "overload", F.array_join(F.col("loads").cast("array<string>"), ",").alias("loads")), "cost")


@query()
def verify_plan(spark: SparkSession, d: str) -> DataFrame:
    pts = samples.sample(spark, "exact_6").cache()
    costs = solve.solve_grouped(pts, (2,), profile=ORDER_KM).groupBy("dataset").agg(F.first("objective").alias("cost"))
    return rounded(whatif.verify(pts, costs, 2), "plan_cost", "discrete", "continuous", "gap_pct", places=3)


@query()
def models_agree(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whatif.agreement(samples.sample(spark, "cross_13"), (1, 2, 3)), "cost_rupee", "cost_order_km", places=2)


@query()
def large_kmedian(spark: SparkSession, d: str) -> DataFrame:
    """One large instance: four sites for all customers."""
    pts = tables.customer_points(spark, d).cache()
    centres = solve.solve_large(pts, 4)
    sites = spark.createDataFrame([("customers", i, f"W{i + 1}", a, b) for i, (a, b) in enumerate(centres)], "dataset string, wh_ord long, wh_id string, lat double, lon double")
    return rounded(cost.weighted_cost(assign.nearest(pts, sites)), "cost", places=2)


@query()
def column_map(spark: SparkSession, d: str) -> DataFrame:
    heads = samples.MESSY_CSV.splitlines()
    words = {"locality": 0, "name": 0, "y": 1, "latitude": 1, "x": 2, "longitude": 2, "parcels": 3, "orders": 3, "deliveries": 3}

    def embed(texts):  # noqa: ANN001, ANN202  a stand-in for a model: counts of known words
        out = []
        for t in texts:
            v = [0.0] * 4
            for w in t.lower().replace(",", " ").split():
                if w in words:
                    v[words[w]] += 1
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out

    return mapping.map_columns(spark, heads[0].split(","), [h.split(",") for h in heads[1:]], embed).select("source_column", "field", "confidence", "method")


@query()
def headline_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whatif.headline(samples.sample(spark, "bengaluru_12")), "total", "per_order", "saving_pct", places=2)


@query()
def geometric_medians(spark: SparkSession, d: str) -> DataFrame:
    return rounded(medians.geometric_medians(samples.sample(spark)), "lat", "lon", places=6)


@query()
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Plans for K = 1..5 written as JSON and read back."""
    plans = solve.solve_grouped(samples.sample(spark, "cross_13"), (1, 2, 3, 4, 5), profile=ORDER_KM)
    return rounded(points.read_json_plans(spark, export.json_plans(plans)), "lat", "lon", places=6)


@query()
def paired_sites(spark: SparkSession, d: str) -> DataFrame:
    pts = samples.sample(spark, "cross_13").cache()
    a, b = (solve.solve_grouped(pts, (3, 4), profile=p) for p in (RUPEE, ORDER_KM))
    return rounded(whatif.pair_sites(a, b), "km", places=3)


@query()
def run_plan(spark: SparkSession, d: str) -> DataFrame:
    """The whole rupee pipeline for three sites: its summary row."""
    out = whatif.run(samples.sample(spark, "bengaluru_12"), 3)["summary"].select("dataset", "delivery", "total", "base_total", "kmeans_total", "improvement_pct", "saved_per_year")
    return rounded(out, "delivery", "total", "base_total", "kmeans_total", "improvement_pct", "saved_per_year", places=2)


@query()
def run_order_km(spark: SparkSession, d: str) -> DataFrame:
    """The whole order-km pipeline for three sites: its summary row."""
    out = whatif.run_order_km(samples.sample(spark, "cross_13"), 3, None, 10.0, 46.0)["summary"].select("dataset", "order_km", "base_order_km", "order_km_saved", "money_per_year")
    return rounded(out, "order_km", "base_order_km", "order_km_saved", "money_per_year", places=2)


@query()
def robustness(spark: SparkSession, d: str) -> DataFrame:
    """Three order-km sites kept while demand moves, against sites solved anew."""
    pts = samples.sample(spark, "cross_13").cache()
    sites = solve.solve_grouped(pts, (3,), profile=ORDER_KM)
    return rounded(whatif.regret(pts, sites, 20, 0.3, 20260919, ORDER_KM), "mean_regret_pct", "worst_regret_pct")


@query()
def spot_check(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whatif.spot_check(samples.sample(spark, "cross_13"), 2, samples=3), "plan_cost", "discrete", "continuous", "gap_pct", places=3)


@query()
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whatif.cross_check(samples.sample(spark, "exact_6", "cross_13"), 2), "gap_pct", places=3)


@query()
def ingest_rows(spark: SparkSession, d: str) -> DataFrame:
    """The built-in messy file read as rows: points of it."""
    head, *body = samples.MESSY_CSV.splitlines()
    renamed = dict(zip(head.split(","), ("id", "lat", "lon", "orders", "manager"), strict=False))
    good, _ = points.read_rows(spark, [dict(zip(map(renamed.get, head.split(",")), row.split(","), strict=False)) for row in body], "messy")
    return good
