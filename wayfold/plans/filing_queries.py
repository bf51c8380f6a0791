"""Queries about filing trips under lines, from pieces of many sources, and about stations and shapes of the result, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_sql, made_up_place
from wayfold.functions.text import mode_of
from wayfold.operators import geometry, search, timetable
from wayfold.plans import geometry_queries, network
from wayfold.plans.geometry_queries import places
from wayfold.plans.routing_queries import shapes
from wayfold.sources.shared import table

#: Names of timetables in order of priority, and the route of each family of them.
SOURCES = ["hill_line", "coast_line", "island", "north_dn", "north_up", "east_dn", "east_up", "west_dn", "west_up"]
FAMILIES = {"hill": "R_HILL", "coast": "R_COAST", "island": "R_ISLAND", "north": "R_NORTH", "east": "R_EAST", "west": "R_WEST"}
#: Nations whose suppliers' stops are a branch, in the order in which branches are looked at.
BRANCH_NATIONS = [7, 3, 11]
#: Stations of timetables, orders of a train.
TIMETABLE_STOPS, TRAIN_ORDERS = 60, 3


def _source(trip: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SOURCES)), (trip % len(SOURCES)).cast("int") + 1)


def _families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILIES.items()), "family string, route string")


def _branches(spark: SparkSession, sf_dir: str, stop: Column) -> DataFrame:
    """(ord, route, stops): the stops of three nations; stop says which stop a supplier is."""
    order = F.array_position(F.array(*map(F.lit, BRANCH_NATIONS)), F.col("line").cast("int"))
    rows = network.stops(spark, sf_dir).where(F.col("line").isin(BRANCH_NATIONS)).select(order.alias("ord"), F.concat(F.lit("B"), F.col("line").cast("string")).alias("route"), stop.alias("stop"))
    return rows.groupBy("ord", "route").agg(F.collect_set("stop").alias("stops"))


def trip_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips in order of time, under a branch or their source's family, with direction and shape."""
    day = network.day_times(spark, sf_dir).select("trip", F.col("seq").alias("n"), "stop", (F.col("arr") % 1440).alias("arr"), (F.col("dep") % 1440).alias("dep"))
    calls = timetable.chronological(day).withColumn("source", _source(F.col("trip")))
    branches = timetable.known_branches(_branches(spark, sf_dir, F.col("stop")), network.stops(spark, sf_dir))
    return timetable.filed_trips(calls, branches, _families(spark))


def compiled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of three orders each, from nine timetables by priority, folded into trips."""
    by = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    order = Window.partitionBy("train", "l_orderkey").orderBy(*by)
    trip = F.col("l_orderkey").cast("long")
    # an order's train has all of it, so what is dealt by train once isn't dealt again
    rows = table(spark, sf_dir, "lineitem").select(F.floor(trip / TRAIN_ORDERS).cast("string").alias("train"), "l_orderkey", *by).repartition("train")
    calls = rows.select(
        "train", _source(trip).alias("source"), F.row_number().over(order).cast("long").alias("n"),
        (F.col("l_suppkey") % TIMETABLE_STOPS).cast("long").alias("stop"), ((trip * 7919 + F.col("l_linenumber") * 17 + F.col("l_partkey") % 12) % 1440).cast("long").alias("minute"),
    )
    sources = spark.createDataFrame(list(zip(SOURCES, range(len(SOURCES)), strict=True)), "source string, priority long")
    return timetable.assemble(timetable.ordered_pieces(calls, sources), dealt=True)


def compiled_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trips under their routes."""
    stop = (F.col("stop") % TIMETABLE_STOPS).cast("long")
    branches = timetable.known_branches(_branches(spark, sf_dir, stop), network.stops(spark, sf_dir).select(stop.alias("stop")))
    calls = compiled_calls(spark, sf_dir).select(F.col("trip_id").alias("trip"), "source", "seq", "stop")
    return timetable.filed_trips(calls, branches, _families(spark))


def station_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4, A3, A4: each stop with name, place, mode, line unless local, and the nations of the trips that call there."""
    mode = mode_of(F.col("line") % 13)
    stops = places(spark, sf_dir).select(F.col("stop").alias("id"), "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), mode.alias("mode"), F.when(mode == "LOCAL", "").otherwise(F.concat(F.lit("N"), F.col("line").cast("string"))).alias("line"))
    trips = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").cast("long").alias("trip"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("route"))
    return search.station_records(stops, network.calls(spark, sf_dir), trips).withColumn("lines", F.array_join("lines", " "))


def shape_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation of the last trip of each shape."""
    filed = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("long").alias("trip"), F.col("c_nationkey").cast("long").alias("route"))
    return timetable.shape_routes(shapes(spark, sf_dir).select("trip", "shape").join(filed, "trip", "left").withColumnRenamed("trip", "n"))


def track_snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations beside the track, each with its nearest node; none is farther than 250 metres."""
    nodes = geometry_queries._track_points(spark, sf_dir).select(F.col("point").alias("node"), "lat", "lon")
    lat, lon = made_up_place(F.col("p_partkey") * 3 + 1)
    stations = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("station"), (lat + F.col("p_partkey") % 20 * 0.0001).alias("lat"), lon.alias("lon"))
    return geometry.on_track(stations, nodes).select("station", "node", F.round("m").cast("long").alias("metres"))


QUERIES = {f.__name__: f for f in (trip_routes, compiled_calls, compiled_trips, station_records, shape_routes, track_snaps)}

_N = network.SQL
_NODE = geometry_queries._PLACE.format(k="(p_partkey * 3 + 1)")

ORACLE_SQL = {
    "trip_routes": f"""WITH {_N}, clocked AS (SELECT trip, stop, seq AS n, arr % 1440 AS arr, dep % 1440 AS dep FROM day_time), late AS (
  SELECT *, max(greatest(arr, dep)) OVER w // 60 - min(least(arr, dep)) OVER w // 60 >= 18 AS over FROM clocked WINDOW w AS (PARTITION BY trip)
), timed AS (
  SELECT trip, stop, n, arr + CASE WHEN over AND arr < 720 THEN 1440 ELSE 0 END AS arr, dep + CASE WHEN over AND dep < 720 THEN 1440 ELSE 0 END AS dep FROM late
), whole AS (
  SELECT trip, string_agg(CAST(stop AS VARCHAR), '_' ORDER BY arr, dep, n) AS s, list(stop ORDER BY arr, dep, n) AS l, count(*) AS n_calls,
    [{', '.join(f"'{s}'" for s in SOURCES)}][trip % {len(SOURCES)} + 1] AS source FROM timed GROUP BY trip
), hit AS (
  SELECT trip, stop, line, CASE line {' '.join(f'WHEN {n} THEN {i}' for i, n in enumerate(BRANCH_NATIONS))} END AS ord FROM call JOIN stops USING (stop) WHERE line IN ({', '.join(map(str, BRANCH_NATIONS))})
), branch AS (
  SELECT trip, 'B' || line AS route, string_agg(CAST(stop AS VARCHAR), ' ' ORDER BY stop) AS shared FROM hit JOIN (SELECT trip, min(ord) AS ord FROM hit GROUP BY trip) USING (trip, ord) GROUP BY trip, line
), filed AS (
  SELECT w.*, shared, coalesce(route, CASE split_part(source, '_', 1) {' '.join(f"WHEN '{f}' THEN '{r}'" for f, r in FAMILIES.items())} END) AS route FROM whole w LEFT JOIN branch USING (trip)
) SELECT trip, route, CAST(CASE right(source, 2) WHEN 'up' THEN 0 WHEN 'dn' THEN 1 END AS BIGINT) AS direction, 'SHP_' || route || '_' || l[1] || '_TO_' || l[-1] || '_' || substr(md5(s), 1, 4) AS shape, coalesce(shared, '') AS shared, n_calls FROM filed""",
    "station_records": f"""WITH {_N}, served AS (
  SELECT DISTINCT stop, 'N' || c_nationkey AS line FROM call JOIN orders ON trip = o_orderkey JOIN customer ON o_custkey = c_custkey
), listed AS (SELECT stop, string_agg(line, ' ' ORDER BY line) AS lines FROM served GROUP BY stop), kind AS (
  SELECT *, CASE line % 13 WHEN 1 THEN 'METRO' WHEN 12 THEN 'MONORAIL' ELSE 'LOCAL' END AS mode, {geometry_queries._PLACE.format(k='stop')} FROM stops
) SELECT k.stop AS id, 'Stop ' || (k.stop % 97) AS name, round(lat, 6) AS lat, round(lon, 6) AS lon, mode, CASE WHEN mode <> 'LOCAL' THEN 'N' || line END AS line, coalesce(lines, '') AS lines FROM kind k LEFT JOIN listed USING (stop)""",
    "shape_routes": f"""WITH {_N}, named AS (
  SELECT trip, 'SHP_' || arg_min(stop, seq) || '_TO_' || arg_max(stop, seq) || '_' || substr(md5(string_agg(CAST(stop AS VARCHAR), '_' ORDER BY seq)), 1, 4) AS shape FROM call GROUP BY trip
) SELECT shape, CAST(arg_max(c_nationkey, trip) AS BIGINT) AS route FROM named JOIN orders ON trip = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY shape""",
    "track_snaps": f"""WITH node AS (SELECT p_partkey AS node, {_NODE} FROM part), station AS (SELECT node AS station, lat + node % 20 * 0.0001 AS lat, lon FROM node), near AS (
  SELECT station, node, {haversine_sql('s.lat', 's.lon', 'n.lat', 'n.lon')} AS m FROM station s JOIN node n ON n.lat BETWEEN s.lat - 0.003 AND s.lat + 0.003 AND n.lon BETWEEN s.lon - 0.003 AND s.lon + 0.003
) SELECT station, arg_min(node, (m, node)) AS node, CAST(round(min(m)) AS BIGINT) AS metres FROM near WHERE m <= 250 GROUP BY station""",
}
