"""Queries about places, walks, tracks and shapes, and checks of the network, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine, haversine_sql, made_up_place
from wayfold.operators import geometry, timetable, validation
from wayfold.plans import network, timetable_queries
from wayfold.sources.shared import table, written

BOX = (18.91, 72.81, 19.0, 72.9)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stop, line, name, lat, lon)."""
    lat, lon = made_up_place(F.col("stop"))
    return network.stops(spark, sf_dir).select("stop", "line", F.concat(F.lit("Stop "), (F.col("stop") % 97).cast("string")).alias("name"), lat.alias("lat"), lon.alias("lon"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = places(spark, sf_dir)
    side = lambda k: here.select(F.col("stop").alias(k), F.col("line").alias(f"{k}_line"), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    return geometry.near_pairs(side("a"), side("b"), geometry.WALK_METRES).where("a < b AND a_line <> b_line")


def station_pairs_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of stops of different lines closer than a kilometre."""
    return _pairs(spark, sf_dir).select("a", "b", F.round("m").cast("long").alias("metres"))


def transfer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers both ways, some pairs with a given distance."""
    pairs = written(_pairs(spark, sf_dir).select("a", "b", "m"), "pairs")
    manual = pairs.where("(a * b) % 50 = 0").select("a", "b", (100 + (F.col("a") + F.col("b")) % 1500).alias("metres"))
    return geometry.transfers(pairs, manual)


def _track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = made_up_place(F.col("point") * 3 + 1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point"), (F.col("p_size") % 5).cast("long").alias("line")).select("point", "line", lat.alias("lat"), lon.alias("lon"))


def nearest_track_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stop's nearest track point of each line."""
    return geometry.nearest(places(spark, sf_dir), _track_points(spark, sf_dir)).select("stop", "line", "point", F.round("m").cast("long").alias("metres"))


def _polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip, seq, stop, lat, lon) of every trip."""
    return network.day_times(spark, sf_dir).join(places(spark, sf_dir), "stop").select("trip", "seq", "stop", "lat", "lon")


def shape_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres along every trip's polyline."""
    return geometry.lengths(geometry.without_repeats(_polylines(spark, sf_dir), "trip", "seq"), "trip", "seq").select("trip", F.round("metres").cast("long").alias("metres"))


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trip's polyline as a GeoJSON feature."""
    return geometry.geojson(_polylines(spark, sf_dir), "trip", "seq")


def shape_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each trip's polyline between points near its second and last stop."""
    points = written(_polylines(spark, sf_dir).withColumnRenamed("trip", "shape"), "polylines")
    ends = points.groupBy("shape").agg(F.max_by(F.struct("lat", "lon"), "seq").alias("b"), F.min_by(F.struct("lat", "lon"), F.abs(F.col("seq") - 2) * 10 + F.col("seq")).alias("a"))
    hops = ends.select(F.col("shape").alias("hop"), "shape", (F.col("a.lat") + 0.0003).alias("lat1"), (F.col("a.lon") - 0.0002).alias("lon1"), (F.col("b.lat") - 0.0003).alias("lat2"), (F.col("b.lon") + 0.0002).alias("lon2"))
    return geometry.slices(points, hops)


def network_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the polylines of each customer's orders, those with enough new points."""
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), F.col("o_custkey").alias("network"))
    points = _polylines(spark, sf_dir).join(owner, "trip")
    return geometry.fresh_shapes(points.select("network", F.col("trip").cast("string").alias("shape"), "seq", "lat", "lon"))


def track_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops that walks connect."""
    return geometry.track_components(network.walks(spark, sf_dir))


def component_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest stops of components less than half a kilometre apart."""
    nodes = geometry.track_components(network.walks(spark, sf_dir)).join(places(spark, sf_dir).withColumnRenamed("stop", "node"), "node")
    return geometry.bridges(nodes).select("a", "b", F.round("m").cast("long").alias("metres"))


def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of the shortest walks from the stop of each nation's number."""
    sources = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source")).join(network.stops(spark, sf_dir).select(F.col("stop").alias("source")), "source", "left_semi")
    return geometry.shortest_paths(network.walks(spark, sf_dir), sources)


def track_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, m): the walks between stops as a track of straight pieces, in metres."""
    here = places(spark, sf_dir)
    side = lambda k: here.select(F.col("stop").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    m = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return network.walks(spark, sf_dir).join(side("a"), "a").join(side("b"), "b").select("a", "b", m.alias("m"))


def snap_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track point for each call of every trip, by snap distances and lengths along the track between them; points lie 200 metres from the stops."""
    points = places(spark, sf_dir).select(F.col("stop").alias("point"), "line", (F.col("lat") + 0.0015).alias("lat"), (F.col("lon") + 0.001).alias("lon"))
    near = geometry.nearest(places(spark, sf_dir), points)
    calls = network.calls(spark, sf_dir).select(F.col("trip").cast("string").alias("shape"), "seq", "stop")
    return geometry.snaps(calls, near, track_edges(spark, sf_dir))


def segment_speed_checks(spark: SparkSession, sf_dir: str, day: DataFrame | None = None) -> DataFrame:
    """Trips that go back in time, go too fast or last too long."""
    return validation.trips(day or network.day_times(spark, sf_dir), places(spark, sf_dir))


def trunk_order_check(spark: SparkSession, sf_dir: str, day: DataFrame | None = None) -> DataFrame:
    """Trips that visit the stops of a trunk, each fifth stop by number, out of order."""
    trunk = network.stops(spark, sf_dir).where("stop % 5 = 0").select("stop", F.col("stop").alias("pos"))
    return validation.trunk_order(day or network.calls(spark, sf_dir), trunk)


def reference_checks(spark: SparkSession, sf_dir: str, day: DataFrame | None = None) -> DataFrame:
    """Broken references once each seventh stop and each eleventh customer is taken out."""
    stops = network.stops(spark, sf_dir).where("stop % 7 <> 3").select("stop")
    routes = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 5").select(F.col("c_custkey").alias("route"))
    trips = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), F.col("o_custkey").alias("route"))
    return validation.references(stops, routes, trips, (day or network.calls(spark, sf_dir)).select("trip", "stop"))


def station_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of one name, too close to each other, or outside a box."""
    return validation.stations(places(spark, sf_dir), BOX)


def coverage_diff(spark: SparkSession, sf_dir: str, day: DataFrame | None = None) -> DataFrame:
    """V5, U4: orders that became no trip, less those of priority 5."""
    orders = table(spark, sf_dir, "orders")
    train = F.col("o_orderkey").alias("train")
    return validation.coverage(orders.select(train), (day or network.calls(spark, sf_dir)).where("seq = 1").select(F.col("trip").alias("train")), orders.where(F.col("o_orderpriority").startswith("5")).select(train))


def _walk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = network.walks(spark, sf_dir).withColumn("metres", (F.col("a") * F.col("b") * 37 % 1300))
    return walks.where("NOT (a > b AND a % 9 = 0)")


def footpath_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks without a reverse, too long, of odd speed, on one line, or lacking."""
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") + 5).cast("long").alias("b"))
    return validation.footpaths(_walk_rows(spark, sf_dir), network.stops(spark, sf_dir), known)


def shape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: shapes without trips or ending away from their stops, once shapes of each thirteenth trip lose their last points."""
    calls = network.day_times(spark, sf_dir).select(F.col("trip").alias("shape"), "seq", "stop")
    points = calls.join(places(spark, sf_dir), "stop").where("NOT (shape % 13 = 0 AND seq > 1)").select((F.col("shape") + F.when(F.col("shape") % 17 == 0, 10_000_000).otherwise(0)).alias("shape"), "seq", "lat", "lon")
    return validation.shape_ends(points, calls, places(spark, sf_dir))


def headway_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and gaps of the events of each type, in minutes since the first day."""
    minute = F.floor(F.unix_timestamp("ts") / 60).cast("long")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("line"), minute.alias("minute"))
    return validation.headways(events, (28401600 + 480, 28401600 + 1920)).select("line", "first", "last", "n", "longest", F.round("peak_mean", 6).alias("peak_mean"))


def metro_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: first and last departure, longest gap and peak headway of the generated lines."""
    named = timetable_queries.headway_departures(spark, sf_dir).select(F.concat_ws("-", "line", F.col("dir").cast("string")).alias("line"), "minute")
    return validation.headways(named, (480, 540)).select("line", "first", "last", "n", "longest", F.round("peak_mean", 6).alias("peak_mean"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many problems each check finds, and the first fifteen."""
    with network.kept_day(spark, sf_dir) as day:
        by_trip = [f(spark, sf_dir, day) for f in (trunk_order_check, reference_checks, coverage_diff)]
        found = [written(df, "problems") for df in (*by_trip, station_checks(spark, sf_dir), footpath_checks(spark, sf_dir))]
    return validation.report(validation.together(*found))


QUERIES = {
    f.__name__: f
    for f in (
        station_pairs_near, transfer_table, nearest_track_point, shape_length, geojson_features, shape_slice, network_dedupe, track_components, component_bridges, shortest_path_len, snap_viterbi,
        segment_speed_checks, trunk_order_check, reference_checks, station_checks, coverage_diff, footpath_checks, shape_checks, headway_stats, metro_facts, quality_report,
    )
}

_N = network.SQL
_PLACE = "18.9 + ((7 * {k} * {k} + 37 * {k}) % 1009) / 1009.0 * 0.1 AS lat, 72.8 + ((11 * {k} * {k} + 53 * {k}) % 997) / 997.0 * 0.1 AS lon"
_P = f"place AS (SELECT stop, line, 'Stop ' || (stop % 97) AS name, {_PLACE.format(k='stop')} FROM stops)"
_PAIRS = f"pairs AS (SELECT * FROM (SELECT a.stop AS a, b.stop AS b, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM place a JOIN place b ON a.stop < b.stop AND a.line <> b.line) WHERE m < 1000)"
_HEAD = f"WITH RECURSIVE {_N}, {_P}"
_COMPONENT = "reach AS (SELECT a AS node, a AS other FROM walk UNION SELECT r.node, w.b FROM reach r JOIN walk w ON r.other = w.a), component AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"
_TRUNK = "trunk_bad AS (SELECT trip FROM (SELECT trip, stop, lag(stop) OVER (PARTITION BY trip ORDER BY seq) AS before FROM call WHERE stop % 5 = 0 AND stop IN (SELECT stop FROM stops)) WHERE before IS NOT NULL GROUP BY trip HAVING NOT bool_and(stop >= before) AND NOT bool_and(stop <= before))"
_REFERENCES = """refs AS (
  SELECT 'unknown route of trip ' || o_orderkey AS problem FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 5)
  UNION ALL SELECT 'no calls of trip ' || o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT trip FROM call)
  UNION ALL SELECT DISTINCT 'calls of unknown trip ' || trip FROM call WHERE trip NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'unserved stop ' || stop FROM stops WHERE stop % 7 <> 3 AND stop NOT IN (SELECT stop FROM call)
  UNION ALL SELECT DISTINCT 'unknown stop ' || stop || ' of trip ' || trip FROM call WHERE stop NOT IN (SELECT stop FROM stops WHERE stop % 7 <> 3)
  UNION ALL SELECT 'no trips of route ' || c_custkey FROM customer WHERE c_custkey % 11 <> 5 AND c_custkey NOT IN (SELECT o_custkey FROM orders))"""
_STATIONS = f"""station_bad AS (
  SELECT 'name twice ' || replace(lower(name), ' ', '') AS problem FROM place GROUP BY name HAVING count(*) > 1
  UNION ALL SELECT 'too close ' || a || ' ' || b FROM (SELECT a.stop AS a, b.stop AS b, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM place a JOIN place b ON a.stop < b.stop) WHERE m < 200
  UNION ALL SELECT 'outside ' || stop FROM place WHERE NOT (lat BETWEEN {BOX[0]} AND {BOX[2]} AND lon BETWEEN {BOX[1]} AND {BOX[3]}))"""
_COVERAGE = "uncovered AS (SELECT 'no trip of train ' || o_orderkey AS problem FROM orders WHERE o_orderkey NOT IN (SELECT trip FROM call) AND o_orderpriority NOT LIKE '5%')"
_FOOT = """foot AS (SELECT *, a * b * 37 % 1300 AS metres FROM walk WHERE NOT (a > b AND a % 9 = 0)), foot_bad AS (
  SELECT 'no reverse ' || f.a || ' ' || f.b AS problem FROM foot f WHERE NOT EXISTS (SELECT 1 FROM foot g WHERE g.a = f.b AND g.b = f.a AND g.minutes = f.minutes)
  UNION ALL SELECT 'too long ' || a || ' ' || b FROM foot WHERE metres > 1200
  UNION ALL SELECT 'odd speed ' || a || ' ' || b FROM foot WHERE minutes < metres / 100.0 OR minutes > metres / 50.0 + 6
  UNION ALL SELECT 'same line ' || f.a || ' ' || f.b FROM foot f JOIN stops x ON x.stop = f.a JOIN stops y ON y.stop = f.b WHERE x.line = y.line
  UNION ALL SELECT 'lacks ' || n_nationkey || ' ' || (n_nationkey + 5) FROM nation WHERE NOT EXISTS (SELECT 1 FROM foot WHERE a = n_nationkey AND b = n_nationkey + 5))"""
_HEADWAY = """SELECT line, min(minute) AS first, max(minute) AS last, count(*) AS n, max(gap) AS longest, round(avg(CASE WHEN minute >= {lo} AND minute < {hi} THEN gap END), 6) AS peak_mean
FROM (SELECT line, minute, lead(minute) OVER (PARTITION BY line ORDER BY minute) - minute AS gap FROM dep) GROUP BY line"""

ORACLE_SQL = {
    "shape_checks": f"""{_HEAD}, placed AS (SELECT trip, seq, d.stop, lat, lon FROM day_time d JOIN place p ON d.stop = p.stop), point AS (
  SELECT trip + CASE WHEN trip % 17 = 0 THEN 10000000 ELSE 0 END AS shape, seq, lat, lon FROM placed WHERE NOT (trip % 13 = 0 AND seq > 1)
), pe AS (
  SELECT shape, arg_min(lat, seq) AS a1, arg_min(lon, seq) AS o1, arg_max(lat, seq) AS a2, arg_max(lon, seq) AS o2 FROM point GROUP BY shape
), se AS (
  SELECT trip AS shape, arg_min(lat, seq) AS a1, arg_min(lon, seq) AS o1, arg_max(lat, seq) AS a2, arg_max(lon, seq) AS o2 FROM placed GROUP BY trip
) SELECT 'shapes' AS "check", 'unused ' || shape AS problem FROM pe WHERE shape NOT IN (SELECT trip FROM day_time)
UNION ALL SELECT DISTINCT 'shapes', 'missing ' || trip FROM day_time WHERE trip NOT IN (SELECT shape FROM pe)
UNION ALL SELECT 'shapes', 'ends away ' || pe.shape FROM pe JOIN se ON pe.shape = se.shape WHERE {haversine_sql('pe.a1', 'pe.o1', 'se.a1', 'se.o1')} > 1500 OR {haversine_sql('pe.a2', 'pe.o2', 'se.a2', 'se.o2')} > 1500""",
    "station_pairs_near": f"{_HEAD}, {_PAIRS} SELECT a, b, CAST(round(m) AS BIGINT) AS metres FROM pairs",
    "transfer_table": f"""{_HEAD}, {_PAIRS}, costed AS (
  SELECT a, b, CASE WHEN (a * b) % 50 = 0 THEN 100 + (a + b) % 1500 ELSE CAST(round(m * 1.3) AS BIGINT) END AS metres, (a * b) % 50 = 0 AS own,
         CASE WHEN (a * b) % 50 = 0 THEN round_even((100 + (a + b) % 1500) / 80.0, 1) ELSE m * 1.3 / 75.0 END AS minutes FROM pairs
), kept AS (SELECT a, b, 2 AS kind, CAST((ceil(minutes) + 2) * 60 AS BIGINT) AS seconds, metres FROM costed WHERE own OR metres <= 1000), timed AS (SELECT *, CAST(ceil(seconds / 60) AS BIGINT) AS minutes FROM kept)
SELECT * FROM timed UNION ALL SELECT b, a, kind, seconds, metres, minutes FROM timed""",
    "nearest_track_point": f"""{_HEAD}, point AS (SELECT p_partkey AS point, CAST(p_size % 5 AS BIGINT) AS line, {_PLACE.format(k='(p_partkey * 3 + 1)')} FROM part), close AS (
  SELECT * FROM (SELECT stop, point.line, point, {haversine_sql('place.lat', 'place.lon', 'point.lat', 'point.lon')} AS m FROM place, point) WHERE m < 1000
), by_line AS (SELECT stop, line, min(struct_pack(m := m, p := point)) AS x FROM close GROUP BY stop, line), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stop ORDER BY x) AS rank, min(x.m) OVER (PARTITION BY stop) AS least FROM by_line
) SELECT stop, line, x.p AS point, CAST(round(x.m) AS BIGINT) AS metres FROM ranked WHERE x.m <= 400 OR (least > 400 AND rank = 1)""",
    "shape_length": f"{_HEAD}, step AS (SELECT trip, lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM day_time JOIN place USING (stop) WINDOW w AS (PARTITION BY trip ORDER BY seq)) SELECT trip, CAST(round(coalesce(sum({haversine_sql('la', 'lo', 'lat', 'lon')}), 0)) AS BIGINT) AS metres FROM step GROUP BY trip",
    "shape_slice": f"""{_HEAD}, line_points AS (SELECT trip AS hop, seq, lat, lon FROM day_time JOIN place USING (stop)), ends AS (
  SELECT hop, arg_max(lat, seq) - 0.0003 AS lat2, arg_max(lon, seq) + 0.0002 AS lon2, max(CASE WHEN seq = 2 THEN lat END) + 0.0003 AS lat1, max(CASE WHEN seq = 2 THEN lon END) - 0.0002 AS lon1 FROM line_points GROUP BY hop
), d AS (SELECT hop, seq, pow(lat - lat1, 2) + pow(lon - lon1, 2) AS d1, pow(lat - lat2, 2) + pow(lon - lon2, 2) AS d2 FROM line_points JOIN ends USING (hop)), i AS (
  SELECT hop, min(struct_pack(d := d1, s := seq)).s AS i, min(struct_pack(d := d2, s := seq)).s AS whole FROM d GROUP BY hop
), j AS (SELECT hop, min(struct_pack(d := d2, s := seq)).s AS j FROM d JOIN i USING (hop) WHERE seq >= i GROUP BY hop)
SELECT hop, CASE WHEN j > i THEN i ELSE least(i, whole) END AS first, CASE WHEN j > i THEN j ELSE greatest(i, whole) END AS last FROM i JOIN j USING (hop)""",
    "track_components": f"{_HEAD}, {_COMPONENT} SELECT node, component FROM component",
    "component_bridges": f"""{_HEAD}, {_COMPONENT}, node AS (SELECT stop, component, lat, lon FROM component JOIN place ON stop = node), close AS (
  SELECT * FROM (SELECT a.component AS ca, b.component AS cb, a.stop AS a, b.stop AS b, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM node a JOIN node b ON a.component < b.component) WHERE m < 500
) SELECT x.a AS a, x.b AS b, CAST(round(x.m) AS BIGINT) AS metres FROM (SELECT min(struct_pack(m := m, a := a, b := b)) AS x FROM close GROUP BY ca, cb)""",
    "shortest_path_len": f"{_HEAD}, far AS (SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(n_nationkey AS BIGINT) AS node, CAST(0 AS BIGINT) AS length FROM nation JOIN stops ON stop = n_nationkey UNION SELECT source, b, length + minutes FROM far JOIN walk ON node = a WHERE length < 400) SELECT source, node, min(length) AS length FROM far GROUP BY source, node",
    "segment_speed_checks": f"""{_HEAD}, hop AS (
  SELECT trip, seq, arr, dep, lead(arr) OVER w AS na, lead(dep) OVER w AS nd, lat, lon, lead(lat) OVER w AS la, lead(lon) OVER w AS lo FROM day_time JOIN place USING (stop) WINDOW w AS (PARTITION BY trip ORDER BY seq)
), checked AS (SELECT trip, seq, arr > dep OR dep > na OR na > nd AS back, {haversine_sql('lat', 'lon', 'la', 'lo')} / 1000 AS km, na - dep AS minutes FROM hop WHERE na IS NOT NULL)
SELECT 'trips' AS "check", 'times go back ' || trip || ' ' || seq AS problem FROM checked WHERE back
UNION ALL SELECT 'trips', 'too fast ' || trip || ' ' || seq FROM checked WHERE NOT back AND km > 1.5 AND (minutes = 0 OR km * 60 > 120 * minutes)
UNION ALL SELECT 'trips', 'too long ' || trip FROM day_time GROUP BY trip HAVING max(arr) - min(dep) > 330""",
    "trunk_order_check": f"{_HEAD}, {_TRUNK} SELECT 'lines' AS \"check\", 'out of order ' || trip AS problem FROM trunk_bad",
    "reference_checks": f"{_HEAD}, {_REFERENCES} SELECT 'references' AS \"check\", problem FROM refs",
    "station_checks": f"{_HEAD}, {_STATIONS} SELECT 'stations' AS \"check\", problem FROM station_bad",
    "coverage_diff": f"{_HEAD}, {_COVERAGE} SELECT 'coverage' AS \"check\", problem FROM uncovered",
    "footpath_checks": f"{_HEAD}, {_FOOT} SELECT 'footpaths' AS \"check\", problem FROM foot_bad",
    "headway_stats": "WITH dep AS (SELECT event_type AS line, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute FROM events) " + _HEADWAY.format(lo=28401600 + 480, hi=28401600 + 1920),
    "metro_facts": timetable_queries._HEADWAYS + ", dep AS (SELECT line || '-' || dir AS line, minute FROM departures) " + _HEADWAY.format(lo=480, hi=540),
    "quality_report": f"""{_HEAD}, {_TRUNK}, {_REFERENCES}, {_STATIONS}, {_COVERAGE}, {_FOOT}, found AS (
  SELECT 'lines' AS "check", 'out of order ' || trip AS problem FROM trunk_bad UNION ALL SELECT 'references', problem FROM refs UNION ALL SELECT 'stations', problem FROM station_bad
  UNION ALL SELECT 'coverage', problem FROM uncovered UNION ALL SELECT 'footpaths', problem FROM foot_bad
), ranked AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY problem) AS rank FROM found)
SELECT "check", count(*) AS n, string_agg(problem, '; ' ORDER BY problem) FILTER (WHERE rank <= 15) AS listed FROM ranked GROUP BY "check"
""",
}
