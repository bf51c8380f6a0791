"""Checks of a network: each gives (check, problem) rows, and a report counts and lists them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine
from wayfold.operators.geometry import near_pairs

#: Fixed values of the reference's checks.
MAX_SPEED_KMH, LONG_HOP_KM, MAX_TRIP_MINUTES, STOP_METRES, MAX_FOOTPATH_METRES, REPORTED = 120, 1.5, 330, 200, 1200, 15
MAX_GAP_MINUTES, PEAK_MINUTES, LENGTHS, MAX_METRO_KMH = 15, 0.6, (0.8, 1.15), 90


def problems(df: DataFrame, check: str, *parts: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.concat_ws(" ", *parts).alias("problem"))


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def each(df: DataFrame, check: str, *found: tuple) -> DataFrame:
    """The problems (condition, parts ..) of all conditions that a row meets, by one pass over the rows."""
    texts = F.array_compact(F.array(*(F.when(condition, F.concat_ws(" ", *parts)) for condition, *parts in found)))
    rows = df.where(reduce(lambda a, b: a | b, (F.coalesce(condition, F.lit(False)) for condition, *_ in found)))
    return rows.select(F.lit(check).alias("check"), F.explode(texts).alias("problem"))


def references(stops: DataFrame, routes: DataFrame, trips: DataFrame, calls: DataFrame) -> DataFrame:
    """Broken references among stops (stop), routes (route), trips (trip, route) and calls (trip, stop)."""
    text = lambda c: F.col(c).cast("string")
    return together(
        problems(trips.join(routes, "route", "left_anti"), "references", F.lit("unknown route of trip"), text("trip")),
        problems(trips.join(calls, "trip", "left_anti"), "references", F.lit("no calls of trip"), text("trip")),
        problems(calls.select("trip").join(trips.select("trip"), "trip", "left_anti").distinct(), "references", F.lit("calls of unknown trip"), text("trip")),
        problems(stops.join(calls.select("stop").distinct(), "stop", "left_anti"), "references", F.lit("unserved stop"), text("stop")),
        problems(calls.select("trip", "stop").join(stops, "stop", "left_anti").distinct(), "references", F.lit("unknown stop"), text("stop"), F.lit("of trip"), text("trip")),
        problems(routes.join(trips, "route", "left_anti"), "references", F.lit("no trips of route"), text("route")),
    )


def stations(places: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Of stops (stop, name, lat, lon): equal names, stops too close, stops outside (south, west, north, east)."""
    south, west, north, east = box
    name = F.regexp_replace(F.lower("name"), " ", "")
    twice = places.groupBy(name.alias("name")).count().where("count > 1")
    side = lambda k: places.select(F.col("stop").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    close = near_pairs(side("a"), side("b"), STOP_METRES).where("a < b")
    outside = places.where(~(F.col("lat").between(south, north) & F.col("lon").between(west, east)))
    text = lambda c: F.col(c).cast("string")
    return together(problems(twice, "stations", F.lit("name twice"), F.col("name")), problems(close, "stations", F.lit("too close"), text("a"), text("b")), problems(outside, "stations", F.lit("outside"), text("stop")))


def northward(places: DataFrame, order: DataFrame, tolerance: float) -> DataFrame:
    """Stops of a line's order (line, pos, stop) that lie south of the one before by more than the tolerance in degrees."""
    w = Window.partitionBy("line").orderBy("pos")
    rows = order.join(places.select("stop", "lat"), "stop").withColumns({"before": F.lag("stop").over(w), "before_lat": F.lag("lat").over(w)})
    return problems(rows.where(F.col("lat") < F.col("before_lat") - tolerance), "stations", F.lit("south of"), *(F.col(c).cast("string") for c in ("line", "before", "stop")))


def filed_lines(calls: DataFrame, trips: DataFrame, expected: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Trips (trip, route) that serve a stop of another route (expected: stop, route) or one that their route never serves (forbidden: route, stop)."""
    # calls at other stops can't be told of, so they meet no trip
    served = lambda stops: calls.select("trip", "stop").join(stops.select("stop").distinct(), "stop", "left_semi").distinct().join(trips, "trip")
    text = lambda c: F.col(c).cast("string")
    wrong = served(expected).join(expected.select("stop", F.col("route").alias("wanted")), "stop").where(F.col("route") != F.col("wanted"))
    return together(
        problems(wrong, "lines", F.lit("wrong route"), text("trip"), text("stop"), text("wanted")),
        problems(served(forbidden).join(forbidden, ["route", "stop"], "left_semi"), "lines", F.lit("forbidden stop"), text("trip"), text("stop")),
    )


def shapes_by_stops(points: DataFrame, calls: DataFrame, places: DataFrame, metres: float = 1500) -> DataFrame:
    """Shapes (shape, seq, lat, lon) none of whose points is near enough to a stop that they serve; calls: (shape, stop)."""
    at = calls.select("shape", "stop").join(places.select("stop", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")), "stop")
    near = points.join(at, "shape").groupBy("shape", "stop").agg(F.min(haversine(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))).alias("m"))
    return problems(near.where(F.col("m") > metres), "shapes", F.lit("passes by"), F.col("shape").cast("string"), F.col("stop").cast("string"))


def own_tracks(points: DataFrame, tracks: DataFrame, wanted: DataFrame | Column) -> DataFrame:
    """Shapes that run over tracks of other lines only: points meet tracks (lat, lon, line) at five decimals.

    wanted: (shape, line), or the line as a column of the shape, which takes no join.
    """
    key = [F.round(c, 5).alias(c) for c in ("lat", "lon")]
    lines = tracks.select(*key, "line").groupBy("lat", "lon").agg(F.collect_set("line").alias("lines"))
    met = points.select("shape", *key).join(lines, ["lat", "lon"])
    rows = (met.withColumn("line", wanted) if isinstance(wanted, Column) else met.join(wanted, "shape")).where(~F.array_contains("lines", F.col("line")))
    off = rows.select("shape", F.explode("lines").alias("off")).distinct()
    return problems(off, "shapes", F.lit("on tracks of"), F.col("shape").cast("string"), F.col("off").cast("string"))


def facts(stats: DataFrame, published: DataFrame) -> DataFrame:
    """Lines whose statistics (line, first, last, longest, peak_mean, minutes, km) differ from what is published.

    published: (line, first, last, peak, minutes, km); a null fact isn't checked.
    A published line without statistics is named too.
    """
    rows = published.select("line", *(F.col(c).alias(f"p_{c}") for c in ("first", "last", "peak", "minutes", "km"))).join(stats.withColumn("there", F.lit(True)), "line", "left")
    line = F.col("line").cast("string")
    return each(
        rows, "metro",
        (F.col("there").isNull(), F.lit("no trains"), line),
        ((F.col("first") != F.col("p_first")) | (F.col("last") != F.col("p_last")), F.lit("first or last train"), line),
        (F.col("longest") > MAX_GAP_MINUTES, F.lit("gap"), line),
        (F.abs(F.col("peak_mean") - F.col("p_peak")) > PEAK_MINUTES, F.lit("headway"), line),
        (F.abs(F.col("minutes") - F.col("p_minutes")) > 1, F.lit("end to end"), line),
        (~F.col("km").between(LENGTHS[0] * F.col("p_km"), LENGTHS[1] * F.col("p_km")), F.lit("length"), line),
    )


def line_orders(stations: DataFrame, trips: DataFrame, published: DataFrame) -> DataFrame:
    """Lines that lack stations or trips of a direction, or whose stations aren't in the published order.

    stations: (line, pos, name); trips: (line, dir); published: (line, stations,
    keys: array). A published line counts even if nothing is known of it. A key
    stands for the first station whose name holds it, in any case; keys must
    stand for stations farther and farther along, and the first that doesn't is
    named. Order is only looked at where both directions have trips.
    """
    own = stations.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.lower("name").alias("name")))), lambda x: x["name"]).alias("names"))
    ways = trips.groupBy("line").agg(F.coalesce(F.bool_or(F.col("dir") == 0) & F.bool_or(F.col("dir") == 1), F.lit(False)).alias("both"))
    rows = published.join(own, "line", "left").join(ways, "line", "left").withColumns({"names": F.coalesce("names", F.array().cast("array<string>")), "both": F.coalesce("both", F.lit(False))}).withColumn("n", F.size("names"))
    start = F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("bad"))

    def step(acc: Column, key: Column) -> Column:
        hit = F.array_min(F.filter(F.transform("names", lambda name, i: F.when(F.contains(name, F.lower(key)), i)), lambda i: i.isNotNull()))
        fits = F.coalesce(hit > acc["at"], F.lit(False))
        return F.when(acc["bad"].isNotNull(), acc).otherwise(F.struct(F.when(fits, hit).otherwise(acc["at"]).alias("at"), F.when(~fits, key).alias("bad")))

    rows = rows.withColumn("bad", F.aggregate("keys", start, step)["bad"])
    line = F.col("line").cast("string")
    return each(
        rows, "metro",
        (F.col("n") != F.col("stations"), F.lit("stations"), line, F.col("n").cast("string"), F.lit("of"), F.col("stations").cast("string")),
        (~F.col("both"), F.lit("no trips in one direction"), line),
        (F.col("both") & F.col("bad").isNotNull(), F.lit("missing or out of order"), line, F.col("bad")),
    )


def metro_hops(times: DataFrame, places: DataFrame) -> DataFrame:
    """Hops of trips (trip, seq, stop, arr, dep) of less than a minute, or of more than half a kilometre at over 90 km/h."""
    w = Window.partitionBy("trip").orderBy("seq")
    rows = times.join(places.select("stop", "lat", "lon"), "stop").withColumns({f"next_{c}": F.lead(c).over(w) for c in ("stop", "arr", "lat", "lon")})
    rows = rows.withColumns({"km": haversine(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")) / 1000, "minutes": F.col("next_arr") - F.col("dep")})
    bad = (F.col("minutes") < 1) | ((F.col("km") > 0.5) & (F.col("km") * 60 > MAX_METRO_KMH * F.col("minutes")))
    return problems(rows.where(bad), "metro", F.lit("hop"), F.col("trip").cast("string"), F.col("seq").cast("string"))


def loaded(stops: DataFrame, trips: DataFrame, calls: DataFrame, transfers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a network is built of: stops with an id, calls of known stops and trips, trips with calls, transfers between two known stops.

    Transfers (a, b) from a stop to itself go as well.
    """
    stops = stops.where((F.col("stop") != "") & F.col("stop").isNotNull())
    calls = calls.join(stops.select("stop"), "stop", "left_semi").join(trips.select("trip"), "trip", "left_semi")
    trips = trips.join(calls.select("trip"), "trip", "left_semi")
    end = lambda c: stops.select(F.col("stop").alias(c))
    transfers = transfers.where(F.col("a") != F.col("b")).join(end("a"), "a", "left_semi").join(end("b"), "b", "left_semi")
    return stops, trips, calls, transfers


def trips(times: DataFrame, places: DataFrame) -> DataFrame:
    """Of trips' calls (trip, seq, stop, arr, dep): one call only, a stop twice, times that go back, impossible speeds, very long trips."""
    w = Window.partitionBy("trip").orderBy("seq")
    rows = times.join(places.select("stop", "lat", "lon"), "stop")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("stop", "arr", "dep", "lat", "lon")}).where(F.col("next_stop").isNotNull())
    km = haversine(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")) / 1000
    rows = rows.withColumns({"km": km, "minutes": F.col("next_arr") - F.col("dep")})
    back = (F.col("arr") > F.col("dep")) | (F.col("minutes") < 0) | (F.col("next_arr") > F.col("next_dep"))
    fast = ~back & (F.col("km") > LONG_HOP_KM) & ((F.col("minutes") == 0) | (F.col("km") * 60 > MAX_SPEED_KMH * F.col("minutes")))
    whole = times.groupBy("trip").agg(F.count("*").alias("n"), F.countDistinct("stop").alias("stops"), (F.max("arr") - F.min("dep")).alias("length"))
    hop = [F.col(c).cast("string") for c in ("trip", "seq")]
    trip = F.col("trip").cast("string")
    return together(
        each(rows, "trips", (back, F.lit("times go back"), *hop), (fast, F.lit("too fast"), *hop)),
        each(whole, "trips", (F.col("n") < 2, F.lit("one call"), trip), (F.col("stops") < F.col("n"), F.lit("stop twice"), trip), (F.col("length") > MAX_TRIP_MINUTES, F.lit("too long"), trip)),
    )


def trunk_order(calls: DataFrame, trunk: DataFrame) -> DataFrame:
    """Trips that visit the stops of a trunk (stop, pos) neither all upwards nor all downwards."""
    w = Window.partitionBy("trip").orderBy("seq")
    rows = calls.join(trunk, "stop").withColumn("before", F.lag("pos").over(w)).where(F.col("before").isNotNull())
    bad = rows.groupBy("trip").agg(F.bool_and(F.col("pos") >= F.col("before")).alias("up"), F.bool_and(F.col("pos") <= F.col("before")).alias("down")).where("NOT up AND NOT down")
    return problems(bad, "lines", F.lit("out of order"), F.col("trip").cast("string"))


def coverage(source: DataFrame, compiled: DataFrame, known_missing: DataFrame) -> DataFrame:
    """Trains of the source without a trip, less those known to be missing; all (train)."""
    return problems(source.select("train").distinct().join(compiled, "train", "left_anti").join(known_missing, "train", "left_anti"), "coverage", F.lit("no trip of train"), F.col("train").cast("string"))


def footpaths(walks: DataFrame, lines: DataFrame, known: DataFrame) -> DataFrame:
    """Of footpaths (a, b, minutes, metres): no equal reverse, too long, odd speed, both ends on one line; and known ones (a, b) that lack."""
    back = walks.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("minutes").alias("back"))
    line = lambda k: lines.select(F.col("stop").alias(k), F.col("line").alias(f"line_{k}"))
    rows = walks.join(back, ["a", "b"], "left").join(line("a"), "a", "left").join(line("b"), "b", "left")
    pair = [F.col(c).cast("string") for c in ("a", "b")]
    return together(
        problems(rows.where(~F.coalesce(F.col("back") == F.col("minutes"), F.lit(False))), "footpaths", F.lit("no reverse"), *pair),
        problems(rows.where(F.col("metres") > MAX_FOOTPATH_METRES), "footpaths", F.lit("too long"), *pair),
        problems(rows.where((F.col("minutes") < F.col("metres") / 100) | (F.col("minutes") > F.col("metres") / 50 + 6)), "footpaths", F.lit("odd speed"), *pair),
        problems(rows.where(F.col("line_a") == F.col("line_b")), "footpaths", F.lit("same line"), *pair),
        problems(known.join(walks, ["a", "b"], "left_anti"), "footpaths", F.lit("lacks"), *pair),
    )


def shape_ends(points: DataFrame, calls: DataFrame, places: DataFrame, metres: float = 1500) -> DataFrame:
    """Shapes (shape, seq, lat, lon) that no trip uses, trips' shapes that lack, and ends too far from the first and last stop.

    calls: (shape, seq, stop) of one trip of each shape.
    """
    end = lambda f, *c: f(F.when(F.col(c[-1]).isNotNull(), F.struct("seq", *c)))
    ends = lambda df, *c: df.groupBy("shape").agg(end(F.min, *c).alias("first"), end(F.max, *c).alias("last"), F.lit(True).alias("there"))
    at = ends(calls.join(places.select("stop", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")), "stop", "left"), "s_lat", "s_lon", "stop")
    drawn = ends(points, "lat", "lon").select("shape", F.col("first").alias("p1"), F.col("last").alias("p2"), F.col("there").alias("drawn"))
    far = lambda p, s: haversine(F.col(f"{p}.lat"), F.col(f"{p}.lon"), F.col(f"{s}.s_lat"), F.col(f"{s}.s_lon")) > metres
    # both sides have one row for each shape, so all is told by one join
    what = F.when(F.col("there").isNull(), "unused").when(F.col("drawn").isNull(), "missing").when(far("p1", "first") | far("p2", "last"), "ends away")
    return problems(drawn.join(at, "shape", "full").withColumn("what", what).where("what IS NOT NULL"), "shapes", F.col("what"), F.col("shape").cast("string"))


def headways(departures: DataFrame, peak: tuple[int, int]) -> DataFrame:
    """(line, first, last, n, longest, peak_mean) of departures (line, minute): gaps, and their mean after departures in [peak).

    Gaps are found day by day; those over midnights from each day's first minute.
    Departures of a line's same minute are one row, with gaps of no minute between them.
    A day is summed up before the days of its line meet, and nothing is joined:
    how many departures there are can't be told from the tables that they are
    made from, so a join's side that looks small may be too large for the driver.
    """
    day = F.floor(F.col("minute") / 1440)
    rows = departures.where("line IS NOT NULL AND minute IS NOT NULL").groupBy("line", "minute").agg(F.count("*").alias("same")).withColumn("day", day)
    inside = lambda minute: (minute >= peak[0]) & (minute < peak[1])
    gap = F.lead("minute").over(Window.partitionBy("line", "day").orderBy("minute")) - F.col("minute")
    within = inside(F.col("minute")) & F.col("gap").isNotNull()
    days = rows.withColumn("gap", gap).groupBy("line", "day").agg(
        F.min("minute").alias("first"), F.max("minute").alias("last"), F.sum("same").alias("n"), F.max("gap").alias("longest"), F.sum(F.when(within, F.col("gap"))).alias("sum"), F.sum(F.when(within, F.col("same"))).alias("gaps"), F.max_by("same", "minute").alias("same")
    )
    over = F.lead("first").over(Window.partitionBy("line").orderBy("day")) - F.col("last")
    days = days.withColumn("over", over).withColumn("night", F.when(F.col("same") > 1, F.coalesce("over", F.lit(0))).otherwise(F.col("over")))
    late, none = inside(F.col("last")), F.lit(0)
    total = F.sum(F.coalesce("sum", none)) + F.coalesce(F.sum(F.when(late, F.col("night"))), none)
    gaps = F.sum(F.coalesce("gaps", none)) + F.coalesce(F.sum(F.when(late, F.col("same") - F.col("over").isNull().cast("long"))), none)
    return days.groupBy("line").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max(F.greatest("longest", "night")).alias("longest"), (total / F.nullif(gaps, none)).alias("peak_mean"))


def report(found: DataFrame, shown: int = REPORTED) -> DataFrame:
    """(check, n, listed): how many problems each check has, and the first of them. Reads found once for each check, and twice more."""
    counts = found.groupBy("check").agg(F.count("*").alias("n"))
    # a task keeps the first of each check as rows pass by; a window would sort all of them
    first = [found.where(F.col("check").eqNullSafe(c)).orderBy("problem").limit(shown) for (c,) in counts.select("check").collect()]
    listed = together(found.limit(0), *first).groupBy("check").agg(F.array_join(F.array_sort(F.collect_list("problem")), "; ").alias("listed"))
    return counts.join(listed, "check")


def request_faults(requests: DataFrame, stations: DataFrame) -> DataFrame:
    """requests (source, target, at; texts) with fault: null, or the first of source, target, at that can't be asked.

    A station is one whose key (stations.key) equals the text, to the letter; a
    time is one to four digits 0-9 and nothing else, below a day's 1440 minutes.
    Nulls are faults. Each row of requests gives one row, whatever repeats.
    """
    keys = stations.where("key IS NOT NULL").select("key").distinct()
    known = lambda name: keys.select(F.col("key").alias(name), F.lit(True).alias(f"{name}_known"))
    at = F.col("at").rlike(r"\A[0-9]{1,4}\z") & (F.expr("try_cast(at AS INT)") < 1440)
    fault = F.when(F.col("source_known").isNull(), "source").when(F.col("target_known").isNull(), "target").when(~F.coalesce(at, F.lit(False)), "at")
    return requests.join(known("source"), "source", "left").join(known("target"), "target", "left").select(*requests.columns, fault.alias("fault"))
