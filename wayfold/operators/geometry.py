"""Tracks, walks and shapes: pairs by distance, transfers, components, shortest paths, snapping and slices."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import cell, haversine
from wayfold.sources.shared import arrow_files, written

#: Fixed values of the reference, in metres: walks, bridges between track parts, snapping per line and at all, metro stations from their track.
WALK_METRES, BRIDGE_METRES, SNAP_LINE, SNAP_ANY, TRACK_METRES = 1000, 500, 400, 1000, 250
#: Cells to a distance in joins of near pairs, and metres within which the nearest is sought before any farther.
CELLS, RINGS = 4, (25, 100)
#: Shapes that a task snaps at a time, stops whose candidates it holds (some 50 KB each), and files of all candidates.
HELD_SHAPES, HELD_STOPS, CANDIDATE_FILES = 200, 1000, 16


def _around(df: DataFrame, lat: str, lon: str, metres: float, reach: int = 1) -> DataFrame:
    """df with (row, column) of each cell that may hold a place closer than `metres`; cells are metres / reach wide."""
    row, column = cell(F.col(lat), F.col(lon), metres / reach)
    steps = range(-reach, reach + 1)
    cells = F.array(*(F.struct((row + i).alias("row"), (column + j).alias("column")) for i in steps for j in steps))
    return df.select("*", F.inline(cells))


def near_pairs(left: DataFrame, right: DataFrame, metres: float, cells: int = CELLS) -> DataFrame:
    """left (a, a_lat, a_lon, ..) with right (b, b_lat, b_lon, ..) closer than `metres`, and the distance m.

    An equi join over grid cells: the right side is entered in the cells around
    its own, so no product of the two is made. Both sides are dealt by cell into
    a given number of tasks, as the work is in the pairs and not in the bytes:
    small tables would be broadcast, or merged into few tasks. So many cells
    make up the distance, so that a dense place is dealt over many; fewer are
    for rows of many bytes, as each is entered (2 * cells + 1) squared times.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row, column = cell(F.col("a_lat"), F.col("a_lon"), metres / cells)
    dealt = left.withColumns({"row": row, "column": column}).repartition(tasks, "row", "column")
    spread = _around(right.repartition(tasks), "b_lat", "b_lon", metres, cells).repartition(tasks, "row", "column")
    m = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    # a degree of latitude is more than 111 kilometres
    likely = F.abs(F.col("a_lat") - F.col("b_lat")) * 111_000 < metres
    joined = dealt.hint("merge").join(spread, ["row", "column"]).where(likely)
    return joined.withColumn("m", m).where(F.col("m") < metres).drop("row", "column")


def nearest_of(asked: DataFrame, spots: DataFrame, rings: tuple[float, ...], *on: str) -> DataFrame:
    """(a, *on, x: (m, b)): the nearest spot (b, b_lat, b_lon, *on), of equal ones the least b, to each place asked for (a, a_lat, a_lon, *on).

    None is farther than the last ring. A ring is searched only for those that
    have none in the ring before, over cells as wide as the ring, so a place
    meets the few spots near it and not all within the last ring. Equal columns
    `on` may be null.
    """
    spots = written(spots.groupBy(*on, "b_lat", "b_lon").agg(F.min("b").alias("b")), "spots")
    asked = written(asked, "asked")
    far = spots.select("b", "b_lat", "b_lon", *(F.col(c).alias(f"b_{c}") for c in on))
    out = None
    for metres in rings:
        row, column = cell(F.col("b_lat"), F.col("b_lon"), metres)
        held = far.withColumns({"b_row": row, "b_column": column})
        same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in (*on,)] + [F.col(c) == F.col(f"b_{c}") for c in ("row", "column")]
        rows = _around(asked, "a_lat", "a_lon", metres).hint("merge").join(held, same)
        m = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
        found = written(rows.withColumn("m", m).where(F.col("m") < metres).groupBy("a", *on).agg(F.min(F.struct("m", "b")).alias("x")), "nearest")
        out = found if out is None else out.unionByName(found)
        if metres != rings[-1]:
            known = found.select(F.col("a").alias("known"), *(F.col(c).alias(f"known_{c}") for c in on))
            asked = written(asked.join(known, [F.col("a") == F.col("known")] + [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in on], "left_anti"), "asked")
            if asked.isEmpty():
                break
    return out


def transfers(pairs: DataFrame, manual: DataFrame) -> DataFrame:
    """(a, b, kind, seconds, metres, minutes), both ways, of pairs (a < b, m) and manual interchanges (a, b, metres).

    A manual interchange replaces the routed walk at 80 metres a minute and may
    be longer than the limit; every transfer takes two minutes more than the
    walk, in whole minutes.
    """
    routed = pairs.join(manual.select("a", "b", F.col("metres").alias("own")), ["a", "b"], "left")
    metres = F.coalesce("own", F.round(F.col("m") * 1.3).cast("long"))
    minutes = F.when(F.col("own").isNotNull(), F.bround(F.col("own") / 80.0, 1)).otherwise(F.col("m") * 1.3 / 75.0)
    kept = routed.withColumns({"metres": metres, "minutes": minutes}).where(F.col("own").isNotNull() | (F.col("metres") <= WALK_METRES))
    out = kept.select("a", "b", F.lit(2).alias("kind"), ((F.ceil("minutes") + 2) * 60).cast("long").alias("seconds"), "metres").withColumn("minutes", F.ceil(F.col("seconds") / 60))
    return out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind", "seconds", "metres", "minutes"))


def nearest(stops: DataFrame, points: DataFrame) -> DataFrame:
    """(stop, line, point, m): for each stop the nearest point of each line up to 400 metres, else the nearest of all up to 1000.

    A stop is asked only for the lines that have points in the cells around it.
    """
    here = written(stops.select(F.col("stop").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), "stops")
    spots = points.select(F.col("point").alias("b"), "line", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    # one metre more, as those found are closer than the limit and a point may be just as far
    limit = SNAP_LINE + 1
    row, column = cell(F.col("b_lat"), F.col("b_lon"), limit)
    lines = spots.select(row.alias("row"), column.alias("column"), "line").distinct()
    asked = _around(here, "a_lat", "a_lon", limit).join(lines, ["row", "column"]).select("a", "a_lat", "a_lon", "line").distinct()
    own = nearest_of(asked, spots, (*RINGS, limit), "line").where(F.col("x.m") <= SNAP_LINE).select("a", "line", "x.m", "x.b")
    rest = here.join(own.select("a"), "a", "left_anti")
    any_line = nearest_of(rest, spots.withColumn("b", F.struct("b", "line")), (SNAP_ANY,)).select("a", "x.b.line", "x.m", "x.b.b")
    return own.unionByName(any_line).select(F.col("a").alias("stop"), "line", F.col("b").alias("point"), "m")


def on_track(stations: DataFrame, nodes: DataFrame, metres: float = TRACK_METRES) -> DataFrame:
    """(station, node, m): the track node (node, lat, lon) nearest to each station (station, lat, lon), of equal ones the least.

    A job that reads a station with no node within so many metres ends with an error.
    """
    here = stations.select(F.col("station").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    spots = nodes.select(F.col("node").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    # one metre more, as those found are closer than the limit and a node may be just as far
    rings = (*(r for r in RINGS if r < metres), metres + 1)
    best = nearest_of(here, spots, rings).where(F.col("x.m") <= metres).select(F.col("a").alias("station"), "x")
    off = F.raise_error(F.concat_ws(" ", F.lit("no track within"), F.lit(str(metres)), F.lit("metres of station"), F.col("station").cast("string")))
    rows = stations.select("station").join(best, "station", "left")
    return rows.select("station", F.coalesce("x.b", off.cast(nodes.schema["node"].dataType)).alias("node"), F.col("x.m").alias("m"))


def without_repeats(points: DataFrame, key: str, order: str) -> DataFrame:
    """Points of polylines less those equal to the one before."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.lag("lat").over(w).eqNullSafe(F.col("lat")) & F.lag("lon").over(w).eqNullSafe(F.col("lon"))
    return points.withColumn("same", same).where(~F.col("same")).drop("same")


def lengths(points: DataFrame, key: str, order: str) -> DataFrame:
    """(key, metres) of polylines."""
    w = Window.partitionBy(key).orderBy(order)
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("step", step).groupBy(key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("metres"))


def geojson(points: DataFrame, key: str, order: str) -> DataFrame:
    """(key, feature): each polyline as a GeoJSON feature."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(order, "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    grouped = points.groupBy(key).agg(line.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col(key).alias("id")).alias("properties"), F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"))
    return grouped.select(key, F.to_json(feature).alias("feature"))


def _lines(points: DataFrame) -> DataFrame:
    """(shape, line): the vertices of each shape (shape, seq, lat, lon), in order."""
    return points.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("line"))


def _cut(rows: DataFrame) -> DataFrame:
    """rows (line, lat1, lon1, lat2, lon2, ..) with first and last, as slices finds them."""
    near = lambda p, n: F.pow(p["lat"] - F.col(f"lat{n}"), 2) + F.pow(p["lon"] - F.col(f"lon{n}"), 2)
    best = lambda v, n: F.array_min(F.transform(v, lambda p: F.struct(near(p, n).alias("d"), p["seq"].alias("seq"))))["seq"]
    ends = rows.withColumns({"i": best(F.col("line"), 1), "whole": best(F.col("line"), 2)})
    ends = ends.withColumn("j", best(F.filter("line", lambda p: p["seq"] >= F.col("i")), 2))
    on = F.col("j") > F.col("i")
    cut = {"first": F.when(on, F.col("i")).otherwise(F.least("i", "whole")), "last": F.when(on, F.col("j")).otherwise(F.greatest("i", "whole"))}
    return ends.withColumns(cut).drop("i", "whole", "j")


def slices(points: DataFrame, hops: DataFrame) -> DataFrame:
    """(hop, first, last): the part of a shape between the vertices nearest to a hop's ends.

    points: (shape, seq, lat, lon); hops: (hop, shape, lat1, lon1, lat2, lon2).
    Nearness is by squared degrees, the first of equals. The end is sought from
    the start on; if nothing beyond the start is nearer, the shape runs the
    other way and both ends are sought in all of it.
    """
    return _cut(hops.join(_lines(points), "shape")).select("hop", "first", "last")


def with_via(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """(trip, seq, stop): calls with a point put in between, where a rule (a, b, via) names their neighbours; numbered anew."""
    w = Window.partitionBy("trip").orderBy("seq")
    rows = calls.withColumn("next", F.lead("stop").over(w))
    put = rows.join(rules, (F.col("stop") == F.col("a")) & (F.col("next") == F.col("b"))).select("trip", "seq", F.lit(1).alias("k"), F.col("via").alias("stop"))
    both = rows.select("trip", "seq", F.lit(0).alias("k"), "stop").unionByName(put)
    return both.select("trip", F.row_number().over(Window.partitionBy("trip").orderBy("seq", "k")).cast("long").alias("seq"), "stop")


def largest_part(edges: DataFrame, nodes: DataFrame, metres: float = BRIDGE_METRES) -> DataFrame:
    """Nodes (node, lat, lon) of the largest part of a track, once its parts are joined by bridges between their closest nodes.

    Of parts of equal size the one of the least node is kept.
    """
    parts = track_components(edges).join(nodes, "node")
    joined = edges.select("a", "b").unionByName(bridges(parts, metres).select("a", "b"))
    whole = written(track_components(joined), "joined")
    size = whole.groupBy("component").agg(F.count("*").alias("n")).agg(F.min_by("component", F.struct((-F.col("n")).alias("n"), "component")).alias("component"))
    return nodes.join(whole.join(F.broadcast(size), "component").select("node"), "node", "left_semi")


def track_graph(edges: DataFrame) -> DataFrame:
    """(a, b, minutes) both ways from edges (a, b, m): whole millimetres, one at least, so that sums are exact and no way is for nothing."""
    both = edges.select("a", "b", "m").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "m")).where("a <> b")
    return both.groupBy("a", "b").agg(F.greatest(F.lit(1), F.round(F.min("m") * 1000)).cast("long").alias("minutes"))


def track_paths(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, m, nodes): the shortest way along a track_graph between the nodes of pairs (a, b), from a to b.

    Lengths come first. From them each node reached gets the node before it, the
    least that a shortest way may come from, and from these the nodes 2, 4, 8 ..
    before it. A wanted end then takes in the nodes that lie the largest of
    these jumps back, all of them those of the next smaller jump, and so on: a
    way of n edges takes about log2(n) rounds, and only wanted ways are made.
    """
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    known = written(shortest_paths(graph, pairs.select(F.col("a").alias("source")), pairs), "known")
    step = known.join(graph, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), F.col("node").alias("before"), (F.col("length") + F.col("minutes")).alias("length"))
    before = step.join(known, ["source", "node", "length"]).where("node <> source").groupBy("source", "node").agg(F.min("before").alias("before"))
    jumps = [written(before, "jumps")]
    while not jumps[-1].isEmpty():
        jumps.append(written(jumps[-1].join(jumps[-1].select("source", F.col("node").alias("before"), F.col("before").alias("further")), ["source", "before"]).select("source", "node", F.col("further").alias("before")), "jumps"))
    reached = known.select(F.col("source").alias("a"), F.col("node").alias("b"), (F.col("length") / 1000).alias("m"))
    found = written(pairs.join(reached, ["a", "b"]), "found")
    rows = found.select(F.col("a").alias("source"), "b", F.col("b").alias("node"))
    for jump in reversed(jumps[:-1]):
        both = F.filter(F.array("node", "before"), lambda x: x.isNotNull())
        rows = written(rows.join(jump, ["source", "node"], "left").select("source", "b", F.explode(both).alias("node")), "ways")
    # no edge is for nothing, so lengths put the nodes of a way in order
    order = F.array_sort(F.collect_list(F.struct("length", "node")))
    ways = rows.join(known, ["source", "node"]).groupBy(F.col("source").alias("a"), "b").agg(F.transform(order, lambda x: x["node"]).alias("nodes"))
    return found.join(ways, ["a", "b"]).select("a", "b", "m", "nodes")


def path_or_line(pairs: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b, metres, straight, nodes): the way along the track of each pair (a, b), or the straight line where no track joins them.

    edges: (a, b, m) in metres; places: (node, lat, lon). A pair whose end has
    no place is left out.
    """
    end = lambda k: places.select(F.col("node").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    rows = pairs.select("a", "b").distinct().join(track_paths(track_graph(edges), pairs.select("a", "b")), ["a", "b"], "left").join(end("a"), "a").join(end("b"), "b")
    line = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return rows.select("a", "b", F.coalesce("m", line).alias("metres"), F.col("m").isNull().alias("straight"), F.coalesce("nodes", F.array("a", "b")).alias("nodes"))


def leg_lines(legs: DataFrame, points: DataFrame, places: DataFrame) -> DataFrame:
    """(leg, positions): each leg as a line: its stations, and between those of a ride the part of its shape.

    legs: (leg, shape, straight, from_stop, to_stop); a straight leg, or one of
    an unknown shape, has its stations only. points: (shape, seq, lat, lon);
    places: (stop, lat, lon). Legs and points that are dealt by shape already
    aren't dealt again, and a leg meets its shape once.
    """
    end = lambda k, n: places.select(F.col("stop").alias(k), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"))
    rows = legs.join(end("from_stop", 1), "from_stop").join(end("to_stop", 2), "to_stop").join(_lines(points), "shape", "left")
    rows = _cut(rows.withColumn("line", F.when(~F.col("straight"), F.col("line"))))
    place = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    at = lambda n: F.array(place(F.col(f"lat{n}"), F.col(f"lon{n}")))
    inner = F.transform(F.filter("line", lambda p: p["seq"].between(F.col("first"), F.col("last"))), lambda p: place(p["lat"], p["lon"]))
    return rows.select("leg", F.concat(at(1), F.coalesce(inner, F.array().cast("array<struct<lat:double,lon:double>>")), at(2)).alias("positions"))


def track_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of undirected edges (a, b): the least node that each is connected to.

    Every round takes the least label of the neighbours, then that label's own
    label, so labels travel twice as far each time; rounds are written to the
    shared folder.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    for _ in range(rounds):
        labels = written(labels, "labels")
        spread = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(labels.join(spread, F.col("node") == F.col("a"), "left").join(jump, "label", "left").select("node", F.col("label").alias("was"), F.least("label", "near", "further").alias("label")), "new")
        labels = new.select("node", "label")
        if new.where("label < was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components are not final after {rounds} rounds")


def bridges(nodes: DataFrame, metres: float = BRIDGE_METRES) -> DataFrame:
    """(a, b, m): for each pair of components of nodes (node, component, lat, lon) the closest two nodes, if close enough."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    pairs = near_pairs(side("a"), side("b"), metres).where(F.col("c_a") < F.col("c_b"))
    return pairs.groupBy("c_a", "c_b").agg(F.min(F.struct("m", "a", "b")).alias("x")).select("x.a", "x.b", "x.m")


def contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, hub, length, back) of directed edges (a, b, minutes), and how many rounds it took.

    Each round takes nodes out of the graph, none of them neighbours: those of
    fewer neighbours than all around them, of equal numbers by a hash. Their
    edges to what is left are rows, back if they lead from the hub to the node,
    and edges that stand for the ways through them are put in. A chain loses a
    third of its nodes a round, so rounds grow with the logarithm of a track.
    """
    left = written(edges.where("a <> b").groupBy("a", "b").agg(F.min("minutes").cast("long").alias("minutes")), "edges")
    out, rounds = None, 0
    while not left.isEmpty():
        sides = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
        rank = F.struct(F.count("*").alias("n"), F.xxhash64("node", F.lit(rounds)).alias("hash"), "node")
        ranks = sides.groupBy("node").agg(rank.alias("rank"))
        least = sides.join(ranks.select(F.col("node").alias("other"), F.col("rank").alias("around")), "other").groupBy("node").agg(F.min("around").alias("around"))
        taken = ranks.join(least, "node").where("rank < around").select("node")
        taken = written(taken, "taken")
        mark = lambda k: taken.select(F.col("node").alias(k), F.lit(True).alias(f"{k}_goes"))  # noqa: E731, B023
        told = written(left.join(mark("a"), "a", "left").join(mark("b"), "b", "left"), "edges")
        forth, back = told.where("a_goes").select("a", "b", "minutes"), told.where("b_goes").select("a", "b", "minutes")
        up = forth.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("minutes").alias("length"), F.lit(False).alias("back"))
        up = up.unionByName(back.select(F.col("b").alias("node"), F.col("a").alias("hub"), F.col("minutes").alias("length"), F.lit(True).alias("back")))
        through = back.join(forth.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("minutes").alias("more")), "b").where("a <> c").select("a", F.col("c").alias("b"), (F.col("minutes") + F.col("more")).alias("minutes"))
        rest = told.where("a_goes IS NULL AND b_goes IS NULL").select("a", "b", "minutes")
        left = written(rest.unionByName(through).groupBy("a", "b").agg(F.min("minutes").alias("minutes")), "edges")
        out, rounds = up if out is None else out.unionByName(up), rounds + 1
    if out is None:
        out = left.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("minutes").alias("length"), F.lit(False).alias("back"))
    return written(out, "ups"), rounds


def hub_labels(ups: DataFrame, rounds: int) -> DataFrame:
    """(node, hub, length): each node's ways to itself and to all hubs by way of ups (node, hub, length), which are at most so many on end.

    Ways double with each join. A shortest way between two nodes leads from both
    up to a hub that they share, so lengths need no search.
    """
    own = ups.select("node").unionByName(ups.select(F.col("hub").alias("node"))).distinct().select("node", F.col("node").alias("hub"), F.lit(0).cast("long").alias("length"))
    labels = written(ups.select("node", "hub", "length").unionByName(own), "labels")
    for _ in range(rounds.bit_length()):
        further = labels.select(F.col("node").alias("hub"), F.col("hub").alias("further"), F.col("length").alias("more"))
        labels = written(labels.join(further, "hub").groupBy("node", F.col("further").alias("hub")).agg(F.min(F.col("length") + F.col("more")).alias("length")), "labels")
    return labels


def shortest_paths(edges: DataFrame, sources: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(source, node, length): the shortest ways from all sources (source) at once over directed edges (a, b, minutes).

    However many edges a way has, rounds grow with the logarithm of the graph
    (see contracted). Negative minutes are refused. If wanted (a, b) names the
    ends that matter, nodes farther from a source than its farthest end are left
    out; those on the ways to its ends are among the rows.
    """
    edges = written(edges.select("a", "b", "minutes"), "edges")
    if not edges.where("minutes < 0").isEmpty():
        raise ValueError("shortest paths need minutes that aren't negative")
    ups, rounds = contracted(edges)
    forth, back = (hub_labels(ups.where(F.col("back") == way), rounds) for way in (False, True))
    sources = written(sources.select("source").distinct(), "sources")
    # a way may lead to its hub without an edge on one side; then only the other has the node
    own = lambda c: sources.select(F.col("source").alias(c), F.col("source").alias("hub"), F.lit(0).cast("long").alias("length"))
    starts = written(sources.join(forth, F.col("source") == F.col("node")).select("source", "hub", F.col("length").alias("so_far")).unionByName(own("source").withColumnRenamed("length", "so_far")).distinct(), "starts")
    hubs = ups.select("node").unionByName(ups.select(F.col("hub").alias("node"))).distinct().select("node", F.col("node").alias("hub"), F.lit(0).cast("long").alias("length"))
    ends = back.unionByName(hubs).unionByName(own("node").select("node", "hub", "length")).distinct()
    if wanted is not None:
        # no bound for a source with an end that isn't reached
        asked = wanted.select(F.col("a").alias("source"), F.col("b").alias("node")).distinct()
        least = asked.join(starts, "source").join(ends, ["node", "hub"]).groupBy("source", "node").agg(F.min(F.col("so_far") + F.col("length")).alias("length"))
        far = written(least.groupBy("source").agg(F.max("length").alias("far")), "far")
        starts = starts.join(far, "source").where("so_far <= far")
        rows = starts.join(ends, "hub").withColumn("length", F.col("so_far") + F.col("length")).where("length <= far")
    else:
        rows = starts.join(ends, "hub").withColumn("length", F.col("so_far") + F.col("length"))
    return written(rows.groupBy("source", "node").agg(F.min("length").alias("length")), "lengths")


def snaps(calls: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(shape, seq, point): for each call of a shape (shape, seq, stop) one of its stop's candidates (stop, point, m), or null if it has none.

    The distances of the points and the lengths along the track, edges (a, b,
    m), between those of neighbours sum to the least. A stop's candidates, with
    the labels of their points, are kept once in files that tasks map, and
    lengths are found from the labels that two candidates share, where they are
    needed: neither a table of pairs of points nor a call with its candidates is
    made. Shapes are dealt by ranges of their stops, so that a task needs few
    stops again and again, and snaps equal ones once.
    """
    ups, rounds = contracted(track_graph(edges))
    # the graph is the same both ways
    labels = hub_labels(ups.where("NOT back"), rounds).groupBy(F.col("node").alias("point")).agg(F.collect_list(F.struct("hub", "length")).alias("hubs"))
    itself = F.array(F.struct(F.col("point").alias("hub"), F.lit(0).cast("long").alias("length")))
    known = candidates.join(labels, "point", "left").withColumn("hubs", F.coalesce("hubs", itself))
    of_stop = known.groupBy("stop").agg(F.array_sort(F.collect_list(F.struct("point", F.col("m").cast("double").alias("m"), "hubs"))).alias("cands"))
    of_stop = of_stop.select(F.col("stop").cast("long").alias("stop"), F.transform("cands", lambda c: c["point"]).alias("points"), F.transform("cands", lambda c: c["m"]).alias("ms"), F.transform("cands", lambda c: F.size(c["hubs"])).alias("sizes"), F.flatten(F.transform("cands", lambda c: c["hubs"]["hub"])).alias("hubs"), F.flatten(F.transform("cands", lambda c: c["hubs"]["length"])).alias("lengths"))
    paths = arrow_files(of_stop.repartition(CANDIDATE_FILES, "stop"), "candidates")
    in_order = F.array_sort(F.collect_list(F.struct("seq", "stop")))
    shapes = calls.groupBy("shape").agg(in_order.alias("calls")).select("shape", F.col("calls.stop").alias("stops"), F.col("calls.seq").alias("seqs"))
    return snapped(written(shapes, "shapes"), paths)


def best_snaps(snap: list[list[tuple[int | None, float]]], between: dict[tuple[int, int], float]) -> list[int | None]:
    """One candidate point for each stop of a sequence, so that snap distances and track lengths between them sum to the least.

    Two points that no track joins are as far apart as 1e9 metres.
    """
    order = lambda x: (x[0], x[1] is None, x[1] or 0)
    joined: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for (a, b), m in between.items():
        joined[b].append((a, m))
    cost: list[dict] = [dict(snap[0])]
    back: list[dict] = []
    for layer in snap[1:]:
        before = cost[-1]
        free = min(((c, a) for a, c in before.items()), key=order)
        apart = free if free[1] is None else min(((c + 1e9, a) for a, c in before.items()), key=order)
        came = {b: free if b is None else min([apart, *((before[a] + m, a) for a, m in joined[b] if a in before)], key=order) if b in joined else apart for b, _ in layer}
        cost.append({b: came[b][0] + d for b, d in layer})
        back.append({b: a for b, (_, a) in came.items()})
    node = min(cost[-1], key=lambda n: (cost[-1][n], n is None, n or 0))
    out = [node]
    for choice in reversed(back):
        node = choice[node]
        out.append(node)
    return out[::-1]


def lengths_between(layers: list[dict[int, list[tuple[int, int]]]]) -> dict[tuple[int, int], float]:
    """Metres between the points of neighbouring layers (hub: (point, length in millimetres) of each that has it), where a track joins them."""
    least: dict[tuple[int, int], int] = {}
    for before, after in zip(layers, layers[1:]):
        for hub in before.keys() & after.keys():
            for a, length in before[hub]:
                for b, more in after[hub]:
                    if length + more < least.get((a, b), 1 << 62):
                        least[a, b] = length + more
    return {k: v / 1000 for k, v in least.items()}


class Candidates:
    """The candidates of stops, looked up in mapped Arrow files (stop, points, ms, sizes, hubs, lengths); where each stop stands is held."""

    def __init__(self, paths: list[str]):
        files = [pa.ipc.open_file(pa.memory_map(path)) for path in paths]
        self.batches = [f.get_batch(i) for f in files for i in range(f.num_record_batches)]
        stops = [b.column("stop").to_numpy() for b in self.batches]
        each = np.concatenate([np.empty(0, np.int64), *stops])
        order = np.argsort(each, kind="stable")
        self.stops = each[order]
        self.batch = np.repeat(np.arange(len(stops)), [len(x) for x in stops])[order]
        self.row = np.concatenate([np.empty(0, np.int64), *(np.arange(len(x)) for x in stops)])[order]
        self.of = lru_cache(HELD_STOPS)(self.find)

    def find(self, stop: int) -> tuple[list[tuple[int | None, float]], dict[int, list[tuple[int, int]]]]:
        """The points with their snap distances, one that is None if there is none; and the points that have a way to each hub."""
        i = np.searchsorted(self.stops, stop)
        if i == len(self.stops) or self.stops[i] != stop:
            return [(None, 0.0)], {}
        batch, row = self.batches[self.batch[i]], int(self.row[i])
        points, ms, sizes, hubs, lengths = (batch.column(c)[row].values.to_pylist() for c in ("points", "ms", "sizes", "hubs", "lengths"))
        at = defaultdict(list)
        for p, hub, length in zip((p for p, n in zip(points, sizes, strict=True) for _ in range(n)), hubs, lengths, strict=True):
            at[hub].append((p, length))
        return list(zip(points, ms, strict=True)), dict(at)


def snapped(shapes: DataFrame, paths: list[str]) -> DataFrame:
    """(shape, seq, point): chosen points of shapes (shape, stops, seqs) from the candidates in files at paths; a few shapes are held at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Candidates(paths)
        stops, chosen = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, HELD_SHAPES):
                shape, seq, point = [], [], []
                for r in batch.slice(start, HELD_SHAPES).to_pylist():
                    if r["stops"] != stops:
                        stops = r["stops"]
                        layers = [known.of(s) for s in stops]
                        chosen = best_snaps([x for x, _ in layers], lengths_between([x for _, x in layers]))
                    shape += [r["shape"]] * len(chosen)
                    seq += r["seqs"]
                    point += chosen
                yield pa.RecordBatch.from_arrays([pa.array(shape, pa.string()), pa.array(seq, pa.int64()), pa.array(point, pa.int64())], ["shape", "seq", "point"])

    tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shapes.repartitionByRange(tasks, "stops", "shape").sortWithinPartitions("stops")
    return dealt.mapInArrow(each, "shape string, seq long, point long")


def fresh_shapes(points: DataFrame, least_new: float = 0.12) -> DataFrame:
    """(network, shape): the shapes of each network, longest first, less those whose points are nearly all on shapes kept before.

    points: (network, shape, seq, lat, lon); points are compared to three
    decimals. A point that no other shape of its network has is new whatever is
    kept, so shapes of enough such points are kept at once, and only points of
    several shapes take part in what follows. There the choice is one after the
    other, but need not be made so: of a point it is known which shape is the
    first that is kept there, and which the first that isn't decided. In each
    round a shape is kept if enough of its points are on neither of an earlier
    rank, and left out if too many are on kept ones of an earlier rank. The
    first of those undecided always is one or the other, and copies of a kept
    shape go all at once, so rounds are few.
    """
    place = lambda c: F.rint(F.col(c) * 1000).cast("long")
    enough = lambda c: c >= F.lit(least_new) * F.col("size")
    own = points.select("network", "shape", place("lat").alias("y"), place("lon").alias("x")).repartition("network", "shape").groupBy("network", "shape", "y", "x").agg(F.count("*").alias("n"))
    own = written(own.withColumn("size", F.sum("n").over(Window.partitionBy("network", "shape"))), "points")
    sizes = own.select("network", "shape", "size").distinct()
    shared = own.withColumn("holders", F.count("*").over(Window.partitionBy("network", "y", "x"))).where("holders > 1 OR y IS NULL OR x IS NULL")
    shared = written(shared.withColumn("rank", F.struct((-F.col("size")).alias("longest"), "shape")).drop("holders"), "points-shared")
    tied = shared.groupBy("network", "shape").agg(F.sum("n").alias("tied"))
    alone = F.col("size") - F.coalesce("tied", F.lit(0))
    told = written(sizes.join(tied, ["network", "shape"], "left").select("network", "shape", enough(alone).alias("fresh"), F.col("tied").isNotNull().alias("meets")), "state")
    # networks in which some are undecided, with those of their shapes that others meet
    undecided = written(told.where("NOT fresh").select("network").distinct(), "undecided")
    state = written(told.where("meets").join(undecided, "network", "left_semi").select("network", "shape", F.when(F.col("fresh"), "kept").otherwise("open").alias("state"), "fresh"), "state-0")
    while not state.where("state = 'open'").isEmpty():
        rows = shared.join(state, ["network", "shape"])
        first = lambda which: F.min(F.when(F.col("state") == which, F.col("rank")))
        held = rows.groupBy("network", "y", "x").agg(first("kept").alias("kept"), first("open").alias("open"))
        free = lambda c: F.coalesce(F.col(c) >= F.col("rank"), F.lit(True))
        # points of others are taken off the size; left joined, as those of no place are on no shape's
        off = lambda here: F.first("size") - F.sum(F.when(F.col("held") & here, 0).otherwise(F.col("n")))
        found = rows.where("state = 'open'").join(held.withColumn("held", F.lit(True)), ["network", "y", "x"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
        found = found.groupBy("network", "shape").agg(off(free("kept") & free("open")).alias("least"), off(free("kept")).alias("most"), F.first("size").alias("size"))
        decided = found.select("network", "shape", F.when(enough(F.col("least")), "kept").when(~enough(F.col("most")), "left out").otherwise("open").alias("now"))
        state = written(state.join(decided, ["network", "shape"], "left").select("network", "shape", F.coalesce("now", "state").alias("state"), "fresh"), "state")
    return told.where("fresh").select("network", "shape").unionByName(state.where("state = 'kept' AND NOT fresh").select("network", "shape"))
