"""Queries without SQL against plain Python, and readers of files."""

import itertools
import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_shortest_paths import dijkstra

from wayfold.functions import text, timefn
from wayfold.operators import analytics, geometry, timetable
from wayfold.plans import geometry_queries, network
from wayfold.plans.catalog import QUERIES
from wayfold.sources import gtfs


def metres(p, q):
    (a, b), (c, d) = ([math.radians(x) for x in z] for z in (p, q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture(scope="module")
def where(spark, sf_dir):
    return {r.stop: (r.lat, r.lon) for r in geometry_queries.places(spark, sf_dir).collect()}


def test_legs_as_lines(spark, sf_dir, where):
    trips = defaultdict(list)
    for r in network.day_times(spark, sf_dir).collect():
        trips[r.trip].append((r.seq, r.stop))
    want = {}
    for trip, calls in trips.items():
        calls = [(s, x) for s, x in sorted(calls) if x in where]
        line = [where[x] for _, x in calls]
        by_seq = dict(sorted(trips[trip]))
        for s, a in by_seq.items():
            if s + 1 not in by_seq or a not in where or by_seq[s + 1] not in where:
                continue
            p, q = where[a], where[by_seq[s + 1]]
            part = []
            if s % 4:
                near = lambda z, v: min(v, key=lambda k: ((line[k][0] - z[0]) ** 2 + (line[k][1] - z[1]) ** 2, k))
                i = near(p, range(len(line)))
                j = near(q, range(i, len(line)))
                if j <= i:
                    k = near(q, range(len(line)))
                    i, j = min(i, k), max(i, k)
                part = line[i : j + 1]
            want[f"{trip}-{s}"] = [p, *part, q]
    got = {r.leg: [(p.lat, p.lon) for p in r.positions] for r in QUERIES["leg_lines"](spark, sf_dir).collect()}
    assert got == want


def test_largest_part(spark, sf_dir, where):
    edges = [(r.a, r.b) for r in network.walks(spark, sf_dir).collect()]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    nodes = sorted(parent)
    for a in nodes:
        for b in nodes:
            if a < b and find(a) != find(b) and metres(where[a], where[b]) < geometry.BRIDGE_METRES:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(set)
    for x in nodes:
        groups[find(x)].add(x)
    want = min(groups.values(), key=lambda g: (-len(g), min(g)))
    assert {r.node for r in QUERIES["largest_part"](spark, sf_dir).collect()} == want


def test_paths_or_straight_lines(spark, sf_dir, where):
    edges = {(r.a, r.b): max(1, round(1000 * metres(where[r.a], where[r.b]))) for r in network.walks(spark, sf_dir).collect()}
    rows = QUERIES["path_or_line"](spark, sf_dir).collect()
    lengths = dijkstra([(a, b, m) for (a, b), m in edges.items()], {r.a for r in rows})
    assert rows and {r.straight for r in rows} == {(r.a, r.b) not in lengths for r in rows}
    for r in rows:
        assert abs(r.metres - (metres(where[r.a], where[r.b]) if r.straight else lengths[r.a, r.b] / 1000)) < 1e-6
        assert (r.nodes[0], r.nodes[-1]) == (r.a, r.b)
        assert r.straight or sum(edges[x] for x in zip(r.nodes, r.nodes[1:])) == lengths[r.a, r.b]


def track(seed, n=60):
    """A random track: a long chain, some loops, and a part of its own."""
    random.seed(seed)
    edges = [(i, i + 1, random.randint(1, 90) / 10) for i in range(n)] + [(random.randrange(n), random.randrange(n), random.randint(50, 400) / 10) for _ in range(12)]
    return edges + [(200, 201, 4.0), (201, 202, 1.5)]


def test_ways_along_a_track(spark):
    edges = track(4)
    random.seed(1)
    pairs = [(random.randrange(60), random.randrange(60)) for _ in range(25)] + [(5, 5), (200, 202), (202, 200), (3, 201), (0, 60), (777, 3)]
    got = {(r.a, r.b): r for r in geometry.track_paths(geometry.track_graph(spark.createDataFrame(edges, "a long, b long, m double")), spark.createDataFrame(pairs + pairs[:3], "a long, b long")).collect()}
    both = defaultdict(lambda: 10**9)
    for a, b, m in edges:
        if a != b:
            both[a, b] = both[b, a] = min(both[a, b], round(1000 * m))
    want = dijkstra([(a, b, m) for (a, b), m in both.items()], {a for a, _ in pairs})
    assert set(got) == {p for p in pairs if p in want}
    for (a, b), r in got.items():
        assert r.nodes[0] == a and r.nodes[-1] == b and round(r.m * 1000) == want[a, b] == sum(both[x] for x in zip(r.nodes, r.nodes[1:]))


def test_snaps_along_a_track_against_all_choices(spark):
    edges = track(7)
    both = [(a, b, round(1000 * m)) for a, b, m in edges if a != b]
    lengths = dijkstra(both + [(b, a, m) for a, b, m in both], set(range(61)) | {200, 201, 202})
    random.seed(3)
    cands = {s: [(random.choice([*range(61), 200, 202]), random.randint(0, 300) / 10) for _ in range(random.randint(1, 3))] for s in range(9)}
    cands = {s: sorted(dict(c).items()) for s, c in cands.items()} | {9: []}
    shapes = {f"s{i}": [random.randrange(10) for _ in range(random.randint(1, 5))] for i in range(30)} | {"twin": [1, 2, 3], "twin2": [1, 2, 3]}
    calls = [(k, 10 * i, s) for k, stops in shapes.items() for i, s in enumerate(stops)]
    df = geometry.snaps(spark.createDataFrame(calls, "shape string, seq long, stop long"), spark.createDataFrame([(s, p, m) for s, c in cands.items() for p, m in c], "stop long, point long, m double"), spark.createDataFrame(edges, "a long, b long, m double"))
    got = defaultdict(dict)
    for r in df.collect():
        got[r["shape"]][r.seq] = r.point
    assert set(got) == set(shapes) and got["twin"] == got["twin2"]
    between = lambda a, b: 0 if a is None or b is None else lengths[a, b] / 1000 if (a, b) in lengths else 1e9
    for k, stops in shapes.items():
        layers = [cands[s] or [(None, 0.0)] for s in stops]
        cost = lambda path: sum(m for _, m in path) + sum(between(a, b) for (a, _), (b, _) in zip(path, path[1:]))
        best = min(map(cost, itertools.product(*layers)))
        chosen = [(p, dict(layer)[p]) for layer, (_, p) in zip(layers, sorted(got[k].items()))]
        assert abs(cost(chosen) - best) < 1e-6


def test_fresh_shapes_against_loops(spark):
    random.seed(2)
    rows = [(n, f"s{s}", i, round(random.choice([0.001, 0.01]) * random.randint(0, 60), 4), 0.5) for n in range(3) for s in range(12) for i in range(random.randint(5, 30))]
    # a trunk that all lines of a network share, with branches, and copies of one line
    rows += [(3, f"t{s}", i, 0.001 * (i if i < 20 else 100 * s + i), 0.5) for s in range(15) for i in range(22 + s % 4)] + [(3, f"copy{c}", i, 0.001 * i, 0.5) for c in range(9) for i in range(25)]
    got = {(r.network, r["shape"]) for r in geometry.fresh_shapes(spark.createDataFrame(rows, "network long, shape string, seq long, lat double, lon double")).collect()}
    want = set()
    for n in range(4):
        points = defaultdict(list)
        for m, s, _, lat, lon in rows:
            if m == n:
                points[s].append((round(lat, 3), round(lon, 3)))
        seen = set()
        for s in sorted(points, key=lambda s: (-len(points[s]), s)):
            if sum(p not in seen for p in points[s]) >= 0.12 * len(points[s]):
                want.add((n, s))
                seen.update(points[s])
    assert got == want


def test_readers_of_json_and_grids(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"relation": 7, "name": "L", "stops": [{"name": "A", "lat": 1.0, "lon": 2.0}], "ways": [[[1.0, 2.0], [1.5, 2.5]]]}))
    (row,) = gtfs.read_map(spark, str(tmp_path / "map.json")).collect()
    assert (row.relation, row.stops[0].name, row.ways[0][1]) == (7, "A", [1.5, 2.5])
    (tmp_path / "inter.json").write_text(json.dumps({"interchanges": [{"a": "x", "b": "y", "meters": 300, "note": "n"}]}))
    assert [tuple(r) for r in gtfs.read_interchanges(spark, str(tmp_path / "inter.json")).collect()] == [("x", "y", 300, "n")]
    (tmp_path / "grid.csv").write_text('STATION,"DRD 93001\n12 CAR",VR\n,,93005\nVale,5:12,6:00\n')
    calls = timetable.unpivot(gtfs.read_grid(spark, str(tmp_path / "grid.csv"), "s")).collect()
    assert {(r.train_number, r.station, r.time) for r in calls} == {("93001", "Vale", "05:12"), ("93005", "Vale", "06:00")}
    walks = lambda rows: spark.createDataFrame(rows, "a string, b string, metres int")
    assert [tuple(r) for r in gtfs.merged_walks(walks([("b", "c", 5)]), walks([("b", "c", 9), ("a", "b", 1)])).collect()] == [("a", "b", 1), ("b", "c", 5)]


def test_grids_of_many_files_keep_their_rows_numbered(spark, tmp_path):
    grid = lambda k: f'STATION,"DRD {90000 + k}\n12 CAR"\n' + "".join(f"Stop {i},{i % 24}:{k:02d}\n" for i in range(40)) + '"Quoted, ""name""",5:00,6:00\n\n'
    for k in range(6):
        (tmp_path / f"sheet{k}.csv").write_text(grid(k))
    rows = gtfs.read_grid(spark, str(tmp_path)).collect()
    by_sheet = defaultdict(dict)
    for r in rows:
        by_sheet[r.sheet][r.row] = r
    assert set(by_sheet) == {f"sheet{k}" for k in range(6)}
    for k in range(6):
        own = by_sheet[f"sheet{k}"]
        assert sorted(own) == list(range(1, 44)) and own[42]["name"] == 'Quoted, "name"' and own[42].cells == ["5:00", "6:00"] and own[43]["name"] == ""
        assert all(own[i + 2]["name"] == f"Stop {i}" for i in range(40))
    calls = timetable.unpivot(gtfs.read_grid(spark, str(tmp_path / "sheet*.csv"))).collect()
    assert {(r.sheet, r.train_number) for r in calls} == {(f"sheet{k}", str(90000 + k)) for k in range(6)} and len(calls) == 6 * 41


def steps_of(first, last, bands):
    minute, out = float(first), []
    while minute < last:
        out.append(minute)
        minute += next(h for a, b, h in bands if a <= math.floor(minute) < b)
    return [*out, float(last)]


def test_headways_band_by_band(spark):
    bands = {"a": [(0, 300, 7.5), (300, 310, 30.0), (310, 600, 0.25), (600, 1440, 11.0)], "b": [(0, 1440, 2000.0)], "c": [(0, 1440, 1.5)]}
    ways = [("a", 0, 290, 1300), ("a", 1, 0, 1440), ("b", 0, 5, 600), ("c", 0, 0, 1440), ("c", 1, 700, 700)]
    rows = timetable.headway_departures(spark.createDataFrame(ways, "line string, dir int, first int, last int"), spark.createDataFrame([(k, *x) for k, v in bands.items() for x in v], "line string, start int, stop int, minutes double")).collect()
    for line, way, first, last in ways:
        assert sorted(r.minute for r in rows if (r.line, r.dir) == (line, way)) == steps_of(first, last, bands[line])


@pytest.mark.parametrize("bands", [[("a", 0, 100, 5.0), ("a", 120, 900, 5.0)], [("a", 0, 900, 0.0)], [("a", 0, 900, -3.0)]])
def test_headways_without_a_band_or_step_are_an_error(spark, bands):
    ways = spark.createDataFrame([("a", 0, 10, 800)], "line string, dir int, first int, last int")
    with pytest.raises(Exception, match="headway"):
        timetable.headway_departures(ways, spark.createDataFrame(bands, "line string, start int, stop int, minutes double")).collect()


def test_an_alias_of_two_stations_ends_the_job_that_uses_it(spark):
    stations = spark.createDataFrame([("A", ["Halt"]), ("B", ["halt "]), ("C", ["c", "Sea"])], "name string, raw_names array<string>")
    rows = lambda *names: timetable.resolve(spark.createDataFrame([(n,) for n in names], "station string"), stations).collect()
    assert {r.station: r["name"] for r in rows("sea", "b", "x")} == {"sea": "C", "b": "B", "x": None}
    with pytest.raises(Exception, match="alias of several stations"):
        rows("sea", "HALT")


def test_a_broken_file_is_an_error_and_a_missing_one_is_empty(spark, tmp_path):
    assert gtfs.read_table(spark, str(tmp_path), "stops").count() == 0


def test_duplicate_stations_of_a_line_are_an_error(spark):
    with pytest.raises(ValueError):
        timetable.unique_names(spark.createDataFrame([("l", "a"), ("l", "a"), ("m", "a")], "line string, name string"))


def test_clock_texts_and_ends_of_shapes(spark):
    rows = spark.createDataFrame([("07:05",), ("24:00",), ("7:05",), (None,)], "s string")
    assert [tuple(r) for r in rows.select(timefn.is_clock(F.col("s")), F.when(timefn.is_clock(F.col("s")), timefn.from_hhmm(F.col("s")))).collect()] == [(True, 425), (False, None), (False, None), (False, None)]
    shapes = spark.createDataFrame([("SHP_L_A_TO_B_C_0a1f",), ("SHP_L_A_TO_B_0a1f2",)], "s string")
    assert [r[0] for r in shapes.select(text.destination(F.col("s"))).collect()] == ["B_C", ""]


def test_legs_of_unknown_trips_are_local(spark):
    legs = spark.createDataFrame([(1, 0, 1, 5, 6, 9, False, 10, 20), (1, 0, 2, 6, 7, None, True, 20, 25)], "q long, journey long, leg long, from_stop long, to_stop long, trip long, is_walk boolean, dep long, arr long")
    trips = spark.createDataFrame([], "trip long, route_id string, line string, mode string")
    walks = spark.createDataFrame([(6, 7, 400)], "a long, b long, metres long")
    rows = sorted(analytics.with_trips(legs, trips, walks).collect(), key=lambda r: r.leg)
    assert [(r["mode"], r.walk_m, r.route_id) for r in rows] == [("LOCAL", 0, ""), ("WALK", 400, "")]
