"""Near pairs and nearest points against plain loops, and how their joins are dealt."""

import random

from test_compile import metres

from wayfold.operators import geometry
from wayfold.plans.catalog import QUERIES


def near(seed, n, step=0.0):
    """(number, lat, lon), several of one place."""
    random.seed(seed)
    spots = [(18.95 + random.random() * 0.02 + step, 72.85 + random.random() * 0.02) for _ in range(n)]
    return [(i, *spots[i % (n - 20)]) for i in range(n)]


def test_near_pairs_are_dealt_by_cell(spark):
    rows = near(1, 120)
    side = lambda k: spark.createDataFrame(rows, f"{k} long, {k}_lat double, {k}_lon double")
    for cells in (1, 2, 4):
        df = geometry.near_pairs(side("a"), side("b"), 300, cells)
        # a broadcast would leave all pairs to the tasks that read the left side: one for a small file
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.a, r.b) for r in df.collect()) == sorted((a, b) for a, *p in rows for b, *q in rows if metres(p, q) < 300)


def test_nearest_points_ring_by_ring(spark):
    stops, points = near(2, 80), [(i, random.choice([1, 2, 3, None]), lat, lon) for i, lat, lon in near(3, 90, 0.004)]
    want = {}
    for stop, *p in stops:
        best = {}
        for point, line, *q in points:
            m = metres(p, q)
            if m < geometry.SNAP_ANY:
                best[line] = min(best.get(line, (m, point)), (m, point))
        kept = {k: x for k, x in best.items() if x[0] <= geometry.SNAP_LINE} or dict([min(best.items(), key=lambda x: x[1])] if best else [])
        want |= {(stop, line): point for line, (_, point) in kept.items()}
    df = geometry.nearest(spark.createDataFrame(stops, "stop long, lat double, lon double"), spark.createDataFrame(points, "point long, line long, lat double, lon double"))
    rows = df.collect()
    assert {(r.stop, r.line): r.point for r in rows} == want and len(rows) == len(want)
    nodes = [(i, lat + 0.0006, lon) for i, lat, lon in stops]
    on = {r.station: r.node for r in geometry.on_track(spark.createDataFrame(stops, "station long, lat double, lon double"), spark.createDataFrame(nodes, "node long, lat double, lon double")).collect()}
    assert on == {s: min((metres(p, q), n) for n, *q in nodes)[1] for s, *p in stops}


def test_a_place_meets_only_the_spots_near_it(spark):
    grid = [(i, 18.9 + i // 60 * 0.0002, 72.8 + i % 60 * 0.0002) for i in range(3600)]
    asked = spark.createDataFrame([(i, lat, lon) for i, lat, lon in grid[::40]], "a long, a_lat double, a_lon double")
    df = geometry.nearest_of(asked, spark.createDataFrame([(i, lat + 0.00001, lon) for i, lat, lon in grid], "b long, b_lat double, b_lon double"), (25, 100, 401))
    assert {r.a: r.x.b for r in df.collect()} == {i: i for i, *_ in grid[::40]}


def test_lines_of_stops_are_numbers(spark, sf_dir):
    plan = QUERIES["unlinked_pairs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(line" not in plan


def test_a_long_chain_takes_few_rounds(spark):
    edges = [(i, i + 1, 1 + i % 3) for i in range(600)]
    _, rounds = geometry.contracted(spark.createDataFrame(edges, "a long, b long, minutes long"))
    # one edge a round would take 600, sixteen 38
    assert rounds <= 24
