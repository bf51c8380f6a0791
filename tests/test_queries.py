"""Every query with SQL gives the SQL's rows; the others are held against plain Python."""

import json
from collections import defaultdict

import pytest
from compare import connect, same

from wayfold.operators import routing, timetable
from wayfold.plans import network
from wayfold.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])


def test_front_against_a_definition(spark, sf_dir):
    times = defaultdict(list)
    for r in network.stop_times(spark, sf_dir).collect():
        times[r.trip].append((r.seq, r.stop, r.arr, r.dep))
    trips = [sorted(t) for t in times.values()]
    walks = defaultdict(list)
    for r in network.walks(spark, sf_dir).collect():
        walks[r.a].append((r.b, r.minutes))
    got = {(r.q, r.k): r.arrival for r in QUERIES["pareto_front"](spark, sf_dir).collect()}
    want = {}
    for r in network.requests(spark, sf_dir).collect():
        if r.src == r.dst:
            continue
        ride, foot = {}, {r.src: r.t0}
        for b, m in walks[r.src]:
            foot[b] = min(foot.get(b, 10**9), r.t0 + m)
        best = 10**9
        for k in range(routing.MAX_VEHICLES + 1):
            if k:
                ready = {s: min(ride.get(s, 10**9) + 5, foot.get(s, 10**9)) for s in {*ride, *foot}}
                new = dict(ride)
                for t in trips:
                    on = False
                    for _, s, arr, dep in t:
                        if on:
                            new[s] = min(new.get(s, 10**9), arr)
                        on = on or dep >= ready.get(s, 10**9)
                ride = new
                for a, at in ride.items():
                    for b, m in walks[a]:
                        foot[b] = min(foot.get(b, 10**9), at + m)
            arrival = min(ride.get(r.dst, 10**9), foot.get(r.dst, 10**9))
            if arrival < best:
                want[r.q, k] = best = arrival
    assert got == want


def test_journeys_fit_the_front(spark, sf_dir):
    front = {(r.q, r.k): r.arrival for r in QUERIES["pareto_front"](spark, sf_dir).collect()}
    legs = defaultdict(list)
    for r in QUERIES["journey_legs"](spark, sf_dir).collect():
        legs[r.q, r.journey].append(r)
    assert {k: max(x.arr for x in v) for k, v in legs.items()} == front
    assert all(sum(not x.is_walk for x in v) == k[1] for k, v in legs.items())
    described = QUERIES["journey_description"](spark, sf_dir).collect()
    for q in {r.q for r in described}:
        own = sorted((r for r in described if r.q == q), key=lambda r: r.journey)
        fastest = min(own, key=lambda r: (r.arrive, r.journey))
        near = [r for r in own if r.arrive <= fastest.arrive + max(30, (fastest.arrive - fastest.depart) / 2)]
        fewest = min(near, key=lambda r: r.journey)
        labels = lambda r: ", ".join(x for x, on in (("fastest", r is fastest), ("fewest changes", r is fewest), ("slower", r not in near)) if on)
        assert all(r.label == labels(r) for r in own)
    for r in QUERIES["journey_json"](spark, sf_dir).collect():
        body = json.loads(r.line.split("|", 1)[1])
        assert len(body["routes"]) == sum(q == r.q for q, _ in front)
        for leg in (x for j in body["routes"] for x in j):
            assert {"from", "to", "route_id", "line", "mode", "is_walk", "walk_m", "trip_id", "dep", "arr", "dep_min", "arr_min"} <= {*leg, *(["trip_id"] if leg["is_walk"] else [])}
            assert (leg["mode"] == "WALK" and leg["walk_m"] == 80 * (leg["arr_min"] - leg["dep_min"])) if leg["is_walk"] else (leg["route_id"].startswith("SHP_") and leg["line"] and leg["walk_m"] == 0)
    assert QUERIES["journey_steps"](spark, sf_dir).count() == sum(map(len, legs.values()))


def test_pieces_fold():
    a, b = "a", "b"
    assert timetable.fold_pieces([(a, [(1, 10), (2, 20), (3, 30)]), (b, [(2, 20), (3, 31), (4, 40)])]) == [(a, {1: (10, 10), 2: (20, 20), 3: (30, 30)})]
    assert timetable.fold_pieces([(a, [(1, 10), (2, 20)]), (b, [(2, 22), (3, 30)])]) == [(a, {1: (10, 10), 2: (20, 22), 3: (30, 30)})]
    assert timetable.fold_pieces([(a, [(1, 10)]), (a, [(1, 5), (2, 6)]), (a, [(2, 50), (1, 60)])]) == [(a, {1: (5, 5), 2: (6, 6)}), (a, {2: (50, 50), 1: (60, 60)})]


def test_assembled_trips_match_the_fold(spark, sf_dir):
    rows = QUERIES["assemble_pieces"](spark, sf_dir).collect()
    trips = defaultdict(list)
    for r in rows:
        trips[r.trip_id].append(r)
    assert rows
    for calls in trips.values():
        calls.sort(key=lambda r: r.seq)
        assert [r.seq for r in calls] == list(range(1, len(calls) + 1)) and len(calls) > 1
        assert all((x.arr, x.dep) <= (y.arr, y.dep) for x, y in zip(calls, calls[1:]))
        assert len({r.stop for r in calls}) == len(calls)


def test_routes_do_not_overtake(spark, sf_dir):
    routes = {r.trip: (r["shape"], r.route) for r in QUERIES["nonovertaking_routes"](spark, sf_dir).collect()}
    times = defaultdict(list)
    for r in network.day_times(spark, sf_dir).collect():
        times[r.trip].append((r.seq, r.arr, r.dep))
    groups = defaultdict(list)
    for trip, key in routes.items():
        groups[key].append(sorted(times[trip]))
    assert set(routes) == set(times)
    for members in groups.values():
        members.sort(key=lambda c: c[0][2])
        assert all(b[1] >= a[1] and b[2] >= a[2] for x, y in zip(members, members[1:]) for a, b in zip(x, y))


def test_rows_only_queries(spark, sf_dir):
    for name in ("geojson_features", "network_dedupe", "snap_viterbi", "shape_checks"):
        df = QUERIES[name](spark, sf_dir)
        assert df.columns and df.count() > 0
    for r in QUERIES["geojson_features"](spark, sf_dir).limit(5).collect():
        feature = json.loads(r.feature)
        assert feature["geometry"]["type"] == "LineString" and all(len(p) == 2 for p in feature["geometry"]["coordinates"])
