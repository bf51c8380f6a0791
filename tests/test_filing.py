"""Pieces of many sources to filed trips by plain Python, and the rules that end a job."""

import hashlib
from collections import defaultdict

import pytest

from wayfold.operators import analytics, geometry, routing, search, timetable
from wayfold.plans import filing_queries as fq
from wayfold.sources.shared import table


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def plain_trips(rows):
    """{trip: (source, [(stop, arr, dep)])} of rows (train, source, n, stop, minute), one timetable after the other."""
    trips = {}
    by_train = defaultdict(lambda: defaultdict(list))
    for train, source, n, stop, minute in rows:
        by_train[train][source].append((n, stop, minute))
    for train, sheets in by_train.items():
        found = []
        for source in fq.SOURCES:
            pieces, now = [], {}
            for _, stop, minute in sorted(sheets.get(source, [])):
                if stop in now:
                    pieces.append(now)
                    now = {}
                now[stop] = minute
            pieces += [now] if now else []
            for piece in pieces:
                best, target = 0, None
                for k, (other, trip) in enumerate(found):
                    if other != source and len(piece.keys() & trip.keys()) >= max(best, 1):
                        best, target = len(piece.keys() & trip.keys()), k
                if best > 1 or len(piece) == 1:
                    continue
                if target is None:
                    found.append((source, {s: (m, m) for s, m in piece.items()}))
                    continue
                trip = found[target][1]
                for s, m in piece.items():
                    trip[s] = (min(trip[s][0], m), max(trip[s][1], m)) if s in trip else (m, m)
        for k, (source, trip) in enumerate(found, 1):
            times = [t for pair in trip.values() for t in pair]
            late = max(times) // 60 - min(times) // 60 >= 18
            shifted = [(s, *(t + 1440 * (late and t < 720) for t in pair)) for s, pair in trip.items()]
            trips[train if k == 1 else f"{train}-{k}"] = (source, sorted(shifted, key=lambda c: c[1:]))
    return trips


@pytest.fixture(scope="module")
def expected(spark, sf_dir):
    lines = defaultdict(list)
    for r in table(spark, sf_dir, "lineitem").collect():
        lines[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_extendedprice, r.l_quantity))
    rows = [
        (str(order // fq.TRAIN_ORDERS), fq.SOURCES[order % len(fq.SOURCES)], n, item[2] % fq.TIMETABLE_STOPS, (order * 7919 + item[0] * 17 + item[1] % 12) % 1440)
        for order, items in lines.items() for n, item in enumerate(sorted(items), 1)
    ]
    return plain_trips(rows)


def test_calls_of_nine_timetables(spark, sf_dir, expected):
    got = defaultdict(list)
    for r in fq.compiled_calls(spark, sf_dir).orderBy("trip_id", "seq").collect():
        got[r.trip_id, r.source].append((r.stop, r.arr, r.dep))
    assert {trip: (source, calls) for (trip, source), calls in got.items()} == expected
    assert len({source for source, _ in expected.values()}) == len(fq.SOURCES)
    assert any("-" in trip for trip in expected) and any(a != d for _, calls in expected.values() for _, a, d in calls)


def test_filed_trips(spark, sf_dir, expected):
    nation = {r.s_suppkey: r.s_nationkey for r in table(spark, sf_dir, "supplier").collect()}
    branches = [(f"B{n}", {s % fq.TIMETABLE_STOPS for s, k in nation.items() if k == n}) for n in fq.BRANCH_NATIONS]
    want = {}
    for trip, (source, calls) in expected.items():
        stops = [c[0] for c in calls]
        route, shared = next(((r, sorted(b & set(stops))) for r, b in branches if b & set(stops)), (fq.FAMILIES[source.split("_")[0]], []))
        digest = hashlib.md5("_".join(map(str, stops)).encode()).hexdigest()[:4]
        want[trip] = (route, {"up": 0, "dn": 1}.get(source[-2:]), f"SHP_{route}_{stops[0]}_TO_{stops[-1]}_{digest}", " ".join(map(str, shared)), len(stops))
    assert {r[0]: tuple(r)[1:] for r in fq.compiled_trips(spark, sf_dir).collect()} == want


def test_pieces_by_priority(spark):
    rows = [("t", "b", 1, 1, 5), ("t", "b", 2, 2, 6), ("t", "b", 3, 1, 7), ("t", "a", 1, 1, 5), ("t", "unlisted", 1, 9, 5), ("u", "a", 1, 3, 1)]
    calls = frame(spark, rows, "train string, source string, n long, stop long, minute long")
    out = timetable.ordered_pieces(calls, frame(spark, [("a", 0), ("b", 1)], "source string, priority long"))
    assert sorted(map(tuple, out.collect())) == [("t", 1, "a", 1, 1, 5), ("t", 2, "b", 1, 1, 5), ("t", 2, "b", 2, 2, 6), ("t", 3, "b", 3, 1, 7), ("u", 1, "a", 1, 3, 1)]


def test_calls_in_order_of_time(spark):
    rows = [(1, 1, 10, 60, 61), (1, 2, 11, 1380, 1380), (1, 3, 12, 60, 60), (2, 1, 10, 5, 5), (2, 2, 11, 5, 5)]
    got = sorted(map(tuple, timetable.chronological(frame(spark, rows, "trip long, n long, stop long, arr long, dep long")).collect()))
    assert got == [(1, 1, 11, 1380, 1380), (1, 2, 12, 1500, 1500), (1, 3, 10, 1500, 1501), (2, 1, 10, 5, 5), (2, 2, 11, 5, 5)]


def test_what_filing_refuses(spark):
    stops = frame(spark, [(1,), (2,)], "stop long")
    branches = frame(spark, [(0, "B", [1, 3])], "ord int, route string, stops array<long>")
    with pytest.raises(Exception, match="unknown stop of branch B 3"):
        timetable.known_branches(branches, stops).collect()
    none = timetable.known_branches(branches.limit(0), stops)
    calls = frame(spark, [(7, "north", 1, 1), (7, "north", 2, 2)], "trip long, source string, seq long, stop long")
    families = frame(spark, [("south", "S")], "family string, route string")
    with pytest.raises(Exception, match="no route for trains of north"):
        timetable.filed_trips(calls, none, families).collect()
    # a branch needs no family
    one = frame(spark, [(0, "B", 1), (1, "C", 2)], "ord int, route string, stop long")
    assert [tuple(r)[:3] + (r.shared,) for r in timetable.filed_trips(calls, one, families).collect()] == [(7, "B", None, "1")]
    assert timetable.filed_trips(calls.limit(0), one, families).collect() == []


def test_stations_off_the_track(spark):
    nodes = frame(spark, [(5, 19.0, 72.8), (4, 19.0, 72.8), (9, 19.01, 72.8)], "node long, lat double, lon double")
    near = frame(spark, [(1, 19.001, 72.8), (2, 19.0, 72.8)], "station long, lat double, lon double")
    assert sorted((r.station, r.node, round(r.m)) for r in geometry.on_track(near, nodes).collect()) == [(1, 4, 111), (2, 4, 0)]
    far = near.union(frame(spark, [(3, 19.004, 72.8)], near.schema))
    with pytest.raises(Exception, match="no track within 250 metres of station 3"):
        geometry.on_track(far, nodes).collect()


def test_first_departures(spark):
    probes = frame(spark, [(1, 5, "a"), (1, 5, "b"), (1, 9, "c"), (2, 0, "d"), (None, 1, "e")], "stop long, at long, who string")
    departures = frame(spark, [(1, 5), (1, 5), (1, 7), (1, None), (3, 1)], "stop long, at long")
    got = {r.who: r.next_dep for r in routing.next_departures(probes, departures).collect()}
    assert got == {"a": 5, "b": 5, "c": None, "d": None, "e": None}


def test_station_records(spark):
    stops = frame(spark, [("A", "a", 1.0, 2.0, "LOCAL", ""), ("B", "b", 1.0, 2.0, "METRO", "M"), ("C", None, None, None, None, None)], "id string, name string, lat double, lon double, mode string, line string")
    calls = frame(spark, [(1, "A"), (2, "A"), (2, "A"), (3, "A"), (4, "B"), (9, "B"), (None, "B")], "trip long, stop string")
    trips = frame(spark, [(1, "z"), (2, "b"), (3, "b"), (4, None), (None, "q")], "trip long, route string")
    got = {r.id: (r.line, r.lines) for r in search.station_records(stops, calls, trips).collect()}
    assert got == {"A": (None, ["b", "z"]), "B": ("M", []), "C": (None, [])}


def test_summaries(spark):
    rows = [
        (1, 1, 1, True, 0, 4, None), (2, 1, 1, False, 0, 9, "Red"), (3, 1, 1, False, 0, 9, "Red"), (3, 1, 2, True, 9, 21, None), (3, 1, 3, False, 30, 31, None),
    ]
    legs = frame(spark, rows, "q long, journey long, leg long, is_walk boolean, dep long, arr long, line_name string")
    got = {r.q: (r.summary, r.strip) for r in analytics.journey_texts(legs).collect()}
    assert got == {
        1: ("Walk only · 320 m", "walk 4 minutes"),
        2: ("Direct", "Red 9 minutes"),
        3: ("1 change · 1.0 km walk", "Red 9 minutes, walk 12 minutes, train 1 minutes"),
    }


def test_last_trip_of_a_shape(spark):
    trips = frame(spark, [(1, "s", "a"), (2, "s", "b"), (3, "t", "a"), (4, "t", None), (5, None, "x")], "n long, shape string, route string")
    assert sorted(map(tuple, timetable.shape_routes(trips).collect())) == [("s", "b"), ("t", None)]
