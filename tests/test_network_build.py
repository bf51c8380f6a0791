"""One build of several sources: what is kept, and what goes for which reason."""

from wayfold.operators.network_build import build


def test_what_goes_and_why(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    stops = "stop_id string, stop_name string, lat double, lon double, mode string, line string"
    routes = "route_id string, agency_id string, short_name string, long_name string, route_type int, color string"
    trips, calls = "trip_id string, route_id string, direction int, shape_id string", "trip_id string, seq long, stop_id string, arr long, dep long"
    stop = lambda k, name="x": (k, name, 1.0, 2.0, "LOCAL", "")
    local = {
        "stops": frame([stop("A"), stop("B", "b"), stop("B", "a"), stop(""), stop(None), stop("C")], stops),
        "routes": frame([(r, "g", r, r, 2, "#000000") for r in ("R1", "R2", "R3")], routes),
        "trips": frame([("t1", "R1", 0, "s1"), ("t1", "R1", 1, "s1"), ("t2", "R2", 0, "s2"), ("t3", "R3", None, "s3")], trips),
        "stop_times": frame([("t1", 1, "A", 5, 5), ("t1", 2, "B", 9, 9), ("t1", 3, "Z", 9, 9), ("t2", 1, "", 1, 1), ("t9", 1, "A", 1, 1), (None, 1, "A", 1, 1), ("t9", 2, "Z", 1, 1)], calls),
        "shapes": frame([("s1", 1, 1.0, 2.0), ("s2", 1, 1.0, 2.0)], "shape_id string, seq long, lat double, lon double"),
        "transfers": frame([("A", "A", 60), ("A", "B", 60), ("A", "Q", 60), (None, "A", 60), ("M", "A", 90)], "a string, b string, seconds long"),
    }
    metro = {"stops": frame([stop("M")], stops), "routes": frame([("M1", "g", "m", "m", 1, "#000000")], routes), "trips": frame([("m", "M1", 0, "sm")], trips), "stop_times": frame([("m", 1, "M", 1, 1)], calls)}
    made = build(local, metro)
    rows = {name: sorted(tuple(r) for r in df.collect()) for name, df in made.tables.items()}
    assert [r[:2] for r in rows["stops"]] == [("A", "x"), ("B", "a"), ("C", "x"), ("M", "x")]
    assert [r[:3] for r in rows["stop_times"]] == [("m", 1, "M"), ("t1", 1, "A"), ("t1", 2, "B")]
    assert rows["trips"] == [("m", "M1", 0, "sm"), ("t1", "R1", 0, "s1")]
    assert [r[0] for r in rows["routes"]] == ["M1", "R1"] and [r[0] for r in rows["shapes"]] == ["s1"]
    assert rows["transfers"] == [("A", "B", 60), ("M", "A", 90)]
    assert made.dropped == {
        "stops": {"without_id": 2, "twice": 1}, "stop_times": {"unknown_trip": 3, "unknown_stop": 2}, "trips": {"twice": 1, "without_calls": 2},
        "routes": {"without_trips": 2}, "shapes": {"without_trips": 1}, "transfers": {"to_itself": 1, "unknown_end": 2},
    }


def test_an_empty_source(spark):
    made = build({k: spark.createDataFrame([], v) for k, v in {
        "stops": "stop_id string, stop_name string, lat double, lon double, mode string, line string", "routes": "route_id string, agency_id string, short_name string, long_name string, route_type int, color string",
        "trips": "trip_id string, route_id string, direction int, shape_id string", "stop_times": "trip_id string, seq long, stop_id string, arr long, dep long",
    }.items()})
    assert all(df.count() == 0 for df in made.tables.values()) and all(n == 0 for x in made.dropped.values() for n in x.values())
