"""Sources, sinks, the request stream and small functions."""

import itertools

from pyspark.sql import functions as F

from wayfold.functions import text, timefn
from wayfold.operators import geometry, search
from wayfold.sources import gtfs
from wayfold.streaming import requests


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "routes.txt").write_text('route_type,route_id,route_long_name\r\n1,M1,"Blue, the ""first"""\r\n\r\n12,MONO,Mono\r\n')
    rows = {r.route_id: r for r in gtfs.read_table(spark, str(tmp_path), "routes").collect()}
    assert rows["M1"].route_long_name == 'Blue, the "first"' and rows["M1"].route_type == 1 and rows["MONO"].agency_id == ""
    assert gtfs.read_table(spark, str(tmp_path), "trips").count() == 0
    gtfs.write_table(gtfs.read_table(spark, str(tmp_path), "routes"), str(tmp_path / "out" / "routes.txt"))
    again = {r.route_id: r for r in gtfs.read_table(spark, str(tmp_path / "out"), "routes").collect()}
    assert again == rows


def test_json_and_kml(spark, tmp_path):
    (tmp_path / "stations.json").write_text('{"Alder": {"raw_names": ["ALDER", "Alder W"], "lat": 19.0, "lon": 72.8}, "Marsh": {"raw_names": [], "lat": 19.1, "lon": 72.9}}')
    assert {(r.name, len(r.raw_names)) for r in gtfs.read_stations(spark, str(tmp_path / "stations.json")).collect()} == {("Alder", 2), ("Marsh", 0)}
    (tmp_path / "walks.json").write_text('{"A|B": {"meters": 100, "walk_minutes": 1.5}}')
    cached = gtfs.read_walks(spark, str(tmp_path / "walks.json"))
    assert [tuple(r) for r in cached.collect()] == [("A", "B", 100, 1.5)]
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "a string, b string")
    assert [tuple(r) for r in gtfs.missing_walks(pairs, cached).collect()] == [("A", "C")]
    (tmp_path / "lines.json").write_text('{"lines": [{"id": "M1", "active": false}, {"id": "M2", "headway_minutes": [["05:00", "24:00", 3.5]]}]}')
    assert [r.id for r in gtfs.read_lines(spark, str(tmp_path / "lines.json")).collect()] == ["M2"]
    (tmp_path / "t.kml").write_text("<kml><Placemark><name>L</name><LineString><coordinates> 72.8,19.0,0\n72.9,19.0 72.9,19.0 </coordinates></LineString></Placemark></kml>")
    points = gtfs.read_tracks(spark, str(tmp_path / "t.kml"))
    assert points.count() == 3
    edges = gtfs.track_edges(points).collect()
    assert len(edges) == 1 and 10_000 < edges[0].m < 11_000
    gtfs.write_geojson(geometry.geojson(points, "line", "seq"), str(tmp_path / "geo"))
    assert spark.read.text(str(tmp_path / "geo")).count() == 1


def test_request_lines(spark, tmp_path):
    times = spark.createDataFrame([(1, 1, 1, 100, 100), (1, 2, 2, 110, 110)], "trip long, stop long, seq long, arr long, dep long")
    walks = spark.createDataFrame([(2, 3, 4)], "a long, b long, minutes long")
    lines = ["x|1,3,90", "y|1,3,90", "z|1,2,99999", "no pipe at all", "w|,,", "|||", "v|1,1,5", "u|1,9,5", "t|A,B,C,D"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines) + "\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    requests.serve(stream, times, walks, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r.id: r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert '"arr_min":114' in got["x"] and got["x"].split("|", 1)[1] == got["y"].split("|", 1)[1]
    assert got["v"] == 'v|{"cached":false,"routes":[]}' and got["u"].endswith('"routes":[]}')
    assert all("bad request" in got[i] for i in ("z", "no pipe at all", "w", "", "t")) and len(got) == len(lines)


def test_requests_of_an_earlier_batch_are_answered_from_what_is_kept(spark, tmp_path, monkeypatch):
    times = spark.createDataFrame([(1, 1, 1, 100, 100), (1, 2, 2, 110, 110)], "trip long, stop long, seq long, arr long, dep long")
    walks = spark.createDataFrame([(2, 3, 4)], "a long, b long, minutes long")
    asked, real = [], requests.routing.labels

    def labels(once, *rest):
        asked.append(sorted((r.src, r.dst, r.t0) for r in once.collect()))
        return real(once, *rest)

    monkeypatch.setattr(requests.routing, "labels", labels)
    got = {}
    for number, lines in enumerate((["a|1,3,90", "b|1,2,80", "e|x,2,80"], ["c|1,3,90", "d|1,2,95", "f|x,2,80"], ["g|1,2,95", "h|1,3,90"])):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{number}.txt").write_text("\n".join(lines) + "\n")
        requests.serve(spark.readStream.text(str(folder)), times, walks, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        got |= {r.id: r.line.split("|", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("batch") == number).collect()}
    assert asked == [[(1, 2, 80), (1, 3, 90)], [(1, 2, 95)], []]
    assert got["a"].startswith('{"cached":false') and '"arr_min":114' in got["a"] and got["c"] == got["h"] == got["a"].replace('"cached":false', '"cached":true', 1)
    assert got["g"] == got["d"].replace('"cached":false', '"cached":true', 1) and "bad request" in got["e"] and got["e"] == got["f"]


def test_stations_are_ranked_as_unicode_sorts_them(spark):
    stations = [(1, "Élan Road", "LOCAL"), (2, "elan Park", "METRO"), (3, "Zoo Elan", "LOCAL"), (4, "Elan park", "LOCAL"), (5, "Elan Park", "METRO"), (6, "Elan Park", "LOCAL"), (7, "Eland", "LOCAL"), (8, "Azure elan", "METRO")]
    typed = spark.createDataFrame([("el",), ("zz",)], "raw string")
    rows = search.ranked_stations(spark.createDataFrame(stations, "id long, name string, mode string"), typed).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == [2, 4, 6, 5, 7, 8, 3]
    everything = search.ranked_stations(spark.createDataFrame(stations, "id long, name string, mode string"), spark.createDataFrame([("",)], "raw string")).collect()
    assert [r.id for r in sorted(everything, key=lambda r: r["rank"])] == [8, 2, 4, 6, 5, 1, 7, 3]


def test_texts(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(text.shape_id(F.lit("R"), F.array(F.lit("A"), F.lit("B")))) == "SHP_R_A_TO_B_d2f0"[:13] + value(F.substring(F.md5(F.lit("A_B")), 1, 4))
    assert value(text.destination(F.lit("SHP_R_A_TO_QUEEN'S_GATE_0af3"))) == "QUEEN'S_GATE"
    assert value(timefn.parse_minutes(F.lit("25:10:59"))) == 1510 and value(timefn.parse_minutes(F.lit("x"))) == 0
    assert value(timefn.clock(F.lit(-5))) == "23:55"


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(i, i + 1, 3) for i in range(40)] + [(100, 101, 1)], "a long, b long, minutes long")
    found = {r.node: r.component for r in geometry.track_components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    lengths = {r.node: r.length for r in geometry.shortest_paths(edges, spark.createDataFrame([(0,)], "source long")).collect()}
    assert lengths == {i: 3 * i for i in range(41)}


def test_snapping_against_all_choices():
    layers = [[(1, 5.0), (2, 1.0)], [(3, 2.0), (4, 0.5)], [(None, 0.0)], [(5, 1.0), (6, 9.0)]]
    between = {(1, 3): 1.0, (1, 4): 9.0, (2, 3): 4.0, (2, 4): 8.0}
    cost = lambda path: sum(d for _, d in path) + sum(between.get((a, b), 1e9) if a and b else 0 for (a, _), (b, _) in zip(path, path[1:]))
    best = min(itertools.product(*layers), key=cost)
    assert geometry.best_snaps(layers, between) == [p for p, _ in best]


def test_search_by_words(spark):
    names = spark.createDataFrame([("Queen's Gate",), ("Maple Road",), ("Road End",)], "n string")
    typed = spark.createDataFrame([("road",), ("QUEENS",), ("gat",), ("zzz",)], "raw string")
    got = {(r.raw, r["rank"]): r["name"] for r in search.suggestions(search.index(names, "n"), typed).collect()}
    assert got == {("road", 1): "Road End", ("road", 2): "Maple Road", ("QUEENS", 1): "Queen's Gate", ("gat", 1): "Queen's Gate"}


def test_request_faults(spark):
    from wayfold.operators.validation import request_faults

    asked = [("A", "B", "0480"), ("A", "B", "1439"), ("A", "B", "1440"), ("A", "B", "+480"), ("A", "B", " 480"), ("A", "B", "480\n"), ("A", "B", "00480"), ("A", "B", "\u0664"), ("A", "B", None), ("a", "B", "1"), ("A ", "B", "1"), (None, "B", "1"), ("A", "constructor", "1"), ("A", "", ""), ("A", "A", "0")]
    df = spark.createDataFrame(asked, "source string, target string, at string")
    keys = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "key string")
    faults = {(r.source, r.target, r["at"]): r.fault for r in request_faults(df, keys).collect()}
    assert [faults[a] for a in asked] == [None, None, "at", "at", "at", "at", "at", "at", "at", "source", "source", "source", "target", "target", None]
    assert request_faults(df.limit(0), keys).count() == 0
