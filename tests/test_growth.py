"""What lets queries grow with their tables: plans without needless shuffles or sorts of packed tables, and the rows they give."""

import random

import duckdb
import pytest
from compare import same

from wayfold.operators import geometry, routing, timetable, validation
from wayfold.plans import compile_queries, network
from wayfold.plans.catalog import ORACLE_SQL, QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_shapes_are_checked_where_their_calls_are_dealt(spark, sf_dir):
    # calls and points by trip, and points by the names of their shapes; no table of calls on the way
    df = QUERIES["shape_checks"](spark, sf_dir)
    assert exchanges(df) <= 3 and "lineitem" in plan(df)


def test_shape_ends_of_all_kinds(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 1.0)], "stop long, lat double, lon double")
    calls = spark.createDataFrame([(10, 1, 1), (10, 2, 2), (11, 1, 1), (12, 1, 1), (12, 2, 3), (13, 1, 99)], "shape long, seq long, stop long")
    points = spark.createDataFrame([(10, 1, 0.0, 0.0), (10, 2, 0.0, 1.0), (12, 1, 0.0, 0.0), (12, 2, 0.5, 0.5), (13, 1, 5.0, 5.0), (14, 1, 0.0, 0.0)], "shape long, seq long, lat double, lon double")
    found = sorted(r.problem for r in validation.shape_ends(points, calls, places).collect())
    assert found == ["ends away 12", "missing 11", "unused 14"]


def test_written_calls_are_dealt_by_shape(spark, sf_dir):
    text = plan(QUERIES["shape_stop_checks"](spark, sf_dir))
    # no grouping lies right on the written table
    assert "REPARTITION_BY_NUM" in text and "Exchange hashpartitioning(shape" in text and text.count("REPARTITION_BY_NUM") >= 2


def test_report_sorts_no_whole_table(spark):
    found = spark.createDataFrame([("a", f"p{i:03d}") for i in range(40)] + [("b", "z"), ("b", "y"), ("b", None)], "check string, problem string")
    df = validation.report(found)
    assert {(r.check, r.n): r.listed for r in df.collect()} == {("a", 40): "; ".join(f"p{i:03d}" for i in range(15)), ("b", 3): "y; z"}
    assert "Window" not in plan(df) and "TakeOrderedAndProject" in plan(df)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_days_are_not_stored(spark, monkeypatch, broadcast):
    """Trips that run on two days give the fronts of trips stored twice, also where a late trip is overtaken by the next day's first."""
    monkeypatch.setattr(routing, "BROADCAST_LABELS", broadcast)
    random.seed(5)
    rows = [(1, 0, 1, 1400, 1400), (1, 1, 2, 1500, 1500), (1, 2, 3, 2900, 2900), (2, 0, 1, 5, 5), (2, 1, 2, 61, 61), (2, 2, 3, 90, 90)]
    for trip in range(3, 40):
        at = random.randrange(1440)
        for seq, stop in enumerate(random.choice([(0, 3, 4), (4, 5, 2), (3, 1, 5), (5, 0)]), 1):
            rows.append((trip, stop, seq, at, at + 1))
            at += random.randint(2, 30)
    day = spark.createDataFrame(rows, "trip long, stop long, seq long, arr long, dep long")
    walks = spark.createDataFrame([(0, 1, 7), (1, 0, 7), (2, 5, 3), (5, 2, 3)], "a long, b long, minutes long")
    requests = spark.createDataFrame([(q, q % 6, (q * 5 + 2) % 6, (q * 173) % 1440) for q in range(60)], "q long, src long, dst long, t0 long")
    fronts = lambda labels: sorted((r.q, r.k, r.arrival) for r in routing.front(requests, labels).collect())
    both = network.next_day(day)
    assert fronts(routing.labels(requests, day, walks, 2, days=2)) == fronts(routing.labels(requests, both, walks, 2))
    want = fronts(routing.labels(requests, both, walks, 1))
    assert want and sorted((r.q, r.k, r.arrival) for r in routing.one_ride_front(requests, day, walks, days=2).collect()) == want


def test_a_round_meets_the_timetable_once(spark, sf_dir, monkeypatch):
    plans = {}

    def record(df, name, written=routing.written):
        plans[name] = plan(df)
        return written(df, name)

    monkeypatch.setattr(routing, "written", record)
    QUERIES["round1_labels"](spark, sf_dir)
    # the routes as they are, and those that were split
    met = [line for name, text in plans.items() if not name.startswith("routes") for line in text.splitlines() if "FileScan" in line and "deps" in line]
    assert len(met) == 2


def test_only_the_wanted_trips_are_dealt(spark, sf_dir):
    whole = network.day_times(spark, sf_dir)
    wanted = whole.select("trip").distinct().where("trip % 50 = 7")
    df = network.day_times(spark, sf_dir, spark.createDataFrame([r.trip for r in wanted.collect()], "long").withColumnRenamed("value", "trip"))
    text = plan(df)
    assert text.index("LeftSemi") > text.rindex("Window")
    assert sorted(df.collect()) == sorted(whole.where("trip % 50 = 7").collect()) != []


def test_trains_are_dealt_once(spark, sf_dir):
    # all of a train's steps where its calls are, no join back of their minutes
    df = QUERIES["compiled_calls"](spark, sf_dir)
    assert exchanges(df) == 1 and "SortMergeJoin" not in plan(df)
    by_trip = [line for line in plan(QUERIES["compiled_trips"](spark, sf_dir)).splitlines() if "Exchange hashpartitioning(trip#" in line]
    assert len(by_trip) == 1
    assert "Exchange hashpartitioning(stop" not in "".join(line for line in plan(QUERIES["trip_routes"](spark, sf_dir)).splitlines() if "seq" in line)


def test_a_stop_of_two_branches_counts_for_the_first(spark):
    calls = spark.createDataFrame([("t", "west_up", 1, 5), ("t", "west_up", 2, 4), ("t", "west_up", 3, 6), ("u", "west_dn", 1, 9)], "trip string, source string, seq long, stop long")
    branches = spark.createDataFrame([(2, "B2", 4), (2, "B2", 5), (1, "B1", 5), (1, "B1", 6)], "ord long, route string, stop long")
    rows = {r.trip: (r.route, r.shared, r.n_calls) for r in timetable.filed_trips(calls, branches, spark.createDataFrame([("west", "R_W")], "family string, route string")).collect()}
    assert rows == {"t": ("B1", "5 6", 3), "u": ("R_W", "", 1)}


def test_legs_meet_their_shapes_where_they_lie(spark, sf_dir):
    df = QUERIES["leg_lines"](spark, sf_dir)
    lines = [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]
    assert lines and all("hashpartitioning(trip#" in line for line in lines) and len(lines) <= 2


def test_shapes_of_own_points_take_no_round(spark, monkeypatch):
    names = []

    def record(df, name, written=geometry.written):
        names.append(name)
        return written(df, name)

    monkeypatch.setattr(geometry, "written", record)
    rows = [(n, f"s{k}", i, n + k / 10, i / 100) for n in range(3) for k in range(4) for i in range(5)]
    df = geometry.fresh_shapes(spark.createDataFrame(rows, "network long, shape string, seq long, lat double, lon double"))
    assert df.count() == 12 and names.count("state") == 1


def test_trips_are_drawn_and_filed_by_one_pass(spark, sf_dir, monkeypatch):
    plans = []

    def record(df, name, written=compile_queries.written):
        plans.append(plan(df))
        return written(df, name)

    monkeypatch.setattr(compile_queries, "written", record)
    made = compile_queries._local_source(spark, sf_dir)
    plans += [plan(df) for df in made.values()]
    assert sum("FileScan" in line and "l_orderkey" in line for text in plans for line in text.splitlines()) == 1
    assert made["stop_times"].count() == network.calls(spark, sf_dir).count()


def test_full_report_makes_the_timetable_once(spark, sf_dir, monkeypatch):
    made, plans = [], []
    for name in ("day_times", "calls"):
        monkeypatch.setattr(network, name, lambda *a, name=name, before=getattr(network, name), **k: made.append(name) or before(*a, **k))

    def record(df, name, written=compile_queries.written):
        plans.append(plan(df))
        return written(df, name)

    monkeypatch.setattr(compile_queries, "written", record)
    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert QUERIES["full_report"](spark, sf_dir).count() > 0
    assert made == ["day_times"] and len(spark.sparkContext._jsc.getPersistentRDDs()) == kept
    # trips' calls lie as dealt, so what passes by stops is told without a shuffle
    passing = [text for text in plans if "passes by" in text]
    assert len(passing) == 1 and "Exchange hashpartitioning(shape" not in passing[0] and "InMemoryTableScan" in passing[0]


def test_headways_of_equal_minutes(spark):
    random.seed(3)
    rows = [(k, random.randrange(4 * 1440)) for k in range(3) for _ in range(40)]
    rows += [(k, m) for k, m in rows if m % 3 == 0] + [(9, 100), (8, 500), (8, 500), (7, 485), (7, 500)]
    df = validation.headways(spark.createDataFrame(rows, "line long, minute long"), (480, 2000))
    got = {r.line: (r.first, r.last, r.n, r.longest, r.peak_mean) for r in df.collect()}
    want = {}
    for line in {k for k, _ in rows}:
        at = sorted(m for k, m in rows if k == line)
        gaps = [(a, b - a) for a, b in zip(at, at[1:])]
        inside = [g for a, g in gaps if 480 <= a < 2000]
        want[line] = (at[0], at[-1], len(at), max((g for _, g in gaps), default=None), sum(inside) / len(inside) if inside else None)
    assert got == want
    # departures of a line's minute are put together before they are sorted
    assert plan(df).index("Window") < plan(df).rindex("partial_count(1)")


def test_orders_that_stand_twice(spark, sf_dir, tmp_path):
    for t in ("nation", "customer", "supplier", "lineitem", "orders"):
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        (rows.unionByName(rows.where("o_orderkey % 3 = 0")) if t == "orders" else rows).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("line_orders", "filed_lines"):
        same(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name])
