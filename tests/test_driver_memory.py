"""What the driver holds of a job: scans of a plan, however many rounds there were, and tables sent to all."""

import pytest

from wayfold.operators import geometry, routing
from wayfold.plans.catalog import QUERIES
from wayfold.sources import shared


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_rounds_and_steps_are_one_scan(spark):
    # four lines on end, each three stops
    rows = [(t, 2 * t + i, i + 1, 100 * t + 10 * i, 100 * t + 10 * i) for t in range(4) for i in range(3)]
    times = spark.createDataFrame(rows, "trip long, stop long, seq long, arr long, dep long")
    walks = spark.createDataFrame([(8, 9, 3), (9, 10, 3)], "a long, b long, minutes long")
    requests = spark.createDataFrame([(0, 0, 9, 0), (1, 3, 3, 0)], "q long, src long, dst long, t0 long")
    labels = routing.labels(requests, times, walks)
    legs = routing.legs(requests, labels, times)
    assert scans(labels) == 1 and scans(legs) == 1 and scans(routing.packed(times)) == 1
    got = [(r.journey, r.leg, r.from_stop, r.to_stop, r.trip, r.is_walk, r.dep, r.arr) for r in legs.orderBy("journey", "leg").collect()]
    assert got == [(4, t + 1, 2 * t, 2 * t + 2, t, False, 100 * t, 100 * t + 20) for t in range(4)] + [(4, 5, 8, 9, None, True, 320, 323)]
    broken = legs.withColumn("dep", legs.dep - 1)
    found = {r.rule: r.violations for r in routing.leg_violations(requests, broken, times, walks).collect()}
    assert found == {"printed times": 4, "footpath time": 1, "connection": 1, "two walks": 0, "early start": 1, "wrong end": 0}


def test_departures_by_headways_are_not_sent_to_all(spark, sf_dir):
    # an explode makes a table large that looks small
    plan = QUERIES["metro_facts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Window" in plan


def test_calls_are_snapped_without_their_candidates(spark, monkeypatch):
    calls = spark.createDataFrame([(k, i, s) for k in "abc" for i, s in enumerate([1, 2, 9] if k < "c" else [2, 1])], "shape string, seq long, stop long")
    near = spark.createDataFrame([(1, 10, 1.0), (1, 11, 5.0), (2, 12, 3.0), (2, 13, 1.0)], "stop long, point long, m double")
    snaps = geometry.snaps(calls, near, spark.createDataFrame([(11, 12, 2.0), (12, 14, 7.0)], "a long, b long, m double"))
    plan = snaps._jdf.queryExecution().executedPlan().toString()
    # points 11 and 12 alone are joined; stop 9 has no candidate
    assert sorted(map(tuple, snaps.collect()), key=str) == sorted([("a", 0, 11), ("a", 1, 12), ("a", 2, None), ("b", 0, 11), ("b", 1, 12), ("b", 2, None), ("c", 0, 12), ("c", 1, 11)], key=str)
    assert "hub" not in plan and "cands" not in plan and "Join" not in plan and plan.count("Exchange ") == 1
    monkeypatch.setattr(shared, "shared_folder", lambda _: "hdfs://nowhere/shared")
    with pytest.raises(ValueError):
        shared.arrow_files(calls, "files")
