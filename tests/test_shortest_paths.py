"""Shortest paths against Dijkstra's, over more edges than a fixed number of rounds would take."""

import heapq
import random
from collections import defaultdict

import pytest

from wayfold.operators import geometry
from wayfold.plans import network
from wayfold.plans.catalog import QUERIES


def dijkstra(edges, sources):
    out, after = {}, defaultdict(list)
    for a, b, m in edges:
        after[a].append((b, m))
    for s in sources:
        heap = [(0, s)]
        while heap:
            length, node = heapq.heappop(heap)
            if (s, node) not in out:
                out[s, node] = length
                for b, m in after[node]:
                    heapq.heappush(heap, (length + m, b))
    return out


def paths(spark, edges, sources):
    df = geometry.shortest_paths(spark.createDataFrame(edges, "a long, b long, minutes long"), spark.createDataFrame([(s,) for s in sources], "source long"))
    rows = df.collect()
    out = {(r.source, r.node): r.length for r in rows}
    assert len(rows) == len(out)
    return out


def test_a_chain_longer_than_200_edges(spark):
    edges = [(i, i + 1, 1 + i % 3) for i in range(230)] + [(10, 150, 10_000), (7, 7, 0)]
    assert paths(spark, edges, [0, 220]) == dijkstra(edges, [0, 220])


def test_random_edges_and_a_hub(spark):
    random.seed(2)
    edges = [(random.randrange(60), random.randrange(60), random.randrange(30)) for _ in range(150)] + [(100, 101, 5)]
    edges += [(i, 60, 40) for i in range(60)] + [(60, i, 40) for i in range(60)]
    assert paths(spark, edges, [0, 5, 100, 999]) == dijkstra(edges, [0, 5, 100, 999])
    assert paths(spark, [], [1]) == {(1, 1): 0}
    with pytest.raises(ValueError):
        paths(spark, [(1, 2, -1)], [1])


def test_query(spark):
    folder = "/root/testdata/sf0.1"
    edges = [(r.a, r.b, r.minutes) for r in network.walks(spark, folder).collect()]
    rows = QUERIES["shortest_path_len"](spark, folder).collect()
    got = {(r.source, r.node): r.length for r in rows}
    assert len(got) == len(rows) and got == dijkstra(edges, {s for s, _ in got})
